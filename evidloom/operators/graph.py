"""Property-graph queries as joins: adjacency, degrees, scored search, bounded traversals, rendering.

Many questions run at once: every table of a query carries query_id. Depths are at most MAX_DEPTH, so traversals
are unrolled; each level is written out by the checkpoint the caller's session names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions import text as T
from evidloom.sources.tables import cut

MAX_DEPTH = 6
HUB_FLOOR = 50
#: Weights of an exact, a prefix and an inner match of a label, and of a match in the source's name. Fixed values.
EXACT, PREFIX, INNER, IN_SOURCE = 1000.0, 100.0, 1.0, 0.5
SEEDS, GAP = 3, 0.2
CHARS_PER_TOKEN = 3
#: Optional parameters of a question: more terms, terms left out, types of seeds, contexts of the edges shown.
LISTS = ("include_terms", "exclude_terms", "target_node_types", "context_filter")
#: Fixed texts of a result: without terms, without a match, and behind a text that has been cut.
NO_TERMS, NO_MATCH = "The question has no word to search for.", "No node holds a word of the question."
CUT = ("\n[", " nodes are left out to stay within ", " tokens: raise token_budget, or name context_filter, exclude_terms or target_node_types]")
#: The shortest line of a text, an edge without names, with its end.
LEAST_LINE = 13


def query_params(rows: DataFrame) -> DataFrame:
    """Raw parameters (query_id, question, mode, depth, token_budget, result_limit as strings) -> normalised: bfs unless dfs, depth 1..6 (3 by default), budget 100 at least (2000), limit above 0 or null; LISTS (string arrays, null or empty: none) stay where rows have them."""
    number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return rows.select(
        "query_id",
        F.coalesce("question", F.lit("")).alias("question"),
        F.when(F.lower("mode") == "dfs", "dfs").otherwise("bfs").alias("mode"),
        F.greatest(F.lit(1), F.least(F.lit(MAX_DEPTH), F.coalesce(number("depth"), F.lit(3)))).cast("long").alias("depth"),
        F.greatest(F.lit(100), F.coalesce(number("token_budget"), F.lit(2000))).cast("long").alias("token_budget"),
        F.when(number("result_limit") > 0, number("result_limit")).alias("result_limit"),
        *[F.col(c) for c in LISTS if c in rows.columns],
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges (source, target, ord) -> (u, v, ord): both directions, parallel edges and loops kept."""
    there = edges.select(F.col("source").alias("u"), F.col("target").alias("v"), "ord", F.lit(0).alias("side"))
    return there.unionByName(edges.select(F.col("target").alias("u"), F.col("source").alias("v"), "ord", F.lit(1).alias("side")))


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def hub_threshold(degree: DataFrame, floor: int = HUB_FLOOR) -> DataFrame:
    """One row: the degree at place floor(0.99 n) of the sorted degrees, `floor` at least. Degrees are counted by value, so what is sorted is their distinct values."""
    by_value = degree.groupBy("degree").agg(F.count("*").alias("n"))
    order = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    placed = by_value.select("degree", F.sum("n").over(order).alias("upto"))
    total = by_value.agg(F.sum("n").alias("total"))
    at = placed.join(F.broadcast(total), F.col("upto") > F.floor(F.col("total") * 0.99)).agg(F.min("degree").alias("p99"))
    return at.select(F.greatest(F.coalesce("p99", F.lit(0)), F.lit(floor)).cast("long").alias("threshold"))


def idf(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """Folded terms (query_id, term) and nodes (id, label) -> term, df, idf = ln(1 + N / (1 + df)), df counting folded labels that contain the term. Terms of questions are few and go to the nodes."""
    each = terms.select("term").distinct()
    n = nodes.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    held = nodes.select(T.folded(F.coalesce("label", F.lit(""))).alias("l")).join(F.broadcast(each), F.contains(F.col("l"), F.col("term")))
    df = held.groupBy("term").agg(F.count("*").alias("df")).withColumnRenamed("term", "t")
    out = each.join(df, F.col("term") == F.col("t"), "left").join(F.broadcast(n))
    return out.select("term", F.coalesce("df", F.lit(0)).alias("df"), F.log(1 + F.col("n") / (1 + F.coalesce("df", F.lit(0)))).alias("idf"))


def _match(label: Column, term: Column) -> Column:
    bare = T.bare_label(label)
    return F.when((label == term) | (bare == term), EXACT).when(label.startswith(term) | bare.startswith(term), PREFIX).when(F.contains(label, term), INNER).otherwise(0.0)


def score_nodes(terms: DataFrame, nodes: DataFrame, weights: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Folded terms (query_id, term; one that two words of a question fold to counts twice), nodes (id, label, node_type, source_file) and idf() -> query_id, id, label, score > 0."""
    wanted = nodes if types is None else nodes.where(F.col("node_type").isin(types))
    counted = terms.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighted = counted.join(weights.select(F.col("term").alias("t"), "idf"), F.col("term") == F.col("t")).select("query_id", "term", (F.col("idf") * F.col("times")).alias("idf"))
    own = wanted.select("id", "label", T.folded(F.coalesce("label", "id")).alias("l"), F.lower(F.coalesce("source_file", F.lit(""))).alias("s"))
    hit = own.join(F.broadcast(weighted), F.contains(F.col("l"), F.col("term")) | F.contains(F.col("s"), F.col("term")))
    part = (_match(F.col("l"), F.col("term")) + F.when(F.contains(F.col("s"), F.col("term")), IN_SOURCE).otherwise(0.0)) * F.col("idf")
    return hit.groupBy("query_id", "id", "label").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def rank(scored: DataFrame) -> DataFrame:
    """scored with `place`: by score, then the shorter label, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.char_length(F.coalesce("label", "id")), "id")
    return scored.withColumn("place", F.row_number().over(order).cast("long"))


def seeds(scored: DataFrame, most: int = SEEDS, gap: float = GAP) -> DataFrame:
    """The best nodes of a query: `most` at most, none under gap times the best."""
    best = scored.groupBy(F.col("query_id").alias("q")).agg(F.max("score").alias("top"))
    near = scored.join(best, F.col("query_id") == F.col("q")).where(F.col("score") >= gap * F.col("top")).drop("q", "top")
    return rank(near).where(F.col("place") <= most)


def bfs(starts: DataFrame, edges: DataFrame, hubs: DataFrame, depth: int, context: list[str] | None = None, limits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Starts (query_id, node), edges (source, target, ord, context), hubs (node) -> visited (query_id, node, level) and tree edges (query_id, u, v, ord), level by level.

    A hub that isn't a start is reached but not left. An edge is recorded for each entry from a node of a level to one not
    visited before it, parallel ones repeated. Limits (query_id, depth) stop a query before `depth`.
    """
    kept = edges if context is None else edges.where(F.col("context").isin(context))
    # Read once a level: made once.
    adj = cut(adjacency(kept).select("u", "v", "ord"))
    now, hubs = cut(starts.select("query_id", "node").distinct().withColumn("level", F.lit(0).cast("long"))), cut(hubs)
    visited, found = now, None
    for level in range(1, max(0, min(depth, MAX_DEPTH)) + 1):
        leaving = now.join(hubs.select(F.col("node").alias("h")), F.col("node") == F.col("h"), "left_anti") if level > 1 else now
        if limits is not None:
            leaving = leaving.join(F.broadcast(limits.where(F.col("depth") >= level).select(F.col("query_id").alias("lq"))), F.col("query_id") == F.col("lq"), "left_semi")
        steps = leaving.select("query_id", F.col("node").alias("u0")).join(adj, F.col("u0") == F.col("u")).select("query_id", "u", "v", "ord")
        seen = visited.select(F.col("query_id").alias("q"), F.col("node").alias("n"))
        new = cut(steps.join(seen, (F.col("query_id") == F.col("q")) & (F.col("v") == F.col("n")), "left_anti"))
        found = new if found is None else found.unionByName(new)
        now = new.select("query_id", F.col("v").alias("node")).distinct().withColumn("level", F.lit(level).cast("long"))
        visited = visited.unionByName(now)
    return visited, found


def dfs(starts: DataFrame, edges: DataFrame, hubs: DataFrame, depth: int) -> DataFrame:
    """Visited nodes (query_id, node, place) of a depth-first walk that takes the last neighbour first, by (ord, side), of equal ones the first by id.

    The order is that of a stack, found by joins. A node's key is its way: the start, then what orders each step. A stack takes
    ways by their keys, each before its continuations, and leaves a node once, so a node's key is the least that a step from the
    keys of visited nodes gives it. Keys are taken anew from the keys of the round before until none changes: they have one
    solution, and each of the first keys that is right stays right. Rounds are only over nodes that are left; others get their keys at the end.
    """
    first = F.min("place") if "place" in starts.columns else F.lit(0)
    roots = starts.where(F.lit(depth > 0)).groupBy("query_id", "node").agg(first.cast("long").alias("p"))
    roots = cut(roots.select("query_id", "node", _step(F.col("p"), F.lit(0), F.col("node")).alias("key")))
    near = _left_by(roots.select("query_id", "node"), edges, hubs, depth - 1)
    left = near.select(F.col("query_id").alias("lq"), F.col("u").alias("ln")).distinct()
    inner = cut(near.join(left, (F.col("query_id") == F.col("lq")) & (F.col("v") == F.col("ln")), "left_semi"))
    keys, before = cut(_keys(roots, roots, inner, depth)), roots
    while not (keys.subtract(before).isEmpty() and before.subtract(keys).isEmpty()):
        keys, before = cut(_keys(roots, keys, inner, depth)), keys
    return _places(cut(_keys(roots, keys, near, depth)))


def _step(ord: Column, side: Column, v: Column) -> Column:
    """A key of one step."""
    return F.array(F.struct(ord.alias("a"), side.cast("int").alias("b"), v.alias("c")))


def _left_by(starts: DataFrame, edges: DataFrame, hubs: DataFrame, depth: int) -> DataFrame:
    """Entries (query_id, u, v, ord, side) of the nodes that a walk may leave: those nearer than `depth`, hubs only as starts."""
    adj = cut(adjacency(edges).where("v IS NOT NULL").select("u", "v", F.coalesce("ord", F.lit(0)).cast("long").alias("ord"), "side"))
    hub = cut(hubs.select(F.col("node").alias("h")))
    now = seen = starts
    out = None
    for level in range(max(0, depth)):
        leaving = now.join(hub, F.col("node") == F.col("h"), "left_anti") if level else now
        steps = cut(leaving.select("query_id", F.col("node").alias("n")).join(adj, F.col("n") == F.col("u")).select("query_id", "u", "v", "ord", "side"))
        out = steps if out is None else out.unionByName(steps)
        old = seen.select(F.col("query_id").alias("q"), F.col("node").alias("o"))
        now = steps.select("query_id", F.col("v").alias("node")).distinct().join(old, (F.col("query_id") == F.col("q")) & (F.col("node") == F.col("o")), "left_anti")
        seen = seen.unionByName(now)
    return out if out is not None else starts.join(adj, F.col("node") == F.col("u")).where(F.lit(False)).select("query_id", "u", "v", "ord", "side")


def _keys(roots: DataFrame, keys: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """query_id, node, key: the least of a root's own key and of those that a step from `keys` gives."""
    given = keys.where(F.size("key") < depth).select(F.col("query_id").alias("q"), F.col("node").alias("n"), "key")
    steps = given.join(entries, (F.col("q") == F.col("query_id")) & (F.col("n") == F.col("u")))
    way = F.concat("key", _step(F.bitwise_not("ord"), -F.col("side"), F.col("v")))
    return roots.unionByName(steps.select("query_id", F.col("v").alias("node"), way.alias("key"))).groupBy("query_id", "node").agg(F.min("key").alias("key"))


def _places(found: DataFrame) -> DataFrame:
    """query_id, node, place: from 0 by key. Ranges of keys are numbered each by itself and moved on by what lies before."""
    ranged = cut(found.repartitionByRange("query_id", "key").withColumn("part", F.spark_partition_id()))
    counted = ranged.groupBy(F.col("query_id").alias("q"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("q").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    moved = counted.select("q", "p", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = ranged.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "part").orderBy("key")))
    return own.join(moved, (F.col("query_id") == F.col("q")) & (F.col("part") == F.col("p"))).select("query_id", "node", (F.col("ahead") + F.col("n") - 1).cast("long").alias("place"))


def _stack_walk(starts: DataFrame, edges: DataFrame, hubs: DataFrame, depth: int, limits: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, u, v, ord, place) of a depth-first walk: v null for a visited node, else an edge pushed, which may repeat or lead to no visited node.

    Its order is the order of a stack, so it is walked in Python, one task for a query, over the ball that bfs()
    bounds: a node at distance `depth` is never taken, so the ball has radius depth - 1. Starts are taken by place, if they have one, then by id.
    """
    near, _ = bfs(starts, edges, hubs, max(0, depth - 1), limits=None if limits is None else limits.withColumn("depth", F.col("depth") - 1))
    first = starts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(*[c for c in ("place",) if c in starts.columns], "node"))), lambda x: x["node"]).alias("starts"))
    own = first if limits is None else first.join(F.broadcast(limits.select("query_id", "depth")), "query_id")
    own = own.withColumn("most", F.least(F.lit(depth), F.col("depth") if limits is not None else F.lit(depth)).cast("long")).select(F.col("query_id").alias("q"), "starts", "most")
    ball = near.select("query_id", "node").distinct()
    rows = ball.join(adjacency(edges), F.col("node") == F.col("u"), "left").join(hubs.select(F.col("node").alias("h")), F.col("node") == F.col("h"), "left")
    rows = rows.join(own, F.col("query_id") == F.col("q")).select("query_id", "node", "v", F.coalesce("ord", F.lit(0)).cast("long").alias("ord"), F.coalesce("side", F.lit(0)).alias("side"), F.col("h").isNotNull().alias("hub"), "starts", "most")

    def walk(pdf):
        import pandas as pd

        roots, most = list(pdf["starts"].iloc[0]), int(pdf["most"].iloc[0])
        hub = set(pdf.loc[pdf["hub"], "node"])
        out: dict = {}
        for u, v, o, _ in sorted(pdf.loc[pdf["v"].notna(), ["node", "v", "ord", "side"]].itertuples(index=False, name=None), key=lambda x: x[2:]):
            out.setdefault(u, []).append((v, o))
        stack, seen, pushed = [(n, 0) for n in reversed(roots)], {}, []
        while stack:
            node, d = stack.pop()
            if node in seen or d >= most:
                continue
            seen[node] = len(seen)
            if node in hub and node not in roots:
                continue
            for v, o in out.get(node, []):
                if v not in seen:
                    stack.append((v, d + 1))
                    pushed.append((node, v, o, 0))
        rows = [(n, None, 0, place) for n, place in seen.items()] + pushed
        return pd.DataFrame(rows, columns=["u", "v", "ord", "place"]).assign(query_id=pdf["query_id"].iloc[0])[["query_id", "u", "v", "ord", "place"]]

    return rows.groupBy("query_id").applyInPandas(walk, f"query_id {starts.schema['query_id'].dataType.simpleString()}, u string, v string, ord bigint, place bigint")


def question_terms(params: DataFrame) -> DataFrame:
    """query_id, term: the terms of each question and its include_terms, each once but for exclude_terms, then folded and cut into words."""
    terms = T.query_terms(F.col("question"))
    own = F.array_compact(F.coalesce("include_terms", F.array().cast("array<string>"))) if "include_terms" in params.columns else F.array().cast("array<string>")
    left_out = F.array_compact(F.coalesce("exclude_terms", F.array().cast("array<string>"))) if "exclude_terms" in params.columns else F.array().cast("array<string>")
    every = F.array_except(F.array_union(terms, own), left_out)
    return params.select("query_id", F.explode(F.flatten(F.transform(every, T.folded_words))).alias("term"))


def _wanted(params: DataFrame, name: str) -> DataFrame:
    """query_id as wq, and its list; null for none."""
    return F.broadcast(params.select(F.col("query_id").alias("wq"), F.when(F.size(name) > 0, F.col(name)).alias("list")))


def queried(params: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Normalised parameters over nodes and edges -> a row for each question: query_id, question, mode, depth, nodes_found, edges_found, text, seeds. Terms, seeds of the types asked for, each question's own walk and depth, edges of its contexts. Without a term or a match the text says so."""
    params, nodes, edges = cut(params), cut(nodes), cut(edges)
    terms = question_terms(params)
    scored = score_nodes(terms, nodes, idf(terms, nodes))
    if "target_node_types" in params.columns:
        types = nodes.select(F.col("id").alias("ti"), "node_type").distinct()
        typed = scored.join(types, F.col("id") == F.col("ti")).join(_wanted(params, "target_node_types"), F.col("query_id") == F.col("wq"))
        scored = typed.where("list IS NULL OR array_contains(list, node_type)").select("query_id", "id", "label", "score").distinct()
    degree = cut(degrees(edges))
    hubs = cut(degree.join(F.broadcast(hub_threshold(degree)), F.col("degree") >= F.col("threshold")).select("node"))
    starts = cut(seeds(scored).select("query_id", F.col("id").alias("node"), "place"))
    deepest = {r["mode"]: r["d"] for r in params.groupBy("mode").agg(F.max("depth").alias("d")).collect()}
    of = lambda mode: params.where(F.col("mode") == mode).select("query_id", "depth")
    asked = lambda mode: starts.join(F.broadcast(of(mode).select("query_id")), "query_id")
    visited, tree = bfs(asked("bfs"), edges, hubs, deepest.get("bfs", 1), limits=of("bfs"))
    if "dfs" in deepest:
        walked = cut(_stack_walk(asked("dfs"), edges, hubs, deepest["dfs"], of("dfs")))
        root = starts.select(F.col("query_id").alias("sq"), F.col("node").alias("sn"))
        nodes_of = walked.where("v IS NULL").join(root, (F.col("query_id") == F.col("sq")) & (F.col("u") == F.col("sn")), "left")
        visited = visited.unionByName(nodes_of.select("query_id", F.col("u").alias("node"), F.when(F.col("sn").isNull(), 1).otherwise(0).cast("long").alias("level")))
        tree = tree.unionByName(walked.where("v IS NOT NULL").select("query_id", "u", "v", "ord"))
    if "context_filter" in params.columns:
        data = edge_data(tree.select("u", "v").distinct(), edges).select(F.col("u").alias("cu"), F.col("v").alias("cv"), "context")
        named = tree.join(data, (F.col("u") == F.col("cu")) & (F.col("v") == F.col("cv"))).join(_wanted(params, "context_filter"), F.col("query_id") == F.col("wq"))
        tree = named.where("list IS NULL OR array_contains(list, context)").select("query_id", "u", "v", "ord")
    found = rendered(visited, tree, nodes, edges, degree, params, starts).withColumnRenamed("query_id", "found_id")
    asked_terms = terms.select(F.col("query_id").alias("tq")).distinct()
    places = F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"])
    seeds_of = starts.groupBy(F.col("query_id").alias("sq")).agg(places.alias("seeds"))
    out = params.join(found, F.col("query_id") == F.col("found_id"), "left").join(seeds_of, F.col("query_id") == F.col("sq"), "left").join(asked_terms, F.col("query_id") == F.col("tq"), "left")
    text = F.coalesce("text", F.when(F.col("tq").isNull(), NO_TERMS).otherwise(NO_MATCH))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("query_id", "question", "mode", "depth", zero("nodes_found"), zero("edges_found"), text.alias("text"), F.coalesce("seeds", F.array().cast("array<string>")).alias("seeds"))


def edge_data(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (u, v) with the data of their last edge in that direction, else of the last in the other (JN-05)."""
    last = edges.groupBy("source", "target").agg(F.max(F.struct("ord", "relation", "context")).alias("e"))
    a = last.select(F.col("source").alias("a1"), F.col("target").alias("a2"), F.col("e").alias("ea"))
    b = last.select(F.col("source").alias("b1"), F.col("target").alias("b2"), F.col("e").alias("eb"))
    both = pairs.join(a, (F.col("u") == F.col("a1")) & (F.col("v") == F.col("a2")), "left").join(b, (F.col("u") == F.col("b2")) & (F.col("v") == F.col("b1")), "left")
    e = F.coalesce("ea", "eb")
    return both.select("u", "v", e["relation"].alias("relation"), e["context"].alias("context"))


def first_edge(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (u, v) with the data of their first edge in either direction: relation, context and, where edges have it, confidence (JN-06)."""
    data = ["relation", "context", *[c for c in ("confidence",) if c in edges.columns]]
    first = edges.groupBy(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(F.min(F.struct("ord", *data)).alias("e"))
    on = (F.least("u", "v") == F.col("lo")) & (F.greatest("u", "v") == F.col("hi"))
    return pairs.join(first, on, "left").select("u", "v", *[F.col(f"e.{c}").alias(c) for c in data])


def rendered(visited: DataFrame, tree: DataFrame, nodes: DataFrame, edges: DataFrame, degree: DataFrame, params: DataFrame, starts: DataFrame) -> DataFrame:
    """query_id, nodes_found, edges_found, text: seeds by place, then other nodes by degree, then edges between visited nodes; lines up to 3 characters a token of the budget, cut at a line's end, with a note of the nodes that were cut.

    Lines are numbered before they are summed, so each task hands on no more of a question's lines than any budget holds.
    """
    own = lambda d, c: F.coalesce(c, F.lit("")) if c in d.columns else F.lit("")
    labels = nodes.select(F.col("id").alias("i"), F.coalesce("label", "id").alias("label"), own(nodes, "node_type").alias("node_type"), own(nodes, "source_file").alias("source_file"), own(nodes, "source_location").alias("source_location"))
    first = starts.select(F.col("query_id").alias("sq"), F.col("node").alias("sn"), F.col("place").cast("long").alias("place"))
    place = visited.join(labels, F.col("node") == F.col("i"), "left").join(degree.withColumnRenamed("node", "d"), F.col("node") == F.col("d"), "left").join(F.broadcast(first), (F.col("query_id") == F.col("sq")) & (F.col("node") == F.col("sn")), "left")
    seed = F.col("place").isNotNull()
    node_lines = place.select(
        "query_id", F.struct(F.lit(0).alias("a"), F.when(seed, 0).otherwise(1).alias("b"), F.when(seed, F.col("place")).otherwise(-F.coalesce("degree", F.lit(0))).alias("c"), F.col("node").alias("d"), F.lit("").alias("e"), F.lit(0).cast("long").alias("f")).alias("o"),
        F.concat(F.lit("NODE "), F.coalesce("label", "node"), F.lit(" [src="), F.coalesce("source_file", F.lit("")), F.lit(" loc="), F.coalesce("source_location", F.lit("")), F.lit(" type="), F.coalesce("node_type", F.lit("")), F.lit("]")).alias("line"),
    )
    seen = lambda c: visited.select(F.col("query_id").alias(f"q{c}"), F.col("node").alias(f"n{c}"))
    a, b = seen("1"), seen("2")
    inside = tree.join(a, (F.col("query_id") == F.col("q1")) & (F.col("u") == F.col("n1")), "left_semi").join(b, (F.col("query_id") == F.col("q2")) & (F.col("v") == F.col("n2")), "left_semi")
    data = first_edge(inside.select("u", "v").distinct(), edges)
    data = data.select(F.col("u").alias("eu"), F.col("v").alias("ev"), own(data, "relation").alias("relation"), own(data, "confidence").alias("confidence"), own(data, "context").alias("context"))
    names = lambda c: labels.select(F.col("i").alias(f"{c}i"), F.col("label").alias(f"{c}l"))
    named = inside.join(data, (F.col("u") == F.col("eu")) & (F.col("v") == F.col("ev"))).join(names("u"), F.col("u") == F.col("ui"), "left").join(names("v"), F.col("v") == F.col("vi"), "left")
    edge_lines = named.select(
        "query_id", F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c"), F.col("u").alias("d"), F.col("v").alias("e"), F.col("ord").alias("f")).alias("o"),
        F.concat(F.lit("EDGE "), F.coalesce("ul", "u"), F.lit(" --"), "relation", F.when(F.col("confidence") != "", F.concat(F.lit(" ["), "confidence", F.lit("]"))).otherwise(""), F.when(F.col("context") != "", F.concat(F.lit(" context="), "context")).otherwise(""), F.lit("--> "), F.coalesce("vl", "v")).alias("line"),
    )
    lines = cut(node_lines.unionByName(edge_lines))
    room = params.select(F.col("query_id").alias("pq"), "token_budget", (CHARS_PER_TOKEN * F.col("token_budget")).alias("room"))
    most = CHARS_PER_TOKEN * (params.agg(F.max("token_budget").alias("b")).first()["b"] or 0) // LEAST_LINE + 2
    sizes = lines.groupBy(F.col("query_id").alias("zq")).agg(F.sum(F.char_length("line") + 1).alias("size"), F.count_if(F.col("o.a") == 0).alias("n_nodes"))
    order = Window.partitionBy("query_id").orderBy("o", "line")
    ahead = lines.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    summed = ahead.withColumn("upto", F.sum(F.char_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fitting = summed.join(F.broadcast(room), F.col("query_id") == F.col("pq")).join(sizes, F.col("query_id") == F.col("zq"))
    over = F.col("size") - 1 > F.col("room")
    # Of a first line that is longer than the budget, its start.
    kept = fitting.where(~over | (F.col("upto") <= F.col("room")) | (F.col("n") == 1)).withColumn("line", F.when(over, F.substring("line", F.lit(1), F.col("room").cast("int"))).otherwise(F.col("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    text = kept.groupBy("query_id").agg(joined.alias("shown"), F.count_if(F.col("o.a") == 0).alias("n_shown"), F.any_value("n_nodes").alias("n_nodes"), F.any_value("token_budget").alias("token_budget"), F.bool_or(over).alias("over"))
    note = F.concat(F.lit(CUT[0]), (F.col("n_nodes") - F.col("n_shown")).cast("string"), F.lit(CUT[1]), F.col("token_budget").cast("string"), F.lit(CUT[2]))
    text = text.select("query_id", F.concat("shown", F.when(F.col("over"), note).otherwise("")).alias("text"))
    counts = visited.groupBy(F.col("query_id").alias("vq")).agg(F.count("*").alias("nodes_found"))
    edge_count = tree.groupBy(F.col("query_id").alias("tq")).agg(F.count("*").alias("edges_found"))
    out = counts.join(edge_count, F.col("vq") == F.col("tq"), "left").join(text, F.col("vq") == F.col("query_id"), "left")
    return out.select(F.col("vq").alias("query_id"), "nodes_found", F.coalesce("edges_found", F.lit(0)).alias("edges_found"), F.coalesce("text", F.lit("")).alias("text"))
