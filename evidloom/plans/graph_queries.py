"""Graph queries over a property graph of the star schema: regions, nations, customers, suppliers and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.functions import text as T
from evidloom.operators import graph as G
from evidloom.plans.text_queries import table

#: Questions asked of the graph: id, text, raw mode, depth, budget and limit, terms more and less, types of seeds, contexts.
ASKED = (
    ("q1", "Which customers live in FRANCE or Customer#000000007?", "bfs", "2", "300", "7", None, None, None, None),
    ("q2", "supplier EUROPE nation", "DFS", "9", "5", "-1", None, None, None, None),
    ("q3", "zz", None, None, None, None, None, None, None, None),
    ("q4", "Supplier#000000003 and its parts", "x", "0", "x", "0", None, None, None, None),
    ("q5", "Where in G\u00e9rmany and gErM\u00c1ny is a supplier?", "bfs", "3", "900", None, ["N\u00e0tion", "asia"], ["supplier", "where"], ["nation", "region"], ["place", "person"]),
    ("q6", "", "bfs", "1", "100", None, None, [], [], None),
    ("q7", "xylophone quagmire", "bfs", "1", "100", None, None, None, None, None),
    ("q8", "customer#000000011", "bfs", "2", "4000", None, None, None, ["customer"], ["person"]),
)
QUESTIONS = tuple((q, text) for q, text, *_ in ASKED)
#: Questions walked breadth-first; the stack walk has no SQL.
BREADTH = tuple(a for a in ASKED if a[0] != "q2")
KINDS = (("region", "r"), ("nation", "n"), ("customer", "c"), ("supplier", "s"), ("part", "p"))


def nodes(spark, sf_dir) -> DataFrame:
    def of(name: str, p: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        return t.select(F.concat(F.lit(f"{name}:"), F.col(f"{p}_{name}key" if name not in ("customer", "supplier", "part") else f"{p}_{ {'customer': 'cust', 'supplier': 'supp', 'part': 'part'}[name] }key")).alias("id"), F.col(f"{p}_name").alias("label"), F.lit(name).alias("node_type"), F.lit(f"{name}.parquet").alias("source_file"))

    return reduce(DataFrame.unionByName, [of(*k) for k in KINDS])


def edges(spark, sf_dir) -> DataFrame:
    """nation-region, customer-nation, supplier-nation and distinct supplier-part edges, with an ordinal by kind and ends."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda n, c: F.concat(F.lit(f"{n}:"), F.col(c))
    of = lambda d, s, x, r, k, o: d.select(s.alias("source"), x.alias("target"), F.lit(r).alias("relation"), F.lit(k).alias("context"), o.cast("long").alias("ord"))
    parts = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    return reduce(
        DataFrame.unionByName,
        [
            of(t("nation"), name("nation", "n_nationkey"), name("region", "n_regionkey"), "part_of", "place", F.col("n_nationkey")),
            of(t("customer"), name("customer", "c_custkey"), name("nation", "c_nationkey"), "lives_in", "person", F.col("c_custkey") + 10**9),
            of(t("supplier"), name("supplier", "s_suppkey"), name("nation", "s_nationkey"), "based_in", "person", F.col("s_suppkey") + 2 * 10**9),
            of(parts, name("supplier", "l_suppkey"), name("part", "l_partkey"), "supplies", "trade", F.col("l_suppkey") * 10**7 + F.col("l_partkey") + 3 * 10**9),
        ],
    )


def _params(spark, asked=ASKED) -> DataFrame:
    lists = ", ".join(f"{c} array<string>" for c in G.LISTS)
    return spark.createDataFrame(list(asked), f"query_id string, question string, mode string, depth string, token_budget string, result_limit string, {lists}")


def _terms(spark) -> DataFrame:
    return G.question_terms(G.query_params(_params(spark)))


def fn_11_query_params(spark, sf_dir):
    p = G.query_params(_params(spark))
    return p.select(*[c for c in p.columns if c not in G.LISTS], *[F.array_join(c, ",").alias(c) for c in G.LISTS])


def fn_09_question_terms(spark, sf_dir):
    """Terms of questions, more and less of them, folded (FN-05, FN-06, FN-09)."""
    return _terms(spark).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def gr_01_adjacency(spark, sf_dir):
    a = G.adjacency(edges(spark, sf_dir))
    return a.groupBy("u").agg(F.count("*").alias("entries"), F.count_distinct("v").alias("neighbours"), F.min("ord").alias("first_ord"))


def agg_03_degrees(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


def gr_02_hub_threshold(spark, sf_dir):
    return G.hub_threshold(G.degrees(edges(spark, sf_dir)))


def agg_01_idf(spark, sf_dir):
    out = G.idf(_terms(spark), nodes(spark, sf_dir))
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


def _scored(spark, sf_dir):
    n, t = nodes(spark, sf_dir), _terms(spark)
    return G.score_nodes(t, n, G.idf(t, n))


def gr_03_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("query_id", "id", "label", F.round("score", 3).alias("score"))


def top_02_seeds(spark, sf_dir):
    return G.seeds(_scored(spark, sf_dir)).select("query_id", "id", "place")


def _hubs(spark, sf_dir):
    d = G.degrees(edges(spark, sf_dir))
    return d.join(F.broadcast(G.hub_threshold(d)), F.col("degree") >= F.col("threshold")).select("node")


def _starts(spark, sf_dir):
    return G.seeds(_scored(spark, sf_dir)).select("query_id", F.col("id").alias("node"))


def gr_04_bfs(spark, sf_dir):
    visited, _ = G.bfs(_starts(spark, sf_dir), edges(spark, sf_dir), _hubs(spark, sf_dir), 3)
    return visited


def gr_04_bfs_edges(spark, sf_dir):
    _, tree = G.bfs(_starts(spark, sf_dir), edges(spark, sf_dir), _hubs(spark, sf_dir), 2)
    return tree


def gr_06_bfs_in_context(spark, sf_dir):
    visited, _ = G.bfs(_starts(spark, sf_dir), edges(spark, sf_dir), _hubs(spark, sf_dir), 3, ["place", "person"])
    return visited


def gr_05_dfs(spark, sf_dir):
    return G.dfs(_starts(spark, sf_dir), edges(spark, sf_dir), _hubs(spark, sf_dir), 3)


def _repeated_edges(spark, sf_dir):
    """Orders as parallel edges between customers and clerks' priorities."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey") % 40).alias("source"), F.concat(F.lit("c"), F.col("o_custkey") % 31).alias("target"), F.concat(F.lit("r"), F.col("o_orderkey") % 7).alias("relation"), F.concat(F.lit("k"), F.col("o_orderkey") % 3).alias("context"), F.col("o_orderkey").alias("ord"))


def _pairs(spark, sf_dir):
    e = _repeated_edges(spark, sf_dir)
    return e.select(F.col("target").alias("u"), F.col("source").alias("v")).distinct()


def jn_05_last_edge(spark, sf_dir):
    return G.edge_data(_pairs(spark, sf_dir), _repeated_edges(spark, sf_dir))


def jn_06_first_edge(spark, sf_dir):
    return G.first_edge(_pairs(spark, sf_dir), _repeated_edges(spark, sf_dir))


def gr_08_query_graph(spark, sf_dir):
    """Whole queries: terms, scores, seeds by type, each question's own walk and depth, contexts, text, early ends (GR-07, GR-08, TOP-06)."""
    out = G.queried(G.query_params(_params(spark, BREADTH)), nodes(spark, sf_dir), edges(spark, sf_dir))
    return out.withColumn("seeds", F.array_join("seeds", ","))


def gr_08_query_graph_depth_first(spark, sf_dir):
    """The question that is walked depth-first."""
    out = G.queried(G.query_params(_params(spark, [a for a in ASKED if a not in BREADTH])), nodes(spark, sf_dir), edges(spark, sf_dir))
    return out.withColumn("seeds", F.array_join("seeds", ","))


QUERIES = {f.__name__: f for f in (fn_11_query_params, fn_09_question_terms, gr_08_query_graph_depth_first, gr_01_adjacency, agg_03_degrees, gr_02_hub_threshold, agg_01_idf, gr_03_scores, top_02_seeds, gr_04_bfs, gr_04_bfs_edges, gr_06_bfs_in_context, gr_05_dfs, jn_05_last_edge, jn_06_first_edge, gr_08_query_graph)}

_NODES = """nodes AS (SELECT 'region:' || r_regionkey AS id, r_name AS label, 'region' AS node_type, 'region.parquet' AS source_file FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', 'nation.parquet' FROM nation
UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer', 'customer.parquet' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', 'supplier.parquet' FROM supplier UNION ALL SELECT 'part:' || p_partkey, p_name, 'part', 'part.parquet' FROM part)"""
_EDGES = """edges AS (SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'part_of' AS relation, 'place' AS context, n_nationkey::BIGINT AS ord FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'lives_in', 'person', c_custkey + 1000000000 FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in', 'person', s_suppkey + 2000000000 FROM supplier
UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', 'trade', l_suppkey * 10000000 + l_partkey + 3000000000 FROM lineitem),
adj AS (SELECT source AS u, target AS v, ord, context FROM edges UNION ALL SELECT target, source, ord, context FROM edges), deg AS (SELECT u AS node, count(*)::BIGINT AS degree FROM adj GROUP BY u),
thr AS (SELECT greatest(50, coalesce(list_sort(list(degree))[floor(count(*) * 0.99)::BIGINT + 1], 0))::BIGINT AS threshold FROM deg), hubs AS (SELECT node FROM deg, thr WHERE degree >= threshold)"""
def _sql_list(values) -> str:
    return "NULL::VARCHAR[]" if values is None else "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


#: What each question's parameters come to.
_NORMAL = {"q1": ("bfs", 2, 300, 7), "q2": ("dfs", 6, 100, None), "q3": ("bfs", 3, 2000, None), "q4": ("bfs", 1, 2000, None), "q5": ("bfs", 3, 900, None), "q6": ("bfs", 1, 100, None), "q7": ("bfs", 1, 100, None), "q8": ("bfs", 2, 4000, None)}
_Q = "qs(query_id, question, mode, depth, b, result_limit, inc, exc, types, ctx) AS (VALUES " + ", ".join(
    "('{}', '{}', '{}', {}, {}, {}, {}, {}, {}, {})".format(q, text, *["NULL" if x is None else x for x in _NORMAL[q]], *map(_sql_list, lists)) for q, text, _, _, _, _, *lists in ASKED
) + ")"
_TERMS = _Q + r""", raw_terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) AS term FROM qs) WHERE NOT (regexp_matches(term, '^[A-Za-z]*$') AND length(term) <= 2)
UNION SELECT query_id, unnest(inc) FROM qs),
terms AS (SELECT query_id, unnest(regexp_extract_all(lower(strip_accents(term)), '[\p{L}\p{N}_]+')) AS term FROM raw_terms JOIN qs USING (query_id) WHERE NOT coalesce(list_contains(exc, term), false))"""
_FOLDED = "lower(strip_accents({}))"
_IDF = f"""{_TERMS}, {_NODES}, idf AS (SELECT term, count(id)::BIGINT AS df, ln(1 + (SELECT greatest(count(*), 1) FROM nodes) / (1 + count(id))) AS idf FROM (SELECT DISTINCT term FROM terms) LEFT JOIN nodes ON contains({_FOLDED.format("coalesce(label, '')")}, term) GROUP BY term)"""
_LABEL = _FOLDED.format("coalesce(label, id)")
_SCORED = f"""{_IDF}, part AS (SELECT query_id, id, label, node_type, idf, {_LABEL} AS l, regexp_replace({_LABEL}, '[()]+$', '') AS b, lower(source_file) AS s, term FROM terms JOIN idf USING (term), nodes),
scored AS (SELECT query_id, id, label, node_type, round(sum(idf * (CASE WHEN l = term OR b = term THEN {G.EXACT} WHEN starts_with(l, term) OR starts_with(b, term) THEN {G.PREFIX} WHEN contains(l, term) THEN {G.INNER} ELSE 0 END + CASE WHEN contains(s, term) THEN {G.IN_SOURCE} ELSE 0 END)), 6) AS score FROM part GROUP BY ALL HAVING score > 0),
typed AS (SELECT scored.* FROM scored JOIN qs USING (query_id) WHERE coalesce(len(types), 0) = 0 OR list_contains(types, node_type)),
seeds_of AS (SELECT query_id, id, place FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(coalesce(label, id)), id)::BIGINT AS place FROM %s) WHERE score >= {G.GAP} * top AND place <= {G.SEEDS}), seeds AS (SELECT * FROM seeds_of)"""


def _walk(depth: int, context: str = "", own: bool = False) -> str:
    """Levels unrolled as tables l0, l1, ...; t1, t2, ... are their tree edges. own: each question's types and depth."""
    out = [f"{_SCORED % ('typed' if own else 'scored')}, {_EDGES}, l0 AS (SELECT query_id, id AS node, 0 AS level FROM seeds), v0 AS (SELECT * FROM l0)"]
    for i in range(1, depth + 1):
        leave = "" if i == 1 else " AND u NOT IN (SELECT node FROM hubs)"
        out.append(
            f"t{i} AS (SELECT query_id, u, v, ord FROM l{i - 1} JOIN adj ON node = u{' JOIN qs USING (query_id)' if own else ''} WHERE {f'qs.depth >= {i}' if own else 'TRUE'}{leave}{context} AND (query_id, v) NOT IN (SELECT (query_id, node) FROM v{i - 1})), "
            f"l{i} AS (SELECT DISTINCT query_id, v AS node, {i} AS level FROM t{i}), v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT * FROM l{i})"
        )
    return "WITH " + ", ".join(out)


_NOTE = f"'{G.CUT[0].lstrip()}' || (n_nodes - n_shown) || '{G.CUT[1]}' || texts.b || '{G.CUT[2]}'"
_RENDERED = f"""{_walk(3, own=True)}, every AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
le AS (SELECT source, target, arg_max(context, ord) AS context FROM edges GROUP BY ALL),
tree AS (SELECT query_id, u, v, ord FROM (SELECT e.*, qs.ctx, coalesce(x.context, y.context) AS context FROM every e JOIN qs USING (query_id) LEFT JOIN le x ON u = x.source AND v = x.target LEFT JOIN le y ON u = y.target AND v = y.source) WHERE coalesce(len(ctx), 0) = 0 OR list_contains(ctx, context)),
fe AS (SELECT least(source, target) AS lo, greatest(source, target) AS hi, arg_min(relation, ord) AS relation, arg_min(context, ord) AS context FROM edges GROUP BY ALL),
lines AS (SELECT v3.query_id, 0 AS a, CASE WHEN place IS NOT NULL THEN 0 ELSE 1 END AS bb, CASE WHEN place IS NOT NULL THEN place ELSE -coalesce(degree, 0) END AS c, v3.node AS d, '' AS e, 0 AS f, 'NODE ' || coalesce(label, v3.node) || ' [src=' || coalesce(source_file, '') || ' loc= type=' || coalesce(node_type, '') || ']' AS line
  FROM v3 LEFT JOIN nodes ON v3.node = nodes.id LEFT JOIN deg ON deg.node = v3.node LEFT JOIN seeds s ON s.query_id = v3.query_id AND s.id = v3.node
UNION ALL SELECT t.query_id, 1, 0, 0, u, v, ord, 'EDGE ' || coalesce(nu.label, u) || ' --' || relation || ' context=' || context || '--> ' || coalesce(nv.label, v) FROM tree t JOIN fe ON least(u, v) = lo AND greatest(u, v) = hi LEFT JOIN nodes nu ON nu.id = u LEFT JOIN nodes nv ON nv.id = v),
upto AS (SELECT *, sum(length(line) + 1) OVER w AS upto, row_number() OVER w AS n, sum(length(line) + 1) OVER (PARTITION BY query_id) AS size, count(*) FILTER (WHERE a = 0) OVER (PARTITION BY query_id) AS n_nodes FROM lines WINDOW w AS (PARTITION BY query_id ORDER BY a, bb, c, d, e, f, line ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT upto.*, qs.b, size - 1 > {G.CHARS_PER_TOKEN} * qs.b AS over FROM upto JOIN qs USING (query_id) WHERE size - 1 <= {G.CHARS_PER_TOKEN} * qs.b OR upto <= {G.CHARS_PER_TOKEN} * qs.b OR n = 1),
texts AS (SELECT query_id, string_agg(CASE WHEN over THEN left(line, {G.CHARS_PER_TOKEN} * b) ELSE line END, chr(10) ORDER BY n) AS text, count(*) FILTER (WHERE a = 0) AS n_shown, any_value(n_nodes) AS n_nodes, any_value(b) AS b, bool_or(over) AS over FROM kept GROUP BY query_id),
n AS (SELECT query_id, count(*)::BIGINT AS nodes_found FROM v3 GROUP BY 1), m AS (SELECT query_id, count(*)::BIGINT AS edges_found FROM tree GROUP BY 1), so AS (SELECT query_id, string_agg(id, ',' ORDER BY place) AS seeds FROM seeds GROUP BY 1)
SELECT query_id, question, mode, depth::BIGINT AS depth, coalesce(nodes_found, 0)::BIGINT AS nodes_found, coalesce(edges_found, 0)::BIGINT AS edges_found,
  coalesce(text || CASE WHEN over THEN chr(10) || {_NOTE} ELSE '' END, CASE WHEN query_id IN (SELECT query_id FROM terms) THEN '{G.NO_MATCH}' ELSE '{G.NO_TERMS}' END) AS text, coalesce(seeds, '') AS seeds
FROM qs LEFT JOIN n USING (query_id) LEFT JOIN m USING (query_id) LEFT JOIN texts USING (query_id) LEFT JOIN so USING (query_id) WHERE mode = 'bfs'"""
_MULTI = """e AS (SELECT 'c' || (o_custkey % 40) AS source, 'c' || (o_custkey % 31) AS target, 'r' || (o_orderkey % 7) AS relation, 'k' || (o_orderkey % 3) AS context, o_orderkey AS ord FROM orders), p AS (SELECT DISTINCT target AS u, source AS v FROM e)"""
ORACLES = {
    "gr_08_query_graph": _RENDERED,
    "fn_11_query_params": f"WITH {_Q} SELECT query_id, question, mode, depth::BIGINT AS depth, b::BIGINT AS token_budget, result_limit::BIGINT AS result_limit, array_to_string(inc, ',') AS include_terms, array_to_string(exc, ',') AS exclude_terms, array_to_string(types, ',') AS target_node_types, array_to_string(ctx, ',') AS context_filter FROM qs",
    "fn_09_question_terms": f"WITH {_TERMS} SELECT query_id, term, count(*)::BIGINT AS times FROM terms GROUP BY ALL",
    "gr_01_adjacency": f"WITH {_EDGES} SELECT u, count(*)::BIGINT AS entries, count(DISTINCT v)::BIGINT AS neighbours, min(ord)::BIGINT AS first_ord FROM adj GROUP BY u",
    "agg_03_degrees": f"WITH {_EDGES} SELECT * FROM deg",
    "gr_02_hub_threshold": f"WITH {_EDGES} SELECT * FROM thr",
    "agg_01_idf": f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "gr_03_scores": f"WITH {_SCORED % 'scored'} SELECT query_id, id, label, round(score, 3) AS score FROM scored",
    "top_02_seeds": f"WITH {_SCORED % 'scored'} SELECT * FROM seeds",
    "gr_04_bfs": f"{_walk(3)} SELECT query_id, node, level::BIGINT AS level FROM v3",
    "gr_04_bfs_edges": f"{_walk(2)} SELECT query_id, u, v, ord::BIGINT AS ord FROM t1 UNION ALL SELECT query_id, u, v, ord FROM t2",
    "gr_06_bfs_in_context": _walk(3, " AND context IN ('place', 'person')") + " SELECT query_id, node, level::BIGINT AS level FROM v3",
    "jn_05_last_edge": f"""WITH {_MULTI}, l AS (SELECT source, target, arg_max(relation, ord) AS r, arg_max(context, ord) AS k FROM e GROUP BY ALL)
SELECT u, v, coalesce(a.r, b.r) AS relation, coalesce(a.k, b.k) AS context FROM p LEFT JOIN l a ON u = a.source AND v = a.target LEFT JOIN l b ON u = b.target AND v = b.source""",
    "jn_06_first_edge": f"""WITH {_MULTI}, l AS (SELECT least(source, target) AS lo, greatest(source, target) AS hi, arg_min(relation, ord) AS relation, arg_min(context, ord) AS context FROM e GROUP BY ALL)
SELECT u, v, relation, context FROM p LEFT JOIN l ON least(u, v) = lo AND greatest(u, v) = hi""",
}
