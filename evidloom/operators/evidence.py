"""Requirements found in texts: first hits, evidence, coverage and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions import text as T

#: Characters of the values of one automaton: some hundred MB in a worker.
MOST_CHARS = 4_000_000


def requirement_items(templates: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Templates (template_name, one array column for each key of kinds) -> template_name, kind, key, value, requirement_id, ord: distinct by kind and value, the first kept."""
    def of(n: int, key: str, kind: str):
        values = F.coalesce(F.col(key), F.array().cast("array<string>"))
        return F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), v.alias("value"), (F.lit(n * 10**6) + i).cast("long").alias("ord")))

    rows = F.flatten(F.array(*[of(n, k, kind) for n, (k, kind) in enumerate(kinds.items())]))
    every = templates.select("template_name", F.inline(rows)).where("value <> ''")
    first = every.groupBy("template_name", "kind", "value").agg(F.min(F.struct("ord", "key")).alias("f"))
    return first.select("template_name", "kind", F.col("f.key").alias("key"), "value", F.concat_ws(".", "template_name", "f.key", "value").alias("requirement_id"), F.col("f.ord").alias("ord"))


def folded(text: str) -> str:
    """A text in lower case, character by character: one whose lower case is longer, and a sigma at a word's end, keep their place and form, so places are those of the text."""
    if "\u0130" in text or "\u03a3" in text:
        return "".join(c if len(x := c.lower()) > 1 else x for c in text)
    return text.lower()


def automata(values: list[tuple[str, str]], most_chars: int = MOST_CHARS) -> list[dict[str, list[str]]]:
    """(requirement_id, value) -> the ids of each folded value, in parts of at most so many characters (or of one value): an automaton is made of each."""
    ids: dict[str, list[str]] = {}
    for requirement_id, value in values:
        if value:
            ids.setdefault(folded(value), []).append(requirement_id)
    parts, size = [{}] if ids else [], 0
    for value, own in sorted(ids.items()):
        if parts[-1] and size + len(value) > most_chars:
            parts.append({})
            size = 0
        parts[-1][value] = own
        size += len(value)
    return parts


def first_hits(requirements: DataFrame, chunks: DataFrame, key: str = "source_id", *, most_chars: int = MOST_CHARS) -> DataFrame:
    """Requirements (requirement_id, value) in chunks (key, chunk_no, chunk_id, start, text) -> for each requirement and key that has it: requirement_id, key, chunk_no, chunk_id, start, end of the first chunk's first place, case aside.

    All values are one Aho-Corasick automaton, so a chunk is scanned once however many there are, and no text is shuffled. Requirements are a
    list in the configuration; beyond most_chars characters they are dealt out to several automata, and chunks are scanned by each.
    """
    found = None
    for part in automata([(r["requirement_id"], r["value"]) for r in requirements.select("requirement_id", "value").distinct().toLocalIterator()], most_chars):
        one = _scanned(part, chunks, key)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = _scanned({}, chunks.limit(0), key)
    best = found.groupBy("requirement_id", key).agg(F.min(F.struct("chunk_no", "chunk_id", "start", "size")).alias("b"))
    return best.select("requirement_id", key, "b.chunk_no", "b.chunk_id", "b.start", (F.col("b.start") + F.col("b.size")).alias("end"))


def _scanned(ids: dict[str, list[str]], chunks: DataFrame, key: str) -> DataFrame:
    """The first place of each requirement in each chunk that has it."""
    shared = chunks.sparkSession.sparkContext.broadcast(ids)

    def scanned(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for value, own in shared.value.items():
            automaton.add_word(value, (len(value), own))
        if shared.value:
            automaton.make_automaton()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows, names, places, lengths = [], [], [], []
                starts = b.column(3).to_pylist()
                for i, text in enumerate(b.column(4).to_pylist() if shared.value else []):
                    first: dict = {}
                    for end, (size, own) in automaton.iter(folded(text or "")):
                        for name in own:
                            if name not in first:
                                first[name] = (end + 1 - size, size)
                    for name, (place, size) in first.items():
                        rows.append(i)
                        names.append(name)
                        places.append(starts[i] + place)
                        lengths.append(size)
                own_rows = b.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[own_rows.column(c) for c in range(3)], pa.array(places, pa.int64()), pa.array(lengths, pa.int64())], names=["requirement_id", key, "chunk_no", "chunk_id", "start", "size"])

    kind = lambda c: chunks.schema[c].dataType.simpleString()
    narrow = chunks.select(key, "chunk_no", "chunk_id", F.col("start").cast("long").alias("start"), "text")
    return narrow.mapInArrow(scanned, f"requirement_id string, {key} {kind(key)}, chunk_no {kind('chunk_no')}, chunk_id {kind('chunk_id')}, start bigint, size bigint")


def evidence(hits: DataFrame, key: str = "source_id") -> DataFrame:
    """First hits -> evidence rows: evidence_id (its chunk part names the requirement, so two requirements at one place give two), span and summary."""
    name = F.concat_ws(":", "chunk_id", "requirement_id")
    return hits.select(T.evidence_id(F.col(key), name, F.col("start"), F.col("end")).alias("evidence_id"), key, "requirement_id", "chunk_id", "start", "end")


def supplements(items: DataFrame, found: DataFrame, key: str = "source_id") -> dict[str, DataFrame]:
    """Requirement items and their evidence -> node, event and edge tables, the status of each requirement, and links: what supports a template (template_name, node_id, event_id, edge_id, evidence_id)."""
    joined = items.join(found.withColumnRenamed("requirement_id", "__r"), F.col("requirement_id") == F.col("__r"))
    node = T.node_id(F.col(key), F.col("requirement_id"), F.lit("requirement"))
    event = T.event_id(F.col(key), F.lit("evidence"), F.col("requirement_id"), F.col("start"), F.col("end"))
    rows = joined.select(key, "template_name", "requirement_id", "kind", "value", "evidence_id", node.alias("node_id"), event.alias("event_id"))
    edge = T.edge_id(F.col(key), F.col("node_id"), F.col("event_id"), F.lit("supports")).alias("edge_id")
    hit = found.select(F.col("requirement_id").alias("__r")).distinct()
    status = items.join(hit, F.col("requirement_id") == F.col("__r"), "left").select("template_name", "requirement_id", "kind", "ord", F.when(F.col("__r").isNull(), "not_found_in_source").otherwise("covered").alias("status"))
    return {
        "nodes": rows.select("node_id", F.col("value").alias("label"), F.lit("requirement").alias("node_type"), "evidence_id").distinct(),
        "events": rows.select("event_id", F.lit("evidence").alias("event_type"), "node_id", "evidence_id").distinct(),
        "edges": rows.select(edge, F.col("node_id").alias("source"), F.col("event_id").alias("target"), "evidence_id").distinct(),
        "status": status,
        "links": rows.select("template_name", "node_id", "event_id", edge, "evidence_id"),
    }


def readiness(status: DataFrame, links: DataFrame) -> DataFrame:
    """Requirement statuses (template_name, kind, ord, status) and links of supplements() -> template_name, total, covered, readiness_score, missing_kinds (in order, each once), the distinct nodes, edges, events and evidence that support it, and a note where a requirement isn't found."""
    missing = F.min(F.when(F.col("status") == "not_found_in_source", F.col("ord"))).alias("first")
    # Kinds are few: they are aggregated before they are put in order, statuses are never gathered.
    by_kind = status.groupBy("template_name", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "covered").alias("c"), missing)
    kinds = F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "kind"))))
    totals = by_kind.groupBy("template_name").agg(F.sum("n").alias("total"), F.sum("c").alias("covered"), F.array_join(F.transform(kinds, lambda x: x["kind"]), ",").alias("missing_kinds"))
    parts = {"supporting_node_count": "node_id", "supporting_edge_count": "edge_id", "supporting_event_count": "event_id", "evidence_count": "evidence_id"}
    counted = links.groupBy(F.col("template_name").alias("__t")).agg(*[F.count_distinct(c).alias(n) for n, c in parts.items()])
    joined = totals.join(counted, F.col("template_name") == F.col("__t"), "left")
    lost = F.col("total") - F.col("covered")
    note = F.when(F.col("missing_kinds") != "", F.concat(lost.cast("string"), F.lit(" of its requirements stand in no chunk"))).otherwise("")
    score = F.round(F.col("covered") / F.col("total"), 4).alias("readiness_score")
    return joined.select("template_name", "total", "covered", score, "missing_kinds", *[F.coalesce(n, F.lit(0)).alias(n) for n in parts], note.alias("note"))


def first_of_each(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group by an order, by aggregation: no window, so a large group is summed where it lies."""
    rest = [c for c in rows.columns if c not in group and c not in order]
    return rows.groupBy(*group).agg(F.min(F.struct(*order, *rest)).alias("f")).select(*group, "f.*")


def ordered_distinct(rows: DataFrame, group: list[str], value: str, order: str, name: str) -> DataFrame:
    """Distinct values of a group in the order of their first row."""
    first = rows.groupBy(*group, value).agg(F.min(order).alias("__o"))
    return first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", value))), lambda x: x[value]).alias(name))


def running_first(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with `place`, their number in the group by the order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def ordered_lists(rows: DataFrame, group: list[str], value: str, order: str, name: str) -> DataFrame:
    """All values of a group in order, repeats included. A group's values come together, so they should be ids, not texts."""
    return rows.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.col(value).alias("__v")))), lambda x: x["__v"]).alias(name))
