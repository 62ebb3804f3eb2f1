"""Packets, run records, contracts between artifacts, and reuse decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions import text as T
from evidloom.functions import values as X
from evidloom.operators.validate import empty, errors, set_difference

#: Scopes that a comprehensive lane holds all of, producers and prefixes that no agent may claim. Fixed values.
COMPREHENSIVE, COMPREHENSIVE_LANE = ("nodes", "edges", "events", "evidence", "supports_templates"), "comprehensive_extraction"
LEGACY, LEGACY_TOKENS, LEGACY_PREFIXES = ("python", "legacy", "python-template-aware"), ("python-template-aware",), ("python", "legacy")
PASSES = 3


def lane_kinds(lanes: DataFrame) -> DataFrame:
    """Lanes (lane_id, scope: array) -> lane_id, comprehensive: by its name or because its scope holds all of COMPREHENSIVE."""
    whole = F.size(F.array_except(F.array(*[F.lit(x) for x in COMPREHENSIVE]), "scope")) == 0
    return lanes.select("lane_id", ((F.col("lane_id") == COMPREHENSIVE_LANE) | F.coalesce(whole, F.lit(False))).alias("comprehensive"))


def requirement_packets(templates: DataFrame, group: str, per_batch: int) -> DataFrame:
    """Templates (group, ord, template_name) -> group, batch_id, n, templates: neighbours of a group, 1 to 5 to a batch."""
    if not 1 <= per_batch <= 5:
        raise ValueError("a batch takes 1 to 5 templates")
    place = F.row_number().over(Window.partitionBy(group).orderBy("ord")) - 1
    rows = templates.select(group, "ord", "template_name", (F.floor(place / per_batch) + 1).cast("int").alias("batch"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "template_name"))), lambda x: x["template_name"])
    return rows.groupBy(group, "batch").agg(F.count("*").alias("n"), F.array_join(names, ",").alias("templates")).select(group, F.format_string("batch-%04d", "batch").alias("batch_id"), "n", "templates")


def refinement_passes(sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """Sources (source_id, raw_path) -> a row for each serial pass: it reads what the one before has written, the first the raw file."""
    each = sources.select("source_id", "raw_path", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"))
    out = lambda p: F.format_string("refinement/%s/pass-%d.json", F.col("source_id").cast("string"), p)
    return each.select("source_id", F.col("pass").cast("long").alias("pass"), F.when(F.col("pass") == 1, F.col("raw_path")).otherwise(out(F.col("pass") - 1)).alias("reads"), out(F.col("pass")).alias("writes"))


def run_records(packets: DataFrame, status: str = "pending") -> DataFrame:
    """Packets (packet_id, agent_role, input_paths, output_paths, write_scope?) -> run records: the packet is the first input, each once; the scope is the outputs where none is given."""
    inputs = F.array_distinct(F.concat(F.array("packet_id"), F.coalesce("input_paths", F.array().cast("array<string>"))))
    return packets.select(F.concat(F.lit("run:"), "packet_id").alias("run_id"), "agent_role", inputs.alias("input_paths"), "output_paths", F.coalesce("write_scope", "output_paths").alias("write_scope"), F.lit(status).alias("status"))


def legacy_producer(value: Column) -> Column:
    """Whether a producer's name is one of those no agent may use: itself, as a token, or a 'producer' with a prefix as token."""
    flat = F.translate(F.lower(F.trim(value)), "_", "-")
    tokens = F.regexp_extract_all(flat, F.lit("[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0))
    parts = F.split(flat, r"[^a-z0-9]+")
    some = lambda names: F.array(*[F.lit(x) for x in names])
    return flat.isin(*LEGACY) | F.arrays_overlap(tokens, some(LEGACY_TOKENS)) | (F.array_contains(parts, "producer") & F.arrays_overlap(parts, some(LEGACY_PREFIXES)))


def names_in_order(found: DataFrame, expected: DataFrame, group: str) -> DataFrame:
    """Names (group, ord, name) against those expected -> group, code: duplicates, else another list or order."""
    lists = lambda d, c: d.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias(c))
    both = lists(found, "a").join(lists(expected, "b").withColumnRenamed(group, "__g"), F.col(group) == F.col("__g"), "full")
    code = F.when(F.size(F.array_distinct("a")) < F.size("a"), "names_duplicate").when(~F.col("a").eqNullSafe(F.col("b")), "names_differ")
    return both.select(F.coalesce(group, "__g").alias(group), code.alias("code")).where("code IS NOT NULL")


def readiness_against_requirements(requirements: DataFrame, statuses: DataFrame, allowed: list[str]) -> DataFrame:
    """Requirements and statuses (template_name, requirement_id; status) -> error rows: ids of one side only, statuses of no enum."""
    key = F.concat_ws("/", "template_name", "requirement_id").alias("item_id")
    diff = set_difference(requirements.select(key), statuses.select(key), "item_id")
    one = diff.select(F.lit("readiness").alias("scope"), "item_id", F.when(F.col("side") == "left_only", "requirement_without_status").otherwise("status_without_requirement").alias("code"))
    return one.unionByName(errors(statuses, "readiness", F.concat_ws("/", "template_name", "requirement_id"), {"status_not_allowed": ~F.coalesce(F.col("status").isin(allowed), F.lit(False))}))


def packet_contract(packets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Packets (packet_id, chunk_id, start, end, hint) against the ledger -> error rows for what isn't equal, nulls being equal."""
    c = chunks.select(F.col("chunk_id").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("hint").alias("__h"))
    joined = packets.join(c, F.col("chunk_id") == F.col("__c"), "left")
    known = F.col("__c").isNotNull()
    return errors(joined, "packet", F.col("packet_id"), {"packet_chunk_unknown": ~known, "packet_range_differs": known & ~(F.col("start").eqNullSafe(F.col("__s")) & F.col("end").eqNullSafe(F.col("__e"))), "packet_hint_differs": known & ~F.col("hint").eqNullSafe(F.col("__h"))})


def missing_outputs(ledger: DataFrame, provenance: DataFrame, existing: DataFrame) -> DataFrame:
    """Paths (path) that the ledger or an item's provenance expects and that aren't there."""
    expected = ledger.select("path").unionByName(provenance.select("path")).where(~empty(F.col("path"))).distinct()
    return expected.join(existing.select(F.col("path").alias("__p")), F.col("path") == F.col("__p"), "left_anti")


def missing_roles(runs: DataFrame, roles: list[str], group: str) -> DataFrame:
    """Roles that a group has no successful run of: group, role."""
    wanted = runs.select(group).distinct().select(group, F.explode(F.array(*[F.lit(r) for r in roles])).alias("role"))
    done = runs.where("status = 'success'").select(F.col(group).alias("__g"), F.col("agent_role").alias("__r")).distinct()
    return wanted.join(done, (F.col(group) == F.col("__g")) & (F.col("role") == F.col("__r")), "left_anti")


def queue_errors(queue: DataFrame, configured: list[str]) -> DataFrame:
    """Merge queues (queue_id, status, bundle_paths, lanes) -> error rows: not ready, no bundle, paths repeated, configured lanes dropped."""
    dropped = F.array_except(F.array(*[F.lit(x) for x in configured]), "lanes")
    return errors(
        queue,
        "queue",
        F.col("queue_id"),
        {
            "queue_not_ready": ~F.col("status").eqNullSafe(F.lit("ready")),
            "queue_without_bundles": F.coalesce(F.size("bundle_paths"), F.lit(0)) <= 0,
            "queue_duplicate_bundle": F.size(F.array_distinct("bundle_paths")) < F.size("bundle_paths"),
            "queue_drops_lane": F.coalesce(F.size(dropped), F.lit(1)) > 0,
        },
    )


def canonical_items(items: DataFrame, source: str) -> DataFrame:
    """Items (item_no, owner, id, canonical_name, label, node_type, start, end, chunk_id, lane_path) -> item_no, id, code: a given id stays, else it is made of the first name and the type; items without these have a code and no id."""
    name = T.first_text(F.col("canonical_name"), F.col("label"))
    made = T.node_id(F.lit(source), name, F.col("node_type"))
    lacks = name.isNull() | empty(F.col("node_type"))
    given = F.nullif("id", F.lit(""))
    return items.select("item_no", F.coalesce(given, F.when(~lacks, made)).alias("id"), F.when(given.isNull() & lacks, F.concat_ws(":", F.lit("node_missing_stable_id_fields"), "chunk_id")).alias("code"))


def provenance_union(rows: DataFrame) -> DataFrame:
    """Rows (id, ord, chunk_ids, lane_paths) -> id with both lists united in order, each value once. Values are aggregated to their first place before they are gathered, so a hot id gathers its distinct values alone; a null list has none."""
    tagged = lambda c: F.transform(c, lambda v, i: F.struct(F.lit(c).alias("list"), v.alias("value"), i.alias("place")))
    both = F.flatten(F.array_compact(F.array(tagged("chunk_ids"), tagged("lane_paths"))))
    each = rows.select("id", F.struct("ord", "chunk_ids", "lane_paths").alias("at"), F.explode_outer(both).alias("x"))
    first = each.groupBy("id", F.col("x.list").alias("list"), F.col("x.value").alias("value")).agg(F.min(F.struct("at", "x.place")).alias("o"))
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == c, F.struct("o", "value")))), lambda x: x["value"]).alias(c)
    return first.groupBy("id").agg(of("chunk_ids"), of("lane_paths"))


def phase_summary(batches: DataFrame) -> DataFrame:
    """Batches (phase, batch_id, packets) -> phase, batches, packets."""
    return batches.groupBy("phase").agg(F.count_distinct("batch_id").alias("batches"), F.sum("packets").alias("packets"))


def ledger_update(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """Ledger (template_name, status) with the status of its records where there are any."""
    r = records.select(F.col("template_name").alias("__t"), F.col("status").alias("__s"))
    return ledger.join(r, F.col("template_name") == F.col("__t"), "left").select("template_name", F.coalesce("__s", "status").alias("status"))


def remapped(requirements: DataFrame, current: DataFrame) -> DataFrame:
    """Requirements (template_name, file_key) and current keys (name, key) -> template_name, key: that of the current template, else of the file, else the name; and how many share it."""
    c = current.groupBy(F.col("name").alias("__n")).agg(F.max("key").alias("__k"))
    own = requirements.join(c, F.col("template_name") == F.col("__n"), "left").select("template_name", F.coalesce("__k", "file_key", "template_name").alias("key"))
    n = own.groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("sharing"))
    return own.join(n, F.col("key") == F.col("__key")).select("template_name", "key", "sharing")


def reuse(previous: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """Cache rows before and now (source_id, fields...) -> source_id, decision (build, reuse, rebuild), changed: the fields that differ."""
    p = previous.select(F.col("source_id").alias("__s"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = current.join(p, F.col("source_id") == F.col("__s"), "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), f) for f in fields]))
    decision = F.when(F.col("__s").isNull(), "build").when(F.size(changed) == 0, "reuse").otherwise("rebuild")
    return joined.select("source_id", decision.alias("decision"), F.when(F.col("__s").isNull(), "").otherwise(F.array_join(changed, ",")).alias("changed"))


def input_hash(rows: DataFrame, parts: list[str]) -> DataFrame:
    """source_id, hash: of the named parts as JSON with sorted keys, nulls kept."""
    return rows.select("source_id", X.stable_hash(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})).alias("hash"))


def canonical_errors(lanes: DataFrame) -> DataFrame:
    """Lists of errors (chunk_id, errors) -> chunk_id, errors: before the first of a lane the code required_lane_missing, each once."""
    each = F.flatten(F.transform("errors", lambda e: F.when(e.startswith("lane_"), F.array(F.lit("required_lane_missing"), e)).otherwise(F.array(e))))
    return lanes.select("chunk_id", F.array_join(F.array_distinct(each), ",").alias("errors"))


def failed_runs(runs: DataFrame, code: str, errors: list[str]) -> DataFrame:
    """Run records, all failed with a code and its errors."""
    return runs.withColumns({"status": F.lit("failed"), "errors": F.array(F.lit(code), *[F.lit(e) for e in errors])})


def chunk_summaries(ledger: DataFrame, key: str = "source_id") -> DataFrame:
    """Chunk ledger -> what packets and the manifest say of a chunk, without its text: key, chunk_id, source_range, chapter_hint, hash, chunk_text_path."""
    place = F.concat(F.lit("chunks/"), F.col(key).cast("string"), F.lit("/"), "chunk_id", F.lit(".txt"))
    return ledger.select(key, "chunk_id", F.array("start", "end").alias("source_range"), F.col("hint").alias("chapter_hint"), F.col("sha256").alias("hash"), place.alias("chunk_text_path"))
