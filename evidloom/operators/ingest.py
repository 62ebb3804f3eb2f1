"""Reviews read, links reconciled, outputs gated and flattened, states decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.operators.merge import latest


def review_rows(files: DataFrame) -> DataFrame:
    """Review files (chunk_id, lane_id, ord, raw JSON): a list, or an object with it under `reviews`, else `findings` -> chunk_id, lane_id, ord, status, severity: ids missing in an entry are the file's; a file of another form gives none."""
    v = F.try_parse_json("raw")
    schema = "array<struct<chunk_id:string,lane_id:string,status:string,severity:string>>"
    entries = F.coalesce(F.try_variant_get(v, "$.reviews", schema), F.try_variant_get(v, "$.findings", schema), F.try_variant_get(v, "$", schema))
    each = files.select(F.col("chunk_id").alias("c"), F.col("lane_id").alias("l"), "ord", F.posexplode(entries).alias("i", "e"))
    return each.select(F.coalesce("e.chunk_id", "c").alias("chunk_id"), F.coalesce("e.lane_id", "l").alias("lane_id"), F.struct("ord", "i").alias("ord"), F.col("e.status").alias("status"), F.col("e.severity").alias("severity"))


def review_statuses(reviews: DataFrame) -> DataFrame:
    """The last status of each chunk and lane."""
    stated = reviews.where("status IS NOT NULL").select("chunk_id", "lane_id", "ord", "status")
    return latest(stated, ["chunk_id", "lane_id"], F.col("ord")).select("chunk_id", "lane_id", "status")


def evidence_links(graph: DataFrame, coverage: DataFrame) -> DataFrame:
    """Evidence of the graph and of the coverage ledger (evidence_id, digest) -> evidence_id, code of what only one has or has otherwise."""
    g, c = graph.select(F.col("evidence_id").alias("g"), F.col("digest").alias("gd")), coverage.select(F.col("evidence_id").alias("c"), F.col("digest").alias("cd"))
    both = g.join(c, F.col("g") == F.col("c"), "full")
    code = F.when(F.col("c").isNull(), "evidence_missing_in_coverage").when(F.col("g").isNull(), "evidence_missing_in_graph").when(~F.col("gd").eqNullSafe(F.col("cd")), "evidence_differs")
    return both.select(F.coalesce("g", "c").alias("evidence_id"), code.alias("code")).where("code IS NOT NULL")


def completeness(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """Ledger (template_name, status) and valid records (template_name) -> template_name, code: not rendered, rendered without a record, records of no template."""
    r = records.select(F.col("template_name").alias("r")).distinct()
    both = ledger.join(r, F.col("template_name") == F.col("r"), "full")
    code = F.when(F.col("template_name").isNull(), "record_without_template").when(F.col("status") != "rendered", "template_not_rendered").when(F.col("r").isNull(), "template_without_record")
    return both.select(F.coalesce("template_name", "r").alias("template_name"), code.alias("code")).where("code IS NOT NULL")


def looked_up(rows: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Rows (row_id, ref) with the value of the last entry (id or alt_id, ord) of the table: its id counts, else its alt_id."""
    last = latest(table.select(F.coalesce(F.nullif("id", F.lit("")), "alt_id").alias("k"), "ord", value).where("k IS NOT NULL"), ["k"], F.col("ord"))
    return rows.join(last.select("k", value), F.col("ref") == F.col("k"), "left").select("row_id", value)


def reconciled(ledger: DataFrame, packets: DataFrame, fields: list[str]) -> DataFrame:
    """Ledger and packets (packet_id, fields...) -> packet_id, code: in one only, or a field that differs."""
    p = packets.select(F.col("packet_id").alias("__p"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = ledger.join(p, F.col("packet_id") == F.col("__p"), "full")
    differs = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), f) for f in fields])), ",")
    code = F.when(F.col("__p").isNull(), "packet_missing").when(F.col("packet_id").isNull(), "ledger_entry_missing").when(differs != "", F.concat(F.lit("packet_differs:"), differs))
    return both.select(F.coalesce("packet_id", "__p").alias("packet_id"), code.alias("code")).where("code IS NOT NULL")


def stage_state(manifests: DataFrame) -> DataFrame:
    """Manifests (source_id, found, valid, blocked, same_config, status) -> source_id, state: build, rebuild or reuse, and why."""
    why = (
        F.when(~F.col("found"), "no_manifest").when(F.col("blocked"), "blocking_failure").when(~F.col("same_config"), "config_changed").when(~F.col("status").eqNullSafe("success"), "not_successful").when(~F.col("valid"), "graph_invalid").otherwise("valid")
    )
    return manifests.select("source_id", F.when(why == "no_manifest", "build").when(why == "valid", "reuse").otherwise("rebuild").alias("state"), why.alias("why"))


def record_claims(running: DataFrame, records: DataFrame) -> DataFrame:
    """Running batches (batch_id) and their records (batch_id, n_errors) -> batch_id, status, errors: completed only by a valid record; errors stay with a running batch."""
    r = records.groupBy(F.col("batch_id").alias("__b")).agg(F.min("n_errors").alias("n"))
    joined = running.join(r, F.col("batch_id") == F.col("__b"), "left")
    return joined.select("batch_id", F.when(F.col("n") == 0, "completed").otherwise("running").alias("status"), F.coalesce("n", F.lit(0)).alias("errors"))


def ingested(bundles: DataFrame, outputs: DataFrame, lanes: list[str], accepted: list[str]) -> DataFrame:
    """Bundles (chunk_id, reviewer_status) and outputs (chunk_id, lane_id, status, n_items) -> chunk_id, ok, reasons, n_items: what the gate lets through of each bundle."""
    done = outputs.where("status = 'completed'").groupBy(F.col("chunk_id").alias("__c")).agg(F.collect_set(F.when(F.col("lane_id").isin(lanes), F.col("lane_id"))).alias("lanes"), F.sum("n_items").alias("n"))
    joined = bundles.join(done, F.col("chunk_id") == F.col("__c"), "left")
    lacks = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in lanes]), F.coalesce("lanes", F.array().cast("array<string>"))))
    review = F.when(F.col("reviewer_status").isNull(), F.array(F.lit("review_missing"))).when(~F.col("reviewer_status").isin(accepted), F.array(F.lit("review_not_passed"))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(review, F.transform(lacks, lambda x: F.concat(F.lit("required_lane_missing:"), x)))
    ok = F.size(reasons) == 0
    return joined.select("chunk_id", ok.alias("ok"), F.array_join(reasons, ",").alias("reasons"), F.when(ok, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_items"))
