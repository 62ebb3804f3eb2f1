"""Validators: every rule gives error rows (scope, item_id, code); nothing is thrown and no row is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(rows: DataFrame, scope: str, item_id: Column, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule (code -> a condition that is an error) that a row breaks."""
    codes = F.array_compact(F.array(*[F.when(bad, code) for code, bad in rules.items()]))
    return rows.select(F.lit(scope).alias("scope"), item_id.cast("string").alias("item_id"), F.explode(codes).alias("code"))


def empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def bad_range(start: Column, end: Column) -> Column:
    """Both ends or none, from 0, in order."""
    return (start.isNull() != end.isNull()) | (start < 0) | (end < start)


def item_errors(items: DataFrame, scope: str, *, prefix: str, statuses: list[str], confidences: list[str]) -> DataFrame:
    """Items (id, label, start, end, evidence_ids, confidence, verification_status): identity, label, locator, evidence, enums."""
    located = F.col("start").isNotNull() | F.col("end").isNotNull()
    return errors(
        items,
        scope,
        F.col("id"),
        {
            f"{scope}_missing_id": empty(F.col("id")),
            f"{scope}_bad_id": ~empty(F.col("id")) & ~F.col("id").startswith(prefix),
            f"{scope}_missing_label": empty(F.col("label")),
            f"{scope}_missing_locator": ~located,
            f"{scope}_bad_range": located & F.coalesce(bad_range(F.col("start"), F.col("end")), F.lit(True)),
            f"{scope}_missing_evidence": F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0,
            f"{scope}_bad_confidence": ~F.coalesce(F.col("confidence").isin(confidences), F.lit(False)),
            f"{scope}_bad_verification_status": ~F.coalesce(F.col("verification_status").isin(statuses), F.lit(False)),
        },
    )


def dangling(refs: DataFrame, known: DataFrame, scope: str, code: str) -> DataFrame:
    """References (item_id, ref) to nothing in known (id): an anti-join."""
    missing = refs.where("ref IS NOT NULL").join(known.select(F.col("id").alias("__id")), F.col("ref") == F.col("__id"), "left_anti")
    return missing.select(F.lit(scope).alias("scope"), F.col("item_id").cast("string").alias("item_id"), F.concat_ws(":", F.lit(code), "ref").alias("code")).distinct()


def outside(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """Items (item_id, chunk_id, start, end) that reach outside their chunk (chunk_id, chunk_start, chunk_end), or have none: error rows."""
    known = ranges.select(F.col("chunk_id").alias("__c"), "chunk_start", "chunk_end")
    joined = items.join(known, F.col("chunk_id") == F.col("__c"), "left")
    return errors(
        joined,
        "range",
        F.col("item_id"),
        {
            "chunk_unknown": F.col("__c").isNull(),
            "source_range_invalid": F.coalesce(bad_range(F.col("start"), F.col("end")), F.lit(True)),
            "source_range_outside_chunk": F.col("__c").isNotNull() & ((F.col("start") < F.col("chunk_start")) | (F.col("end") > F.col("chunk_end"))),
        },
    )


def duplicate_ids(items: DataFrame, scope: str) -> DataFrame:
    again = items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 AND id IS NOT NULL")
    return again.select(F.lit(scope).alias("scope"), F.col("id").cast("string").alias("item_id"), F.lit(f"{scope}_duplicate_id").alias("code"))


def single_writer(outputs: DataFrame, scopes: DataFrame) -> DataFrame:
    """outputs and scopes (run_id, path) -> errors: a path that two runs write or claim, an output of one in another's scope.

    Owners are counted for each path; only two owners' extremes are compared, never all pairs of them.
    """
    several = lambda d, code: d.groupBy("path").agg(F.min("run_id").alias("a"), F.max("run_id").alias("b")).where("a <> b").select(F.lit("writer").alias("scope"), F.col("path").alias("item_id"), F.lit(code).alias("code"))
    held = scopes.groupBy(F.col("path").alias("__p")).agg(F.min("run_id").alias("a"), F.max("run_id").alias("b"))
    foreign = outputs.join(held, F.col("path") == F.col("__p")).where((F.col("a") != F.col("run_id")) | (F.col("b") != F.col("run_id")))
    foreign = foreign.select(F.lit("writer").alias("scope"), F.col("path").alias("item_id"), F.lit("output_in_foreign_scope").alias("code")).distinct()
    return several(outputs, "duplicate_output_path").unionByName(several(scopes, "duplicate_write_scope")).unionByName(foreign)


def repair_errors(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings (finding_id, status, repair_required, repair_run_id) and runs (run_id, repair_of): open findings without a repair, repairs by an unknown run or one that repairs nothing, one run for several findings."""
    r = runs.select(F.col("run_id").alias("__r"), "repair_of")
    joined = findings.join(r, F.col("repair_run_id") == F.col("__r"), "left")
    one = errors(
        joined,
        "finding",
        F.col("finding_id"),
        {
            "repair_missing": (F.col("status") == "open") & F.col("repair_required") & F.col("repair_run_id").isNull(),
            "repair_run_unknown": F.col("repair_run_id").isNotNull() & F.col("__r").isNull(),
            "repair_run_not_fresh": F.col("__r").isNotNull() & F.col("repair_of").isNull(),
        },
    )
    again = findings.where("repair_run_id IS NOT NULL").groupBy("repair_run_id").agg(F.count("*").alias("n")).where("n > 1")
    return one.unionByName(again.select(F.lit("run").alias("scope"), F.col("repair_run_id").cast("string").alias("item_id"), F.lit("repair_run_reused").alias("code")))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, each once: key, side."""
    l, r = left.select(key).distinct(), right.select(F.col(key).alias("__k")).distinct()  # noqa: E741
    both = l.join(r, F.col(key) == F.col("__k"), "full").where(F.col(key).isNull() | F.col("__k").isNull())
    return both.select(F.coalesce(key, "__k").alias(key), F.when(F.col("__k").isNull(), "left_only").otherwise("right_only").alias("side"))


def required_lanes(chunks: DataFrame, outputs: DataFrame, lanes: list[str]) -> DataFrame:
    """Chunks (chunk_id) and lane outputs (chunk_id, lane_id, status, failures) -> for each required lane that isn't completed: chunk_id, lane_id, reason."""
    wanted = chunks.select("chunk_id").distinct().select("chunk_id", F.explode(F.array(*[F.lit(x) for x in lanes])).alias("lane_id"))
    seen = outputs.groupBy(F.col("chunk_id").alias("__c"), F.col("lane_id").alias("__l")).agg(F.bool_or(F.col("status") == "completed").alias("done"), F.bool_or(F.col("failures") > 0).alias("failed"))
    joined = wanted.join(seen, (F.col("chunk_id") == F.col("__c")) & (F.col("lane_id") == F.col("__l")), "left")
    reason = F.when(F.col("__c").isNull(), "required_lane_missing").when(F.col("done"), None).when(F.col("failed"), "required_lane_failed").otherwise("required_lane_not_completed")
    return joined.select("chunk_id", "lane_id", reason.alias("reason")).where("reason IS NOT NULL")


def json_errors(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows (item_id, raw JSON) against fields {name: strict type}: unparsable, no object, field missing, null, empty or of another type.

    Types are those of the parsed value (schema_of_variant), so true is no number and 1.0 no integer.
    """
    v = F.try_parse_json("raw")
    parsed = rows.select("item_id", "raw", v.alias("v"))
    shape = F.schema_of_variant("v")
    rules = {"invalid_json": F.col("v").isNull(), "not_an_object": F.col("v").isNotNull() & ~shape.startswith("OBJECT")}
    named = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}
    for name, kind in fields.items():
        value = F.try_variant_get("v", f"$.{name}", "variant")
        own = F.schema_of_variant(value)
        there = F.col("v").isNotNull() & shape.startswith("OBJECT")
        rules[f"field_missing:{name}"] = there & value.isNull()
        rules[f"field_type:{name}"] = there & value.isNotNull() & ~(own.startswith("ARRAY") if kind == "array" else own == named[kind])
        if kind == "string":
            rules[f"field_empty:{name}"] = there & (F.try_variant_get("v", f"$.{name}", "string") == "") & (own == "STRING")
    return errors(parsed, "json", F.col("item_id"), rules)
