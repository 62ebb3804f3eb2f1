"""Templates to documents: batches, records, drafts, rendered text, usage and gaps; reviews and requirement contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions import values as X
from evidloom.operators.evidence import ordered_distinct
from evidloom.operators.validate import empty, errors

CONTENT = 500


def template_batches(templates: DataFrame, categories: DataFrame) -> DataFrame:
    """Templates (template_name, ord) and categories (category_id, ord, templates, targets) -> template_name, category_id (the first that covers it), targets (in order, each once)."""
    covered = categories.select(F.col("ord").alias("c_ord"), "category_id", "targets", F.explode("templates").alias("t"))
    joined = templates.select("template_name").join(covered, F.col("template_name") == F.col("t"))
    first = joined.groupBy("template_name").agg(F.min(F.struct("c_ord", "category_id"))["category_id"].alias("category_id"))
    each = joined.select("template_name", "c_ord", F.posexplode("targets").alias("i", "target")).select("template_name", "target", F.struct("c_ord", "i").alias("at"))
    lists = ordered_distinct(each, ["template_name"], "target", "at", "targets").withColumnRenamed("template_name", "t2")
    return first.join(lists, F.col("template_name") == F.col("t2"), "left").select("template_name", "category_id", "targets")


def needs_batch(templates: DataFrame, previous: DataFrame, rendered: DataFrame, selection: str = "changed-or-missing") -> DataFrame:
    """Templates (template_name, sha256), earlier tasks (template_name, sha256, status), rendered targets (template_name) -> template_name, reason: new, changed, failed, target_missing; or all."""
    p = previous.select(F.col("template_name").alias("pn"), F.col("sha256").alias("ps"), "status")
    r = rendered.select(F.col("template_name").alias("rn")).distinct()
    joined = templates.join(p, F.col("template_name") == F.col("pn"), "left").join(r, F.col("template_name") == F.col("rn"), "left")
    why = F.when(F.col("pn").isNull(), "new").when(~F.col("sha256").eqNullSafe(F.col("ps")), "changed").when(F.col("status") == "failed", "failed").when(F.col("rn").isNull(), "target_missing")
    out = joined.select("template_name", (F.coalesce(why, F.lit("selected")) if selection == "all" else why).alias("reason"))
    return out.where("reason IS NOT NULL")


def cache_match(templates: DataFrame, cache: DataFrame) -> DataFrame:
    """Templates (template_name, file_name) against a cache of the same -> error rows: missing or another file."""
    c = cache.select(F.col("template_name").alias("cn"), F.col("file_name").alias("cf"))
    joined = templates.join(c, F.col("template_name") == F.col("cn"), "left")
    code = F.when(F.col("cn").isNull(), "template_missing_in_cache").when(~F.col("file_name").eqNullSafe(F.col("cf")), "template_file_mismatch")
    return joined.select("template_name", code.alias("code")).where("code IS NOT NULL")


def latest_results(results: DataFrame) -> DataFrame:
    """Agents' answers (template_name, ord, raw) -> template_name, title: of each template the last that is a JSON object; `cases` unwrapped to its first."""
    v = F.try_parse_json("raw")
    parsed = results.select("template_name", "ord", F.coalesce(F.try_variant_get(v, "$.cases[0]", "variant"), v).alias("v")).where(F.col("v").isNotNull())
    parsed = parsed.where(F.schema_of_variant("v").startswith("OBJECT"))
    title = F.try_variant_get("v", "$.title", "string")
    return parsed.groupBy("template_name").agg(F.max_by(title, F.struct("ord", title)).alias("title"))


def drafts(results: DataFrame) -> DataFrame:
    """Query results (template_name, text, nodes_found) -> template_name, content (500 characters), coverage."""
    return results.select("template_name", F.substring(F.coalesce("text", F.lit("")), 1, CONTENT).alias("content"), F.when(F.col("nodes_found") > 0, "partial").otherwise("missing").alias("coverage"))


def markdown(cases: DataFrame) -> DataFrame:
    """Draft cases (template_name, title, fields: array of (name, value), coverage, ord) -> template_name, text: a heading, bold fields, a note where the coverage isn't complete."""
    line = F.transform("fields", lambda f: F.concat(F.lit("**"), F.initcap(F.translate(f["name"], "_", " ")), F.lit("**: "), F.coalesce(f["value"], F.lit(""))))
    note = F.when(F.col("coverage") != "complete", F.array(F.concat(F.lit("> coverage: "), "coverage"))).otherwise(F.array().cast("array<string>"))
    one = F.array_join(F.concat(F.array(F.concat(F.lit("## "), "title")), line, note), "\n")
    each = cases.select("template_name", "ord", one.alias("t"))
    return each.groupBy("template_name").agg(F.concat(F.lit("# "), F.first("template_name"), F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "\n\n")).alias("text"))


def gap_report(records: DataFrame) -> DataFrame:
    """Records (template_name, ord, gap_items, not_found) -> template_name, gaps: blanks left out, in order."""
    gaps = F.filter(F.concat(F.coalesce("gap_items", F.array().cast("array<string>")), F.coalesce("not_found", F.array().cast("array<string>"))), lambda g: F.trim(g) != "")
    each = records.select("template_name", "ord", gaps.alias("g"))
    return each.groupBy("template_name").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "g"))), lambda x: x["g"])), "; ").alias("gaps"))


def evidence_usage(sections: DataFrame) -> DataFrame:
    """Sections (template_name, heading, evidence_ids) -> evidence_id, templates, uses."""
    each = sections.select("template_name", "heading", F.explode("evidence_ids").alias("evidence_id"))
    return each.groupBy("evidence_id").agg(F.count_distinct("template_name").alias("templates"), F.count("*").alias("uses"))


def record_errors(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Records (template_name, schema_name, facts, sections, evidence_ids) -> error rows; evidence must be known (evidence_id)."""
    own = errors(
        records,
        "record",
        F.col("template_name"),
        {
            "record_missing_schema": empty(F.col("schema_name")),
            "record_without_facts": F.coalesce(F.size("facts"), F.lit(0)) <= 0,
            "record_empty_fact": F.coalesce(F.exists("facts", lambda f: F.coalesce(F.trim(f), F.lit("")) == ""), F.lit(False)),
            "record_without_sections": F.coalesce(F.size("sections"), F.lit(0)) <= 0,
        },
    )
    refs = records.select("template_name", F.explode(F.array_distinct("evidence_ids")).alias("ref"))
    lost = refs.join(evidence.select(F.col("evidence_id").alias("e")).distinct(), F.col("ref") == F.col("e"), "left_anti")
    return own.unionByName(lost.select(F.lit("record").alias("scope"), F.col("template_name").cast("string").alias("item_id"), F.concat_ws(":", F.lit("record_unknown_evidence"), "ref").alias("code")).distinct())


def finding_errors(findings: DataFrame, severities: list[str], statuses: list[str], depth: int = 20) -> DataFrame:
    """Review findings (finding_id, severity, status, repair_required, probe JSON) -> error rows."""
    return errors(
        findings,
        "finding",
        F.col("finding_id"),
        {
            "finding_bad_severity": ~F.coalesce(F.col("severity").isin(severities), F.lit(False)),
            "finding_bad_status": ~F.coalesce(F.col("status").isin(statuses), F.lit(False)),
            "finding_repair_not_boolean": F.col("repair_required").isNull(),
            "finding_probe_invalid": F.try_parse_json("probe").isNull(),
            "finding_probe_too_deep": F.coalesce(X.json_depth(F.col("probe")) > depth, F.lit(False)),
        },
    )


def review_gate(chunks: DataFrame, reviews: DataFrame, accepted: list[str]) -> DataFrame:
    """Chunk lanes (chunk_id, lane_id) and reviews (chunk_id, lane_id, status, ord; the last counts) -> chunk_id, lane_id, code of those that don't pass."""
    last = reviews.groupBy(F.col("chunk_id").alias("rc"), F.col("lane_id").alias("rl")).agg(F.max_by("status", F.struct("ord", "status")).alias("status"))
    joined = chunks.join(last, (F.col("chunk_id") == F.col("rc")) & (F.col("lane_id") == F.col("rl")), "left")
    code = F.when(F.col("rc").isNull(), "review_missing").when(~F.coalesce(F.col("status").isin(accepted), F.lit(False)), "review_not_passed")
    return joined.select("chunk_id", "lane_id", code.alias("code")).where("code IS NOT NULL")


def bundles(outputs: DataFrame) -> DataFrame:
    """Lane outputs (chunk_id, lane_id, own_chunk_id, items, ord) -> chunk_id, lanes, n_items, foreign: outputs that name another chunk count as foreign and give no items."""
    own = F.col("own_chunk_id").eqNullSafe(F.col("chunk_id"))
    lanes = F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("ord", "lane_id")))), lambda x: x["lane_id"])
    return outputs.groupBy("chunk_id").agg(F.array_join(F.array_distinct(lanes), ",").alias("lanes"), F.sum(F.when(own, F.col("items")).otherwise(0)).alias("n_items"), F.count_if(~own).alias("foreign"))


def summary_errors(categories: DataFrame, sources: DataFrame, passes: Column | int = 3) -> DataFrame:
    """Requirement categories (category_id, passes, templates) and source templates (template_name) -> error rows: passes other than 3, repeated ids, templates covered nowhere or unknown."""
    bad = errors(categories, "category", F.col("category_id"), {"summary_passes_invalid": ~F.col("passes").eqNullSafe(F.lit(3)), "category_without_templates": F.coalesce(F.size("templates"), F.lit(0)) <= 0})
    again = categories.groupBy("category_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("category").alias("scope"), F.col("category_id").cast("string").alias("item_id"), F.lit("category_id_duplicate").alias("code"))
    named = categories.select(F.explode("templates").alias("t")).distinct()
    s = sources.select("template_name").distinct()
    both = s.join(named, F.col("template_name") == F.col("t"), "full").where("template_name IS NULL OR t IS NULL")
    lost = both.select(F.lit("template").alias("scope"), F.coalesce("template_name", "t").alias("item_id"), F.when(F.col("t").isNull(), "template_not_covered").otherwise("template_unknown").alias("code"))
    return bad.unionByName(again).unionByName(lost)


def dense_sequence(batches: DataFrame, group: str) -> DataFrame:
    """Batch numbers (group, n) that aren't 1..max each once: group, code."""
    seen = batches.groupBy(group).agg(F.max("n").alias("most"), F.min("n").alias("least"), F.count_distinct("n").alias("k"), F.count("*").alias("rows"))
    code = F.when(F.col("rows") > F.col("k"), "batch_sequence_duplicate").when((F.col("least") != 1) | (F.col("most") != F.col("k")), "batch_sequence_gap")
    return seen.select(group, code.alias("code")).where("code IS NOT NULL")
