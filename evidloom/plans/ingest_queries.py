"""Ingest, reconciliation and state queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.operators import ingest as I
from evidloom.plans.text_queries import table


def _reviews(spark, sf_dir):
    x = table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    status = F.when(F.col("quality") == 1, "passed").otherwise("failed")
    entry = F.concat(F.lit('{"status":"'), status, F.lit('","severity":"s'), F.col("toxic"), F.lit('"'), F.when(k % 5 == 0, F.lit(',"chunk_id":"other"')).otherwise(""), F.lit("}"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("["), entry, F.lit("]"))).when(k % 4 == 1, F.concat(F.lit('{"reviews":['), entry, F.lit(","), entry, F.lit("]}"))).when(k % 4 == 2, F.concat(F.lit('{"findings":['), entry, F.lit("]}"))).otherwise(F.lit("{broken"))
    return I.review_rows(x.select(F.concat(F.lit("c"), k).alias("chunk_id"), F.lit("main").alias("lane_id"), k.alias("ord"), raw.alias("raw")))


def src_10_review_rows(spark, sf_dir):
    return _reviews(spark, sf_dir).select("chunk_id", "lane_id", F.col("ord.ord").alias("file"), F.col("ord.i").cast("long").alias("place"), "status", "severity")


def src_10_review_statuses(spark, sf_dir):
    return I.review_statuses(_reviews(spark, sf_dir))


def val_12_evidence_links(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    of = lambda m, n: d.where(k % m != 0).select(F.concat(F.lit("e"), k).alias("evidence_id"), F.when(k % n == 0, "x").otherwise(F.md5("text")).alias("digest"))
    return I.evidence_links(of(7, 11), of(5, 13))


def val_21_completeness(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return I.completeness(c.where(k % 9 != 0).select(k.alias("template_name"), F.when(k % 4 == 0, "pending").otherwise("rendered").alias("status")), c.where(k % 5 != 0).select(k.alias("template_name")))


def jn_04_looked_up(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    entries = e.select(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), "user_id")).alias("id"), F.concat(F.lit("a"), "user_id").alias("alt_id"), F.col("event_id").alias("ord"), "event_type")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "u").otherwise("a"), F.col("c_custkey") % 200).alias("ref"))
    return I.looked_up(rows, entries, "event_type")


def jn_13_reconciled(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    of = lambda m, n, a: p.where(k % m != 0).select(k.alias("packet_id"), F.when(k % n == 0, a).alias("hint"), (k + F.when(k % (n + 1) == 0, len(a)).otherwise(0)).alias("start"))
    return I.reconciled(of(7, 3, "h"), of(5, 4, "hh"), ["hint", "start"])


def inc_05_stage_state(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return I.stage_state(o.select(k.alias("source_id"), (k % 5 != 0).alias("found"), (k % 11 != 0).alias("valid"), (k % 13 == 0).alias("blocked"), (k % 3 != 0).alias("same_config"), F.when(k % 7 == 0, None).otherwise("success").alias("status")))


def dsp_02_record_claims(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return I.record_claims(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id")), li.where("l_linenumber > 2").select(F.col("l_orderkey").alias("batch_id"), (F.col("l_partkey") % 3).alias("n_errors")))


def mrg_09_ingested(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    bundles = e.select(u.alias("chunk_id")).distinct().select("chunk_id", F.when(F.col("chunk_id") % 6 != 0, F.when(F.col("chunk_id") % 7 == 0, "failed").otherwise("passed")).alias("reviewer_status"))
    outputs = e.select(u.alias("chunk_id"), F.col("event_type").alias("lane_id"), F.when((u % 5 == 0) & (F.col("event_type") == "click"), "failed").otherwise("completed").alias("status"), (F.col("event_id") % 3).alias("n_items"))
    return I.ingested(bundles, outputs, ["view", "click"], ["passed"])


QUERIES = {f.__name__: f for f in (src_10_review_rows, src_10_review_statuses, val_12_evidence_links, val_21_completeness, jn_04_looked_up, jn_13_reconciled, inc_05_stage_state, dsp_02_record_claims, mrg_09_ingested)}

_REVIEWS = """r AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE 'c' || doc_id END AS chunk_id, 'main' AS lane_id, doc_id AS file, unnest(CASE doc_id % 4 WHEN 1 THEN [0, 1] WHEN 3 THEN [] ELSE [0] END)::BIGINT AS place, CASE WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS status, 's' || toxic AS severity FROM labels)"""
ORACLES = {
    "src_10_review_rows": f"WITH {_REVIEWS} SELECT * FROM r",
    "src_10_review_statuses": f"WITH {_REVIEWS} SELECT chunk_id, lane_id, arg_max(status, file * 10 + place) AS status FROM r GROUP BY ALL",
    "val_12_evidence_links": """SELECT 'e' || doc_id AS evidence_id, CASE WHEN doc_id % 5 = 0 THEN 'evidence_missing_in_coverage' WHEN doc_id % 7 = 0 THEN 'evidence_missing_in_graph' ELSE 'evidence_differs' END AS code FROM documents
WHERE doc_id % 35 <> 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0 OR (doc_id % 11 = 0) <> (doc_id % 13 = 0))""",
    "val_21_completeness": "SELECT c_custkey AS template_name, CASE WHEN c_custkey % 9 = 0 THEN 'record_without_template' WHEN c_custkey % 4 = 0 THEN 'template_not_rendered' ELSE 'template_without_record' END AS code FROM customer WHERE CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 5 <> 0 ELSE c_custkey % 4 = 0 OR c_custkey % 5 = 0 END",
    "jn_04_looked_up": """WITH t AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'u' END || user_id AS k, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1)
SELECT c_custkey AS row_id, event_type FROM customer LEFT JOIN t ON k = CASE WHEN c_custkey % 2 = 0 THEN 'u' ELSE 'a' END || (c_custkey % 200)""",
    "jn_13_reconciled": """WITH x AS (SELECT p_partkey AS k, (k % 3 = 0) OR (k % 4 = 0) AS h, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END <> CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS s FROM part WHERE p_partkey % 35 <> 0)
SELECT k AS packet_id, CASE WHEN k % 5 = 0 THEN 'packet_missing' WHEN k % 7 = 0 THEN 'ledger_entry_missing' ELSE 'packet_differs:' || concat_ws(',', CASE WHEN h THEN 'hint' END, CASE WHEN s THEN 'start' END) END AS code FROM x WHERE k % 5 = 0 OR k % 7 = 0 OR h OR s""",
    "inc_05_stage_state": """WITH w AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'no_manifest' WHEN o_orderkey % 13 = 0 THEN 'blocking_failure' WHEN o_orderkey % 3 = 0 THEN 'config_changed' WHEN o_orderkey % 7 = 0 THEN 'not_successful' WHEN o_orderkey % 11 = 0 THEN 'graph_invalid' ELSE 'valid' END AS why FROM orders)
SELECT k AS source_id, CASE why WHEN 'no_manifest' THEN 'build' WHEN 'valid' THEN 'reuse' ELSE 'rebuild' END AS state, why FROM w""",
    "dsp_02_record_claims": "SELECT o_orderkey AS batch_id, CASE WHEN n = 0 THEN 'completed' ELSE 'running' END AS status, coalesce(n, 0)::BIGINT AS errors FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey % 3) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) ON l_orderkey = o_orderkey",
    "mrg_09_ingested": """WITH o AS (SELECT user_id, event_type, event_id FROM events WHERE NOT (user_id % 5 = 0 AND event_type = 'click')), l AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, sum(event_id % 3) AS n FROM o GROUP BY 1),
b AS (SELECT DISTINCT user_id AS u FROM events), x AS (SELECT u, concat_ws(',', CASE WHEN u % 6 = 0 THEN 'review_missing' WHEN u % 7 = 0 THEN 'review_not_passed' END, CASE WHEN NOT coalesce(c, false) THEN 'required_lane_missing:click' END, CASE WHEN NOT coalesce(v, false) THEN 'required_lane_missing:view' END) AS reasons, n FROM b LEFT JOIN l ON u = user_id)
SELECT u AS chunk_id, reasons = '' AS ok, reasons, CASE WHEN reasons = '' THEN coalesce(n, 0) ELSE 0 END::BIGINT AS n_items FROM x""",
}
