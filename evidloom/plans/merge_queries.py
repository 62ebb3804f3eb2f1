"""Merge, validation, dispatch and incremental queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.functions import text as T
from evidloom.operators import dispatch as D
from evidloom.operators import merge as M
from evidloom.operators import validate as V
from evidloom.plans.text_queries import ledger, table

LANES = ("click", "view", "purchase")


def _items(spark, sf_dir):
    """Documents as items: a key from their first 40 characters, so that copies meet; their body is a hash of the text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.md5(F.substring("text", 1, 40)).alias("id"), F.col("doc_id").alias("bundle_no"), F.lit(0).cast("long").alias("item_no"), F.md5("text").alias("body"), "lang", F.concat(F.lit("chunk-"), "doc_id").alias("chunk"))


def _merged(spark, sf_dir):
    return M.merge_items(_items(spark, sf_dir), key="id", order=["bundle_no", "item_no"], body=["body", "lang"], provenance="chunk")


def mrg_01_canonical_merge(spark, sf_dir):
    return _merged(spark, sf_dir)["kept"].select("id", "body", "lang", F.array_join("provenance", ",").alias("provenance"))


def mrg_01_conflicts(spark, sf_dir):
    return _merged(spark, sf_dir)["conflicts"].select("id", "bundle_no", "kept_from", "conflicting", "reason")


def mrg_03_merge_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    x = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    b = d.join(x, F.col("doc_id") == F.col("l_id"), "left")
    b = b.select(F.col("doc_id").alias("bundle_id"), (F.col("source") != "src3").alias("ready"), F.when(F.col("quality") == 1, "passed").when(F.col("quality") == 0, "failed").alias("reviewer_status"), F.when(F.col("doc_id") % 10 == 0, "passed").alias("gate_status"), F.col("toxic").alias("open_must_fix"))
    return M.merge_gate(b, statuses=["passed", "waived"])


def agg_06_review_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("value") > 140, "needs_incremental").when(F.col("event_id") % 41 == 0, "review_failed").when(F.col("event_id") % 5 == 0, "unreviewed").otherwise("reviewed")
    return M.graph_review_status(e.select(F.col("user_id").alias("graph_id"), state.alias("state")))


def top_04_latest_attempt(spark, sf_dir):
    """The latest attempt of each user and event type, paths compared as strings (TOP-04, SRC-09)."""
    e = table(spark, sf_dir, "events")
    path = F.format_string("%d/%s/run-%03d.json", "user_id", "event_type", F.col("event_id") % 1500)
    return M.latest(e.select("user_id", "event_type", path.alias("path"), "event_id"), ["user_id", "event_type"], F.struct("path", "event_id"))


def mrg_05_supplement(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_nationkey").cast("string").alias("place"))
    extra = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("label"), F.concat(F.lit("s"), "s_nationkey").alias("place"))
    return M.supplement(base, extra, "id", ["label", "place"])


def mrg_08_requirements_overlay(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.md5("text").alias("value"))
    current = b.select("key", F.col("key").alias("ord"))
    return M.overlay(current, b.where("key % 3 = 0").select("key", F.upper("value").alias("value")), b.where("key % 3 = 1"), "key", "value")


def _graph_items(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.when(k % 37 == 0, "").when(k % 29 == 0, F.concat(F.lit("x:"), k)).otherwise(F.concat(F.lit("node:part:"), k % 5000)).alias("id"),
        F.when(k % 31 == 0, None).otherwise(F.col("p_name")).alias("label"),
        F.when(k % 23 == 0, None).otherwise(k - F.when(k % 19 == 0, 10**6).otherwise(0)).alias("start"),
        F.when(k % 23 == 0, None).when(k % 17 == 0, k - 1).otherwise(k + 9).alias("end"),
        F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("evidence:"), k % 150), F.concat(F.lit("evidence:"), k))).alias("evidence_ids"),
        F.when(k % 11 == 0, "sure").otherwise("high").alias("confidence"),
        F.when(k % 7 == 0, None).otherwise("verified").alias("verification_status"),
    )


def val_02_item_errors(spark, sf_dir):
    """Rules of nodes, broken by rule (VAL-01, VAL-02, VAL-22, VAL-28)."""
    return V.item_errors(_graph_items(spark, sf_dir), "node", prefix="node:", statuses=["verified", "unverified"], confidences=["high", "medium", "low"])


def val_02_duplicate_ids(spark, sf_dir):
    return V.duplicate_ids(_graph_items(spark, sf_dir), "node")


def jn_01_dangling_evidence(spark, sf_dir):
    """Evidence named by nodes that is no customer's: all customers are known, and there are more parts than customers."""
    refs = _graph_items(spark, sf_dir).select(F.col("id").alias("item_id"), F.explode("evidence_ids").alias("ref"))
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("evidence:"), "c_custkey").alias("id"))
    return V.dangling(refs, known, "node", "dangling_evidence")


def jn_02_dangling_ends(spark, sf_dir):
    """Order lines whose part or supplier isn't a node: parts whose key 13 divides and suppliers whose key 9 divides are none."""
    e = table(spark, sf_dir, "lineitem")
    ends = e.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), F.explode(F.array(F.concat(F.lit("part:"), "l_partkey"), F.concat(F.lit("supplier:"), "l_suppkey"))).alias("ref"))
    parts = table(spark, sf_dir, "part").where("p_partkey % 13 <> 0").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    suppliers = table(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 0").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))
    return V.dangling(ends, parts.unionByName(suppliers), "edge", "dangling_end")


def jn_03_range_containment(spark, sf_dir):
    """Ranges against the whole chunk ledger; every ninth document names chunk-0099, which only very long ones have."""
    c = ledger(spark, sf_dir).select(F.concat_ws(":", "source_id", "chunk_id").alias("chunk_id"), F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"))
    d = table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    items = d.select(F.col("doc_id").alias("item_id"), F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, ":chunk-0099").otherwise(":chunk-0001")).alias("chunk_id"), (n % 50).alias("start"), F.when(F.col("doc_id") % 8 == 0, None).otherwise((n * 7) % 3000).alias("end"))
    return V.outside(items, c)


def val_05_required_lanes(spark, sf_dir):
    """Required lanes that users lack (VAL-05, VAL-30)."""
    e = table(spark, sf_dir, "events")
    chunks = e.select(F.col("user_id").alias("chunk_id"))
    outputs = e.where("user_id % 7 <> 0 OR event_type <> 'view'").select(F.col("user_id").alias("chunk_id"), F.col("event_type").alias("lane_id"), F.when((F.col("user_id") % 5 == 0) & (F.col("event_type") == "click"), "blocked").otherwise("completed").alias("status"), F.when(F.col("user_id") % 10 == 0, 1).otherwise(0).alias("failures"))
    return V.required_lanes(chunks, outputs, list(LANES))


def val_18_single_writer(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    outputs = o.select((F.col("o_orderkey") % 400).alias("run_id"), F.concat(F.lit("out/"), (F.col("o_orderkey") % 400) * 3 + F.when(F.col("o_custkey") % 97 == 0, 1).otherwise(0)).alias("path"))
    scopes = o.select((F.col("o_orderkey") % 400).alias("run_id"), F.concat(F.lit("out/"), (F.col("o_orderkey") % 400) * 3 + F.when(F.col("o_custkey") % 89 == 0, 4).otherwise(0)).alias("path"))
    return V.single_writer(outputs, scopes)


def val_19_repairs(spark, sf_dir):
    """Findings against repair runs: all customers are runs, those with an even key repairs."""
    x = table(spark, sf_dir, "labels")
    findings = x.select(F.col("doc_id").alias("finding_id"), F.when(F.col("toxic") == 1, "open").otherwise("closed").alias("status"), (F.col("quality") == 1).alias("repair_required"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 500).alias("repair_run_id"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") + 1).alias("repair_of"))
    return V.repair_errors(findings, runs)


def val_03_json_contract(spark, sf_dir):
    """The events' JSON against a contract with strict types; some of it is damaged by rule (VAL-03, VAL-06, SRC-07)."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    raw = (
        F.when(k % 50 == 0, F.lit("{oops")).when(k % 50 == 1, F.lit("[1]")).when(k % 50 == 2, F.lit('{"code":"","attempt":1}')).when(k % 50 == 3, F.lit('{"code":"a","attempt":true}'))
        .when(k % 50 == 4, F.lit('{"code":"a","attempt":1.0}')).when(k % 50 == 5, F.lit('{"code":7,"attempt":2}')).when(k % 50 == 6, F.lit('{"attempt":2}')).otherwise(F.lit('{"code":"ok","attempt":3}'))
    )
    return V.json_errors(e.select(k.alias("item_id"), raw.alias("raw")), {"code": "string", "attempt": "integer"})


def set_02_set_difference(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_partkey").alias("key"))
    b = table(spark, sf_dir, "lineitem").where("l_quantity < 5").select(F.col("l_partkey").alias("key"))
    return V.set_difference(a, b, "key")


def _lanes(spark):
    return spark.createDataFrame([(i, x, f"{x}-agent", x != "view") for i, x in enumerate(LANES)], "lane_no int, lane_id string, agent_role string, required boolean")


def _packets(spark, sf_dir):
    return D.task_packets(ledger(spark, sf_dir), _lanes(spark))


def prj_02_task_packets(spark, sf_dir):
    return _packets(spark, sf_dir).select("source_id", "chunk_no", "lane_id", "agent_role", "packet_id")


def prj_07_batches(spark, sf_dir):
    return D.batches(_packets(spark, sf_dir), 2, ["source_id", "lane_no"], ["chunk_no"]).select("packet_id", "batch_no")


def _state(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("batch_id"), F.when(k % 3 == 0, "running").when(k % 3 == 1, "completed").otherwise("pending").alias("status"), F.when(k % 3 != 2, F.col("o_custkey")).alias("claimed_at"), F.concat(F.lit("agent-"), F.col("o_custkey") % 3).alias("agent"))


def dsp_01_transitions(spark, sf_dir):
    outputs = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("batch_id"), (F.col("o_orderkey") % 5 != 0).alias("complete"))
    return D.transitions(_state(spark, sf_dir), outputs)


def win_07_claims(spark, sf_dir):
    """What each agent may claim within its capacity, 4 to 6 places above what it runs, and 12 in all (WIN-07, TOP-03, DSP-01)."""
    s = _state(spark, sf_dir)
    running = s.where("status = 'running'").groupBy("agent").agg(F.count("*").alias("n"))
    capacity = s.groupBy("agent").agg((F.count_if(F.col("status") == "running") + 4 + F.right("agent", F.lit(1)).cast("long")).alias("cap"))
    return D.claims(s.where("status = 'pending'").select("batch_id", "agent", F.col("batch_id").alias("ord")), running, capacity, 12)


def win_06_serial_gate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    status = F.when((F.col("l_linenumber") == 1) | (F.col("l_partkey") % 5 == 0), "completed").when(F.col("l_suppkey") % 6 == 0, "running").otherwise("pending")
    return D.serial_next(li.select(F.col("l_orderkey").alias("phase"), F.col("l_linenumber").alias("ord"), status.alias("status")), "phase")


def agg_05_status_counts(spark, sf_dir):
    return D.status_counts(_state(spark, sf_dir), "agent", ["pending", "running", "completed"])


def dsp_04_resolved_agents(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    requests = c.select(k.alias("request_id"), F.when(k % 4 == 0, F.array(F.lit("gamma"), F.lit("alpha"))).when(k % 4 == 1, F.array(F.lit("delta"))).otherwise(F.array().cast("array<string>")).alias("preferred"), F.when(k % 3 == 0, "view").when(k % 3 == 1, "click").otherwise("none").alias("lane_id"))
    rows = [("alpha", "view", True, 2), ("beta", "view", True, 1), ("gamma", "view", False, 0), ("beta", "click", True, 1), ("gamma", "click", True, 0), ("delta", "click", True, 3)]
    return D.resolved_agents(requests, spark.createDataFrame(rows, "agent string, lane_id string, available boolean, registered int"))


def inc_02_cache_decision(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    before = p.where(k % 5 != 0).select(k.alias("key"), F.md5(F.when(k % 7 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html"))).alias("md5"), F.sha2("html", 256).alias("sha256"))
    now = p.where(k % 11 != 0).select(k.alias("key"), F.md5("html").alias("md5"), F.sha2("html", 256).alias("sha256"))
    return D.cache_decision(before, now, p.where(k % 6 != 0).select(k.alias("key")))


def jn_07_affected_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    supports = e.select(F.concat(F.lit("chunk-"), "user_id").alias("chunk_id"), F.concat(F.lit("t"), F.col("event_id") % 97).alias("template_name"))
    changed = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey") * 11).alias("template_name"))
    return D.affected_chunks(changed, supports)


def snk_02_paths(spark, sf_dir):
    """Paths normalised and refused (SNK-02, FN-17, FN-18)."""
    u = F.regexp_replace("url", "^https?:/", "")
    k = F.col("page_id")
    path = F.when(k % 9 == 0, F.concat(F.lit("a//b/./"), k)).when(k % 9 == 1, F.concat(F.lit("../"), k)).when(k % 9 == 2, F.concat(F.lit("C:\\x\\"), k)).when(k % 9 == 3, F.concat(F.lit("a\\b\\"), k)).when(k % 9 == 4, F.lit("")).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", T.relative_path(path).alias("path"), T.portable_key(path).alias("key"), T.safe_segment(path).alias("safe"))


QUERIES = {
    f.__name__: f
    for f in (mrg_01_canonical_merge, mrg_01_conflicts, mrg_03_merge_gate, agg_06_review_status, top_04_latest_attempt, mrg_05_supplement, mrg_08_requirements_overlay, val_02_item_errors, val_02_duplicate_ids, jn_01_dangling_evidence, jn_02_dangling_ends, jn_03_range_containment, val_05_required_lanes, val_18_single_writer, val_19_repairs, val_03_json_contract, set_02_set_difference, prj_02_task_packets, prj_07_batches, dsp_01_transitions, win_07_claims, win_06_serial_gate, agg_05_status_counts, dsp_04_resolved_agents, inc_02_cache_decision, jn_07_affected_chunks, snk_02_paths)
}

from evidloom.plans.text_queries import _CHUNKS  # noqa: E402

_ITEMS = """i AS (SELECT md5(text[1:40]) AS id, doc_id, md5(text) AS body, lang, 'chunk-' || doc_id AS chunk FROM documents),
f AS (SELECT id, arg_min(body, doc_id) AS body, arg_min(lang, doc_id) AS lang, arg_min(chunk, doc_id) AS kept_from FROM i GROUP BY id)"""
_GRAPH = """p AS (SELECT p_partkey AS k, CASE WHEN k % 37 = 0 THEN '' WHEN k % 29 = 0 THEN 'x:' || k ELSE 'node:part:' || (k % 5000) END AS id, CASE WHEN k % 31 <> 0 THEN p_name END AS label,
CASE WHEN k % 23 <> 0 THEN k - CASE WHEN k % 19 = 0 THEN 1000000 ELSE 0 END END AS s, CASE WHEN k % 23 = 0 THEN NULL WHEN k % 17 = 0 THEN k - 1 ELSE k + 9 END AS e FROM part)"""
_STATE = """s AS (SELECT o_orderkey AS batch_id, CASE o_orderkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 3 <> 2 THEN o_custkey END AS claimed_at, 'agent-' || (o_custkey % 3) AS agent FROM orders)"""
_RULES = (
    ("node_missing_id", "id = ''"), ("node_bad_id", "id <> '' AND NOT starts_with(id, 'node:')"), ("node_missing_label", "label IS NULL"), ("node_missing_locator", "s IS NULL AND e IS NULL"),
    ("node_bad_range", "s < 0 OR e < s"), ("node_missing_evidence", "k % 13 = 0"), ("node_bad_confidence", "k % 11 = 0"), ("node_bad_verification_status", "k % 7 = 0"),
)
ORACLES = {
    "mrg_01_canonical_merge": f"WITH {_ITEMS} SELECT f.id, f.body, f.lang, string_agg(chunk, ',' ORDER BY doc_id) AS provenance FROM f JOIN i ON f.id = i.id AND f.body = i.body AND f.lang = i.lang GROUP BY ALL",
    "mrg_01_conflicts": f"WITH {_ITEMS} SELECT i.id, doc_id AS bundle_no, kept_from, chunk AS conflicting, 'different_content' AS reason FROM f JOIN i ON f.id = i.id WHERE f.body <> i.body OR f.lang <> i.lang",
    "mrg_03_merge_gate": """WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id), b AS (SELECT doc_id, source, q, coalesce(t, 0) AS t, CASE WHEN doc_id % 10 = 0 THEN 'passed' WHEN q = 1 THEN 'passed' WHEN q = 0 THEN 'failed' END AS st FROM documents LEFT JOIN l USING (doc_id)),
r AS (SELECT doc_id, CASE WHEN source = 'src3' THEN 'not_ready_for_merge' WHEN t > 0 THEN 'open_must_fix_finding' WHEN st IS NULL THEN 'review_missing' WHEN st <> 'passed' THEN 'review_not_passed' ELSE '' END AS reason FROM b) SELECT doc_id AS bundle_id, reason = '' AS ok, reason FROM r""",
    "agg_06_review_status": "SELECT user_id AS graph_id, ['needs_incremental', 'review_failed', 'unreviewed', 'reviewed'][min(CASE WHEN value > 140 THEN 1 WHEN event_id % 41 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 3 ELSE 4 END)] AS review_status FROM events GROUP BY user_id",
    "top_04_latest_attempt": "SELECT user_id, event_type, path, event_id FROM (SELECT user_id, event_type, printf('%d/%s/run-%03d.json', user_id, event_type, event_id % 1500) AS path, event_id FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY path DESC, event_id DESC) = 1",
    "mrg_05_supplement": """WITH x AS (SELECT s_suppkey * 3 AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS label, 's' || s_nationkey AS place FROM supplier)
SELECT coalesce(c_custkey, id) AS id, coalesce(label, c_name) AS label, coalesce(place, c_nationkey::VARCHAR) AS place FROM customer FULL JOIN x ON c_custkey = id""",
    "mrg_08_requirements_overlay": "SELECT item_id AS key, item_id AS ord, CASE item_id % 3 WHEN 0 THEN upper(md5(text)) WHEN 1 THEN md5(text) END AS value, CASE item_id % 3 WHEN 0 THEN 'refreshed' WHEN 1 THEN 'existing' ELSE 'missing' END AS origin FROM benchmark",
    "val_02_item_errors": f"WITH {_GRAPH} " + " UNION ALL ".join(f"SELECT 'node' AS scope, id AS item_id, '{c}' AS code FROM p WHERE {r}" for c, r in _RULES),
    "val_02_duplicate_ids": f"WITH {_GRAPH} SELECT 'node' AS scope, id AS item_id, 'node_duplicate_id' AS code FROM p GROUP BY id HAVING count(*) > 1",
    "jn_01_dangling_evidence": f"WITH {_GRAPH}, r AS (SELECT id, unnest(['evidence:' || (k % 150), 'evidence:' || k]) AS ref FROM p WHERE k % 13 <> 0) SELECT DISTINCT 'node' AS scope, id AS item_id, 'dangling_evidence:' || ref AS code FROM r WHERE ref NOT IN (SELECT 'evidence:' || c_custkey FROM customer)",
    "jn_02_dangling_ends": """WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS id, unnest(['part:' || l_partkey, 'supplier:' || l_suppkey]) AS ref FROM lineitem)
SELECT DISTINCT 'edge' AS scope, id AS item_id, 'dangling_end:' || ref AS code FROM r WHERE ref NOT IN (SELECT 'part:' || p_partkey FROM part WHERE p_partkey % 13 <> 0 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_suppkey % 9 <> 0)""",
    "jn_03_range_containment": f"""WITH {_CHUNKS}, i AS (SELECT doc_id::VARCHAR AS item_id, doc_id || CASE WHEN doc_id % 9 = 0 THEN ':chunk-0099' ELSE ':chunk-0001' END AS c, n_chars % 50 AS a, CASE WHEN doc_id % 8 <> 0 THEN (n_chars * 7) % 3000 END AS z FROM documents),
k AS (SELECT doc_id || ':' || chunk_id AS c, s, e FROM chunks), x AS (SELECT i.*, k.s, k.e FROM i LEFT JOIN k ON i.c = k.c)
SELECT 'range' AS scope, item_id, 'chunk_unknown' AS code FROM x WHERE s IS NULL UNION ALL SELECT 'range', item_id, 'source_range_invalid' FROM x WHERE z IS NULL OR z < a UNION ALL SELECT 'range', item_id, 'source_range_outside_chunk' FROM x WHERE a < s OR z > e""",
    "val_05_required_lanes": """WITH w AS (SELECT DISTINCT user_id, lane FROM events, (VALUES ('click'), ('view'), ('purchase')) AS l(lane)),
o AS (SELECT user_id, event_type AS lane, bool_or(NOT (user_id % 5 = 0 AND event_type = 'click')) AS done, bool_or(user_id % 10 = 0) AS failed FROM events WHERE user_id % 7 <> 0 OR event_type <> 'view' GROUP BY ALL)
SELECT user_id AS chunk_id, lane AS lane_id, CASE WHEN done IS NULL THEN 'required_lane_missing' WHEN failed THEN 'required_lane_failed' ELSE 'required_lane_not_completed' END AS reason FROM w LEFT JOIN o USING (user_id, lane) WHERE done IS NULL OR NOT done""",
    "val_18_single_writer": """WITH o AS (SELECT DISTINCT o_orderkey % 400 AS run, 'out/' || ((o_orderkey % 400) * 3 + CASE WHEN o_custkey % 97 = 0 THEN 1 ELSE 0 END) AS path FROM orders), s AS (SELECT DISTINCT o_orderkey % 400 AS run, 'out/' || ((o_orderkey % 400) * 3 + CASE WHEN o_custkey % 89 = 0 THEN 4 ELSE 0 END) AS path FROM orders)
SELECT 'writer' AS scope, path AS item_id, 'duplicate_output_path' AS code FROM o GROUP BY path HAVING count(DISTINCT run) > 1 UNION ALL SELECT 'writer', path, 'duplicate_write_scope' FROM s GROUP BY path HAVING count(DISTINCT run) > 1
UNION ALL SELECT DISTINCT 'writer', o.path, 'output_in_foreign_scope' FROM o JOIN s ON o.path = s.path AND o.run <> s.run""",
    "val_19_repairs": """WITH f AS (SELECT doc_id, toxic = 1 AS open, quality = 1 AS need, CASE WHEN doc_id % 3 = 0 THEN doc_id % 500 END AS run FROM labels), r AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS repair FROM customer), x AS (SELECT f.*, r.id, r.repair FROM f LEFT JOIN r ON run = id)
SELECT 'finding' AS scope, doc_id::VARCHAR AS item_id, 'repair_missing' AS code FROM x WHERE open AND need AND run IS NULL UNION ALL SELECT 'finding', doc_id::VARCHAR, 'repair_run_unknown' FROM x WHERE run IS NOT NULL AND id IS NULL
UNION ALL SELECT 'finding', doc_id::VARCHAR, 'repair_run_not_fresh' FROM x WHERE id IS NOT NULL AND NOT repair UNION ALL SELECT 'run', run::VARCHAR, 'repair_run_reused' FROM f WHERE run IS NOT NULL GROUP BY run HAVING count(*) > 1""",
    "val_03_json_contract": "SELECT 'json' AS scope, event_id::VARCHAR AS item_id, unnest(CASE event_id % 50 WHEN 0 THEN ['invalid_json'] WHEN 1 THEN ['not_an_object'] WHEN 2 THEN ['field_empty:code'] WHEN 5 THEN ['field_type:code'] WHEN 6 THEN ['field_missing:code'] ELSE ['field_type:attempt'] END) AS code FROM events WHERE event_id % 50 < 7",
    "set_02_set_difference": """WITH a AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity > 20), b AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity < 5)
SELECT key, 'left_only' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'right_only' FROM b WHERE key NOT IN (SELECT key FROM a)""",
    "prj_02_task_packets": f"WITH {_CHUNKS} SELECT doc_id AS source_id, no AS chunk_no, lane AS lane_id, lane || '-agent' AS agent_role, doc_id || ':' || chunk_id || ':' || lane || ':attempt-001' AS packet_id FROM chunks, (VALUES ('click'), ('purchase')) AS l(lane)",
    "prj_07_batches": f"WITH {_CHUNKS} SELECT doc_id || ':' || chunk_id || ':' || lane || ':attempt-001' AS packet_id, ((no - 1) // 2 + 1)::BIGINT AS batch_no FROM chunks, (VALUES ('click'), ('purchase')) AS l(lane)",
    "dsp_01_transitions": f"""WITH {_STATE}, d AS (SELECT *, batch_id % 4 <> 0 AND batch_id % 5 <> 0 AS done FROM s), n AS (SELECT *, CASE WHEN status = 'running' AND done THEN 'completed' WHEN status = 'completed' AND NOT done THEN 'pending' ELSE status END AS now FROM d)
SELECT batch_id, status, now, CASE WHEN now <> 'pending' THEN claimed_at END AS claimed_at FROM n""",
    "win_07_claims": f"""WITH {_STATE}, free(agent, free) AS (VALUES ('agent-0', 4), ('agent-1', 5), ('agent-2', 6)),
p AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY batch_id) AS place FROM s WHERE status = 'pending') SELECT batch_id, agent, batch_id AS ord FROM p JOIN free USING (agent) WHERE place <= free ORDER BY batch_id LIMIT 12""",
    "win_06_serial_gate": """WITH b AS (SELECT l_orderkey AS phase, l_linenumber AS ord, CASE WHEN l_linenumber = 1 OR l_partkey % 5 = 0 THEN 'completed' WHEN l_suppkey % 6 = 0 THEN 'running' ELSE 'pending' END AS status FROM lineitem)
SELECT phase, min(ord) FILTER (WHERE status <> 'completed') AS ord FROM b GROUP BY phase HAVING count(*) FILTER (WHERE status = 'running') = 0 AND count(*) FILTER (WHERE status <> 'completed') > 0""",
    "agg_05_status_counts": f"WITH {_STATE} SELECT agent, (count(*) FILTER (WHERE status = 'pending'))::BIGINT AS pending, (count(*) FILTER (WHERE status = 'running'))::BIGINT AS running, (count(*) FILTER (WHERE status = 'completed'))::BIGINT AS completed FROM s GROUP BY agent",
    "dsp_04_resolved_agents": "SELECT c_custkey AS request_id, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'alpha' ELSE 'beta' END WHEN 1 THEN CASE WHEN c_custkey % 4 = 0 THEN 'gamma' WHEN c_custkey % 4 = 1 THEN 'delta' ELSE 'gamma' END END AS agent FROM customer",
    "inc_02_cache_decision": "SELECT page_id AS key, CASE WHEN page_id % 11 = 0 THEN 'deleted' WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN 'changed' WHEN page_id % 6 = 0 THEN 'missing_requirement' ELSE 'reused' END AS decision FROM pages WHERE NOT (page_id % 11 = 0 AND page_id % 5 = 0)",
    "jn_07_affected_chunks": "SELECT DISTINCT 'chunk-' || user_id AS chunk_id FROM events WHERE event_id % 97 IN (SELECT n_nationkey * 11 FROM nation)",
    "snk_02_paths": r"""WITH p AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'a//b/./' || page_id WHEN 1 THEN '../' || page_id WHEN 2 THEN 'C:\x\' || page_id WHEN 3 THEN 'a\b\' || page_id WHEN 4 THEN '' ELSE regexp_replace(url, '^https?:/', '') END AS path FROM pages)
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'a/b/' || page_id WHEN 3 THEN 'a/b/' || page_id END AS path, CASE page_id % 9 WHEN 0 THEN path WHEN 1 THEN path WHEN 2 THEN page_id::VARCHAR WHEN 3 THEN 'a/b/' || page_id WHEN 4 THEN '' ELSE regexp_extract(path, '([^/]*)$', 1) END AS key, false AS safe FROM p""",
}
