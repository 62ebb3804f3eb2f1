"""Packet, record, contract and reuse queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.operators import ledgers as L
from evidloom.plans.text_queries import table


def prj_03_lane_kinds(spark, sf_dir):
    k = F.col("c_custkey")
    scope = F.filter(F.array(*[F.when(k % (i + 2) != 0, F.lit(x)) for i, x in enumerate(L.COMPREHENSIVE)]), lambda x: x.isNotNull())
    return L.lane_kinds(table(spark, sf_dir, "customer").select(F.when(k % 50 == 0, L.COMPREHENSIVE_LANE).otherwise(F.concat(F.lit("lane-"), k)).alias("lane_id"), F.when(k % 9 != 0, scope).alias("scope")))


def prj_04_requirement_packets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return L.requirement_packets(p.select((F.col("p_partkey") % 40).alias("source_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("t"), "p_partkey").alias("template_name")), "source_id", 4)


def prj_05_refinement_passes(spark, sf_dir):
    return L.refinement_passes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.concat(F.lit("raw/"), "doc_id").alias("raw_path")))


def prj_10_run_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(F.concat(F.lit("p"), k).alias("packet_id"), F.lit("reader").alias("agent_role"), F.when(k % 3 != 0, F.array(F.concat(F.lit("p"), k), F.lit("in"), F.lit("in"))).alias("input_paths"), F.array(F.concat(F.lit("out"), k)).alias("output_paths"), F.when(k % 5 == 0, F.array(F.lit("scope"))).alias("write_scope"))
    out = L.run_records(rows)
    return out.select("run_id", "agent_role", "status", *[F.array_join(c, ",").alias(c) for c in ("input_paths", "output_paths", "write_scope")])


def val_04_legacy_producers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = F.when(k % 6 == 0, " Python ").when(k % 6 == 1, "my Python_template_aware v2").when(k % 6 == 2, "producer-of legacy").when(k % 6 == 3, "pythonic producer").when(k % 6 == 4, "agent-7").otherwise(None)
    return s.select("s_suppkey", L.legacy_producer(name).alias("legacy"))


def _names(spark, sf_dir, shift):
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber") + F.when((F.col("l_orderkey") % 10 == 0) & (F.col("l_linenumber") == 2), shift).otherwise(0)
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).select(F.col("l_orderkey").alias("source_id"), F.struct("l_linenumber", "p").alias("ord"), F.concat(F.lit("n"), n).alias("name"))


def val_07_names_in_order(spark, sf_dir):
    return L.names_in_order(_names(spark, sf_dir, -1).where("source_id % 7 <> 0"), _names(spark, sf_dir, 0).where("source_id % 13 <> 0"), "source_id")


def val_10_readiness_contract(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), F.col("l_orderkey") % 50).alias("template_name"), F.concat(F.lit("r"), "l_partkey").alias("requirement_id"), "l_partkey")
    req = li.where("l_partkey % 4 <> 0").select("template_name", "requirement_id").distinct()
    sts = li.where("l_partkey % 3 <> 0").select("template_name", "requirement_id", F.when(F.col("l_partkey") % 17 == 0, "odd").otherwise("covered").alias("status")).distinct()
    return L.readiness_against_requirements(req, sts, ["covered", "not_found_in_source"])


def val_16_packet_contract(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    chunks = d.where("doc_id % 9 <> 0").select(F.concat(F.lit("c"), k).alias("chunk_id"), F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"), F.when(k % 2 == 0, "h").alias("hint"))
    packets = d.select(F.concat(F.lit("p"), k).alias("packet_id"), F.concat(F.lit("c"), k).alias("chunk_id"), F.lit(0).cast("long").alias("start"), (F.col("n_chars") + F.when(k % 5 == 0, 1).otherwise(0)).alias("end"), F.when((k % 2 == 0) & (k % 8 != 0), "h").alias("hint"))
    return L.packet_contract(packets, chunks)


def val_15_missing_outputs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = lambda c: F.concat(F.lit("out/"), c)
    return L.missing_outputs(o.select(path(F.col("o_custkey")).alias("path")), o.select(F.when(F.col("o_orderkey") % 2 == 0, path(F.col("o_orderkey"))).otherwise("").alias("path")), table(spark, sf_dir, "customer").select(path(F.col("c_custkey")).alias("path")))


def val_14_missing_roles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return L.missing_roles(e.select("user_id", F.col("event_type").alias("agent_role"), F.when(F.col("value") > 100, "success").otherwise("failed").alias("status")), ["click", "purchase", "view"], "user_id")


def val_26_queue_errors(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    paths = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return L.queue_errors(c.select(k.alias("queue_id"), F.when(k % 4 != 0, "ready").alias("status"), paths.alias("bundle_paths"), F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("lanes")), ["x", "y"])


def mrg_02_canonical_items(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = c.select(k.alias("item_no"), F.when(k % 4 == 0, F.concat(F.lit("given"), k)).otherwise("").alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("canonical_name"), F.when(k % 5 != 0, "label").alias("label"), F.when(k % 7 != 0, "person").alias("node_type"), F.concat(F.lit("c"), k).alias("chunk_id"))
    return L.canonical_items(rows, "world")


def mrg_04_provenance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.array(F.concat(F.lit("c"), F.col("event_id") % 7)).alias("chunk_ids"), F.array(F.col("event_type"), F.lit("all")).alias("lane_paths"))
    return L.provenance_union(rows).select("id", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.array_join("lane_paths", ",").alias("lane_paths"))


def agg_11_phase_summary(spark, sf_dir):
    return L.phase_summary(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("phase"), F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").cast("long").alias("packets")))


def jn_15_ledger_update(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("t"), "doc_id").alias("template_name"), F.lit("pending").alias("status"))
    x = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).select(F.concat(F.lit("t"), "doc_id").alias("template_name"), F.when(F.col("q") == 1, "ingested").alias("status"))
    return L.ledger_update(d, x)


def jn_08_remapped_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    req = p.select(F.concat(F.lit("t"), k).alias("template_name"), F.when(k % 3 == 0, F.concat(F.lit("f"), k % 10)).alias("file_key"))
    return L.remapped(req, p.where("p_partkey % 4 = 0").select(F.concat(F.lit("t"), k).alias("name"), F.concat(F.lit("k"), k % 6).alias("key")))


def _cache(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.md5("text").alias("text_hash"), F.col("lang").alias("config"), F.col("n_chars").alias("size"))


def inc_03_reuse(spark, sf_dir):
    now = _cache(spark, sf_dir)
    k = F.col("source_id")
    before = now.where("source_id % 10 <> 0").select(k, F.when(k % 3 == 0, "old").otherwise(F.col("text_hash")).alias("text_hash"), F.when(k % 4 != 0, F.col("config")).alias("config"), "size")
    return L.reuse(before, now, ["text_hash", "config", "size"])


def inc_06_input_hash(spark, sf_dir):
    return L.input_hash(_cache(spark, sf_dir), ["text_hash", "size", "config"])


def fn_22_canonical_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    errors = F.filter(F.array(F.when(k % 2 == 0, "a"), F.when(k % 3 == 0, F.concat(F.lit("lane_"), "event_type")), F.lit("b"), F.when(k % 5 == 0, "lane_x"), F.when(k % 7 == 0, "a")), lambda x: x.isNotNull())
    return L.canonical_errors(e.select(k.alias("chunk_id"), errors.alias("errors")))


QUERIES = {f.__name__: f for f in (prj_03_lane_kinds, prj_04_requirement_packets, prj_05_refinement_passes, prj_10_run_records, val_04_legacy_producers, val_07_names_in_order, val_10_readiness_contract, val_16_packet_contract, val_15_missing_outputs, val_14_missing_roles, val_26_queue_errors, mrg_02_canonical_items, mrg_04_provenance, agg_11_phase_summary, jn_15_ledger_update, jn_08_remapped_keys, inc_03_reuse, inc_06_input_hash, fn_22_canonical_errors)}

ORACLES = {
    "prj_03_lane_kinds": "SELECT CASE WHEN c_custkey % 50 = 0 THEN 'comprehensive_extraction' ELSE 'lane-' || c_custkey END AS lane_id, c_custkey % 50 = 0 OR (c_custkey % 9 <> 0 AND c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 6 <> 0) AS comprehensive FROM customer",
    "prj_04_requirement_packets": """WITH b AS (SELECT p_partkey % 40 AS s, p_partkey AS k, (row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) - 1) // 4 + 1 AS b FROM part)
SELECT s AS source_id, printf('batch-%04d', b) AS batch_id, count(*)::BIGINT AS n, string_agg('t' || k, ',' ORDER BY k) AS templates FROM b GROUP BY s, b""",
    "prj_05_refinement_passes": "SELECT doc_id AS source_id, p::BIGINT AS pass, CASE WHEN p = 1 THEN 'raw/' || doc_id ELSE printf('refinement/%d/pass-%d.json', doc_id, p - 1) END AS reads, printf('refinement/%d/pass-%d.json', doc_id, p) AS writes FROM documents, range(1, 4) AS r(p)",
    "prj_10_run_records": "SELECT 'run:p' || o_orderkey AS run_id, 'reader' AS agent_role, 'pending' AS status, 'p' || o_orderkey || CASE WHEN o_orderkey % 3 <> 0 THEN ',in' ELSE '' END AS input_paths, 'out' || o_orderkey AS output_paths, CASE WHEN o_orderkey % 5 = 0 THEN 'scope' ELSE 'out' || o_orderkey END AS write_scope FROM orders",
    "val_04_legacy_producers": "SELECT s_suppkey, CASE WHEN s_suppkey % 6 < 3 THEN true WHEN s_suppkey % 6 < 5 THEN false END AS legacy FROM supplier",
    "val_07_names_in_order": """WITH n AS (SELECT DISTINCT l_orderkey AS s, l_linenumber AS i FROM lineitem), a AS (SELECT s, list('n' || (i + CASE WHEN s % 10 = 0 AND i = 2 THEN -1 ELSE 0 END) ORDER BY i) AS a FROM n WHERE s % 7 <> 0 GROUP BY s), b AS (SELECT s, list('n' || i ORDER BY i) AS b FROM n WHERE s % 13 <> 0 GROUP BY s)
SELECT coalesce(a.s, b.s) AS source_id, CASE WHEN len(list_distinct(a)) < len(a) THEN 'names_duplicate' ELSE 'names_differ' END AS code FROM a FULL JOIN b ON a.s = b.s WHERE len(list_distinct(a)) < len(a) OR a IS DISTINCT FROM b""",
    "val_10_readiness_contract": """WITH x AS (SELECT DISTINCT 't' || (l_orderkey % 50) || '/r' || l_partkey AS id, l_partkey AS k FROM lineitem)
SELECT 'readiness' AS scope, id AS item_id, 'requirement_without_status' AS code FROM x WHERE k % 4 <> 0 AND k % 3 = 0 UNION ALL SELECT 'readiness', id, 'status_without_requirement' FROM x WHERE k % 4 = 0 AND k % 3 <> 0 UNION ALL SELECT 'readiness', id, 'status_not_allowed' FROM x WHERE k % 3 <> 0 AND k % 17 = 0""",
    "val_16_packet_contract": """SELECT 'packet' AS scope, 'p' || doc_id AS item_id, 'packet_chunk_unknown' AS code FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'packet', 'p' || doc_id, 'packet_range_differs' FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 5 = 0
UNION ALL SELECT 'packet', 'p' || doc_id, 'packet_hint_differs' FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 8 = 0""",
    "val_15_missing_outputs": "SELECT DISTINCT 'out/' || k AS path FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) WHERE k NOT IN (SELECT c_custkey FROM customer)",
    "val_14_missing_roles": "SELECT u.user_id, role FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('click'), ('purchase'), ('view')) AS r(role) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND event_type = role AND value > 100)",
    "val_26_queue_errors": " UNION ALL ".join(f"SELECT 'queue' AS scope, c_custkey::VARCHAR AS item_id, '{c}' AS code FROM customer WHERE {w}" for c, w in (("queue_not_ready", "c_custkey % 4 = 0"), ("queue_without_bundles", "c_custkey % 7 = 0"), ("queue_duplicate_bundle", "c_custkey % 5 = 0 AND c_custkey % 7 <> 0"), ("queue_drops_lane", "c_custkey % 3 = 0"))),
    "mrg_02_canonical_items": """WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_name WHEN c_custkey % 5 <> 0 THEN 'label' END AS name, c_custkey % 7 <> 0 AS typed FROM customer)
SELECT k AS item_no, CASE WHEN k % 4 = 0 THEN 'given' || k WHEN typed AND name IS NOT NULL THEN 'node:person:' || substr(sha256('world|' || name || '|person'), 1, 16) END AS id, CASE WHEN k % 4 <> 0 AND (NOT typed OR name IS NULL) THEN 'node_missing_stable_id_fields:c' || k END AS code FROM x""",
    "mrg_04_provenance": """WITH e AS (SELECT user_id, event_id, 'c' || (event_id % 7) AS c, unnest([event_type, 'all']) AS l, generate_subscripts([1, 2], 1) AS i FROM events), c AS (SELECT user_id, string_agg(c, ',' ORDER BY o) AS cs FROM (SELECT user_id, c, min(event_id) AS o FROM e GROUP BY ALL) GROUP BY 1)
SELECT user_id AS id, any_value(cs) AS chunk_ids, string_agg(l, ',' ORDER BY o) AS lane_paths FROM (SELECT user_id, l, min(event_id * 10 + i) AS o FROM e GROUP BY ALL) JOIN c USING (user_id) GROUP BY user_id""",
    "agg_11_phase_summary": "SELECT l_returnflag AS phase, count(DISTINCT l_orderkey)::BIGINT AS batches, sum(l_linenumber)::BIGINT AS packets FROM lineitem GROUP BY 1",
    "jn_15_ledger_update": "SELECT 't' || d.doc_id AS template_name, CASE WHEN q = 1 THEN 'ingested' ELSE 'pending' END AS status FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)",
    "jn_08_remapped_keys": "SELECT template_name, key, count(*) OVER (PARTITION BY key)::BIGINT AS sharing FROM (SELECT 't' || p_partkey AS template_name, CASE WHEN p_partkey % 4 = 0 THEN 'k' || (p_partkey % 6) WHEN p_partkey % 3 = 0 THEN 'f' || (p_partkey % 10) ELSE 't' || p_partkey END AS key FROM part)",
    "inc_03_reuse": """SELECT doc_id AS source_id, CASE WHEN doc_id % 10 = 0 THEN 'build' WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'rebuild' ELSE 'reuse' END AS decision, CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 12 = 0 THEN 'text_hash,config' WHEN doc_id % 3 = 0 THEN 'text_hash' WHEN doc_id % 4 = 0 THEN 'config' ELSE '' END AS changed FROM documents""",
    "inc_06_input_hash": """SELECT doc_id AS source_id, sha256('{"config":"' || lang || '","size":' || n_chars || ',"text_hash":"' || md5(text) || '"}') AS hash FROM documents""",
    "fn_22_canonical_errors": """SELECT event_id AS chunk_id, concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'a' END, CASE WHEN event_id % 3 = 0 THEN 'required_lane_missing,lane_' || event_type END, 'b', CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 3 <> 0 THEN 'required_lane_missing,' ELSE '' END || 'lane_x' END, CASE WHEN event_id % 7 = 0 AND event_id % 2 <> 0 THEN 'a' END) AS errors FROM events""",
}
