"""Queries of single parts: files written and read back, sinks, projections, orders, sets and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidloom.functions import text as T
from evidloom.functions import values as X
from evidloom.operators import agents as A
from evidloom.operators import contracts as C
from evidloom.operators import dispatch as D
from evidloom.operators import evidence as E
from evidloom.operators import graph as G
from evidloom.operators import ledgers as L
from evidloom.operators import validate as V
from evidloom.plans import contract_queries as CQ
from evidloom.plans import graph_queries as GQ
from evidloom.plans import merge_queries as MQ
from evidloom.plans.text_queries import _CHUNKS, ledger, table
from evidloom.sources import files, sinks
from evidloom.sources.tables import shared_dir


def _written(spark, df, what: str) -> str:
    """(k, text) as text files, a folder for each k, in the shared folder."""
    df.write.partitionBy("k").text(path := f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return path


def src_01_texts(spark, sf_dir):
    """Texts written and read back: digests and sizes of bytes, line ends as LF (SRC-01, SRC-02, SNK-04)."""
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "n_name || '\\r\\nsecond \\rthird' AS text")
    out = files.texts(spark, _written(spark, n, "texts"), "part-*", recursive=True)
    return out.select(F.regexp_extract("source_id", "k=([0-9]+)", 1).cast("long").alias("k"), "sha256", "size", "text", "code")


def src_07_json_artifacts(spark, sf_dir):
    """JSON artifacts with failure codes: a byte order mark, no JSON, too deep (SRC-07, SRC-08)."""
    k = F.col("s_suppkey")
    raw = F.when(k % 5 == 0, "{bad").when(k % 7 == 0, F.concat(F.lit("\ufeff"), F.lit('{"a":1}'))).when(k % 3 == 0, F.concat(F.repeat(F.lit("["), F.lit(9)), F.repeat(F.lit("]"), F.lit(9)))).otherwise(F.concat(F.lit('{"a":'), k, F.lit("}")))
    s = table(spark, sf_dir, "supplier").select(k.alias("k"), raw.alias("text"))
    out = files.json_artifacts(spark, _written(spark, s, "artifacts"), "part-*", depth=8, refuse_bom=True)
    return out.select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("long").alias("k"), "code")


def snk_05_manifest(spark, sf_dir):
    o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.md5("c_name").alias("sha256"), F.lit("day 1").alias("created_at"), F.lit("day 1").alias("updated_at"), F.when(F.col("c_custkey") % 4 == 0, "success").otherwise("pending").alias("status"))
    new = o.select("source_id", "sha256", F.lit("day 2").alias("created_at"), F.lit("day 2").alias("updated_at"), F.lit("new").alias("status"))
    return sinks.manifest(o.where("source_id % 3 <> 0"), new)


def snk_08_render_targets(spark, sf_dir):
    """Targets under the three policies (SNK-07, SNK-08)."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("t"), "p_partkey").alias("template_name"), "p_partkey")
    there = p.where("p_partkey % 3 = 0").select("template_name")
    each = lambda policy: sinks.render_targets(p, there, policy).withColumn("policy", F.lit(policy))
    return each("draft").unionByName(each("backup-and-overwrite")).unionByName(each("merge"))


def prj_09_dispatch_plan(spark, sf_dir):
    """Phases with their batches; the review phase stays out (PRJ-08, PRJ-09)."""
    of = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).alias("batch_id"), F.lit(n).alias("n_packets"))
    return D.dispatch_plan([("templates", of("nation", "n_nationkey", 5)), ("lanes", of("supplier", "s_suppkey", 2)), ("review", of("region", "r_regionkey", 1))], review=False)


def prj_12_failed_runs(spark, sf_dir):
    """Records of packets, rewritten as failed (PRJ-11, PRJ-12)."""
    o = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), "c_custkey").alias("packet_id"), F.lit("reader").alias("agent_role"), F.array(F.lit("a"), F.concat(F.lit("p"), "c_custkey")).alias("input_paths"), F.array(F.lit("o")).alias("output_paths"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("s"))).alias("write_scope"))
    out = L.failed_runs(L.run_records(o), "source_missing", ["no such file"])
    return out.select("run_id", "status", *[F.array_join(c, ",").alias(c) for c in ("input_paths", "write_scope", "errors")])


def prj_13_chunk_summaries(spark, sf_dir):
    out = L.chunk_summaries(ledger(spark, sf_dir))
    return out.withColumn("source_range", F.array_join(F.col("source_range").cast("array<string>"), "-"))


def prj_20_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.lit("reviewer").alias("reviewer_role"), F.concat(F.lit("chunk-"), "doc_id").alias("chunk_id"), F.col("lang").alias("lane_id"), F.when(F.col("doc_id") % 3 == 0, "must_fix").otherwise("note").alias("severity"), F.col("source").alias("probe"))
    return A.findings(rows)


def agg_02_score_sums(spark, sf_dir):
    return GQ._scored(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("nodes"), F.round(F.sum("score"), 2).alias("total"))


def agg_08_packets_by_lane(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = E.ordered_lists(li.select(F.col("l_suppkey").alias("lane"), F.struct("l_orderkey", "l_linenumber").alias("at"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("packet")), ["lane"], "packet", "at", "packets")
    return out.select("lane", F.size("packets").cast("long").alias("n"), F.md5(F.array_join("packets", ",")).alias("packets"))


def agg_10_distinct_counts(spark, sf_dir):
    """Distinct parts and suppliers of orders, as contracts count covered templates."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("templates"), F.count_distinct("l_suppkey").alias("sources"))


def win_04_numbering(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return E.running_first(li, ["l_suppkey"], ["l_orderkey", "l_linenumber"])


def win_05_first_match(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return E.first_of_each(e.where("event_type = 'purchase'"), ["user_id"], ["event_id"])


def top_01_ranks(spark, sf_dir):
    return G.rank(GQ._scored(spark, sf_dir)).select("query_id", "id", "place")


def top_03_all_pending(spark, sf_dir):
    """A negative limit claims all that capacity allows."""
    s = MQ._state(spark, sf_dir)
    running = s.where("status = 'running'").groupBy("agent").agg(F.count("*").alias("n"))
    cap = s.groupBy("agent").agg((F.count_if(F.col("status") == "running") + 20).alias("cap"))
    return D.claims(s.where("status = 'pending'").select("batch_id", "agent", F.col("batch_id").alias("ord")), running, cap, -1).select("batch_id", "agent")


def top_05_p99_degree(spark, sf_dir):
    return G.hub_threshold(G.degrees(GQ.edges(spark, sf_dir)), 0)


def set_05_bag(spark, sf_dir):
    """Nodes of a graph and its supplement, as a bag: repeats stay."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    both = c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))
    return both.groupBy("nation").agg(F.count("*").alias("n"))


def set_06_deleted_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    return V.set_difference(p, p.where("key % 5 <> 0"), "key").where("side = 'left_only'").select("key")


def fn_03_canonical_parts(spark, sf_dir):
    raw = F.concat(F.lit('{"b": '), F.col("p_partkey"), F.lit(', "a": {"z": null, "y": ["'), "p_name", F.lit('", true]}}'))
    return table(spark, sf_dir, "part").select("p_partkey", X.canonical_json(raw).alias("part"))


def fn_08_segments(spark, sf_dir):
    """Ideographs: found and cut into pairs (FN-07, FN-08)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.translate(F.col("c_custkey").cast("string"), "0123", "零一二三").alias("t"))
    return c.select("c_custkey", T.has_cjk(F.col("t")).alias("ideographs"), F.array_join(T.segmented(F.col("t")), ",").alias("segments"), T.searchable(F.col("t")).alias("searchable"))


def fn_16_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


def fn_17_portable_keys(spark, sf_dir):
    """Path keys and safe segments (FN-17, FN-18)."""
    k = F.col("c_custkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("/abs/dir/"), k)).when(k % 4 == 1, F.concat(F.lit("C:\\x\\"), k)).when(k % 4 == 2, F.concat(F.lit("rel\\a/"), k)).otherwise(F.lit(".."))
    return table(spark, sf_dir, "customer").select(k.alias("k"), T.portable_key(path).alias("portable"), T.safe_segment(T.portable_key(path)).alias("safe"))


def fn_19_first_texts(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.first_text(F.when(k % 2 == 0, ""), F.when(k % 3 == 0, "third"), F.lit("last")).alias("first"))


def fn_21_batch_digests(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", X.batch_digest(F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey").cast("string")).alias("batch_id"))


def fn_23_bare_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.bare_label(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "()").otherwise("(x)"))).alias("label"))


def fn_25_tails(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.tail(X.decoded(F.col("text").cast("binary")), 40).alias("tail"), X.decoded(F.when(F.col("doc_id") % 2 == 0, F.lit(bytearray(b"\xff\xfe")))).isNull().alias("undecodable"))


def evd_03_statuses(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = E.ordered_distinct(li.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").alias("at"), F.concat("l_returnflag", "l_linestatus").alias("status")), ["l_orderkey"], "status", "at", "statuses")
    return out.withColumn("statuses", F.array_join("statuses", ","))


def inc_08_refreshed(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url")
    d = p.select("key", F.when(F.col("key") % 5 == 0, "changed").when(F.col("key") % 6 == 0, "missing_requirement").when(F.col("key") % 7 == 0, "deleted").otherwise("reused").alias("decision"))
    return D.templates_to_refresh(p, d)


def dsp_03_stamped_packets(spark, sf_dir):
    """Agents selected by preference and stamped into the packets."""
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.array(F.when(F.col("c_custkey") % 2 == 0, "beta").otherwise("gamma"), F.lit("alpha")).alias("preferred"), F.concat(F.lit("lane-"), F.col("c_custkey") % 3).alias("lane_id"))
    agents = spark.createDataFrame([("alpha", "lane-0", True, 0), ("beta", "lane-0", True, 1), ("beta", "lane-1", False, 1), ("gamma", "lane-1", True, 2)], "agent string, lane_id string, available boolean, registered int")
    return D.stamped_packets(r.select(F.col("request_id").alias("packet_id"), "lane_id"), D.resolved_agents(r, agents))


def mrg_07_normalised_items(spark, sf_dir):
    return C.normalised_items(table(spark, sf_dir, "orders").selectExpr(f"{CQ._K} AS output_id", f"{CQ.LANE_RAW} AS raw"))


QUERIES = {f.__name__: f for f in (
    src_01_texts, src_07_json_artifacts, snk_05_manifest, snk_08_render_targets, prj_09_dispatch_plan, prj_12_failed_runs, prj_13_chunk_summaries, prj_20_findings, agg_02_score_sums, agg_08_packets_by_lane, agg_10_distinct_counts, win_04_numbering,
    win_05_first_match, top_01_ranks, top_03_all_pending, top_05_p99_degree, set_05_bag, set_06_deleted_keys, fn_03_canonical_parts, fn_08_segments, fn_16_hashes, fn_17_portable_keys, fn_19_first_texts, fn_21_batch_digests, fn_23_bare_labels,
    fn_25_tails, evd_03_statuses, inc_08_refreshed, dsp_03_stamped_packets, mrg_07_normalised_items,
)}

_TEXT = "(n_name || chr(13) || chr(10) || 'second ' || chr(13) || 'third' || chr(10))"
_TARGET = "SELECT 't' || p_partkey AS template_name, 't' || p_partkey || CASE WHEN p_partkey % 3 = 0 AND {d} THEN '.draft.md' ELSE '.md' END AS target, CASE WHEN p_partkey % 3 <> 0 THEN 'create' ELSE '{a}' END AS action, p_partkey % 3 = 0 AND NOT {d} AS will_overwrite, '{p}' AS policy FROM part"
_NODES_OF = " UNION ALL ".join(
    f"SELECT output_id, '{k.removeprefix('extracted_')}' AS collection, n::BIGINT AS ord, l[n + 1]::VARCHAR AS item FROM (SELECT output_id, l, unnest(range(len(l))) AS n FROM (SELECT output_id, {CQ._list('$.' + k)} AS l FROM o)) WHERE json_type(l[n + 1]) = 'OBJECT'" for k in C.OBJECT_LISTS
)
ORACLES = {
    "src_01_texts": f"SELECT n_nationkey::BIGINT AS k, sha256({_TEXT}) AS sha256, octet_length(encode({_TEXT}))::BIGINT AS size, n_name || chr(10) || 'second ' || chr(10) || 'third' || chr(10) AS text, NULL::VARCHAR AS code FROM nation",
    "src_07_json_artifacts": "SELECT s_suppkey::BIGINT AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'artifact_invalid_json' WHEN s_suppkey % 7 = 0 THEN 'artifact_has_bom' WHEN s_suppkey % 3 = 0 THEN 'artifact_too_deep' END AS code FROM supplier",
    "snk_05_manifest": "SELECT c_custkey AS source_id, md5(c_name) AS sha256, CASE WHEN c_custkey % 3 = 0 THEN 'day 2' ELSE 'day 1' END AS created_at, 'day 2' AS updated_at, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 4 = 0 THEN 'success' ELSE 'pending' END AS status FROM customer",
    "snk_08_render_targets": " UNION ALL ".join(_TARGET.format(d=d, a=a, p=p) for d, a, p in (("true", "draft", "draft"), ("false", "backup_and_overwrite", "backup-and-overwrite"), ("false", "merge", "merge"))),
    "prj_09_dispatch_plan": "SELECT 1::BIGINT AS phase_no, 'templates' AS phase, n_nationkey::VARCHAR AS batch_id, 5::BIGINT AS n_packets FROM nation UNION ALL SELECT 2, 'lanes', s_suppkey::VARCHAR, 2 FROM supplier",
    "prj_12_failed_runs": "SELECT 'run:p' || c_custkey AS run_id, 'failed' AS status, 'p' || c_custkey || ',a' AS input_paths, CASE WHEN c_custkey % 2 = 0 THEN 's' ELSE 'o' END AS write_scope, 'source_missing,no such file' AS errors FROM customer",
    "prj_13_chunk_summaries": f"WITH {_CHUNKS} SELECT doc_id AS source_id, chunk_id, s || '-' || e AS source_range, hint AS chapter_hint, sha256(t) AS hash, 'chunks/' || doc_id || '/' || chunk_id || '.txt' AS chunk_text_path FROM chunks",
    "prj_20_findings": "SELECT 'finding:' || left(sha256('reviewer|chunk-' || doc_id || '|' || lang || '|' || s || '|' || source), 16) AS finding_id, 'reviewer' AS reviewer_role, 'chunk-' || doc_id AS chunk_id, lang AS lane_id, s AS severity, source AS probe, 'open' AS status, s = 'must_fix' AS repair_required FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'must_fix' ELSE 'note' END AS s FROM documents)",
    "agg_02_score_sums": f"WITH {GQ._SCORED % 'scored'} SELECT query_id, count(*)::BIGINT AS nodes, round(sum(score), 2) AS total FROM scored GROUP BY 1",
    "agg_08_packets_by_lane": "SELECT l_suppkey AS lane, count(*)::BIGINT AS n, md5(string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber)) AS packets FROM lineitem GROUP BY 1",
    "agg_10_distinct_counts": "SELECT l_orderkey, count(DISTINCT l_partkey)::BIGINT AS templates, count(DISTINCT l_suppkey)::BIGINT AS sources FROM lineitem GROUP BY 1",
    "win_04_numbering": "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber)::BIGINT AS place FROM lineitem",
    "win_05_first_match": "SELECT user_id, min(event_id) AS event_id, 'purchase' AS event_type FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "top_01_ranks": f"WITH {GQ._SCORED % 'scored'} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(coalesce(label, id)), id)::BIGINT AS place FROM scored",
    "top_03_all_pending": f"WITH {MQ._STATE} SELECT batch_id, agent FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY batch_id) AS place FROM s WHERE status = 'pending') WHERE place <= 20",
    "top_05_p99_degree": f"WITH {GQ._EDGES} SELECT coalesce(list_sort(list(degree))[floor(count(*) * 0.99)::BIGINT + 1], 0)::BIGINT AS threshold FROM deg",
    "set_05_bag": "SELECT nation, count(*)::BIGINT AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
    "set_06_deleted_keys": "SELECT p_partkey AS key FROM part WHERE p_partkey % 5 = 0",
    "fn_03_canonical_parts": """SELECT p_partkey, '{"a":{"y":["' || p_name || '",true],"z":null},"b":' || p_partkey || '}' AS part FROM part""",
    "fn_08_segments": "SELECT c_custkey, regexp_matches(t, '[一-鿿]') AS ideographs, CASE WHEN length(t) <= 1 THEN t ELSE array_to_string(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) || [t], ',') END AS segments, true AS searchable FROM (SELECT c_custkey, translate(c_custkey::VARCHAR, '0123', '零一二三') AS t FROM customer)",
    "fn_16_hashes": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "fn_17_portable_keys": "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 2 THEN 'rel/a/' || c_custkey WHEN 3 THEN '..' ELSE c_custkey::VARCHAR END AS portable, c_custkey % 4 < 2 AS safe FROM customer",
    "fn_19_first_texts": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'third' ELSE 'last' END AS first FROM orders",
    "fn_21_batch_digests": "SELECT n_nationkey, printf('template-batch-%04d-', n_nationkey) || left(sha256(n_name || '|' || n_regionkey), 12) AS batch_id FROM nation",
    "fn_23_bare_labels": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || '(x' END AS label FROM part",
    "fn_25_tails": "SELECT doc_id, right(text, 40) AS tail, true AS undecodable FROM documents",
    "evd_03_statuses": "SELECT l_orderkey, string_agg(s, ',' ORDER BY p) AS statuses FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS s, min((l_linenumber, l_partkey, l_returnflag, l_linestatus)) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "inc_08_refreshed": "SELECT page_id AS key, url FROM pages WHERE page_id % 5 = 0 OR page_id % 6 = 0",
    "dsp_03_stamped_packets": "SELECT c_custkey AS packet_id, 'lane-' || (c_custkey % 3) AS lane_id, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'beta' ELSE 'alpha' END WHEN 1 THEN 'gamma' END AS selected_agent FROM customer",
    "mrg_07_normalised_items": f"WITH o AS (SELECT output_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS raw FROM (SELECT {CQ._K} AS output_id, {CQ.LANE_RAW} AS raw FROM orders)) {_NODES_OF}",
}
