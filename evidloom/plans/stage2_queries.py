"""Stage 2, review and contract queries bound to the test tables: pages are templates, labels reviews, turns agents' answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.functions import values as X
from evidloom.operators import stage2 as S
from evidloom.plans.text_queries import table


def _templates(spark, sf_dir):
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select(F.format_string("t%04d", k).alias("template_name"), k.alias("ord"), F.sha2("html", 256).alias("sha256"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("file_name"))


def _categories(spark, sf_dir):
    """One category for each benchmark item: it covers three templates and names two targets."""
    k = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(F.format_string("c%03d", k).alias("category_id"), k.alias("ord"), F.array(*[F.format_string("t%04d", (k * m) % 45) for m in (1, 7, 11)]).alias("templates"), F.array(F.format_string("target-%d", k % 6), F.format_string("target-%d", k % 4)).alias("targets"))


def prj_14_template_batches(spark, sf_dir):
    out = S.template_batches(_templates(spark, sf_dir), _categories(spark, sf_dir))
    return out.select("template_name", "category_id", F.array_join("targets", ",").alias("targets"))


def inc_07_needs_batch(spark, sf_dir):
    t = _templates(spark, sf_dir)
    previous = t.where("ord % 5 <> 0").select("template_name", F.when(F.col("ord") % 7 == 0, F.lit("old")).otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("ord") % 11 == 0, "failed").otherwise("completed").alias("status"))
    return S.needs_batch(t, previous, t.where("ord % 3 <> 0"))


def jn_10_cache_match(spark, sf_dir):
    t = _templates(spark, sf_dir)
    return S.cache_match(t, t.where("ord % 6 <> 0").select("template_name", F.when(F.col("ord") % 4 == 0, F.lit("xx")).otherwise(F.col("file_name")).alias("file_name")))


def udf_04_latest_results(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    raw = F.when(t % 4 == 0, F.concat(F.lit('{"title":"a'), t, F.lit('"}'))).when(t % 4 == 1, F.concat(F.lit('{"cases":[{"title":"b'), t, F.lit('"},{"title":"no"}]}'))).when(t % 4 == 2, F.lit("[1]")).otherwise(F.col("text"))
    return S.latest_results(c.select(F.concat(F.lit("t"), "conv_id").alias("template_name"), t.alias("ord"), raw.alias("raw")))


def prj_18_drafts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return S.drafts(d.select(F.concat(F.lit("t"), "doc_id").alias("template_name"), "text", (F.col("doc_id") % 3).alias("nodes_found")))


def prj_19_markdown(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    fields = F.array(F.struct(F.lit("return_flag").alias("name"), F.col("l_returnflag").alias("value")), F.struct(F.lit("line_status").alias("name"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus")).alias("value")))
    rows = li.select(F.concat(F.lit("order_"), "l_orderkey").alias("template_name"), F.concat(F.lit("Line "), "l_linenumber").alias("title"), fields.alias("fields"), F.when(F.col("l_linenumber") % 2 == 0, "complete").otherwise("partial").alias("coverage"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"))
    return S.markdown(rows)


def agg_09_gap_report(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    gaps = F.array(F.concat(F.col("event_type"), F.lit("-"), F.col("event_id")), F.when(F.col("event_id") % 2 == 0, "  ").otherwise("x"))
    rows = e.select(F.concat(F.lit("t"), "user_id").alias("template_name"), F.col("event_id").alias("ord"), gaps.alias("gap_items"), F.when(F.col("event_id") % 4 == 0, F.array(F.lit("nf"))).alias("not_found"))
    return S.gap_report(rows)


def agg_09_evidence_usage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.concat(F.lit("t"), F.col("l_orderkey") % 100).alias("template_name"), F.lit("h").alias("heading"), F.array(F.concat(F.lit("e"), "l_partkey"), F.concat(F.lit("e"), "l_suppkey")).alias("evidence_ids"))
    return S.evidence_usage(rows)


def val_20_record_errors(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("t"), k).alias("template_name"), F.when(k % 7 != 0, "record-1").alias("schema_name"), F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("fact"), F.when(k % 13 == 0, " ").otherwise("b"))).alias("facts"),
        F.when(k % 5 != 0, F.array(F.lit("s"))).alias("sections"), F.array(F.concat(F.lit("e"), k % 40), F.concat(F.lit("e"), k % 90)).alias("evidence_ids"),
    )
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("e"), F.col("n_nationkey") * 2).alias("evidence_id"))
    return S.record_errors(rows, known)


def val_06_finding_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    deep = F.concat(F.repeat(F.lit("["), 21), F.lit('"]]"'), F.repeat(F.lit("]"), 21))
    rows = e.select(
        k.alias("finding_id"), F.when(k % 9 == 0, "odd").otherwise("major").alias("severity"), F.when(k % 8 == 0, None).otherwise("open").alias("status"), F.when(k % 7 != 0, k % 2 == 0).alias("repair_required"),
        F.when(k % 6 == 0, deep).when(k % 5 == 0, F.lit("{")).otherwise(F.lit('{"a":[1,"[[["]}')).alias("probe"),
    )
    return S.finding_errors(rows, ["minor", "major"], ["open", "closed"])


def val_29_review_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("main").alias("lane_id"))
    x = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.lit("main").alias("lane_id"), F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("status"), (F.col("toxic") * 10 + F.col("quality")).alias("ord"))
    return S.review_gate(d, x, ["passed"])


def mrg_06_bundles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    own = F.when(F.col("event_id") % 12 == 0, F.col("user_id") + 1).when(F.col("event_id") % 50 == 0, None).otherwise(F.col("user_id"))
    return S.bundles(e.select(F.col("user_id").alias("chunk_id"), F.col("event_type").alias("lane_id"), own.alias("own_chunk_id"), (F.col("event_id") % 4).alias("items"), F.col("event_id").alias("ord")))


def val_08_summary_errors(spark, sf_dir):
    c = _categories(spark, sf_dir)
    c = c.select(F.when(F.col("ord") % 15 == 1, "c000").otherwise(F.col("category_id")).alias("category_id"), F.when(F.col("ord") % 9 == 0, 2).otherwise(3).alias("passes"), F.when(F.col("ord") % 8 == 0, F.array().cast("array<string>")).otherwise(F.col("templates")).alias("templates"))
    return S.summary_errors(c, _templates(spark, sf_dir).where("ord % 10 <> 7"))


def val_27_dense_sequence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return S.dense_sequence(li.where("l_partkey % 9 <> 0").select(F.col("l_orderkey").alias("phase"), F.col("l_linenumber").alias("n")), "phase")


def val_23_json_depth(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    raw = F.concat(F.repeat(F.lit('{"a":['), (k % 9).cast("int")), F.lit('"]}\\"["'), F.repeat(F.lit("]}"), (k % 9).cast("int")))
    return c.select("c_custkey", X.json_depth(raw).cast("long").alias("depth"))


def fn_05_without_marks(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.without_marks(F.col("text")).alias("plain"))


def fn_15_stable_hash(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    raw = F.concat(F.lit('{"b": '), "n_regionkey", F.lit(', "a": ["'), "n_name", F.lit('", 1.0]}'))
    return n.select("n_nationkey", X.canonical_json(raw).alias("json"), X.stable_hash(raw).alias("hash"))


def fn_20_event_actor(spark, sf_dir):
    n = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    out = X.event_actor(F.when(k % 3 == 0, F.col("s_name")).otherwise(""), F.when(k % 2 == 0, "label"), F.array(F.lit(""), F.concat(F.lit("p"), k)))
    return n.select("s_suppkey", out.alias("actor"), X.batch_digest(k.cast("int"), F.col("s_name")).alias("batch_id"), X.tail(F.col("s_name"), 4).alias("tail"))


QUERIES = {f.__name__: f for f in (prj_14_template_batches, inc_07_needs_batch, jn_10_cache_match, udf_04_latest_results, prj_18_drafts, prj_19_markdown, agg_09_gap_report, agg_09_evidence_usage, val_20_record_errors, val_06_finding_errors, val_29_review_gate, mrg_06_bundles, val_08_summary_errors, val_27_dense_sequence, val_23_json_depth, fn_05_without_marks, fn_15_stable_hash, fn_20_event_actor)}

_CATEGORIES = "cat AS (SELECT printf('c%03d', item_id) AS category_id, item_id AS k, [printf('t%04d', (item_id * m) % 45) for m in [1, 7, 11]] AS templates, [printf('target-%d', item_id % 6), printf('target-%d', item_id % 4)] AS targets FROM benchmark)"
_TEMPLATES = "tpl AS (SELECT printf('t%04d', page_id) AS template_name, page_id AS k, regexp_extract(url, '/([a-z]{2})/', 1) AS file_name FROM pages)"
ORACLES = {
    "prj_14_template_batches": f"""WITH {_CATEGORIES}, {_TEMPLATES}, j AS (SELECT template_name, cat.k, category_id, targets FROM tpl JOIN (SELECT *, unnest(templates) AS t FROM cat) cat ON t = template_name),
x AS (SELECT template_name, unnest(targets) AS target, k * 10 + generate_subscripts(targets, 1) AS o FROM j), y AS (SELECT template_name, target, min(o) AS o FROM x GROUP BY ALL), z AS (SELECT template_name, string_agg(target, ',' ORDER BY o) AS targets FROM y GROUP BY 1)
SELECT template_name, arg_min(category_id, j.k) AS category_id, any_value(z.targets) AS targets FROM j JOIN z USING (template_name) GROUP BY template_name""",
    "inc_07_needs_batch": f"WITH {_TEMPLATES}, r AS (SELECT template_name, CASE WHEN k % 5 = 0 THEN 'new' WHEN k % 7 = 0 THEN 'changed' WHEN k % 11 = 0 THEN 'failed' WHEN k % 3 = 0 THEN 'target_missing' END AS reason FROM tpl) SELECT * FROM r WHERE reason IS NOT NULL",
    "jn_10_cache_match": f"WITH {_TEMPLATES} SELECT template_name, CASE WHEN k % 6 = 0 THEN 'template_missing_in_cache' ELSE 'template_file_mismatch' END AS code FROM tpl WHERE k % 6 = 0 OR k % 4 = 0",
    "udf_04_latest_results": "SELECT 't' || conv_id AS template_name, arg_max(CASE turn % 4 WHEN 0 THEN 'a' ELSE 'b' END || turn, turn) AS title FROM conversations WHERE turn % 4 < 2 GROUP BY conv_id",
    "prj_18_drafts": "SELECT 't' || doc_id AS template_name, coalesce(text, '')[1:500] AS content, CASE WHEN doc_id % 3 > 0 THEN 'partial' ELSE 'missing' END AS coverage FROM documents",
    "prj_19_markdown": """WITH c AS (SELECT 'order_' || l_orderkey AS n, (l_linenumber, l_partkey, l_suppkey) AS o, '## Line ' || l_linenumber || chr(10) || '**Return Flag**: ' || l_returnflag || chr(10) || '**Line Status**: ' || CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus ELSE '' END || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE chr(10) || '> coverage: partial' END AS t FROM lineitem)
SELECT n AS template_name, '# ' || n || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY o, t) AS text FROM c GROUP BY n""",
    "agg_09_gap_report": """WITH g AS (SELECT user_id, event_id, unnest([event_type || '-' || event_id, CASE WHEN event_id % 2 <> 0 THEN 'x' END, CASE WHEN event_id % 4 = 0 THEN 'nf' END]) AS g, generate_subscripts([1, 2, 3], 1) AS i FROM events)
SELECT 't' || user_id AS template_name, string_agg(g, '; ' ORDER BY event_id, i) AS gaps FROM g WHERE g IS NOT NULL GROUP BY user_id""",
    "agg_09_evidence_usage": "WITH e AS (SELECT l_orderkey % 100 AS t, unnest(['e' || l_partkey, 'e' || l_suppkey]) AS evidence_id FROM lineitem) SELECT evidence_id, count(DISTINCT t)::BIGINT AS templates, count(*)::BIGINT AS uses FROM e GROUP BY evidence_id",
    "val_20_record_errors": """WITH p AS (SELECT p_partkey AS k, 't' || p_partkey AS item_id FROM part), u AS (SELECT DISTINCT item_id, unnest(['e' || (k % 40), 'e' || (k % 90)]) AS ref FROM p)
SELECT 'record' AS scope, item_id, 'record_missing_schema' AS code FROM p WHERE k % 7 = 0 UNION ALL SELECT 'record', item_id, 'record_without_facts' FROM p WHERE k % 11 = 0 UNION ALL SELECT 'record', item_id, 'record_empty_fact' FROM p WHERE k % 13 = 0 AND k % 11 <> 0
UNION ALL SELECT 'record', item_id, 'record_without_sections' FROM p WHERE k % 5 = 0 UNION ALL SELECT 'record', item_id, 'record_unknown_evidence:' || ref FROM u WHERE ref NOT IN (SELECT 'e' || (n_nationkey * 2) FROM nation)""",
    "val_06_finding_errors": " UNION ALL ".join(f"SELECT 'finding' AS scope, event_id::VARCHAR AS item_id, '{c}' AS code FROM events WHERE {w}" for c, w in (("finding_bad_severity", "event_id % 9 = 0"), ("finding_bad_status", "event_id % 8 = 0"), ("finding_repair_not_boolean", "event_id % 7 = 0"), ("finding_probe_invalid", "event_id % 5 = 0 AND event_id % 6 <> 0"), ("finding_probe_too_deep", "event_id % 6 = 0"))),
    "val_29_review_gate": """WITH l AS (SELECT doc_id, arg_max(quality, toxic * 10 + quality) AS q FROM labels GROUP BY doc_id)
SELECT doc_id AS chunk_id, 'main' AS lane_id, CASE WHEN q IS NULL THEN 'review_missing' ELSE 'review_not_passed' END AS code FROM documents LEFT JOIN l USING (doc_id) WHERE q IS NULL OR q <> 1""",
    "mrg_06_bundles": """WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 12 = 0 THEN false WHEN event_id % 50 = 0 THEN false ELSE true END AS own FROM events),
l AS (SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS lanes FROM (SELECT user_id, event_type, min(event_id) AS o FROM e WHERE own GROUP BY ALL) GROUP BY user_id)
SELECT user_id AS chunk_id, coalesce(any_value(lanes), '') AS lanes, sum(CASE WHEN own THEN event_id % 4 ELSE 0 END)::BIGINT AS n_items, (count(*) FILTER (WHERE NOT own))::BIGINT AS foreign FROM e LEFT JOIN l USING (user_id) GROUP BY user_id""".replace("AS foreign", 'AS "foreign"'),
    "val_08_summary_errors": f"""WITH {_CATEGORIES}, {_TEMPLATES}, c AS (SELECT CASE WHEN k % 15 = 1 THEN 'c000' ELSE category_id END AS id, CASE WHEN k % 9 = 0 THEN 2 ELSE 3 END AS passes, CASE WHEN k % 8 = 0 THEN [] ELSE templates END AS templates FROM cat),
n AS (SELECT DISTINCT unnest(templates) AS t FROM c), s AS (SELECT template_name FROM tpl WHERE k % 10 <> 7)
SELECT 'category' AS scope, id AS item_id, 'summary_passes_invalid' AS code FROM c WHERE passes <> 3 UNION ALL SELECT 'category', id, 'category_without_templates' FROM c WHERE len(templates) = 0 UNION ALL SELECT 'category', id, 'category_id_duplicate' FROM c GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'template', template_name, 'template_not_covered' FROM s WHERE template_name NOT IN (SELECT t FROM n) UNION ALL SELECT 'template', t, 'template_unknown' FROM n WHERE t NOT IN (SELECT template_name FROM s)""",
    "val_27_dense_sequence": """WITH b AS (SELECT l_orderkey AS phase, count(*) AS n, count(DISTINCT l_linenumber) AS k, min(l_linenumber) AS a, max(l_linenumber) AS z FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY 1)
SELECT phase, CASE WHEN n > k THEN 'batch_sequence_duplicate' ELSE 'batch_sequence_gap' END AS code FROM b WHERE n > k OR a <> 1 OR z <> k""",
    "val_23_json_depth": "SELECT c_custkey, (c_custkey % 9 * 2)::BIGINT AS depth FROM customer",
    "fn_05_without_marks": "SELECT item_id, strip_accents(text) AS plain FROM benchmark",
    "fn_15_stable_hash": """SELECT n_nationkey, '{"a":["' || n_name || '",1],"b":' || n_regionkey || '}' AS json, sha256('{"a":["' || n_name || '",1],"b":' || n_regionkey || '}') AS hash FROM nation""",
    "fn_20_event_actor": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 2 = 0 THEN 'label' ELSE 'p' || s_suppkey END AS actor, printf('template-batch-%04d-', s_suppkey) || substr(sha256(s_name), 1, 12) AS batch_id, right(s_name, 4) AS tail FROM supplier",
}
