"""Packets with their payloads, and rendered documents written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidloom.operators import packets as P
from evidloom.plans.text_queries import _CHUNKS, ledger, table
from evidloom.sources import rendering as R
from evidloom.sources.tables import shared_dir

#: Lanes of a configuration: rules of some 12 KB that all packets share, an evidence policy, a lane's own contract.
RULES = "concat('{\"path\":\"rules.md\",\"content\":\"', repeat('Every statement names its evidence. ', 340), '\"}')"
LANES = (("click", "click-agent", "click.schema.json", "null"), ("purchase", "purchase-agent", "purchase.schema.json", "'{\"least\":2}'"))
REQUIREMENTS = "requirements/template-requirements.json"


def _contract(lane: str, role: str, schema: str) -> str:
    return f'\'{{"lane_id":"{lane}","agent_role":"{role}","schema":"{schema}","required":true}}\''


def _lanes(spark):
    one = lambda lane, role, schema, policy: f"SELECT '{lane}' AS lane_id, '{role}' AS agent_role, '{schema}' AS schema, true AS required, {_contract(lane, role, schema)} AS lane_contract, CAST({policy} AS STRING) AS required_evidence_policy, {RULES} AS extraction_quality_rules"
    return spark.sql(" UNION ALL ".join(one(*x) for x in LANES))


def _packets(spark, sf_dir):
    chunks = ledger(spark, sf_dir).select("source_id", F.concat(F.lit("source/"), F.col("source_id").cast("string"), F.lit(".txt")).alias("source_path"), "chunk_id", "start", "end", "hint")
    lanes = _lanes(spark)
    return P.payloads(chunks, lanes, requirements_path=REQUIREMENTS), P.dictionary(lanes)


def prj_02_payloads(spark, sf_dir):
    """Packets as they are kept, with references, and as they are resolved: digests and sizes of both (PRJ-02, PRJ-06, PRJ-16)."""
    packets, entries = _packets(spark, sf_dir)
    whole = P.resolved(packets, entries)
    digests = whole.select(F.col("packet_id").alias("__w"), F.sha2("raw", 256).alias("whole_sha256"))
    own = P.sizes(packets, whole).join(digests, F.col("packet_id") == F.col("__w")).drop("__w")
    return own.join(packets.select(F.col("packet_id").alias("__r"), F.sha2("raw", 256).alias("sha256")), F.col("packet_id") == F.col("__r")).drop("__r")


def dsp_07_render(spark, sf_dir):
    """A document for each supplier, its line items as lines, rendered twice so that the second overwrites with a backup; names, digests and sizes of all files read back (DSP-07, SNK-07, SNK-08)."""
    folder = f"{shared_dir(spark)}/rendered-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("template_name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.lit("- "), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit(" "), F.col("l_returnflag")).alias("text"),
    )
    R.render(lines.where("ord % 10 = 1"), folder)
    R.render(lines, folder)
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))
    return files


def src_18_verified(spark, sf_dir):
    """Rendered documents read through a ledger that names a wrong size for one in five and a wrong digest for one in seven: those give nothing (SRC-18)."""
    folder = f"{shared_dir(spark)}/verified-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "part").selectExpr("concat('group-', p_partkey % 60) AS template_name", "p_partkey AS ord", "p_name AS text")
    ledger_ = R.render(lines, folder)
    number = F.regexp_extract("template_name", "([0-9]+)$", 1).cast("int")
    damaged = ledger_.select(F.col("target").alias("file_name"), F.when(number % 5 == 0, F.col("n_bytes") + 1).otherwise(F.col("n_bytes")).alias("size"), F.when(number % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return R.verified_texts(spark, folder, damaged).select("file_name", F.sha2("text", 256).alias("sha256"), F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (prj_02_payloads, dsp_07_render, src_18_verified)}


def _packet_sql(whole: bool) -> str:
    ref = lambda c: f"'{{\"sha256\":\"' || sha256({c}) || '\"}}'"
    value = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE {c if whole else ref(c)} END"
    text = lambda c: f"coalesce(to_json({c})::VARCHAR, 'null')"
    return (
        "'{\"task_packet_id\":' || " + text("id") + " || ',\"stage\":\"stage1\",\"chunk_id\":' || " + text("chunk_id") + " || ',\"lane_id\":' || " + text("lane") + " || ',\"agent_role\":' || " + text("role") + " || ',\"source_path\":' || " + text("'source/' || doc_id || '.txt'")
        + f" || ',\"source_range\":[' || s || ',' || e || '],\"chapter_hint\":' || {text('hint')} || ',\"relevant_template_requirements\":{{\"path\":\"{REQUIREMENTS}\"}},\"lane_contract\":' || {value('contract')} || ',\"allowed_output_schema\":' || {text('schema')}"
        + f" || ',\"required_evidence_policy\":' || {value('policy')} || ',\"extraction_quality_rules\":' || {value('rules')} || ',\"attempt\":1,\"task_packet_path\":\"intermediate/task-packets/' || chunk_id || '/' || lane || '.json\"}}'"
    )


_LANE_ROWS = ", ".join(f"('{lane}', '{role}', '{schema}', {policy}, {_contract(lane, role, schema)})" for lane, role, schema, policy in LANES)
ORACLES = {
    "prj_02_payloads": f"""WITH {_CHUNKS}, p AS (
  SELECT *, doc_id || ':' || chunk_id || ':' || lane || ':attempt-001' AS id, {RULES} AS rules FROM chunks, (VALUES {_LANE_ROWS}) l(lane, role, schema, policy, contract)
), r AS (SELECT id AS packet_id, {_packet_sql(False)} AS light, {_packet_sql(True)} AS whole FROM p)
SELECT packet_id, strlen(light)::BIGINT AS n_bytes, strlen(whole)::BIGINT AS whole_bytes, sha256(whole) AS whole_sha256, sha256(light) AS sha256 FROM r""",
    "dsp_07_render": """WITH l AS (SELECT 'supplier-' || l_suppkey AS name, l_orderkey * 10 + l_linenumber AS ord, '- ' || l_orderkey || '/' || l_linenumber || ' ' || l_returnflag || chr(10) AS text FROM lineitem),
f AS (SELECT name || '.md' AS file_name, string_agg(text, '' ORDER BY ord, text) AS t FROM l GROUP BY name UNION ALL SELECT name || '.md.bak', string_agg(text, '' ORDER BY ord, text) FROM l WHERE ord % 10 = 1 GROUP BY name)
SELECT file_name, sha256(t) AS sha256, strlen(t)::BIGINT AS n_bytes FROM f""",
    "src_18_verified": """WITH f AS (SELECT p_partkey % 60 AS g, string_agg(p_name || chr(10), '' ORDER BY p_partkey) AS t FROM part GROUP BY 1)
SELECT 'group-' || g || '.md' AS file_name, sha256(t) AS sha256, length(t) AS n_chars FROM f WHERE g % 5 <> 0 AND g % 7 <> 0""",
}
