"""Stage 1 flows over a versioned store in the shared folder: what the published tables hold in the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.operators import input_cache as I
from evidloom.operators import chunks as K
from evidloom.operators import stage1 as S
from evidloom.plans.contract_queries import _B, BUNDLE_RAW, LANE_IDS
from evidloom.plans.contract_queries import ORACLES as CONTRACTS
from evidloom.plans.text_queries import _CHUNKS, HEADING, MAX_CHARS, OVERLAP, table
from evidloom.sources.tables import shared_dir
from evidloom.sources.versions import Store

#: Documents as they are the second time: some changed, some gone.
CHANGED = "CASE WHEN doc_id % 10 = 3 THEN concat(text, ' Added words.') ELSE text END"
KEPT = "doc_id % 10 <> 7"
LANES = "lane_no int, lane_id string, agent_role string, required boolean"


def _store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _texts(spark, sf_dir, again: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "doc_id", "text")
    return docs.where(KEPT).select("source_id", F.expr(CHANGED).alias("text")) if again else docs.select("source_id", "text")


def _templates(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("template_name"), F.sha2("n_name", 256).alias("sha256"))


def _lanes(spark) -> DataFrame:
    return spark.createDataFrame([(1, "click", "click-agent", True), (2, "purchase", "purchase-agent", True), (3, "view", "view-agent", False)], LANES)


def dsp_05_prepare(spark, sf_dir):
    """Prepared twice, the second time of changed texts: chunks, packets and runs of the last version (DSP-05, INC-01, INC-03, PRJ-02, PRJ-10)."""
    store = _store(spark)
    for again in (False, True):
        S.prepare(store, _texts(spark, sf_dir, again), _templates(spark, sf_dir), _lanes(spark), patterns=(HEADING,), max_chars=MAX_CHARS, overlap_chars=OVERLAP)
    chunks = store.read("chunks").select(F.col("source_id").alias("__s"), F.col("chunk_id").alias("__c"), "start", "end", "sha256")
    runs = store.read("runs").select("run_id", "status")
    packets = store.read("packets").join(runs, F.col("packet_id") == F.col("run_id"))
    joined = packets.join(chunks, (F.col("source_id") == F.col("__s")) & (F.col("chunk_id") == F.col("__c")))
    return joined.select("packet_id", "source_id", "chunk_id", "lane_id", "status", "start", "end", "sha256")


def inc_01_changes(spark, sf_dir):
    """What differs between the inputs of two runs, by descending unequal branches of their trees (INC-01, INC-02)."""
    tree = lambda again: I.tree(K.chunks(_texts(spark, sf_dir, again), patterns=(HEADING,), max_chars=MAX_CHARS, overlap_chars=OVERLAP), _templates(spark, sf_dir).where("template_name <> 'FRANCE'") if again else _templates(spark, sf_dir))
    return I.changes(tree(False), tree(True))


#: Evidence: events as findings in the chunk of their user, for a template.
EVIDENCE = "SELECT event_id, 'chunk:' || user_id AS chunk_key, event_type || '-' || (event_id % 200) AS template_name FROM events"


def inc_04_scoped_deletion(spark, sf_dir):
    """Evidence after the deletion of all rows of chunks that support a changed template: the published table (INC-04, SNK-09)."""
    store = _store(spark)
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "concat('chunk:', user_id) AS chunk_key", "concat(event_type, '-', event_id % 200) AS template_name")
    change = store.begin()
    change.put("evidence", rows, "chunk_key")
    change.commit()
    change = store.begin()
    S.forget_evidence(store, change, rows.where("event_id % 100 = 7").select("template_name").distinct())
    change.commit()
    return store.read("evidence")


def mrg_09_ingest(spark, sf_dir):
    """Bundles ingested: good ones, the codes of the others, and the outcome, as they were published (MRG-09, MRG-06)."""
    store = _store(spark)
    S.ingest(store, table(spark, sf_dir, "customer").selectExpr(f"{_B} AS bundle_id", f"{BUNDLE_RAW} AS raw"), LANE_IDS)
    notes = store.manifest()["notes"]
    good = store.read("bundles").select(F.lit("bundle").alias("kind"), F.col("bundle_id").cast("string").alias("item_id"), F.lit("").alias("code"))
    bad = store.read("bundle_errors").select(F.lit("error").alias("kind"), F.col("bundle_id").cast("string").alias("item_id"), F.explode("codes").alias("code"))
    said = spark.range(1).select(F.lit("status").alias("kind"), F.lit(f"{notes['good']}/{notes['good'] + notes['bad']}").alias("item_id"), F.lit(notes["ingest_status"]).alias("code"))
    return good.unionByName(bad).unionByName(said)


def mrg_10_merge(spark, sf_dir):
    """Ingested bundles merged into canonical items: orders are a bundle's items, an item is a priority of a month; the published items and conflicts (MRG-10, VAL-26, MRG-01)."""
    store = _store(spark)
    good = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").selectExpr(f"{_B} AS bundle_id", "'{\"chunk_id\":\"c\",\"source_range\":[0,9],\"lane_outputs\":[{\"chunk_id\":\"c\",\"lane_id\":\"lane-1\",\"output_status\":\"completed\"}],\"review_findings\":[]}' AS raw")
    S.ingest(store, good, ["lane-1"])
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey AS bundle_id", "concat(o_orderpriority, '/', date_format(o_orderdate, 'yyyy-MM')) AS item_id", "o_orderkey", "o_orderstatus AS label", "concat('out/', o_custkey, '.json') AS lane_output_path")
    queue = spark.createDataFrame([("q", "ready", ["b"], ["lane-1"])], "queue_id string, status string, bundle_paths array<string>, lanes array<string>")
    outcome = S.merge(store, queue, orders, ["lane-1"], order=["o_orderkey"], body=["label"])
    if outcome["status"] != "success":
        raise RuntimeError(f"merge refused: {outcome}")
    items = store.read("items").select(F.lit("item").alias("kind"), "item_id", "label", F.array_join("provenance", ",").alias("detail"))
    conflicts = store.read("conflicts").select(F.lit("conflict").alias("kind"), "item_id", F.col("o_orderkey").cast("string").alias("label"), F.concat_ws("<", "kept_from", "conflicting").alias("detail"))
    return items.unionByName(conflicts)


def dsp_01_claim_log(spark, sf_dir):
    """Who holds each batch after a log of claims by many claimers, replayed: events are attempts of their users on batches of 50 events (DSP-01, DSP-02)."""
    attempts = table(spark, sf_dir, "events").selectExpr("event_id div 50 AS batch_id", "concat('agent-', user_id) AS claimer", "unix_micros(CAST(ts AS TIMESTAMP)) AS seq")
    return S.winners(attempts.unionByName(attempts.where("seq % 3 = 0")))


QUERIES = {f.__name__: f for f in (dsp_05_prepare, inc_01_changes, inc_04_scoped_deletion, mrg_09_ingest, mrg_10_merge, dsp_01_claim_log)}

_AGAIN = _CHUNKS.replace("documents", "second")
_SECOND = f"second AS (SELECT * REPLACE ({CHANGED} AS text) FROM documents WHERE {KEPT})"
ORACLES = {
    "dsp_05_prepare": f"WITH {_SECOND}, {_AGAIN} SELECT doc_id || ':' || chunk_id || ':' || lane || ':attempt-001' AS packet_id, doc_id AS source_id, chunk_id, lane AS lane_id, 'pending' AS status, s AS start, e AS \"end\", sha256(t) AS sha256 FROM chunks, (VALUES ('click'), ('purchase')) AS l(lane)",
    "inc_01_changes": f"""WITH a AS (WITH {_CHUNKS} SELECT doc_id, chunk_id, s, e, sha256(t) AS h FROM chunks), b AS (WITH {_SECOND}, {_AGAIN} SELECT doc_id, chunk_id, s, e, sha256(t) AS h FROM chunks)
SELECT 'chunk' AS level, coalesce(a.doc_id, b.doc_id)::VARCHAR AS source_id, coalesce(a.chunk_id, b.chunk_id) AS name, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.chunk_id = b.chunk_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.s <> b.s OR a.e <> b.e OR a.h <> b.h
UNION ALL SELECT 'template', NULL, n_name, 'deleted' FROM nation WHERE n_name = 'FRANCE'""",
    "inc_04_scoped_deletion": f"WITH e AS ({EVIDENCE}) SELECT * FROM e WHERE chunk_key NOT IN (SELECT chunk_key FROM e WHERE template_name IN (SELECT template_name FROM e WHERE event_id % 100 = 7))",
    "mrg_09_ingest": f"""WITH errors AS ({CONTRACTS['val_05_bundle_gate']}), bad AS (SELECT DISTINCT item_id FROM errors)
SELECT 'bundle' AS kind, c_custkey::VARCHAR AS item_id, '' AS code FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT item_id FROM bad)
UNION ALL SELECT 'error', item_id, code FROM errors
UNION ALL SELECT 'status', (count(*) - (SELECT count(*) FROM bad)) || '/' || count(*), CASE WHEN (SELECT count(*) FROM bad) > 0 THEN 'failed' ELSE 'success' END FROM customer""",
    "mrg_10_merge": """WITH o AS (
  SELECT o_orderpriority || '/' || strftime(o_orderdate, '%Y-%m') AS item_id, o_orderkey, o_orderstatus AS label, 'out/' || o_custkey || '.json' AS path FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
), f AS (SELECT item_id, arg_min(label, o_orderkey) AS label, arg_min(path, o_orderkey) AS first FROM o GROUP BY item_id),
p AS (SELECT item_id, path, min(o_orderkey) AS place FROM o JOIN f USING (item_id, label) GROUP BY item_id, path)
SELECT 'item' AS kind, item_id, label, (SELECT string_agg(path, ',' ORDER BY place) FROM p WHERE p.item_id = f.item_id) AS detail FROM f
UNION ALL SELECT 'conflict', o.item_id, o_orderkey::VARCHAR, first || '<' || path FROM o JOIN f ON o.item_id = f.item_id WHERE o.label <> f.label""",
    "dsp_01_claim_log": """WITH a AS (SELECT event_id // 50 AS batch_id, 'agent-' || user_id AS claimer, epoch_us(ts) AS seq FROM events)
SELECT batch_id, arg_min(claimer, (seq, claimer)) AS claimer, min(seq) AS seq, count(DISTINCT (seq, claimer)) AS n_attempts FROM a GROUP BY batch_id""",
}
