"""Stage 1 as a flow over a versioned store: prepare, ingest, merge and claim, each one published change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evidloom.operators import chunks as K
from evidloom.operators import contracts as C
from evidloom.operators import dispatch as D
from evidloom.operators import input_cache as I
from evidloom.operators import ledgers as L
from evidloom.operators import merge as M
from evidloom.sources.tables import cut, forget
from evidloom.sources.versions import Conflict, Store


def prepare(store: Store, texts: DataFrame, templates: DataFrame, lanes: DataFrame, *, patterns: tuple[str, ...] = (), max_chars: int = 20_000, overlap_chars: int = 1_200, config: str = "") -> dict:
    """Texts (source_id, text), templates (template_name, sha256) and lanes (lane_no, lane_id, agent_role, required) -> chunks, packets, run records and the input cache, published as one version.

    Where there is a version before, the trees of inputs are compared: of sources that have changed, or are gone, the rows are replaced, and evidence
    of chunks that are gone or support a changed template is deleted; all other rows stay in their files.
    """
    made = cut(K.chunks(texts, patterns=patterns, max_chars=max_chars, overlap_chars=overlap_chars).drop("text"))
    tree = cut(I.tree(made, templates, f"{config}|{patterns}|{max_chars}|{overlap_chars}"))
    packets_of = lambda c: D.task_packets(c, lanes)
    runs_of = lambda p: p.select("source_id", F.col("packet_id").alias("run_id"), "chunk_id", "lane_id", "agent_role", F.lit("pending").alias("status"))
    before, change = store.read("cache"), store.begin()
    outcome = {"source_flow": "refreshed", "templates": "refreshed", "changed_sources": None}
    if before is None:
        packets = packets_of(made)
        for name, rows in (("chunks", made), ("packets", packets), ("runs", runs_of(packets))):
            change.put(name, rows, "source_id")
        change.put("templates", templates.select("template_name", "sha256"))
    else:
        found = cut(I.changes(before, tree))
        kind = made.schema["source_id"].dataType
        sources = found.where("level = 'chunk'").select(F.col("source_id").cast(kind).alias("source_id")).distinct()
        n = {r["level"]: r["n"] for r in found.groupBy("level").agg(F.count("*").alias("n")).collect()}
        if n.get("chunk"):
            own = made.join(sources.select(F.col("source_id").alias("__s")), F.col("source_id") == F.col("__s"), "left_semi")
            packets = packets_of(own)
            for name, rows in (("chunks", own), ("packets", packets), ("runs", runs_of(packets))):
                change.replace(name, sources, rows)
        if n.get("template"):
            change.put("templates", templates.select("template_name", "sha256"))
        if "evidence" in change.tables and n:
            changed = found.where("level = 'template'").select(F.col("name").alias("template_name"))
            gone = found.where("level = 'chunk' AND change <> 'added'").select(F.concat_ws(":", "source_id", "name").alias("chunk_key"))
            forget_evidence(store, change, changed, gone)
        outcome = {"source_flow": "refreshed" if n.get("chunk") else "reused", "templates": "refreshed" if n.get("template") else "reused", "changed_sources": sources.count()}
        forget(found)
    change.put("cache", tree)
    version = change.commit(stage="prepared", **outcome)
    forget(made)
    forget(tree)
    return {"status": "prepared", "version": version, **outcome}


def forget_evidence(store: Store, change, changed_templates: DataFrame, gone_chunks: DataFrame | None = None) -> list[int]:
    """Delete from the staged evidence (chunk_key, template_name, ...) all rows of chunks that support a changed template (template_name) or are gone (chunk_key); the buckets written."""
    evidence = store.read("evidence")
    hit = D.affected_chunks(changed_templates, evidence.withColumnRenamed("chunk_key", "chunk_id")).withColumnRenamed("chunk_id", "chunk_key")
    return change.replace("evidence", hit if gone_chunks is None else hit.unionByName(gone_chunks).distinct())


def ingest(store: Store, bundles: DataFrame, lanes: list[str], *, require_review: bool = True) -> dict:
    """Bundles (bundle_id, raw JSON) -> the good ones in 'bundles', the others with their codes in 'bundle_errors', both published; status failed if one bundle is bad.

    Bundles are judged and written in one pass; what it counts on the way decides the outcome, so nothing is read again for it.
    """
    errors = C.bundle_errors(bundles, lanes, require_review=require_review)
    by_bundle = errors.groupBy("item_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    joined = bundles.join(by_bundle, F.col("bundle_id").cast("string") == F.col("item_id"), "left")
    judged = joined.select("bundle_id", "raw", "codes", F.col("codes").isNull().cast("int").alias("good"))
    seen = Observation("ingested")
    observed = judged.observe(seen, F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("*").alias("n"))
    change = store.begin()
    change.split(observed, "good", {1: "bundles", 0: "bundle_errors"})
    counts = seen.get
    bad = counts["n"] - counts["good"]
    status = "failed" if bad else "success"
    version = change.commit(stage="ingested", ingest_status=status, good=counts["good"], bad=bad)
    return {"status": status, "version": version, "good": counts["good"], "bad": bad}


def merge(store: Store, queue: DataFrame, items: DataFrame, lanes: list[str], *, order: list[str], body: list[str]) -> dict:
    """The merge queue (queue_id, status, bundle_paths, lanes) and items (bundle_id, item_id, order..., body..., lane_output_path) of ingested bundles -> 'items' and 'conflicts' published, or queue errors and no change of either.

    Items of bundles that weren't ingested are left out: a semi-join with the published bundles.
    """
    errors = cut(L.queue_errors(queue, lanes))
    change = store.begin()
    if n := errors.count():
        change.put("queue_errors", errors)
        version = change.commit(stage="merge_refused", queue_errors=n)
        forget(errors)
        return {"status": "failed", "version": version, "errors": n}
    good = store.read("bundles").select(F.col("bundle_id").alias("__b"))
    own = items.join(good, F.col("bundle_id") == F.col("__b"), "left_semi")
    parts = M.merge_items(own, key="item_id", order=order, body=body, provenance="lane_output_path")
    change.put("items", parts["kept"], "item_id")
    change.put("conflicts", parts["conflicts"])
    version = change.commit(stage="merged", queue_errors=0)
    forget(errors)
    return {"status": "success", "version": version, "errors": 0}


def winners(attempts: DataFrame) -> DataFrame:
    """A log of attempts (batch_id, claimer, seq) -> batch_id, claimer, seq, n_attempts: the lowest sequence number has the batch, of equal ones the least claimer. The log may be replayed, in any order and with repeats."""
    best = F.min(F.struct("seq", "claimer")).alias("w")
    return attempts.groupBy("batch_id").agg(best, F.count_distinct(F.struct("seq", "claimer")).alias("n_attempts")).select("batch_id", "w.claimer", "w.seq", "n_attempts")


def claim(store: Store, plan: DataFrame, claimer: str, limit: int, *, retries: int = 20) -> list:
    """The ids of at most `limit` batches of a plan (batch_id, ord) that nobody holds, now held by this claimer, in plan order.

    The log is read and added to under one version: if another claimer has published meanwhile, this one looks again. A batch is never held twice.
    """
    for _ in range(retries):
        change = store.begin()
        taken = change.tables.get("claims")
        free = plan.select("batch_id", "ord")
        if taken is not None:
            held = store._rows(taken, [f for _, f in taken["parts"]]).select(F.col("batch_id").alias("__b"))
            free = free.join(held, F.col("batch_id") == F.col("__b"), "left_anti")
        got = [r["batch_id"] for r in free.orderBy("ord", "batch_id").limit(limit).collect()]
        if not got:
            return []
        kind = plan.schema["batch_id"].dataType.simpleString()
        change.add("claims", store.spark.createDataFrame([(b, claimer, change.start + 1) for b in got], f"batch_id {kind}, claimer string, seq bigint"))
        try:
            change.commit()
        except Conflict:
            continue
        return got
    raise Conflict(f"no version could be published in {retries} attempts")
