"""Work-batch state over a stream of output events, and chunking of arriving texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.operators.chunks import chunks

STATE = "batch_id bigint, status string, outputs bigint, changed_at timestamp"


def chunk_stream(texts: DataFrame, **parameters) -> DataFrame:
    """The chunk ledger of arriving texts (source_id, text). Chunking is row-local, so the stream keeps no state."""
    return chunks(texts, **parameters)


def batch_states(events: DataFrame, wanted: int, delay: str = "10 minutes") -> DataFrame:
    """Events (batch_id, path, present, at) of outputs that appear and vanish -> STATE, a row whenever a batch's status changes.

    A batch is completed while `wanted` different outputs are there, running while some are, pending while none is; an
    output that vanishes takes it back. Events later than the watermark are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        paths, status = (set(state.get[0]), state.get[1]) if state.exists else (set(), "pending")
        rows = pd.concat(list(frames)).sort_values(["at", "path"], kind="stable")
        out = []
        for path, present, at in rows[["path", "present", "at"]].itertuples(index=False, name=None):
            (paths.add if present else paths.discard)(path)
            now = "completed" if len(paths) >= wanted else "running" if paths else "pending"
            if now != status:
                out.append((key[0], now, len(paths), at))
                status = now
        state.update((sorted(paths), status))
        yield pd.DataFrame(out, columns=["batch_id", "status", "outputs", "changed_at"])

    timed = events.withWatermark("at", delay)
    return timed.groupBy("batch_id").applyInPandasWithState(fold, STATE, "paths array<string>, status string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Events (event_type, ts) -> counts for each window and type, late ones up to the delay counted."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def upsert_each(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's last row for a key is written beside the others under its number, so that a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("changed_at", *rest)).alias("l")).select(key, "l.*", F.lit(number).alias("batch_number"))
        last.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def current(spark, target: str, key: str) -> DataFrame:
    """The last row of each key over all batches written by upsert_each()."""
    rows = spark.read.parquet(f"{target}/*")
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("batch_number", "changed_at", *rest)).alias("l")).select(key, "l.*").drop("batch_number")
