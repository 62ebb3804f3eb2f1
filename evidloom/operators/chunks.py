"""Chunk ledgers: texts cut at headings and to a size, numbered, hashed and checked for gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions import text as T


def chunks(texts: DataFrame, *, patterns: tuple[str, ...] = (), max_chars: int = 2000, overlap_chars: int = 120, key: str = "source_id") -> DataFrame:
    """(key, text) -> key, chunk_no, chunk_id, start, end, hint, sha256, text: the ledger, in one pass over the texts, without a shuffle."""
    own = texts.select(key, T.normalised(F.col("text")).alias("text")).where("text IS NOT NULL")
    pieces = F.flatten(F.transform("s", lambda s: F.transform(T.bounded(s["start"], s["end"], max_chars, overlap_chars), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), s["hint"].alias("hint")))))
    cut = own.select(key, "text", T.sections(F.col("text"), patterns).alias("s")).select(key, "text", F.posexplode(pieces).alias("i", "c"))
    piece = F.substring("text", F.col("c.start").cast("int") + 1, (F.col("c.end") - F.col("c.start")).cast("int"))
    return cut.select(
        key,
        (F.col("i") + 1).cast("long").alias("chunk_no"),
        F.format_string("chunk-%04d", F.col("i") + 1).alias("chunk_id"),
        F.col("c.start").alias("start"),
        F.col("c.end").alias("end"),
        F.col("c.hint").alias("hint"),
        F.sha2(piece, 256).alias("sha256"),
        piece.alias("text"),
    )


def coverage_errors(ledger: DataFrame, lengths: DataFrame, key: str = "source_id") -> DataFrame:
    """Ledger (key, chunk_id, start, end, status) and lengths (key, n) -> error rows (key, chunk_id, code): empty ledgers, a first chunk not at 0, gaps, a last chunk short of the end, chunks not completed."""
    order = Window.partitionBy(key).orderBy("start", "end", "chunk_id")
    seen = ledger.select(key, "chunk_id", "start", "end", "status", F.lag("end").over(order).alias("before"), F.lead("start").over(order).alias("after"))
    known = seen.join(lengths.select(F.col(key).alias("__k"), "n"), F.col(key) == F.col("__k"), "left")
    codes = F.array_compact(
        F.array(
            F.when(F.col("before").isNull() & (F.col("start") != 0), "chunk_coverage_start"),
            F.when(F.col("start") > F.col("before"), "chunk_coverage_gap"),
            F.when(F.col("after").isNull() & (F.col("end") != F.col("n")), "chunk_coverage_end"),
            F.when(~F.col("status").eqNullSafe("completed"), "chunk_not_completed"),
        )
    )
    found = known.select(key, "chunk_id", F.explode(codes).alias("code"))
    none = lengths.join(ledger.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")
    return found.unionByName(none.select(key, F.lit("").alias("chunk_id"), F.lit("chunk_ledger_empty").alias("code")))
