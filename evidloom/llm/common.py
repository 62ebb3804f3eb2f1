"""Column helpers and lineage cuts that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space, \t, \n, \v, \f and \r.
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Tables whose rows are long texts.
TEXTS = ("documents", "pages")
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Where its files make fewer partitions than there are cores, its rows are dealt out anew: a table so small costs little to shuffle, and its texts much to read through. Larger tables stay as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in TEXTS and df.rdd.getNumPartitions() < cores else df


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row: a lambda's variable is bound, not repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def rows_with(df: DataFrame, **keys: Column) -> DataFrame:
    """df's rows as one column, row, beside the keys: whatever df's columns are called, nothing clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def rows_of(df: DataFrame, like: DataFrame) -> DataFrame:
    """Back from rows_with(): the columns of `like`."""
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in like.columns])


def words_of(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def shingle_hashes(words: Column, k: int) -> Column:
    """XXH64 (seed 42) of each k-word shingle, repeats included: its words joined by a space. Fewer than k words: one shingle of them all; none: no shingle."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - k),
        lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])),
    )
    return (
        F.when(F.size(words) >= k, hashed)
        .when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master, whose executors are the driver, gets a temporary one; a cluster is refused."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="evidloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: The folder that scratch() has opened last in this thread or task.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{_scratch.get() or shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are stored inside this block go to a folder that is deleted at its end: write what is to stay elsewhere before it ends."""
    folder = fresh_path(spark, "scratch")
    before = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(before)
        _delete(spark, folder)


def settled(spark: SparkSession, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows stored; the tables that it has stored on the way are deleted."""
    path = fresh_path(spark, what)
    with scratch(spark):
        (df := make()).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: df written as a table in the shared folder and read back. It outlives any executor."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_path(spark, what))
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a side of a join that may be broadcast: some tens of MB of ids, hashes and short lists. Operators take it as a parameter; beyond it both sides are shuffled, with the same rows.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df as the side of a join: broadcast if it has been counted to have so few rows, shuffled otherwise. It is counted for this, so it should be a stored table. weight: what a row counts for, if it holds a list."""
    n = df.count() if weight is None else df.agg(F.sum(weight).alias("n")).first()["n"] or 0
    return F.broadcast(df) if n <= rows else df


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by stored()."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def per_worker(key: str, make):
    """make(), once for each Python worker process and key: what it holds serves all tasks that the worker runs."""
    import sys
    from types import ModuleType

    kept = vars(sys.modules.setdefault("_evidloom_worker", ModuleType("_evidloom_worker"))).setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def ranked(df: DataFrame, order: tuple[Column, ...], name: str, group: str | None = None) -> DataFrame:
    """df with each row's place from 0 on in `order` (within its group, a column that isn't null): rows are dealt out by ranges, numbered in their partition, stored, and raised by the counts of the partitions before. No task holds a group, equal keys are dealt out by the place that they come from."""
    keys = ([F.col(group).asc()] if group else []) + list(order)
    dealt = df.withColumn("__row", F.monotonically_increasing_id())
    by_range = dealt.repartitionByRange(*keys, F.col("__row").asc()).sortWithinPartitions(*keys, F.col("__row").asc()).drop("__row")
    numbered = stored(by_range.select("*", F.monotonically_increasing_id().alias("__at")), "ranked")
    part, owner = F.shiftright("__at", 33).alias("__part"), F.col(group) if group else F.lit("")
    counts = numbered.groupBy(part, owner.alias("__group")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = small_side(stored(counts.select("__part", "__group", (before - F.col("__first")).alias("__shift")), "offsets"))
    placed = numbered.select("*", part, owner.alias("__group")).join(offsets, ["__part", "__group"])
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__at") + F.col("__shift")).alias(name))


#: SQL for the table of crc32 by bytes, a list of 256 numbers in column tab.
CRC_TABLE_SQL = """SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes; CRC_TABLE_SQL's column is in scope."""
    byte_list = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda k: ('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {byte_list}), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"
