"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions alone.

A text is the set of its 5-word shingles (A-Z lower-cased, punctuation of PUNCTUATION removed).
An item is contained in a document if at least 4 of 5 of its shingles are the document's.

Search. Items are partitioned by the power of two above their number of shingles. An item's sketch is
its k least shingle hashes (bottom-k MinHash) with k = u // 5 + 1 for the largest size u of its
partition. A contained item lacks at most a fifth of its shingles, so at least one value of its
sketch is a hash of the document: no contained item is lost, however long the document. A document is
searched in the partitions whose least item is short enough for its own number of shingles: it gives
those of its hashes that are at most the greatest sketch value of these.

Items of fewer than 5 words have no such shingle. They are contained in a document if their words stand in it one after another: windows of as many
words as such items have, if there are any, are looked up among them.

Check. The documents of candidates are read again and the item's and the document's shingles are
intersected as strings.

Sketches, item shingles and candidates are broadcast only if counted and at most `broadcast_rows`
(strings: a third of it); else both sides are shuffled, with the same rows.

Defined results: null and blank texts have no shingles, contain nothing and are contained nowhere; an
item of fewer than 5 words counts as one shingle of them all, a document of fewer has none of 5 words; repeated shingles count once; repeated items with one id
are one item for each different text; repeated documents each get their rows; other columns are kept by `clean` and ignored
by `matches`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import ASCII_LOWER, ASCII_UPPER, BROADCAST_ROWS, let, read, rows_of, rows_with, settled, small_side, stored, words_of

SHINGLE = 5
PUNCTUATION = ".,;:!?\"'()"


def _words(text: Column) -> Column:
    return words_of(F.translate(text, ASCII_UPPER + PUNCTUATION, ASCII_LOWER))


def _of_windows(w: Column, whole: Column, one) -> Column:
    """one(the words of a window) for each window of w; `whole` for a shorter w with words."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: one([F.get(w, i + j) for j in range(SHINGLE)]))
    return F.when(F.size(w) >= SHINGLE, windows).when(F.size(w) > 0, F.array(whole))


def hashes_of(text: Column) -> Column:
    """The distinct shingle hashes of a text, or null."""
    return F.array_distinct(let(_words(text), lambda w: _of_windows(w, F.xxhash64(F.array_join(w, " ")), lambda x: F.xxhash64(*x))))


def shingles_of(text: Column) -> Column:
    """The distinct shingles of a text as strings, or null."""
    return F.array_distinct(let(_words(text), lambda w: _of_windows(w, F.array_join(w, " "), lambda x: F.concat_ws(" ", *x))))


def sketches(items: DataFrame) -> DataFrame:
    """items (item_id, text) -> (item_id, item_key, n, largest, h): item_key tells texts of one id apart, n is the number of shingles, largest names the size partition."""
    long = items.where(F.size(_words(F.col("text"))) >= SHINGLE)
    sized = long.select("item_id", F.xxhash64("text").alias("item_key"), F.sort_array(hashes_of(F.col("text"))).alias("a")).where("a IS NOT NULL").distinct()
    largest = F.pow(F.lit(2), F.ceil(F.log2(F.size("a")))).cast("int")
    k = F.least(F.size("a"), F.floor(largest / 5).cast("int") + 1)
    return sized.select("item_id", "item_key", F.size("a").alias("n"), largest.alias("largest"), F.explode(F.slice("a", F.lit(1), k)).alias("h"))


def _long_enough(n_doc: Column, n_item: Column) -> Column:
    """Whether a document of so many shingles can contain an item of so many."""
    return n_doc * 5 >= n_item * 4


def candidates(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, doc_key, item_id, item_key) of pairs that share a sketch value; doc_key is a hash of the text."""
    sketch = stored(sketches(items), "sketches")
    # A row for each size partition: powers of two, 31 at most.
    partitions = sketch.groupBy("largest").agg(F.min("n").alias("least"), F.max("h").alias("most")).orderBy("largest").collect()

    def searched(a: Column) -> Column:
        reach = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *[F.when(_long_enough(F.size(a), F.lit(p["least"])), F.lit(p["most"]).cast("long")) for p in partitions])
        return let(reach, lambda most: F.filter(a, lambda h: h <= most))

    # One expression under explode: a column would be made again for the test of emptiness that Spark adds to one.
    probes = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), F.explode(let(hashes_of(F.col("text")), searched)).alias("p"))
    found = probes.join(small_side(sketch, broadcast_rows), F.col("p") == F.col("h"))
    return found.select("doc_id", "doc_key", "item_id", "item_key").distinct()


def _short_matches(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame | None:
    """_matches() of the items of fewer than SHINGLE words; None where there are none."""
    short = items.select("item_id", F.xxhash64("text").alias("item_key"), _words(F.col("text")).alias("w")).where(F.size("w").between(1, SHINGLE - 1)).distinct()
    sizes = sorted(r["n"] for r in short.select(F.size("w").alias("n")).distinct().collect())
    if not sizes:
        return None
    windows = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))).otherwise(F.array().cast("array<string>"))
    probes = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), F.explode(let(_words(F.col("text")), lambda w: F.array_distinct(F.concat(*[windows(w, n) for n in sizes])))).alias("p"))
    side = small_side(stored(short.select("item_id", F.array_join("w", " ").alias("phrase")), "short-items"), broadcast_rows)
    found = probes.join(side, F.col("p") == F.col("phrase"))
    one = F.lit(1).cast("long")
    return found.select("doc_id", "doc_key", "item_id", one.alias("n_shared"), one.alias("n_item"))


def _matches(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame:
    """(doc_id, doc_key, item_id, n_shared, n_item) of documents with an item contained."""
    found, short = _long_matches(docs, items, broadcast_rows), _short_matches(docs, items, broadcast_rows)
    return found if short is None else found.unionByName(short)


def _long_matches(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame:
    cands = stored(candidates(docs, items, broadcast_rows), "candidates")
    by_doc = cands.groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("item_id", "item_key")).alias("its")).withColumnsRenamed({"doc_id": "c_id", "doc_key": "c_key"})
    side = F.broadcast(by_doc) if cands.count() <= broadcast_rows else by_doc
    own = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text")
    hit = own.join(side, own["doc_id"].eqNullSafe(F.col("c_id")) & (F.col("doc_key") == F.col("c_key")))
    pairs = hit.select("doc_id", "doc_key", shingles_of(F.col("text")).alias("d"), "its").select("doc_id", "doc_key", "d", F.explode("its").alias("it"))
    wanted = items.select(F.col("item_id").alias("i_id"), F.xxhash64("text").alias("i_key"), shingles_of(F.col("text")).alias("s")).where("s IS NOT NULL").distinct()
    wanted = small_side(stored(wanted, "item-shingles"), broadcast_rows // 3, F.size("s"))
    both = pairs.join(wanted, F.col("it.item_id").eqNullSafe(F.col("i_id")) & (F.col("it.item_key") == F.col("i_key")))
    counted = both.select(
        "doc_id", "doc_key", F.col("i_id").alias("item_id"), F.size(F.array_intersect("d", "s")).cast("long").alias("n_shared"), F.size("s").cast("long").alias("n_item")
    )
    return counted.where(F.col("n_shared") * 5 >= F.col("n_item") * 4)


def matches(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document and item contained in it: doc_id, item_id, n_shared, n_item."""
    return _matches(docs, items, broadcast_rows).select("doc_id", "item_id", "n_shared", "n_item")


def clean(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    bad = settled(docs.sparkSession, "contaminated", lambda: _matches(docs, items, broadcast_rows).select("doc_id", "doc_key").distinct())
    own = rows_with(docs, own_id=F.col("doc_id"), own_key=F.xxhash64("text"))
    return rows_of(own.join(small_side(bad, broadcast_rows), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("doc_key")), "left_anti"), docs)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}


def _sql(table: str, key: str, sizes: str) -> str:
    """Shingles of a table's texts: of 5 words, and of as many as `sizes` names."""
    words = r"""list_filter(regexp_split_to_array(translate(regexp_replace(coalesce(text, ''), '[.,;:!?"''()]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
    return f"""SELECT r, {key}, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s
  FROM (SELECT row_number() OVER () AS r, {key}, {words} AS w FROM {table}), (SELECT unnest(range(1, 6)) AS n) WHERE n <= len(w) AND n IN ({sizes})"""


ORACLES = {
    "op9_decontamination": f"""
WITH d AS (SELECT DISTINCT * FROM ({_sql("documents", "doc_id", "1, 2, 3, 4, 5")})), i AS (SELECT DISTINCT * FROM ({_sql("benchmark", "item_id", "least(5, len(w))")})),
n AS (SELECT r, item_id, count(*) AS n_item FROM i GROUP BY ALL)
SELECT doc_id, n.item_id, count(*)::BIGINT AS n_shared, n_item::BIGINT AS n_item
FROM d JOIN i USING (s) JOIN n ON i.r = n.r GROUP BY d.r, doc_id, n.r, n.item_id, n_item HAVING count(*) * 5 >= n_item * 4
"""
}
