"""Target-distribution importance resampling: documents are drawn by how much their word runs look like the target's.

Features of a text are its runs of 1 to MOST_WORDS consecutive words, repeats counted; a feature's bucket is the crc32 of
its bytes modulo BUCKETS. A ring holds the running zlib states of the runs that start at the last MOST_WORDS words: the
next word, with a space before it, extends each of them, a new state starts with the word itself, the oldest is dropped. So a text
is scanned once, no run is put together as a string, and a text of any length is held in slices of SLICE bytes.

Each task sums its documents' buckets (BUCKETS rows at most leave it), these sums give the buckets' gains against
the target, and a second scan weighs each document by them: nothing but ids and scores is stored or shuffled. The draw ranks
scores by range partitions and their counts, so no task holds all of them; the Gumbel noise of a document depends on its id and
the seed alone.

Defined results: a null text has no words; a document without features weighs 0; a null doc_id hashes as an empty one
and comes last among equal scores; repeated rows are documents of their own (equal scores and ids: any order); an empty target
gives each bucket a count of 0; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import CRC_TABLE_SQL, crc_sql, ranked, read, stored

BUCKETS = 10_000
MOST_WORDS = 3
#: Documents of fewer words aren't drawn; of the others `percent` in a hundred are.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
#: Upper case to lower, all ASCII but letters and digits to spaces; bytes of other characters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes):
    """Lists of a text's words, a list for each slice; a slice ends between words."""
    at = 0
    while at < len(text):
        part = text[at : at + SLICE].translate(WORD_BYTES)
        cut = part.rfind(b" ") if at + SLICE < len(text) else len(part)
        while cut < 0:
            # A word that is longer than the slice: read on to its end.
            more = text[at + len(part) : at + len(part) + SLICE].translate(WORD_BYTES)
            end = more.find(b" ")
            part, cut = part + more, (len(part) + end if end >= 0 else -1) if more else len(part)
        at += max(cut, 1)
        yield part[:cut].split()


def buckets(text: bytes, most: int = MOST_WORDS, n_buckets: int = BUCKETS):
    """(words, buckets of the features that end in them) of each slice of a text; the ring goes on from slice to slice."""
    import numpy as np

    crc, ring = zlib.crc32, []
    for found in words(text):
        states: list[int] = []
        add = states.append
        if most == 3:
            # The ring of the general case, unrolled.
            a, b = ring if len(ring) == 2 else (ring[0], None) if ring else (None, None)
            for w in found:
                tail = b" " + w
                if b is not None:
                    add(crc(tail, b))
                if a is not None:
                    add(b := crc(tail, a))
                add(a := crc(w))
            ring = [x for x in (a, b) if x is not None]
        else:
            for w in found:
                tail = b" " + w
                ring = [crc(w), *(crc(tail, s) for s in ring)]
                states += ring
                del ring[most - 1 :]
        yield len(found), np.array(states, dtype=np.int64) % n_buckets


def bucket_counts(texts: DataFrame, *, most: int = MOST_WORDS, n_buckets: int = BUCKETS) -> dict[int, int]:
    """How many features of all texts (text) are in each bucket: at most n_buckets entries, summed in tasks first."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    for _, found in buckets(text.as_py(), most, n_buckets):
                        total += np.bincount(found, minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    parts = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(counted, "bucket bigint, n bigint")
    return {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], n_buckets: int = BUCKETS) -> list[int]:
    """A thousand times the logarithm of each bucket's share in the target by that in the source, each count raised by 1, rounded down."""
    s_all, t_all = sum(source.values()), sum(target.values())
    value = lambda s, t: math.floor(1000 * math.log((t + 1) * (s_all + n_buckets) / ((s + 1) * (t_all + n_buckets))))
    return [value(source.get(b, 0), target.get(b, 0)) for b in range(n_buckets)]


def noise(doc_id, seed: int = SEED) -> int:
    """The Gumbel noise of an id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: list[int], *, most: int = MOST_WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_features, weight, score."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def scored(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(shared.value, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                out = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    n = features = weight = 0
                    if text.is_valid:
                        for some, found in buckets(text.as_py(), most, len(table)):
                            n, features, weight = n + some, features + len(found), weight + int(table[found].sum())
                    out.append((n, features, weight, weight + noise(i, seed)))
                columns = [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], [], []))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(scored, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, most: int = MOST_WORDS, n_buckets: int = BUCKETS) -> DataFrame:
    """One row for each document: doc_id, n_features, weight, score, rank (null if it isn't drawn). docs: (doc_id, text); target: (text)."""
    gain = gains(bucket_counts(docs, most=most, n_buckets=n_buckets), bucket_counts(target, most=most, n_buckets=n_buckets), n_buckets)
    found = stored(weighed(docs, gain, most=most, seed=seed), "weighed")
    long_enough = F.col("n_words") >= least_words
    drawn = found.where(long_enough).count() * percent // 100
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    places = ranked(found.where(long_enough), order, "place")
    out = ["doc_id", "n_features", "weight", "score"]
    rest = found.where(~long_enough).select(*out, F.lit(None).cast("long").alias("rank"))
    return places.select(*out, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")).unionByName(rest)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op13_importance_resampling": op13_importance_resampling}

ORACLES = {
    "op13_importance_resampling": rf"""
WITH tab AS ({CRC_TABLE_SQL}), texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), w AS (
  SELECT side, r, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM texts
), f AS (
  SELECT side, r, array_to_string(ws[i:i + n - 1], ' ') AS feature FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT unnest(range(1, {MOST_WORDS} + 1)) AS n) WHERE i + n - 1 <= len(ws)
), b AS MATERIALIZED (
  SELECT feature, {crc_sql('feature')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM f), tab
), fb AS MATERIALIZED (SELECT side, r, bucket, count(*) AS n FROM f JOIN b USING (feature) GROUP BY ALL),
c AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::BIGINT AS t FROM fb GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c)::BIGINT + {BUCKETS}))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM c)::BIGINT + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM c
), x AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM fb JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
y AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN x USING (r) WHERE side = 0
), z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM z
"""
}
