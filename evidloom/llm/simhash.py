"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit b is set where over half of the text's shingle hashes (3 words,
lower-cased A-Z, XXH64 with seed 42, repeats included) have it. Fingerprints link at 2 or
fewer differing bits.

Search. A fingerprint is cut into segments of 22, 21 and 21 bits. Two errors over three
segments leave, in at least one of the ordered pairs (1,2), (2,3), (3,1), the first segment
without error and the second with one at most. The first segment is a key as it is. The second,
as a 23-bit word, is decoded by the perfect binary Golay code (23, 12, 7) to the codewords
within reach: its own and those of its 23 words at distance 1. Two segments at distance 1
share one of these, so the keys lose no link.

Buckets. Fingerprints of a bucket of at most `pair_limit` are compared in pairs. A larger bucket
gives no pairs: its fingerprints emit themselves and their 64 neighbours at one bit, and
all that share such a midpoint link to the least of them. Two fingerprints share a midpoint
exactly if they differ in 2 bits or fewer, so this way is exact, too.

Defined results: null and blank texts have fingerprint zero, which links like any other; texts
of fewer words than a shingle are one shingle; equal fingerprints, repeated rows and repeated ids
are of one component; a null doc_id takes part but is never a component_id unless all are
null; an empty table gives no rows; other columns are kept by `distinct_documents` and ignored
by `classes`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import forget, let, lower_ascii, read, rows_of, rows_with, shingle_hashes, stored, words_of
from evidloom.llm.components import connected_components

SHINGLE = 3
BITS = 2
PAIR_LIMIT = 32
#: Fingerprints of a task that makes keys.
LOT = 20_000
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def golay_tables():
    """(the remainder of each single bit, the error pattern of each of the 2048 syndromes), by the code's rule: errors of 3 bits at most have distinct syndromes."""
    from itertools import combinations

    import numpy as np

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << bit - 11
        return word

    single = np.array([remainder(1 << b) for b in range(23)], dtype=np.int64)
    errors = np.zeros(2048, dtype=np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            syndrome = 0
            for b in places:
                syndrome ^= int(single[b])
            errors[syndrome] = sum(1 << b for b in places)
    return single, errors


def golay_indices(words, tables):
    """Rows of the codeword indices near each 23-bit word: of the word, then of its 23 neighbours."""
    import numpy as np

    single, errors = tables
    syndrome = np.zeros(len(words), dtype=np.int64)
    for b in range(23):
        syndrome ^= (words >> b & 1) * single[b]
    near = np.concatenate([[0], 1 << np.arange(23)])
    flips = np.concatenate([[0], single])
    return (words[:, None] ^ near ^ errors[syndrome[:, None] ^ flips]) >> 11


def search_keys(fingerprints, tables):
    """For each fingerprint of an int64 array: its distinct keys."""
    import numpy as np

    f = fingerprints.view(np.uint64)
    parts = [((f >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys = []
    for p in range(3):
        near = golay_indices(parts[(p + 1) % 3], tables)
        keys.append((p << 34) | (parts[p] << 12)[:, None] | near)
    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
    first = np.ones(keys.shape, dtype=bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, first


def _majority(hashes):
    """ListArray of int64 hashes -> int64 fingerprints; hashes are unpacked to bits 65,536 at a time, whatever the length of a text."""
    import numpy as np
    import pyarrow as pa

    lists = hashes.cast(pa.large_list(pa.int64()))
    ends = lists.offsets.to_numpy()
    flat, ends = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]
    count = np.diff(ends)
    ones = np.zeros((len(count), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    for at in range(0, len(flat), step := 65536):
        bits = np.unpackbits(np.ascontiguousarray(flat[at : at + step]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + step]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little")
    return pa.array(packed.view(np.int64).reshape(-1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, doc_key, fp), longs; doc_key is a hash of the text. Shingle hashes are made in the JVM, majorities in numpy, a batch of rows at a time."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), let(words_of(lower_ascii(F.col("text"))), lambda w: shingle_hashes(w, SHINGLE)).alias("h"))

    def majorities(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _majority(b.column(2))], names=["doc_id", "doc_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(majorities, f"doc_id {kind}, doc_key bigint, fp bigint")


def _keyed(fps: DataFrame) -> DataFrame:
    """(fp) -> (fp, key): a row for each search key."""
    tables = golay_tables()

    def keys(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own = np.ascontiguousarray(b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False))
                rows, first = search_keys(own, tables)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, first.sum(axis=1))), pa.array(rows[first])], names=["fp", "key"])

    return fps.select("fp").mapInArrow(keys, "fp bigint, key bigint")


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) whose components are those of all links at BITS or fewer."""
    # Each fingerprint becomes some 20 keys: small lots of them are dealt out, and the keys are made once.
    lots = -(-fps.count() // LOT) or 1
    keyed = stored(_keyed(fps.repartition(lots, "fp")), "search-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("__key"), "n")
    shared = stored(keyed.join(sizes, F.col("key") == F.col("__key")).select("key", "fp", "n"), "buckets")
    forget(keyed)
    lists = shared.where(F.col("n") <= pair_limit).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("a"))
    pairs = (
        lists.select("a", F.posexplode("a").alias("i", "v"))
        .select("v", F.explode(F.slice("a", F.col("i") + 2, F.size("a"))).alias("u"))
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS)
    )
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    crowd = shared.where(F.col("n") > pair_limit).select("fp").distinct().select("fp", F.explode(near).alias("mid"))
    least = crowd.groupBy("mid").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select(F.col("mid").alias("__mid"), "v")
    stars = crowd.join(least, F.col("mid") == F.col("__mid")).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.select("u", "v").unionByName(stars).distinct()


def _classes(docs: DataFrame, pair_limit: int) -> DataFrame:
    """docs -> doc_id, doc_key, fp, root (the class, a fingerprint), component_id: a row for each row of docs."""
    marked = stored(fingerprints(docs), "fingerprints")
    least = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(least.select("fp"), pair_limit))
    placed = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = placed.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("__root"), "component_id")
    of_fp = placed.join(of_root, F.col("root") == F.col("__root")).select(F.col("fp").alias("__fp"), "root", "component_id")
    return marked.join(of_fp, F.col("fp") == F.col("__fp"), "left").select("doc_id", "doc_key", "fp", "root", "component_id")


def classes(docs: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (long), component_id, one row for each row of docs."""
    return _classes(docs, pair_limit).select("doc_id", "fp", "component_id")


def distinct_documents(docs: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """One document of each class, with all its columns: that with the smallest doc_id, of its texts in the class that with the least hash, of repeated rows any one."""
    heads = _classes(docs, pair_limit).where("doc_id <=> component_id")
    chosen = stored(heads.groupBy("root").agg(F.min(F.struct("doc_id", "doc_key")).alias("c"), F.count("*").alias("n")).select("c.*", "n"), "chosen")
    own = rows_with(docs, own_id=F.col("doc_id"), own_key=F.xxhash64("text"))
    kept = own.join(chosen.drop("n"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("doc_key")), "left_semi")
    # Rows can only repeat here where a class has several rows of its smallest id.
    return rows_of(kept if chosen.where("n > 1").isEmpty() else kept.dropDuplicates(["own_id", "own_key"]), docs)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
