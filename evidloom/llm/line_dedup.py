"""Line dedup by a deletion-neighbourhood join, in DataFrame functions alone.

A line is removed if an earlier one, in any document, is at a word edit distance of at most 1
(one word replaced, inserted or deleted; equal lines included). Earlier: by doc_id, then by place in the
text. Lines of fewer than `min_words` words are removed for an earlier equal line alone; lines without a word stay.

1. Equal lines, short ones too: hashes are aggregated to the first place of each different line.
2. Pigeonhole: of two lines within the bound, the first or the last half of the words agree. Lines whose halves
   (lengths rounded so that neighbouring sizes meet) occur in no other line leave the search; this
   loses no pair.
3. Neighbourhood: a line emits, for each place where its shared halves allow an edit, the hash of what
   stands before and after: once with the word there deleted, once with nothing deleted. Lines at
   distance 1 have such a key in common, and lines with a common key are at distance 1 or
   less. So only the least place of a key matters; groups are aggregated, never paired.
4. Check: a line's words are compared with those of the lines found before it.
5. The places of removed lines are joined to the documents.

Texts meet the places of lines twice. At 3, where the lines that are left have been counted to be `broadcast_rows` at
most, they are broadcast and texts stay where they are; else, and at 5, texts are shuffled by document. What the steps
store is deleted once the places of removed lines are.

Hashes before and after a place are kept as prefix and suffix sums (XOR of word hashes with their places), in blocks of 64
words, so a line of W words costs about 64 W steps.

Defined results: a null text stays null with no lines; a text whose lines all go becomes
empty, its document stays; documents with a null id come first; rows of one id are at the same places: a line doesn't
remove its equal at the same place of the same id, so repeated rows get the same result; n_chars, where a table has it, is
counted anew by `dedup`; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import BROADCAST_ROWS, SPACE_RE, let, read, settled, small_side, stored

MIN_WORDS = 5
BLOCK = 64
FIRST = -(2**63)


def _normal(line: Column) -> Column:
    """The words of a line joined by single spaces; most lines are so already, which is cheaper to see than to make."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(line, SPACE_RE, " ")).otherwise(line))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (__id, __doc, __no, line): every line with its place, normalised; __doc is a hash of the text."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("__id"), F.xxhash64("text").alias("__doc"), F.posexplode(F.split("text", "\n")).alias("__no", "raw"))
    return own.select("__id", "__doc", "__no", _normal(F.col("raw")).alias("line"))


def _half(shorter: Column) -> Column:
    """Words at either end of which at least one run is equal where the shorter line has so many; from 8 on in steps of 4."""
    h = F.floor(shorter / 2).cast("int")
    return F.when(h < 8, h).otherwise(h - h % 4)


def _ends(line: Column, n: Column) -> Column:
    """Hashes of the first and last half: at the line's own size and at that of a line with a word less, where these differ."""
    cut = lambda k: F.call_function("substring_index", line, F.lit(" "), k)
    two = lambda h: [F.xxhash64(F.lit("first"), cut(h)), F.xxhash64(F.lit("last"), cut(-h))]
    own, less = _half(n), _half(n - 1)
    return F.when(own == less, F.array(*two(own))).otherwise(F.array(*two(own), *two(less)))


def _sums(hashes: Column) -> Column:
    """XOR of all hashes before each place 0..W."""
    xor = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    last = F.floor(F.size(hashes) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: xor(F.slice(hashes, b * BLOCK + 1, F.lit(BLOCK))))
    before = lambda s: F.transform(F.sequence(F.lit(0), last), lambda b: xor(F.slice(s, F.lit(1), b)))
    place = lambda p: F.transform(
        F.sequence(F.lit(0), F.size(hashes)),
        lambda i: F.get(p, F.floor(i / BLOCK).cast("int")).bitwiseXOR(xor(F.slice(hashes, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))),
    )
    return let(let(blocks, before), place)


def _neighbourhood(words: Column, at_first: Column, at_last: Column) -> Column:
    """Keys of the edits a line allows. at_first / at_last: how many words at the start / end are shared and unedited where the other end isn't; null: none."""
    n = F.size(words)
    from_start = F.transform(words, lambda w, i: F.xxhash64(w, i))
    from_end = F.transform(F.reverse(words), lambda w, i: F.xxhash64(w, i))
    # An edit lies behind a shared start or ahead of a shared end.
    low = F.when(at_last.isNotNull(), F.lit(0)).otherwise(at_first)
    high = F.when(at_first.isNotNull(), n).otherwise(n - at_last)
    key = lambda s, e, i, after: F.xxhash64(F.get(s, i), F.get(e, after), i, after)

    def both(s: Column) -> Column:
        places = F.sequence(low, high)
        return let(
            let(from_end, _sums),
            lambda e: F.concat(
                F.transform(F.filter(places, lambda i: i < n), lambda i: key(s, e, i, n - 1 - i)),
                F.transform(places, lambda i: key(s, e, i, n - i)),
            ),
        )

    return let(let(from_start, _sums), both)


def _within_one(a: Column, b: Column) -> Column:
    """Whether two different word arrays are at an edit distance of 1: what follows the first difference is equal with the longer's, or both's, word there left out."""
    na, nb = F.size(a), F.size(b)
    rest = lambda x, n, p: F.slice(x, p, F.greatest(n - p + 1, F.lit(0)))
    same = lambda p: (
        F.when(na == nb, rest(a, na, p + 1) == rest(b, nb, p + 1)).when(na == nb + 1, rest(a, na, p + 1) == rest(b, nb, p)).when(nb == na + 1, rest(a, na, p) == rest(b, nb, p + 1)).otherwise(False)
    )
    return let(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int"), lambda p: F.when(p == 0, True).otherwise(same(p)))


def _text_side(docs: DataFrame) -> DataFrame:
    """The side of the documents in both joins."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("__id"), F.xxhash64("text").alias("__doc"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def removed_lines(docs: DataFrame, text_side: DataFrame, min_words: int = MIN_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(__id, __doc, __no) of the lines to remove."""
    n = F.size(F.split("line", " "))
    lines = _lines(docs).where("line <> ''").withColumn("n", n)
    lines = stored(lines.select("__id", "__doc", "__no", F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b"), F.when(F.col("n") >= min_words, _ends(F.col("line"), F.col("n"))).alias("ends")), "lines")
    place = F.struct(F.col("__id").alias("id"), F.col("__no").alias("no"))
    firsts = stored(lines.groupBy("a", "b").agg(F.min(F.struct("__id", "__no", "__doc", "ends")).alias("f"), F.count("*").alias("times")).select("a", "b", "times", "f.*"), "firsts")

    again = small_side(firsts.where("times > 1").select(F.col("a").alias("fa"), F.col("b").alias("fb"), place.alias("first")), broadcast_rows)
    equal = lines.join(again, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb"))).where(place > F.col("first")).select("__id", "__doc", "__no")

    # From here on a line is known by the first of its hashes: where two lines should share it, both are kept in the search.
    halves = firsts.select("a", F.posexplode("ends").alias("which", "end"))
    shared = halves.groupBy("end").agg(F.count("*").alias("n")).where("n > 1").select(F.col("end").alias("__end"))
    halves = halves.join(shared, F.col("end") == F.col("__end")).groupBy("a").agg(F.max(F.col("which") % 2 == 0).alias("by_first"), F.max(F.col("which") % 2 == 1).alias("by_last"))
    live = firsts.select("a", "__id", "__no", "__doc").join(halves, ["a"])
    wanted = stored(live.groupBy("__id", "__doc").agg(F.collect_list(F.struct("__no", "a", "by_first", "by_last")).alias("its")), "wanted")
    found = text_side.join(small_side(wanted, broadcast_rows, F.size("its")), ["__id", "__doc"]).select("__id", "__doc", F.split("__row.text", "\n").alias("raw"), F.explode("its").alias("it"))
    found = found.select("__id", "__doc", "it.*", F.split(_normal(F.get("raw", F.col("it.__no"))), " ").alias("w")).dropDuplicates(["a", "__id", "__no", "__doc"])
    live = stored(found, "live-lines")

    size = F.size("w")
    shared_words = F.least(_half(size), _half(size - 1))
    keys = _neighbourhood(F.col("w"), F.when(F.col("by_first"), shared_words), F.when(F.col("by_last"), shared_words))
    # A line's keys are made once; in a columnar table its place costs next to nothing beside each.
    emitted = stored(live.select(F.struct(F.col("__id").alias("id"), F.col("__no").alias("no"), "a").alias("p"), F.explode(F.array_distinct(keys)).alias("key")), "keys")
    least = emitted.groupBy("key").agg(F.min("p").alias("m"), F.count("*").alias("k")).where("k > 1").select(F.col("key").alias("__key"), "m")
    earlier = F.struct("p.id", "p.no") > F.struct("m.id", "m.no")
    pairs = emitted.join(least, F.col("key") == F.col("__key")).where(earlier).select("p.a", F.col("m.a").alias("o")).distinct()
    other = live.select(F.col("a").alias("o"), F.col("w").alias("v"))
    near = pairs.join(live, "a").join(other, "o").where(_within_one(F.col("w"), F.col("v"))).select("__id", "__doc", "__no")
    return equal.unionByName(near).distinct()


def _kept(docs: DataFrame, min_words: int, broadcast_rows: int) -> DataFrame:
    """docs' columns as __row, __n and __kept: its lines, those that stay."""
    side = _text_side(docs)
    gone = settled(docs.sparkSession, "removed-lines", lambda: removed_lines(docs, side, min_words, broadcast_rows).groupBy("__id", "__doc").agg(F.collect_list("__no").alias("gone")))
    gone = gone.select("__id", "__doc", F.map_from_entries(F.transform("gone", lambda i: F.struct(i, F.lit(True)))).alias("gone"))
    lines = F.split("__row.text", "\n")
    stay = F.filter(lines, lambda x, i: F.coalesce(F.col("gone").isNull() | ~F.map_contains_key("gone", i), F.lit(True)))
    return side.join(gone, ["__id", "__doc"], "left").select("__row", F.coalesce(F.size(lines), F.lit(0)).alias("__n"), F.when(F.col("gone").isNull(), lines).otherwise(stay).alias("__kept"))


def mark(docs: DataFrame, min_words: int = MIN_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_lines, n_removed, text (of the lines that stay): a row for each row of docs."""
    out = _kept(docs.select("doc_id", "text"), min_words, broadcast_rows)
    n = F.when(F.col("__row.text").isNull(), F.lit(0)).otherwise(F.col("__n")).cast("long")
    left = F.coalesce(F.size("__kept"), F.lit(0)).cast("long")
    return out.select("__row.doc_id", n.alias("n_lines"), F.when(F.col("__row.text").isNull(), F.lit(0).cast("long")).otherwise(n - left).alias("n_removed"), F.array_join("__kept", "\n").alias("text"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with its lines removed from text, and n_chars, if there, counted anew."""
    text = F.array_join("__kept", "\n")
    new = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return _kept(docs, min_words, broadcast_rows).select(*[(new[c] if new.get(c) is not None else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(read(spark, sf_dir, "documents"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {
    "op7_line_dedup": rf"""
WITH raw AS (
  SELECT r, doc_id, no, raw[no + 1] AS line FROM (SELECT r, doc_id, raw, unnest(range(len(raw))) AS no FROM (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS raw FROM documents WHERE text IS NOT NULL))
), l AS (
  SELECT *, coalesce(doc_id, {FIRST}) AS id, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM raw
), f AS (
  SELECT w, min((id, no)) AS p FROM l WHERE len(w) > 0 GROUP BY w
), e AS (
  SELECT w, p, unnest([('p', n, array_to_string(w[:n//2], ' ')) for n in [len(w), len(w) - 1]] || [('s', n, array_to_string(w[len(w)-n//2+1:], ' ')) for n in [len(w), len(w) - 1]]) AS k FROM f WHERE len(w) >= {MIN_WORDS}
), two AS (
  SELECT DISTINCT x.w, y.w AS v, y.p AS m FROM e x JOIN e y USING (k) WHERE y.p < x.p AND abs(len(x.w) - len(y.w)) <= 1
), met AS (
  SELECT *, list_position([w[i] IS NOT DISTINCT FROM v[i] for i in range(1, greatest(len(w), len(v)) + 1)], false) AS i FROM two
), near AS (
  SELECT w, m FROM met WHERE w[i + CASE WHEN len(w) >= len(v) THEN 1 ELSE 0 END:] = v[i + CASE WHEN len(v) >= len(w) THEN 1 ELSE 0 END:]
  UNION ALL SELECT w, p AS m FROM f
), best AS (
  SELECT w, min(m) AS m FROM near GROUP BY w
), gone AS (
  SELECT l.r, l.no FROM l JOIN best USING (w) WHERE best.m < (l.id, l.no)
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text
FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents) d LEFT JOIN (
  SELECT l.r, count(*) AS n_lines, count(gone.no) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE gone.no IS NULL) AS text
  FROM l LEFT JOIN gone ON l.r = gone.r AND l.no = gone.no GROUP BY l.r
) x USING (r)
"""
}
