"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Four rules judge a text by a share: symbols by words, capitals by characters, repeated lines by lines, words in repeated
windows by words. A rule has a cutoff out of CUTS (twentieths) or is off; a text is rejected if one of its shares
reaches its rule's cutoff. Labelled documents (labels.quality = 1: good) that pass the base rules are the holdout: for each
stratum and each of the 256 vectors of cutoffs the exact binomial test of "at least max_risk of the good documents are
rejected" is made, and a vector is certified if its tail P(Bin(n, max_risk) <= rejected) is at most delta / (strata *
vectors) (Bonferroni, so the guarantee holds for all of them at once, whichever is then chosen). Of the certified
vectors a stratum takes the one with the best gain, rejected share of bad less `cost` times rejected share of good, the
highest cutoffs at ties; a stratum where none is certified, or none gains, rejects nothing by these rules.

A trial is a text: equal texts of a stratum with equal labels count once, however many documents or labels repeat them. (Near
copies count each; where they are many, the trials aren't independent.) The guarantee is on what these rules reject of
good documents that pass the base rules. The base rules are fixed and reject what they say, good documents too: short ones.

Texts are read once: their counts are stored, some bytes a document, and cutoffs and verdicts are made of these.

Defined results: a null or blank text has no words and fails the base rules; a null language
or one outside `strata` belongs to stratum 'other'; labels with a null doc_id, a null quality or
no document are ignored, a text labelled good and bad counts as both; repeated documents
each get a row; other columns of the documents stay (`keep`) or go (`rate`), whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import let, read, rows_of, rows_with, stored, words_of

STRATA = ("en", "fr", "de", "es")
#: Rules (count, by what) and their cutoffs in twentieths.
RULES = (("n_symbols", "n_words"), ("n_upper", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"))
CUTS = (2, 5, 10)
#: A rule has one of these or is off.
CHOICES = len(CUTS) + 1
VECTORS = CHOICES ** len(RULES)
MAX_RISK = 0.02
DELTA = 0.05
COST = 10.0
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more: windows sorted by hash, equal neighbours flagged, flagged places united."""

    def by_hash(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        flagged = lambda s: F.sort_array(
            F.array_compact(F.transform(s, lambda e, j: F.when((e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"])))
        )
        covered = lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda s: let(flagged(s), covered)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, by_hash))


def _totals(text: Column) -> dict[str, Column]:
    return {
        "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
    }


def _cell(c: Column) -> Column:
    """Of a struct of counts: how many cuts each rule's share reaches, as the digits of one number, the first rule's lowest."""
    reached = lambda a, b: sum(((c[b] > 0) & (F.lit(20) * c[a] >= F.lit(cut) * c[b])).cast("int") for cut in CUTS)
    return sum(reached(*rule) * CHOICES**k for k, rule in enumerate(RULES)).cast("int")


def _digit(number: Column, k: int) -> Column:
    return F.floor(number / CHOICES**k).cast("int") % CHOICES


def rejects(cell: Column, vector: Column) -> Column:
    """Whether a cell reaches a vector's cutoffs: a digit of the vector is the place of the rule's cutoff in CUTS; the last says that it is off."""
    out = F.lit(False)
    for k in range(len(RULES)):
        out = out | (_digit(cell, k) > _digit(vector, k))
    return out


def measures(text: Column) -> Column:
    """A struct of MEASURES as long, base_failed and cell."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        *[c.alias(k) for k, c in _totals(text).items()],
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    )
    own = ("n_words", "word_chars", "n_symbols", "n_upper", "n_repeat_words")
    named = lambda c: F.struct(*[c[k].alias(k) for k in own], c["lines"]["n"].alias("n_lines"), (c["lines"]["n"] - c["lines"]["d"]).alias("n_dup_lines"))
    judged = lambda c: F.struct(*[c[k].alias(k) for k in MEASURES], base_failed(c).alias("base_failed"), _cell(c).alias("cell"))
    return let(let(let(words_of(text), counted), named), judged)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (F.lit(100) * m["n_repeat_words"] > F.lit(50) * m["n_words"])


def stratum(lang: Column, strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise(F.lit("other"))


def tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly: terms by their logarithms from log C(n, i) = log C(n, i-1) + log((n-i+1)/i); 1 where k >= n."""
    import math

    first = n * F.lit(math.log1p(-p))
    step = F.lit(math.log(p) - math.log1p(-p))
    add = lambda a, i: F.struct(
        (a["t"] + F.log((n - i + 1) / i) + step).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i) + step)).alias("s")
    )
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("t"), F.exp(first).alias("s")), add)["s"]
    return F.when(k >= n, F.lit(1.0)).when(k < 1, F.exp(first)).otherwise(F.least(total, F.lit(1.0)))


def cutoffs(trials: DataFrame, *, max_risk: float = MAX_RISK, delta: float = DELTA, cost: float = COST, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """(stratum, cell, quality) of labelled texts -> (stratum, vector, cuts), at most len(strata) + 1 rows: the counts are summed by stratum, cell and quality, some thousand rows, before vectors are tried. cuts: the cutoff of each rule, null for off."""
    n_tests = (len(strata) + 1) * VECTORS
    counted = trials.groupBy("stratum", "cell", "quality").agg(F.count("*").alias("n"))
    good, out = F.col("quality") == 1, rejects(F.col("cell"), F.col("vector"))
    tried = (
        counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(VECTORS - 1))).alias("vector"))
        .groupBy("stratum", "vector")
        .agg(*[F.sum(F.when(which, F.col("n")).otherwise(0)).alias(name) for name, which in (("good", good), ("good_out", good & out), ("bad", ~good), ("bad_out", ~good & out))])
    )
    # A tail is summed only where the share of rejected lies under the risk; elsewhere it exceeds a half or so.
    certified = F.when(F.col("good_out") <= F.col("good") * max_risk, tail(F.col("good"), F.col("good_out"), max_risk) <= delta / n_tests).otherwise(False)
    gain = F.col("bad_out") / F.col("bad") - cost * F.col("good_out") / F.col("good")
    places = [_digit(F.col("vector"), k) for k in range(len(RULES))]
    best = (
        tried.where((F.col("good") > 0) & (F.col("bad") > 0))
        .where(certified)
        .select("stratum", "vector", F.round(gain, 9).alias("gain"))
        .where("gain > 0")
        .groupBy("stratum")
        .agg(F.max(F.struct("gain", sum(places).alias("height"), "vector"))["vector"].alias("vector"))
    )
    return best.select("stratum", "vector", F.array(*[F.get(F.array(*[F.lit(c) for c in CUTS]), p) for p in places]).alias("cuts"))


def limits(measured: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The cutoffs that labelled documents (doc_id, key: a hash of the text, stratum, base_failed, cell) certify: (__stratum, __vector)."""
    wanted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("quality").alias("quality"))
    judged = measured.where("NOT base_failed").select("doc_id", "key", "stratum", "cell")
    trials = judged.join(wanted, F.col("doc_id") == F.col("__id")).select("stratum", "key", "cell", "quality").distinct()
    return cutoffs(trials, **parameters).select(F.col("stratum").alias("__stratum"), F.col("vector").alias("__vector"))


def _kept() -> Column:
    return ~F.col("base_failed") & ~F.coalesce(rejects(F.col("cell"), F.col("__vector")), F.lit(False))


def rate(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, kept."""
    own = docs.select("doc_id", F.xxhash64("text").alias("key"), stratum(F.col("lang"), parameters.get("strata", STRATA)).alias("stratum"), measures(F.col("text")).alias("m"))
    measured = stored(own.select("doc_id", "key", "stratum", "m.*"), "measures")
    joined = measured.join(F.broadcast(limits(measured, labels, **parameters)), F.col("stratum") == F.col("__stratum"), "left")
    return joined.select("doc_id", *MEASURES, "base_failed", _kept().alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents that the rules keep, with all their columns; they are stored with their verdicts in between."""
    m = rows_with(docs, id=F.col("doc_id"), key=F.xxhash64("text"), stratum=stratum(F.col("lang"), parameters.get("strata", STRATA)), m=measures(F.col("text")))
    measured = stored(m.select("row", "id", "key", "stratum", "m.base_failed", "m.cell"), "judged")
    found = limits(measured.select(F.col("id").alias("doc_id"), "key", "stratum", "base_failed", "cell"), labels, **parameters)
    joined = measured.where("NOT base_failed").join(F.broadcast(found), F.col("stratum") == F.col("__stratum"), "left")
    return rows_of(joined.where(_kept()), docs)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_rules": op1_quality_rules}

_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_REACHED = " + ".join(f"({{b}} > 0 AND 20 * {{a}} >= {cut} * {{b}})::INT" for cut in CUTS)
ORACLES = {
    "op1_quality_rules": rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, {_W} AS ws FROM documents
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
    SELECT r, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
  )
), rep AS (
  SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM (SELECT r, i, unnest([0, 1, 2]) AS d FROM win WHERE n > 1) GROUP BY r
), m AS (
  SELECT w.r, doc_id, text, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'other' END AS stratum, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN rep ON w.r = rep.r
), s AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    {_REACHED.format(a="n_symbols", b="n_words")} AS c0, {_REACHED.format(a="n_upper", b="word_chars")} AS c1, {_REACHED.format(a="n_dup_lines", b="n_lines")} AS c2, {_REACHED.format(a="n_repeat_words", b="n_words")} AS c3
  FROM m
), v AS (
  SELECT a AS v0, b AS v1, c AS v2, d AS v3 FROM range({CHOICES}) x(a), range({CHOICES}) y(b), range({CHOICES}) z(c), range({CHOICES}) u(d)
), l AS (
  SELECT stratum, c0, c1, c2, c3, quality, count(*) AS n FROM (SELECT DISTINCT stratum, text, c0, c1, c2, c3, quality FROM s JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND NOT base_failed) GROUP BY ALL
), o AS (
  SELECT *, (c0 > v0 OR c1 > v1 OR c2 > v2 OR c3 > v3) AS bad_cell FROM l, v
), t AS (
  SELECT stratum, v0, v1, v2, v3, coalesce(sum(n) FILTER (WHERE quality = 1), 0) AS good, coalesce(sum(n) FILTER (WHERE quality = 1 AND bad_cell), 0) AS good_out,
    coalesce(sum(n) FILTER (WHERE quality <> 1), 0) AS bad, coalesce(sum(n) FILTER (WHERE quality <> 1 AND bad_cell), 0) AS bad_out
  FROM o GROUP BY ALL
), p AS (
  SELECT *, (SELECT sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({MAX_RISK}) + (good - i) * ln(1 - {MAX_RISK}))) FROM (SELECT unnest(range(0, good_out::BIGINT + 1)) AS i)) AS tail
  FROM t WHERE good > 0 AND bad > 0 AND good_out <= good * {MAX_RISK}
), g AS (
  SELECT *, round(bad_out / bad - {COST} * good_out / good, 9) AS gain FROM p WHERE tail <= {DELTA} / {(len(STRATA) + 1) * VECTORS}
), best AS (
  SELECT stratum, v0, v1, v2, v3 FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, v0 + v1 + v2 + v3 DESC, v3 DESC, v2 DESC, v1 DESC, v0 DESC) AS place FROM g WHERE gain > 0) WHERE place = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(c0 > v0 OR c1 > v1 OR c2 > v2 OR c3 > v3, false) AS kept
FROM s LEFT JOIN best USING (stratum)
"""
}
