"""Quality rules, line dedup, SimHash, decontamination, packing and the pipeline: edge cases and brute force."""

import re
import zlib
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from evidloom.llm import decontamination, line_dedup, packing, quality_rules, simhash
from evidloom.llm.common import read
from evidloom.llm.registry import oracle_sql, queries
from tests.compare import connection, differences

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __id bigint, h string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in (t if isinstance(t, tuple) else (k + first, t) for k, t in enumerate(texts))], DOCS)


def prose(seed, n=60):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


EDGES = [None, "", "   \n\t", "one", "a b", prose(1), prose(1), (1, prose(1)), (None, prose(2)), (None, prose(2)), (99, "word " * 30_000), (100, "x" * 200_000), (101, "\n" * 5000)]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_oracle(name, spark, sf_dir):
    assert differences(queries()[name](spark, sf_dir), connection(sf_dir), oracle_sql()[name]) == ([], [])


@pytest.mark.parametrize("n,k,p", [(0, 0, 0.02), (10, 0, 0.02), (100, 3, 0.05), (500, 10, 0.02), (40, 40, 0.3), (7, 9, 0.3)])
def test_binomial_tail_is_exact(spark, n, k, p):
    got = spark.range(1).select(quality_rules.tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("t")).first()["t"]
    assert got == pytest.approx(min(1.0, sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(n, k) + 1))), rel=1e-9)


def test_quality_measures_by_brute_force(spark, sf_dir):
    rows = {(r["doc_id"], r["text"]) for r in read(spark, sf_dir, "documents").limit(60).collect()} | {(-1, "a b c a b c d\n a\n a\n\n"), (-2, "x x x x x")}
    labels = read(spark, sf_dir, "labels")
    got = {r["doc_id"]: r for r in quality_rules.rate(docs(spark, sorted(rows)), labels).collect()}
    for i, t in rows:
        w = WORDS.findall(t)
        triples = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + d for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))


def best_vector(trials, strata=5):
    """{stratum: vector} by trying every vector on every trial (stratum, cell, quality)."""
    from itertools import product

    digits = lambda n: [n // quality_rules.CHOICES**k % quality_rules.CHOICES for k in range(4)]
    found = {}
    for s in {t[0] for t in trials}:
        own = [(digits(c), q) for x, c, q in trials if x == s]
        for vector in product(range(quality_rules.CHOICES), repeat=4):
            hit = lambda c, v=vector: any(a > b for a, b in zip(c, v, strict=True))
            good, bad = [c for c, q in own if q == 1], [c for c, q in own if q != 1]
            out, away = sum(map(hit, good)), sum(map(hit, bad))
            if not good or not bad or out > 0.02 * len(good):
                continue
            risk = sum(comb(len(good), i) * 0.02**i * 0.98 ** (len(good) - i) for i in range(out + 1))
            gain = round(away / len(bad) - 10 * out / len(good), 9)
            if risk <= 0.05 / (strata * 256) and gain > 0:
                found.setdefault(s, []).append((gain, sum(vector), sum(v * quality_rules.CHOICES**k for k, v in enumerate(vector))))
    return {s: max(v)[2] for s, v in found.items()}


@pytest.mark.parametrize("seed", range(3))
def test_quality_cutoffs_by_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    trials = []
    for s, good, bad in (("en", 1500, 300), ("fr", 900, 60), ("de", 60, 60), ("es", 700, 0)):
        trials += [(s, r.choice([0] * 300 + [1, 4, 16, 64, 5]), 1) for _ in range(good)]
        trials += [(s, r.choice([0, 1, 2, 3, 4, 8, 12, 48, 64, 192, 21, 255]), 0) for _ in range(bad)]
    found = quality_rules.cutoffs(spark.createDataFrame(trials, "stratum string, cell int, quality int")).collect()
    want = best_vector(trials)
    assert {x["stratum"]: x["vector"] for x in found} == want
    # German has too few labels for any guarantee, Spanish no bad ones to gain from.
    assert set(want) == {"en", "fr"}
    for x in found:
        assert x["cuts"] == [(*quality_rules.CUTS, None)[x["vector"] // quality_rules.CHOICES**k % quality_rules.CHOICES] for k in range(4)]


def test_quality_trials_are_distinct_texts(spark):
    """30 labelled texts give no certificate, however often documents and labels repeat them."""
    texts = [prose(i, 60) for i in range(30)] + ["#*$% ".join(prose(100 + i, 60).split()) for i in range(5)]
    d = docs(spark, [(i, t) for i, t in enumerate(texts * 40)])
    labels = spark.createDataFrame([(i, int(i % 35 < 30)) for i in range(35 * 40)] * 3, "doc_id bigint, quality int")
    assert quality_rules.rate(d, labels).where("NOT kept").count() == 0
    many = docs(spark, [(i, prose(i, 60) if i % 8 else "#*$% ".join(prose(i, 60).split())) for i in range(900)])
    labels = spark.createDataFrame([(i, int(i % 8 > 0)) for i in range(900)], "doc_id bigint, quality int")
    assert {r["doc_id"] % 8 for r in quality_rules.rate(many, labels).where("NOT kept").collect()} == {0}


def test_quality_edges(spark, sf_dir):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (77, 0)], "doc_id bigint, quality int")
    out = quality_rules.rate(docs(spark, EDGES), labels)
    assert out.count() == len(EDGES)
    assert {r["kept"] for r in out.where("n_words < 50").collect()} == {False}
    spam = docs(spark, [*EDGES, (500, "a#b c " * 100_000)])
    assert quality_rules.rate(spam, labels).where("doc_id = 500").first()["n_symbols"] == 100_000
    kept = quality_rules.keep(docs(spark, EDGES), labels)
    assert kept.columns == docs(spark, EDGES).columns and kept.count() == out.where("kept").count()
    assert quality_rules.rate(docs(spark, []), labels.limit(0)).count() == 0


def with_automatic_broadcasts(spark, on):
    """Off: small as the tables of a test are, Spark itself broadcasts nothing."""
    (spark.conf.unset if on else lambda k: spark.conf.set(k, -1))("spark.sql.autoBroadcastJoinThreshold")


def near(a, b):
    """Whether word lists are at an edit distance of 1 or less."""
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("limit", [0, 500_000])
def test_line_dedup_by_brute_force(spark, limit):
    import random

    r = random.Random(5)
    base = [[r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(1, 14))] for _ in range(12)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(r.randint(0, 5)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(w) + 1)
                w = r.choice([w[:at] + ["z"] + w[at:], w[:at] + w[at + 1 :], w[:at] + ["y"] + w[at + 1 :]])
            lines.append((" " if r.random() < 0.8 else " \t ").join(w))
        texts.append("\n".join(lines))
    with_automatic_broadcasts(spark, limit > 0)
    got = {x["doc_id"]: x["text"] for x in line_dedup.mark(docs(spark, texts), broadcast_rows=limit).collect()}
    with_automatic_broadcasts(spark, True)
    seen, want = [], {}
    for i, t in enumerate(texts, 1):
        kept = []
        for line in t.split("\n"):
            w = WORDS.findall(line)
            gone = bool(w) and (w in seen or len(w) >= line_dedup.MIN_WORDS and any(near(w, o) for o in seen if len(o) >= line_dedup.MIN_WORDS))
            if w:
                seen.append(w)
            if not gone:
                kept.append(line)
        want[i] = "\n".join(kept)
    assert got == want


def test_line_dedup_edges(spark):
    long = [" ".join(f"w{i}" for i in range(5000)), " ".join(f"w{i}" for i in range(5000) if i != 2500)]
    rows = [*EDGES, (200, long[0]), (201, long[1]), (202, "p q r s t\np q r s t")]
    out = line_dedup.dedup(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns and out.count() == len(rows)
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r)
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert by[1][0]["text"] is None and by[201][0]["text"] == "" and by[202][0]["text"] == "p q r s t"
    # Repeated rows, and rows without an id, have the same result.
    assert len({r["text"] for r in by[None]}) == 1 and by[None][0]["text"] == prose(2)
    assert line_dedup.mark(docs(spark, [])).count() == 0


def brute_classes(rows):
    import xxhash

    fps = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return [(i, f"{fp:016x}", least[g]) for (i, _), fp, g in zip(rows, fps, group, strict=True)]


@pytest.mark.parametrize("limit", [1, 32])
def test_simhash_by_brute_force(spark, sf_dir, limit):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf_dir, "documents").collect()]
    text = prose(8, 400).split()
    rows += [(1000 + i, " ".join([*text[: 5 * i], "new", *text[5 * i + 1 :]])) for i in range(60)]
    rows += [(5, None), (None, None), (None, prose(3)), (2000, ""), (2001, "A"), (2002, "a")]
    out = simhash.classes(docs(spark, rows), limit)
    got = Counter((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in out.collect())
    assert got == Counter(brute_classes(rows))


def test_golay_code_is_perfect_and_keys_lose_nothing():
    import numpy as np

    tables = simhash.golay_tables()
    assert len(set(tables[1].tolist())) == 2048
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**63), 2**63 - 1, 3000)
    flips = [rng.choice(64, rng.integers(0, 3), replace=False) for _ in a]
    b = a ^ np.array([np.bitwise_or.reduce(np.left_shift(np.int64(1), x.astype(np.int64)), initial=0) for x in flips], dtype=np.int64)
    (ka, _), (kb, _) = simhash.search_keys(a, tables), simhash.search_keys(b, tables)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist(), strict=True))


def test_distinct_documents(spark):
    rows = [(3, prose(1)), (2, prose(1)), (2, prose(1)), (9, prose(4)), (None, prose(5)), (None, prose(5)), (7, None), (8, "")]
    out = simhash.distinct_documents(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(2, prose(1)), (9, prose(4)), (None, prose(5)), (7, None)])
    assert simhash.classes(docs(spark, [])).count() == 0


def test_decontamination_of_many_sizes_by_brute_force(spark, sf_dir):
    """Items of 5 to 200 words in documents shorter and longer than they are, whole and damaged; every limit gives the same rows."""
    import random

    r = random.Random(4)
    items = [(i, prose(1000 + i, r.choice([5, 6, 9, 14, 40, 90, 200]))) for i in range(40)]
    rows = []
    for i in range(250):
        w = r.choice(items)[1].split()
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = "other"
        w = w[r.choice([0, 0, 1, 3]) :]
        rows.append((i, " ".join([*prose(i, r.choice([1, 3, 500])).split(), *w, *prose(-i, r.choice([1, 2, 300])).split()])))
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    want = Counter()
    for i, t in rows:
        for j, u in items:
            both = len(shingles(t) & shingles(u))
            if both * 5 >= len(shingles(u)) * 4:
                want[i, j, both, len(shingles(u))] += 1
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    assert len(want) > 100
    for limit in (0, 20, 500_000):
        with_automatic_broadcasts(spark, limit > 20)
        assert Counter(tuple(x) for x in decontamination.matches(d, b, broadcast_rows=limit).collect()) == want
        assert {x["doc_id"] for x in decontamination.clean(d, b, broadcast_rows=limit).collect()} == {i for i, _ in rows} - {k[0] for k in want}
    with_automatic_broadcasts(spark, True)


def test_decontamination_finds_items_of_one_to_four_words(spark):
    import random

    r = random.Random(9)
    items = [(1, "The answer is forty"), (2, "forty"), (3, "is, forty"), (4, "a b c"), (5, "a b c d e f"), (2, "FORTY"), (6, None), (7, "forty-two"), (None, "b c")]
    rows = [(i, " ".join(r.choice(("a", "b", "c", "d", "the", "answer", "is", "forty", "fortytwo", "x")) for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 30, 300, 3000])]
    rows += [(20, "We know that the answer, is forty."), (21, "the answer is not forty"), (21, "the answer is not forty"), (None, "a b c d e f g"), (22, "forty"), (23, None)]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER | dict.fromkeys(map(ord, decontamination.PUNCTUATION))))
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = Counter()
    for j, u in set(items):
        n = min(5, len(words(u)))
        for i, t in rows:
            both = len(runs(words(t), n) & runs(words(u), n)) if n else 0
            if n and both * 5 >= len(runs(words(u), n)) * 4:
                want[i, j, both, len(runs(words(u), n))] += 1
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    assert {k[:2] for k in want} >= {(20, 1), (20, 2), (20, 3), (22, 2), (None, 4), (None, 5), (None, None)}
    for limit in (0, 500_000):
        with_automatic_broadcasts(spark, limit > 0)
        assert Counter(tuple(x) for x in decontamination.matches(d, b, broadcast_rows=limit).collect()) == want
        assert {x["doc_id"] for x in decontamination.clean(d, b, broadcast_rows=limit).collect()} == {i for i, _ in rows} - {k[0] for k in want}
    with_automatic_broadcasts(spark, True)


def test_decontamination_by_brute_force_and_edges(spark):
    item = prose(11, 30).split()
    changed = [*item[:15], "other", *item[16:]]
    twice = [*item[:8], "x", *item[9:20], "y", *item[21:]]
    rows = [*EDGES, (300, "Lead. " + " ".join(item).upper().replace(" ", ",\n") + " end"), (301, " ".join(changed)), (302, " ".join(twice)), (303, "w " * 20_000 + " ".join(item)), (304, "tiny one"), (None, " ".join(item))]
    items = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (4, "Tiny, one"), (None, prose(12, 20)), (6, prose(13, 4))], "item_id bigint, text string")
    d = docs(spark, rows)
    # One word replaced costs 5 of 26 shingles, two cost 10.
    want = [(300, 1, 26, 26), (301, 1, 21, 26), (303, 1, 26, 26), (304, 4, 1, 1), (None, 1, 26, 26)]
    assert Counter(tuple(r) for r in decontamination.matches(d, items).collect()) == Counter(want)
    kept = decontamination.clean(d, items)
    assert kept.columns == d.columns and kept.count() == len(rows) - len(want)
    assert decontamination.matches(d.limit(0), items).count() == 0
    assert decontamination.clean(d, items.limit(0)).count() == len(rows)


@pytest.mark.parametrize("limits", [{}, {"share_rows": 1, "shares": 40}])
def test_packing_is_whole_and_tight(spark, limits):
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    odd = ["It's a  café́ Ångström! 中文 12345 it'll...", "a<|endoftext|>b", "x\x1cy z", "İstanbul ΣΣ ßen", " nb sp　"]
    rows = [*EDGES, *[(500 + i, t) for i, t in enumerate(odd)], *[(600 + i, prose(i, 20 + 37 * i)) for i in range(60)], *[(700, prose(3))] * 30]
    clash = docs(spark, rows).selectExpr("doc_id", "text", "1 AS seen", "'x' AS share", "0 AS length", "0 AS rank", "0 AS start", "n_chars AS __length")
    got = packing.pack(clash, **limits).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = Counter((i, x) for i, x in ((r["doc_id"], r["text"]) for r in docs(spark, rows).collect()))
    want = Counter()
    for (i, text), n in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[(i, at, len(part), zlib.crc32(part.tobytes()), len(ids))] += n
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    packs = {}
    for r in got:
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in packs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_plan_places_all():
    import random

    r = random.Random(1)
    histogram = {n: r.randint(1, 50) for n in r.sample(range(1, 4097), 700)} | {1: 9000, 4096: 3}
    patterns = packing.plan(histogram)
    placed = Counter()
    for runs, count in patterns:
        assert sum(n * k for n, k in runs) <= 4096
        for n, k in runs:
            placed[n] += k * count
    assert placed == Counter(histogram)
    used = sum(n * k for n, k in histogram.items())
    # Uniform lengths pack worse than those of documents.
    assert 1 - used / (4096 * sum(c for _, c in patterns)) < 0.03


def test_encoder_equals_encoding_whole_texts():
    import random

    import numpy as np

    e = packing.Encoder(packing.tokenizer_json(), most_words=5000)
    whole = lambda t: np.asarray(e.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    r = random.Random(9)
    letters = "aAbZéÉİıſßẞÞñÑŒœĲŉǅǆȺⱥΣςﬁK'’-_&@#0١٣²½.,;:!?\u0301\u0307\u200d\u00a0\u0085\u2028\x1c\x1f\t\n中あ한😀<|endoftext|>"
    texts = ["İ;", "İİ", "xİ.", "İ\u0307!", "Aİa?", "ſ:", "ǅ,"] + ["".join(r.choice(letters) if r.random() < 0.5 else r.choice("abcdeABC İ.;") for _ in range(r.randint(1, 24))) for _ in range(20_000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x250, 0x3000), r.randrange(0x1F000, 0x1FFFF)])) for _ in range(12)) for _ in range(10_000)]
    texts += [f"{chr(c)}{t}" for c in range(33, 0x250) for t in ("", *e.TAILS)] + [f"a{chr(c)}b{t}" for c in range(33, 0x250) for t in ("", ";")]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        for t, got in zip(some, e.encode(some), strict=True):
            assert got == whole(t), t


def test_encoder_keeps_its_bound():
    e = packing.Encoder(packing.tokenizer_json(), most_words=50)
    plain = packing.Encoder(packing.tokenizer_json())
    for i in range(20):
        assert e.encode([prose(i)]) == plain.encode([prose(i)])
        assert len(e.table) <= 120


def test_pipeline_stages_do_their_work(spark, sf_dir):
    import corpus_pipeline as c

    assert c.ORACLE_SQL is None and len(c.STAGES) == 5
    before = read(spark, sf_dir, "documents")
    labels, items = read(spark, sf_dir, "labels"), read(spark, sf_dir, "benchmark")
    after = {}
    for name, stage in c.STAGES:
        now = stage(spark, before, sf_dir)
        if name != "packing":
            assert now.columns == before.columns
            now = now.cache()
        after[name] = (before, now)
        before = now
    first, kept = after["quality_rules"]
    assert {r[0] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in quality_rules.rate(first, labels).where("kept").collect()}
    docs_, deduped = after["line_dedup"]
    assert deduped.count() == docs_.count()
    assert line_dedup.mark(docs_).where("n_removed > 0").count() > 0
    docs_, single = after["simhash_near_dedup"]
    want = {x[2] for x in brute_classes([(r["doc_id"], r["text"]) for r in docs_.collect()])}
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(want)
    docs_, clean = after["benchmark_decontamination"]
    assert decontamination.matches(clean, items).count() == 0 and clean.count() < docs_.count()
    assert {r[0] for r in after["packing"][1].select("doc_id").collect()} == {r[0] for r in clean.select("doc_id").collect()}
    assert Counter(tuple(r) for r in c.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect()) == Counter(tuple(r) for r in after["packing"][1].select("doc_id", "start", "length", "ids_crc32").collect())


STAGE_TABLES = {"labels": "doc_id bigint, quality int, toxic int, text string", "benchmark": "item_id bigint, text string, doc_id string"}


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeated rows, columns of other names and empty tables pass through every stage."""
    import corpus_pipeline as c

    item = prose(77, 40)
    spark.createDataFrame([(1, 1, 0, "x"), (None, 0, 0, None), (2, None, None, "y"), (1, 1, 0, "x")], STAGE_TABLES["labels"]).write.parquet(f"{tmp_path}/full/labels.parquet")
    spark.createDataFrame([(1, item, "d"), (None, None, None), (1, item, "d")], STAGE_TABLES["benchmark"]).write.parquet(f"{tmp_path}/full/benchmark.parquet")
    rows = [*EDGES, (300, prose(5, 90) + "\n" + item), (301, prose(6, 90)), (301, prose(6, 90)), (None, None), (302, prose(1, 60))]
    docs(spark, rows).write.parquet(f"{tmp_path}/full/documents.parquet")
    for name, kind in STAGE_TABLES.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/{name}.parquet")
    docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    now = read(spark, f"{tmp_path}/full", "documents")
    for _, stage in c.STAGES[:-1]:
        after = stage(spark, now, f"{tmp_path}/full")
        assert after.columns == now.columns
        now = after.cache()
    kept = {(r["doc_id"], r["text"]) for r in now.collect()}
    assert (301, prose(6, 90)) in kept and 300 not in {i for i, _ in kept} and now.where("doc_id = 301").count() == 1
    # Equal documents are emptied by line dedup but for the first; one of the empty ones stays for all.
    assert (1, prose(1)) in kept and sum(t == "" for _, t in kept) == 1
    assert {r["doc_id"] for r in c.run(spark, f"{tmp_path}/full").collect()} == {i for i, _ in kept}
    assert c.run(spark, f"{tmp_path}/none").count() == 0


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from evidloom.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file://")


def test_scratch_of_two_threads_is_apart(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from evidloom.llm.common import fresh_path, scratch

    both = Barrier(2)

    def one(_):
        with scratch(spark) as folder:
            both.wait(20)
            inside = fresh_path(spark, "a").startswith(folder)
            both.wait(20)
        return inside

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(one, range(2))) == [True, True]


def test_scratch_tables_go(spark):
    from pathlib import Path

    from evidloom.llm.common import fresh_path, scratch, stored

    kept = fresh_path(spark, "kept")
    with scratch(spark) as folder:
        stored(spark.range(3), "a").write.parquet(kept)
        assert Path(folder.removeprefix("file://")).is_dir()
    assert not Path(folder.removeprefix("file://")).exists() and spark.read.parquet(kept).count() == 3


def test_short_lines_go_for_an_earlier_equal_one_alone(spark):
    texts = ["All rights reserved.\n\nyes\na b c d e", "All  rights reserved.\n\nAll rights kept.\nyes", "\tyes\n\na b c d f\nnew", None, "yes"]
    out = line_dedup.mark(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in out} == {1: (4, 0, texts[0]), 2: (4, 2, "\nAll rights kept."), 3: (4, 2, "\nnew"), 4: (0, 0, None), 5: (1, 1, "")}


def test_line_dedup_of_the_table_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    seen, equal = set(), {}
    for r in docs.orderBy("doc_id").collect():
        lines = [" ".join(x.split()) for x in (r["text"] or "").split("\n")]
        equal[r["doc_id"]] = 0
        for w in filter(None, lines):
            equal[r["doc_id"]] += w in seen
            seen.add(w)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.mark(docs).collect()}
    assert sum(equal.values()) > 0 and all(got[k] >= n for k, n in equal.items())
