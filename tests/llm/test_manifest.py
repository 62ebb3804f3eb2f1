"""Merkle manifest and importance resampling: edge cases and brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidloom.llm import merkle, resampling

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __at bigint, tree string, __row string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], DOCS)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    """Of each level below the root: (left, right) of a node's run, empty where nothing is."""
    for level in levels[:-1]:
        yield ("", level[i + 1] if i + 1 < len(level) else "") if i % 2 == 0 else (level[i - 1], "")
        i //= 2


def manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: h("".join(map(field, (i, source, lang, n, text))))
    by_lang: dict = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = [tree([leaf(*r) for r in by_lang[lang]]) for lang in langs]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (lang, levels) in enumerate(zip(langs, trees, strict=True)):
        for i, r in enumerate(by_lang[lang]):
            way = [*siblings(levels, i), *siblings(top, k)]
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(*r[:4], r[4] + 1) if tampered else leaf(*r)
            for left, right in way:
                node = h(left + node + right)
            root = top[-1][0]
            out.append((r[0], leaf(*r), levels[-1][0], root, h("".join(a + b for a, b in way)), node, node == root))
    return Counter(out)


ROWS = [(i, f"text {i}", ("en", "de", None, "", "zü")[i % 5 if i % 3 else 0], None if i % 4 == 0 else "s", None if i % 6 == 0 else i) for i in range(60)]
CASES = {
    "none": [],
    "one": [(1, None, None, None, None)],
    "one language": [(i, "x", "en", "s", 1) for i in range(9)],
    "repeats": [(3, "x", "en", "s", 1)] * 5 + [(3, "y", "en", "s", 1), (None, "x", "en", "s", 2), (None, "x", "en", "s", 2)],
    "greatest": [(i, "w" * 100_000, "en", "s", 2**63 - 1) for i in range(30)],
    "mixed": ROWS,
}


@pytest.mark.parametrize("block", [1, 3, 8])
@pytest.mark.parametrize("name", sorted(CASES))
def test_manifest_by_brute_force(name, block, spark):
    got = Counter(map(tuple, merkle.manifest(docs(spark, CASES[name]), block=block).collect()))
    assert got == manifest(CASES[name])
    assert sum(got.values()) == len(CASES[name])


@pytest.mark.parametrize("n,height,stratum", [(1, 0, 4), (1, 3, 2), (2, 1, 1), (5, 3, 2), (13, 8, 3), (256, 8, 4), (100, 7, 7)])
def test_walk_gives_each_path_with_bounded_nodes(n, height, stratum, monkeypatch):
    leaves, most = [bytes([i % 251]) * 32 for i in range(n)], 0
    made = []
    monkeypatch.setattr(merkle, "_Desired", type("Seen", (merkle._Desired,), {"__init__": lambda self, *a: (super(type(self), self).__init__(*a), made.append(self))[0]}))
    for i, path in enumerate(merkle.whole_paths(leaves, height)):
        assert merkle.fold(leaves[i], path) == merkle.root_of(leaves, height)
    assert all(len(level) <= 1 << stratum for d in made for level in d.nodes if d.top - d.base <= stratum)
    assert all(len(d.stack) <= d.top + 1 for d in made)
    assert [len(p) for p in merkle.paths(leaves, height, stratum)] == [len(p) for p in merkle.paths(leaves, height, 4)]


def resampled(rows, target, percent=5, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    features = lambda w: Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))
    found = [(i, words(t), features(words(t))) for i, t in rows]
    s, t = sum((f for _, _, f in found), Counter()), sum((features(words(x)) for x in target), Counter())
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, w, f in found:
        weight = sum(n * gain(b) for b, n in f.items())
        x = int(h(f"42:{'' if i is None else i}")[:8], 16)
        out.append((i, len(w), sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296)))))
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(eligible) * percent // 100
    return Counter([(*r[:1], *r[2:], k + 1 if k < drawn else None) for k, r in enumerate(eligible)] + [(*r[:1], *r[2:], None) for r in out if r[1] < least])


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(("ab", "Cé", "d-e", "9x", "ñandú", "Z")) for _ in range(n))


TEXTS = [(k, prose(k, k % 50)) for k in range(120)] + [(None, prose(5, 30)), (None, prose(6, 30)), (7, prose(7, 40)), (7, prose(7, 40)), (500, None), (501, " .,;\n"), (502, "word " * 30_000), (503, "x" * 200_000), (504, "\x00a\x7fb")]


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resampling_by_brute_force(percent, spark):
    target = [prose(1, 60), None, "ab ab ab ab", "ab ab ab ab"]
    d = docs(spark, [(i, t, "en", "s", 1) for i, t in TEXTS])
    got = resampling.resample(d, spark.createDataFrame([(t, 1) for t in target], "text string, score int"), percent=percent)
    assert Counter(map(tuple, got.collect())) == resampled(TEXTS, target, percent)


def test_resampling_of_nothing(spark):
    d, none = docs(spark, [(1, prose(1, 30), "en", "s", 1)]), spark.createDataFrame([], "text string")
    assert resampling.resample(d.where(F.lit(False)), none).collect() == []
    assert Counter(map(tuple, resampling.resample(d, none).collect())) == resampled([(1, prose(1, 30))], [])


@pytest.mark.parametrize("most", [1, 2, 3, 5])
@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ring_goes_on_over_slices(most, size, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", size)
    for text in ["", " ", "a", "one two", " lead and tail ", prose(3, 50), "x" * 300, "x" * 300 + " y " + "z" * 300, prose(4, 9).replace(" ", "   ")]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        want = Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, most + 1) for i in range(len(w) - n + 1))
        found = list(resampling.buckets(text.encode(), most))
        assert sum(n for n, _ in found) == len(w) and Counter(int(b) for _, x in found for b in x) == want
