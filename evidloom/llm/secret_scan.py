"""Secret scan: base patterns, and a character convolutional network over every candidate and its context.

Candidates are the runs of 12 or more of A-Z a-z 0-9 + / _ . = - with a digit and a letter. The
network sees a candidate (all of it: a longer one in windows of WINDOW characters that overlap by half,
the highest score counting) and CONTEXT characters on either side. A character is a class and
whether it is of the candidate; a convolution of WIDTH characters, its maxima and means over the
window, and a logistic unit follow, all in numpy.

It is trained on labelled findings: `findings` makes secrets of some families and look-alikes (addresses, numbers, names,
paths, dates, words, account numbers) in contexts, by a seed. A second part of them calibrates the scores (Platt). A third
sets the threshold: the highest at which recall is at least `recall` in every family of secrets. Findings are scored there
as they are in a text, by all their windows. The weights, some KB, go to the tasks.

Candidates that overlap a base finding are scored, but base findings stay as they are and nothing is added there.

Defined results: a null text is empty and has no findings; whole texts are read; scanning is linear in
the text but for one search in the sorted base findings for each candidate; repeated rows each get a row; no rows give
none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import read

#: Base patterns and the least length of a finding: fixed values of the query.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "cnn")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
WINDOW, CONTEXT, WIDTH, FILTERS = 64, 24, 5, 24
SEED, ROUNDS, EXAMPLES = 7, 250, 6000
RECALL = 0.95
#: Character classes: the first that holds.
CLASSES = ("aeiou", "bcdf", "ghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "+/", "_-", ".", "=", ":", "\"'`", " \t\n\r", "@", "<>()[]{}&?#%$!,;|*\\^~")
N_CLASSES = len(CLASSES) + 2  # others; none (beyond the text)
CHANNELS = 2 * N_CLASSES


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not run.isalpha() and any("0" <= c <= "9" for c in run) and any(c.isalpha() for c in run):
            out.append(m.span())
    return out


def _class_table():
    import numpy as np

    table = np.full(129, N_CLASSES - 2, dtype=np.int64)
    for k, chars in reversed(list(enumerate(CLASSES))):
        for c in chars:
            table[ord(c)] = k
    return table


def windows(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(characters, first of the candidate, behind its last) of a candidate's windows, padded with NUL to one length."""
    out = []
    for at in range(start, max(start + 1, end - WINDOW // 2), WINDOW // 2):
        stop = min(end, at + WINDOW)
        left, right = text[max(0, at - CONTEXT) : at], text[stop : stop + CONTEXT]
        s = left.rjust(CONTEXT, "\0") + text[at:stop] + right
        out.append((s.ljust(2 * CONTEXT + WINDOW, "\0"), CONTEXT, CONTEXT + stop - at))
    return out


def one_hot(parts: list[tuple[str, int, int]]):
    """Windows -> class numbers, with an offset where a character is of the candidate."""
    import numpy as np

    length = 2 * CONTEXT + WINDOW
    codes = np.array([[min(ord(c), 128) for c in s] for s, _, _ in parts], dtype=np.int64).reshape(-1, length)
    classes = _class_table()[codes]
    classes[codes == 0] = N_CLASSES - 1
    place = np.arange(length)
    inside = (place >= np.array([a for _, a, _ in parts])[:, None]) & (place < np.array([b for _, _, b in parts])[:, None])
    return classes + N_CLASSES * inside


class Network:
    """Convolution, maxima and means, logistic unit. The convolution of one-hot characters is a sum of table rows."""

    def __init__(self, kernel, bias, out, calibration=(1.0, 0.0), threshold=0.5):
        self.kernel, self.bias, self.out, self.calibration, self.threshold = kernel, bias, out, calibration, threshold

    def layers(self, x):
        import numpy as np

        n = x.shape[1] - WIDTH + 1
        z = sum(self.kernel[k][x[:, k : k + n]] for k in range(WIDTH)) + self.bias
        a = np.maximum(z, 0)
        return a, np.concatenate([a.max(axis=1), a.mean(axis=1), np.ones((len(x), 1))], axis=1)

    def logits(self, x):
        import numpy as np

        return np.concatenate([self.layers(x[i : i + 1024])[1] @ self.out for i in range(0, len(x), 1024)] or [np.zeros(0)])

    def scores(self, x):
        import numpy as np

        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x) + b, -40, 40)))

    def step(self, x, y):
        """The loss's gradients by (kernel, bias, out)."""
        import numpy as np

        a, h = self.layers(x)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out, -40, 40)))
        d = (p - y) / len(y)
        g = d[:, None] * self.out[None, :]
        da = np.repeat((g[:, FILTERS : 2 * FILTERS] / a.shape[1])[:, None, :], a.shape[1], axis=1)
        rows, best = np.arange(len(x))[:, None], a.argmax(axis=1)
        da[rows, best, np.arange(FILTERS)[None, :]] += g[:, :FILTERS]
        dz = da * (a > 0)
        kernel = np.zeros_like(self.kernel)
        n = a.shape[1]
        flat = dz.reshape(-1, FILTERS)
        for k in range(WIDTH):
            hot = np.zeros((flat.shape[0], CHANNELS))
            hot[np.arange(flat.shape[0]), x[:, k : k + n].reshape(-1)] = 1
            kernel[k] = hot.T @ flat
        return kernel, dz.sum(axis=(0, 1)), h.T @ d


LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SYLLABLES = ("th", "er", "on", "an", "in", "re", "nd", "at", "en", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "tion", "ment", "qu", "ou")


class Maker:
    """Secrets, look-alikes and words around them, by a seed."""

    def __init__(self, seed: int):
        import random

        self.r = random.Random(seed)
        some, number, word, pick = self.some, self.number, self.word, self.r.choice
        b64url = LOW + UP + DIGITS + "_-"
        #: Families of secrets.
        self.secrets = {
            "mixed": lambda: some(LOW + UP + DIGITS, 20, 64),
            "base64": lambda: some(LOW + UP + DIGITS + "+/", 24, 88) + pick(["", "=", "=="]),
            "upper": lambda: some(UP + DIGITS, 20, 40),
            "lower": lambda: some(LOW + DIGITS, 20, 48),
            "hex": lambda: some("0123456789ABCDEFabcdef", 32, 64),
            "prefixed": lambda: pick(["ghp_", "sk-", "pk_live_", "AIza", "npm_", "hf_", "key-", some(LOW, 2, 4) + "_"]) + some(pick([LOW + UP + DIGITS, b64url, "0123456789ABCDEFabcdef"]), 24, 60),
            "numbered": lambda: f"{pick(['xoxb', 'xoxp', some(LOW, 3, 5)])}-{some(DIGITS, 9, 13)}-{some(DIGITS, 9, 13)}-{some(LOW + UP + DIGITS, 20, 32)}",
            "dotted": lambda: f"{pick(['eyJ', 'SG.', ''])}{some(b64url, 16, 40)}.{some(b64url, 20, 90)}.{some(b64url, 20, 60)}",
        }
        #: Look-alikes.
        self.plain = (
            lambda: ".".join(number(1, 255) for _ in range(4)) + pick([".", "/24", "-" + word(1, 2)]),
            lambda: f"{word(2, 4)}.{number(1, 99)}",
            lambda: f"mail{number(0, 9)}.{word(1, 2)}.com",
            lambda: f"{word(1, 2)}{number(0, 99)}.{word(1, 4)}.{pick(['com', 'org', 'net', 'de', 'io'])}",
            lambda: f"{number(1990, 2030)}-{number(10, 12)}-{number(10, 28)}T{number(10, 23)}.{number(10, 59)}Z",
            lambda: f"/{word()}/{word()}/{word()}{number(1, 999)}",
            lambda: f"{word()}-{word()}-{number(1, 9999)}",
            lambda: f"{word()}_{word()}_{number(1, 99)}.{pick(['txt', 'pdf', 'html', 'jpg', 'py'])}",
            lambda: f"www.{word()}{number(1, 99)}.{word(1, 2)}.org/{word()}",
            lambda: f"v{number(1, 9)}.{number(0, 20)}.{number(0, 99)}-{pick(['beta', 'rc1', 'alpha', 'release'])}",
            lambda: f"{word()}-{word()}-{number(0, 9)}.{number(0, 20)}.{number(0, 99)}.tar.gz",
            lambda: word(4, 7) + number(1, 9),
            lambda: word(4, 9) + number(1990, 2030) + word(1, 3),
            lambda: "=" * self.r.randint(5, 20) + word() + number(1, 9),
            lambda: f"{word(2, 3).capitalize()}{word(2, 3).capitalize()}{number(1, 99)}",
            lambda: "".join(word(1, 2).capitalize() for _ in range(self.r.randint(3, 6))) + number(1, 99),
            lambda: word().upper() + "-" + number(1000, 99999) + "-" + word().upper(),
            lambda: f"{some(UP, 2, 3)}-{number(1990, 2030)}-{some(DIGITS, 4, 8)}",
            lambda: some(UP, 2, 2) + some(DIGITS, 16, 24),
            lambda: f"{some(DIGITS, 3, 4)}-{some(DIGITS, 3, 4)}-{some(DIGITS, 4, 4)}{pick(['x', 'ext'])}{number(1, 99)}",
            lambda: f"10.{number(1000, 9999)}/{word(1, 3)}.{number(1990, 2030)}.{number(1, 999)}",
            lambda: ".".join(word() for _ in range(self.r.randint(2, 5))) + number(1, 9),
            lambda: f"{number(1, 999)}/{number(1, 999)}/{word(2, 4)}",
            lambda: "/".join(word() for _ in range(self.r.randint(3, 9))) + number(1, 9),
            lambda: "_".join(word() for _ in range(self.r.randint(3, 8))) + number(1, 9),
        )

    def some(self, chars: str, least: int, most: int) -> str:
        return "".join(self.r.choice(chars) for _ in range(self.r.randint(least, most)))

    def number(self, least: int, most: int) -> str:
        return str(self.r.randint(least, most))

    def word(self, least: int = 1, most: int = 4) -> str:
        """Of frequent syllables, or of a consonant, a vowel and perhaps a consonant each."""
        c = self.r.choice
        often = c((True, False))
        syllable = lambda: c(SYLLABLES) if often else c("bcdfghjklmnprstvwxz") + c("aeiouy") + c(("", "", c("lmnprstx")))
        return "".join(syllable() for _ in range(self.r.randint(least, most)))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most)))

    def body(self, make) -> str:
        """A run that is a candidate."""
        return next(b for b in iter(make, None) if candidates(b) == [(0, len(b))])


def findings(n: int, seed: int) -> list[tuple[str, int, int, str]]:
    """n labelled findings (text, start, end, family; empty for a look-alike), half of each, made by rule."""
    m = Maker(seed)
    pick, families, out = m.r.choice, sorted(m.secrets), []
    for i in range(n):
        family = families[i // 2 % len(families)] if i % 2 else ""
        body = m.body(m.secrets[family] if family else pick(m.plain))
        if family:
            lead = pick(["", "", "Authorization: Bearer ", "key: ", "credential ", "client_id:", "auth '", "use ", 'access "', "private key ", "signature: ", m.words(1, 3) + " "])
            tail = pick(["", " ", '"', "'", "\n", ","])
        else:
            lead, tail = pick(["", "see ", m.word() + "@", f"{m.word()}.{m.number(1, 99)}@", "http://", "in ", "(", "key: ", m.words(1, 4) + " "]), pick(["", " ", ",", ")", "@" + m.word() + ":", "\n"])
        before = m.words(0, 8) + pick([" ", "\n", ": "]) + lead
        # What follows may be another secret, whatever the finding is.
        after = " " + m.words(0, 8) if m.r.random() < 0.8 else f' {m.word()} = "{m.body(m.secrets[pick(families)])}"'
        out.append((before + body + tail + after, len(before), len(before) + len(body), family))
    return out


def examples(found: list[tuple[str, int, int, str]]):
    """The windows of findings, whether each is of a secret, and the finding it is of."""
    import numpy as np

    parts = [(w, i) for i, (text, a, b, _) in enumerate(found) for w in windows(text, a, b)]
    of = np.array([i for _, i in parts], dtype=np.int64)
    return one_hot([w for w, _ in parts]), np.array([bool(f[3]) for f in found], dtype=float)[of], of


def highest(values, of, n: int):
    """The highest value of the windows of each of n findings."""
    import numpy as np

    out = np.full(n, -np.inf)
    np.maximum.at(out, of, values)
    return out


@lru_cache(4)
def trained(seed: int = SEED, rounds: int = ROUNDS, n: int = EXAMPLES, recall: float = RECALL) -> Network:
    """The network by Adam on n findings, calibrated on n / 2 others, its threshold set on n / 2 more."""
    import numpy as np

    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.15, (WIDTH, CHANNELS, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS + 1))
    x, y, _ = examples(findings(n, seed))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.kernel, net.bias, net.out)]
    for t in range(1, rounds + 1):
        pick = rng.permutation(len(x))[:256]
        for p, g, (m, v) in zip((net.kernel, net.bias, net.out), net.step(x[pick], y[pick]), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    found = findings(n // 2, seed + 1)
    x, _, of = examples(found)
    z, y, (a, b) = highest(net.logits(x), of, len(found)), np.array([bool(f[3]) for f in found]), (1.0, 0.0)
    # Platt's targets keep the fit finite where the parts are apart; Newton's steps.
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w, e = q * (1 - q), q - target
        hessian = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(hessian, [(e * z).sum(), e.sum()])
    net.calibration = (float(a), float(b))
    found = findings(n // 2, seed + 2)
    x, _, of = examples(found)
    scores, families = highest(net.scores(x), of, len(found)), np.array([f[3] for f in found])
    of_family = [np.sort(scores[families == f]) for f in sorted(set(families) - {""})]
    net.threshold = min(float(s[int((1 - recall) * len(s))]) for s in of_family)
    return net


def united(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans cover together, in order."""
    starts, ends = [], []
    for _, a, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def added(texts: list[str], base: list[list[tuple[str, int, int]]], net: Network) -> list[list[tuple[str, int, int]]]:
    """The network's findings for each text: candidates at the threshold or above that overlap no base finding."""
    import numpy as np

    owners, spans, parts, of = [], [], [], []
    for i, text in enumerate(texts):
        for a, b in candidates(text):
            for w in windows(text, a, b):
                parts.append(w)
                of.append(len(spans))
            owners.append(i)
            spans.append((a, b))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not parts:
        return out
    best = np.zeros(len(spans))
    for at in range(0, len(parts), 4096):
        np.maximum.at(best, of[at : at + 4096], net.scores(one_hot(parts[at : at + 4096])))
    covered = {i: united(base[i]) for i in set(owners)}
    for i, (a, b), score in zip(owners, spans, best, strict=True):
        starts, ends = covered[i]
        last = bisect_left(starts, b) - 1
        if score >= net.threshold and not (last >= 0 and ends[last] > a):
            out[i].append(("cnn", a, b))
    return out


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added."""
    net = net or trained()
    shared = docs.sparkSession.sparkContext.broadcast((net.kernel, net.bias, net.out, net.calibration, net.threshold))
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def scanned(batches):
        import pyarrow as pa

        own = Network(*shared.value)
        joined = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(1).to_pylist()
                base = [base_findings(t) for t in texts]
                more = added(texts, base, own)
                count = lambda kind: pa.array([sum(x[0] == kind for x in found) for found in base], pa.int64())  # noqa: B023, E731
                spans = [joined(sorted(x + y, key=lambda s: (s[1], KINDS.index(s[0])))) for x, y in zip(base, more, strict=True)]
                digests = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
                names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"]
                yield pa.RecordBatch.from_arrays([b.column(0), count("assign"), count("access"), count("hex"), pa.array(digests), pa.array(spans), pa.array([len(x) for x in more], pa.int64())], names=names)

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(scanned, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES: dict[str, str] = {}
