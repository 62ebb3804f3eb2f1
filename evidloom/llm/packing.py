"""Packing of token sequences by shortest-pack-first over the length histogram.

1. Each text becomes ids, ended by id 2; pieces of `capacity` ids are cut off, the rest is a shorter piece. The
   pieces, small rows, are stored. Words are encoded once and kept in a worker's table of bounded size:
   no token of this tokenizer crosses white space.
2. The histogram (at most `capacity` lengths) goes to the driver. Lengths are placed longest first, each into the pack with
   the most room, a new pack where none fits; equal packs are one pattern with a count. This makes at
   most two patterns a length, and a pattern has at most 90 different lengths (1 + 2 + ... + 91 > 4096), which bounds the plan.
3. The plan goes to the tasks; a piece finds its place by the rank among pieces of its length. Ranks are counted within
   shares of a length, of some `SHARE_ROWS` pieces or 1 in `SHARES` of all pieces, whichever is more: a length of a third
   of all documents is no single task's, and at most SHARES + `capacity` counts come to the driver, whatever the input.

Defined results: a null or empty text is the end id alone; repeated documents are packed each; texts are read whole; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidloom.llm.common import per_worker, read, stored

CAPACITY = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
SHARE_ROWS, SHARES = 100, 20_000
#: Words and their lower-case forms kept by a worker: some 170 MB.
MOST_WORDS = 1_100_000
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Encoder:
    """Texts to little-endian 32-bit ids, word by word through a table.

    A word whose lower-case form is of Latin letters alone, also before one of TAILS, is one pretoken: its ids are those
    of that form, which is kept as a word, too, and just the last of these ends a word. Forms of ASCII letters are what the model itself takes: it is asked for
    each. Other forms are encoded many at a time and cut behind the ends. A word whose lower case brings in a mark (a
    dotted capital I) is encoded as it stands.
    """

    #: A separator the tokenizer knows as a token of its own.
    MARK, MARK_ID = "<|endoftext|>", 49407
    #: White space to Python, not to the tokenizer.
    ODD = "\x1c\x1d\x1e\x1f"
    TAILS = ".,;:!?"
    LAST_LATIN = "\u024f"

    def __init__(self, tokenizer_json: str, most_words: int = MOST_WORDS):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.most, self.table = most_words, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.tails = {c: self._bytes(c) for c in self.TAILS}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(self.ends))]

    def _bytes(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def _cut(ids, ends) -> list[bytes]:
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _learn_forms(self, forms: set[str]) -> None:
        import numpy as np

        tokenize, id_bytes, others = self.tokenizer.model.tokenize, self.id_bytes, []
        for form in forms:
            if form.isascii():
                self.table[form] = b"".join([id_bytes[t.id] for t in tokenize(form)])
            else:
                others.append(form)
        for at in range(0, len(others), 2000):
            some = others[at : at + 2000]
            ids = np.asarray(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            found = self._cut(ids, np.flatnonzero(self.ends[ids]) + 1)
            self.table.update(zip(some, found if len(found) == len(some) else map(self._bytes, some), strict=True))

    def _learn(self, words: set[str]) -> None:
        import numpy as np

        tails, last, table = self.tails, self.LAST_LATIN, self.table
        heads, forms, ends, plain, new = [], [], [], [], set()
        for w in words:
            if w.isalpha():
                head, tail = w, b""
            elif w[-1] in tails and len(w) > 1 and (head := w[:-1]).isalpha():
                tail = tails[w[-1]]
            else:
                plain.append(w)
                continue
            form = head.lower()
            if not w.isascii() and not (form.isalpha() and max(head) <= last and max(form) <= last):
                plain.append(w)
                continue
            if form != w:
                heads.append(w)
                forms.append(form)
                ends.append(tail)
            if form not in table:
                new.add(w if form == w else form)
        self._learn_forms(new)
        table.update(zip(heads, map(bytes.__add__, map(table.__getitem__, forms), ends), strict=True))
        marked = [w for w in plain if "<|" in w]
        table.update((w, self._bytes(w)) for w in marked)
        plain = [w for w in plain if "<|" not in w] if marked else plain
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = np.asarray(self.tokenizer.encode(self.MARK.join(some) + self.MARK, add_special_tokens=False).ids, dtype="<u4")
            table.update(zip(some, (x[:-4] for x in self._cut(ids, np.flatnonzero(ids == self.MARK_ID) + 1)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. The table is emptied where it would pass its bound (by the forms of one lot at most)."""
        split = [None if any(c in t for c in self.ODD) else t.split() for t in texts]
        new = set().union(*(x for x in split if x)).difference(self.table)
        if len(self.table) + len(new) > self.most and self.table:
            self.table = {}
            new = set().union(*(x for x in split if x))
        self._learn(new)
        get = self.table.__getitem__
        return [self._bytes(t) if x is None else b"".join(map(get, x)) for t, x in zip(texts, split, strict=True)]


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file; by default that of the public_tokenizers package. It is read on the driver and sent to the tasks (under 2 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) -> PIECE and seen, a running number that starts elsewhere in each task."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = per_worker(f"encoder {zlib.crc32(spec.value.encode())}", lambda: Encoder(spec.value))
        seen, end = TaskContext.get().partitionId() * 1_000_003, np.array([END], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = b.column(0).to_pylist()
                out = []
                for doc, data in zip(ids, encoder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                    data += end
                    for start in range(0, len(data), 4 * capacity):
                        part = data[start : start + 4 * capacity]
                        out.append((doc, start // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, seen))
                        seen += 1
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "seen"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE + ", seen bigint")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """{length: number} -> patterns ([(length, times)], count): shortest pack first, longest length first."""
    room: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max(room, default=0)
            if most < length:
                # New packs: as many of this length as are left, one each.
                room.setdefault(capacity - length, []).append(([(length, 1)], left))
                break
            runs, count = room[most].pop()
            used = min(count, left)
            if count > used:
                room[most].append((runs, count - used))
            if not room[most]:
                del room[most]
            *head, last = runs
            grown = [*head, (length, last[1] + 1)] if last[0] == length else [*runs, (length, 1)]
            room.setdefault(most - length, []).append((grown, used))
            left -= used
    return [p for patterns in room.values() for p in patterns]


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, times in a pack, first sequence, offset)] by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for runs, count in patterns:
        offset = 0
        for length, times in runs:
            rank = given.get(length, 0)
            out.setdefault(length, []).append((rank, times, sequence, offset))
            given[length] = rank + count * times
            offset += length * times
        sequence += count
    return out


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, share_rows: int = SHARE_ROWS, shares: int = SHARES) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import numpy as np

    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer=tokenizer, capacity=capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    each = max(share_rows, -(-sum(histogram.values()) // shares))
    dealt = spark.createDataFrame([(k, -(-n // each)) for k, n in histogram.items()], "__length bigint, __shares bigint")
    cut = cut.join(F.broadcast(dealt), F.col("length") == F.col("__length")).withColumn("share", F.col("seen") % F.col("__shares")).drop("seen", "__length", "__shares")
    before, given = {}, dict.fromkeys(histogram, 0)
    for r in cut.groupBy("length", "share").agg(F.count("*").alias("n")).orderBy("length", "share").collect():
        before[r["length"], r["share"]] = given[r["length"]]
        given[r["length"]] += r["n"]
    shared = spark.sparkContext.broadcast((before, {k: np.array(v, dtype=np.int64) for k, v in places(plan(histogram, capacity)).items()}))

    def placed(batches):
        import pyarrow as pa

        offsets, table = shared.value
        for b in batches:
            size, share, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "share", "rank"))
            sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            ends = [0, *(np.flatnonzero((np.diff(size) != 0) | (np.diff(share) != 0)) + 1).tolist(), len(size)]
            for i, j in zip(ends, ends[1:], strict=False):
                if i == j:
                    continue
                rows = table[int(size[i])]
                r = rank[i:j] - 1 + offsets[int(size[i]), int(share[i])]
                at = rows[np.searchsorted(rows[:, 0], r, side="right") - 1]
                q = r - at[:, 0]
                sequence[i:j] = at[:, 2] + q // at[:, 1]
                offset[i:j] = at[:, 3] + q % at[:, 1] * size[i]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    order = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return cut.withColumn("rank", F.row_number().over(order).cast("long")).mapInArrow(placed, PIECE + ", sequence_id bigint, offset bigint")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
