"""Merkle manifest of a dataset: a leaf for each document, a subroot for each language, one root, and a proof for each leaf.

H is the hex sha256 of its inputs joined. Leaves of a language ascend by doc_id; of each level every two nodes become their H,
a last one alone its own H, until one is left. The subroots, by language, make the root in the same way.

Leaves get their places by range partitions and counts, then blocks of 2 ** BLOCK aligned leaves make one row each. The blocks'
roots are the leaves of the layer above, in blocks again, until each tree has one node: some three layers for a billion
documents, each shuffled by (tree, block), so that a language that holds most rows is dealt out like any other.
Proofs come down the same layers: a block's row meets the proof of its root and is walked leaf by leaf.

The walk is a fractal traversal. A block's tree is cut into strata of STRATUM levels; of each stratum the subtree over the present
leaf (existing) is kept and the next one to its right (desired) is built by tree hashing, two units a leaf, so that it is whole when
the walk gets there. A block's memory is its leaves, some KB, and two subtrees a stratum; no more of the tree is ever held.

Defined results: null columns are written `-`; a null language is a tree of its own, before the others; a null doc_id comes
first in its language and isn't tampered with; equal ids are ordered by their leaf; repeated rows each have a leaf; no rows give none; extra
columns are ignored; a very long text is hashed as any other. Tampering with the greatest long is counted without overflow.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import CRC_TABLE_SQL, crc_sql, ranked, read, stored

#: Levels of a block, and of a stratum of its walk.
BLOCK, STRATUM = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the languages' subroots.
TOP = "top"


def H(*parts: bytes) -> bytes:
    """The digest of digests, which are joined as hex text."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def _parent(left, right):
    """None stands for a node that isn't there."""
    return None if left is None else H(left) if right is None else H(left, right)


class _Desired:
    """A subtree over 2 ** top leaves from `first` on, built by tree hashing: its nodes of levels base to top - 1 are kept."""

    def __init__(self, leaves, first: int, base: int, top: int):
        self.leaves, self.at, self.end, self.base, self.top = leaves, first, first + (1 << top), base, top
        self.nodes: list[list] = [[] for _ in range(base, top)]
        self.stack: list[tuple[int, object]] = []

    def _put(self, level: int, node) -> None:
        if self.base <= level < self.top:
            self.nodes[level - self.base].append(node)
        if level < self.top:
            self.stack.append((level, node))

    def grow(self, units: int) -> None:
        for _ in range(units):
            if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
                (level, right), (_, left) = self.stack.pop(), self.stack.pop()
                self._put(level + 1, _parent(left, right))
            elif self.at < self.end:
                self._put(0, self.leaves[self.at] if self.at < len(self.leaves) else None)
                self.at += 1
            else:
                return


def paths(leaves: list[bytes], height: int, stratum: int = STRATUM):
    """The authentication path of each leaf in turn: (is the sibling on the left, sibling) of each level that has one."""
    strata = [(base, min(base + stratum, height)) for base in range(0, height, stratum)]
    existing, desired = [], []
    for base, top in strata:
        whole = _Desired(leaves, 0, base, top)
        whole.grow(2 << top)
        existing.append(whole.nodes)
        desired.append(_Desired(leaves, 1 << top, base, top))
    for i in range(len(leaves)):
        path = []
        for (base, top), nodes in zip(strata, existing, strict=True):
            for level in range(base, top):
                other = (i >> level) ^ 1
                node = nodes[level - base][other & ((1 << (top - level)) - 1)]
                if node is not None:
                    path.append((other < i >> level, node))
        yield path
        for k, (base, top) in enumerate(strata):
            desired[k].grow(2)
            if (i + 1) % (1 << top) == 0:
                existing[k], desired[k] = desired[k].nodes, _Desired(leaves, i + 1 + (1 << top), base, top)


def root_of(leaves: list[bytes], height: int) -> bytes:
    level = leaves
    for _ in range(height):
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def fold(node: bytes, path: list[tuple[bool, bytes]]) -> bytes:
    """The root that a node and its path give; where the path has an entry of no bytes, the node is alone at that level."""
    for left, other in path:
        node = (H(other, node) if left else H(node, other)) if other else H(node)
    return node


def _packed(path: list[tuple[bool, bytes]]) -> bytes:
    """A path as bytes: 0 and a sibling on the left, 1 and one on the right, 2 for none."""
    return b"".join(bytes([0 if left else 1]) + other if other else b"\x02" for left, other in path)


def _unpacked(data: bytes) -> list[tuple[bool, bytes]]:
    out, at = [], 0
    while at < len(data):
        if data[at] == 2:
            out.append((False, b""))
            at += 1
        else:
            out.append((data[at] == 0, data[at + 1 : at + 33]))
            at += 33
    return out


def whole_paths(leaves: list[bytes], height: int):
    """paths() with an entry of no bytes at each level where a node is alone."""
    sizes = [len(leaves)]
    for _ in range(height):
        sizes.append((sizes[-1] + 1) // 2)
    for i, path in enumerate(paths(leaves, height)):
        found = iter(path)
        yield [next(found) if ((i >> level) ^ 1) < sizes[level] else (False, b"") for level in range(height)]


def height_of(n: int, alone: bool, block: int = BLOCK) -> int:
    """Levels of a block of n nodes: all of them, unless it is the only one of its tree."""
    return (n - 1).bit_length() if alone else block


def _shown(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def _leaf(n_chars: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_shown(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS]), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """docs -> tree (the language, marked so that null stands first), doc_id, leaf, changed (the leaf after tampering, null where there is none)."""
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.concat(F.lit("="), F.col("lang")).alias("tree"),
        "doc_id",
        _leaf(F.col("n_chars")).alias("leaf"),
        F.when(tampered, _leaf((F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)"))).alias("changed"),
    ).withColumn("tree", F.coalesce("tree", F.lit("")))


def _blocks(nodes: DataFrame, block: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(tree, at, node, extra) -> (tree, block, alone, nodes): a row for each run of 2 ** block places, which bounds it."""
    by = nodes.groupBy("tree", F.shiftright("at", block).alias("block"))
    rows = by.agg(F.sort_array(F.collect_list(F.struct("at", "node", *extra))).alias("nodes"))
    sizes = rows.groupBy("tree").agg(F.count("*").alias("n_blocks"))
    return rows.join(sizes, "tree").select("tree", "block", (F.col("n_blocks") == 1).alias("alone"), "nodes")


def _roots(blocks: DataFrame, block: int) -> DataFrame:
    """(tree, at, node) of the layer above: a node for each block."""

    def rooted(batches):
        import pyarrow as pa

        for b in batches:
            found = [root_of(nodes, height_of(len(nodes), alone, block)) for alone, nodes in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["tree", "at", "node"])

    return blocks.select("tree", "block", "alone", "nodes.node").mapInArrow(rooted, "tree string, at bigint, node binary")


def _walked(blocks: DataFrame, block: int) -> DataFrame:
    """(tree, block, alone, nodes, path: packed, of the block's root) -> (tree, at, path) of each node."""

    def walked(batches):
        import pyarrow as pa

        for b in batches:
            trees, ats, found = [], [], []
            for tree, number, alone, nodes, above in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for i, path in enumerate(whole_paths(nodes, height_of(len(nodes), alone, block))):
                    trees.append(tree)
                    ats.append((number << block) + i)
                    found.append(_packed(path) + above)
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array(ats, pa.int64()), pa.array(found, pa.binary())], names=["tree", "at", "path"])

    return blocks.select("tree", "block", "alone", "nodes.node", "path").mapInArrow(walked, "tree string, at bigint, path binary")


def layers(nodes: DataFrame, block: int, extra: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each layer over (tree, at, node), lowest first, stored; and each tree's one root (tree, node)."""
    found = []
    while True:
        found.append(stored(_blocks(nodes, block, extra if not found else ()), "blocks"))
        nodes = stored(_roots(found[-1], block), "roots")
        if found[-1].where("NOT alone").isEmpty():
            return found, nodes.select("tree", "node")


def down(found: list[DataFrame], above: DataFrame, block: int) -> DataFrame:
    """The lowest blocks with the path of their roots: `above` has each tree's (tree, path) beyond its own root."""
    paths_above = above.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for layer in reversed(found[1:]):
        walked = _walked(layer.join(paths_above, ["tree", "block"]), block)
        paths_above = stored(walked.withColumnRenamed("at", "block"), "paths")
    return found[0].join(paths_above, ["tree", "block"])


def manifest(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """One row for each document (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaves = ranked(leaves_of(docs), (F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()), "at", "tree")
    found, subroots = layers(leaves.withColumnRenamed("leaf", "node"), block, ("doc_id", "changed"))
    # The subroots, in the order of their languages, are one more tree.
    by_lang = ranked(subroots, (F.col("tree").asc(),), "at").select(F.lit(TOP).alias("tree"), F.col("tree").alias("lang"), "at", "node")
    top, roots = layers(by_lang, block, ("lang",))
    whole = down(top, roots.select("tree", F.lit(b"").alias("path")), block)
    to_root = _walked(whole, block).select("at", "path")
    langs = whole.select(F.explode("nodes").alias("n")).select("n.lang", "n.at", F.col("n.node").alias("subroot"))
    root = F.lit(r["node"] if (r := roots.first()) else None).cast("binary")
    above = stored(langs.join(to_root, "at").select(F.col("lang").alias("tree"), "path", "subroot", root.alias("root")), "tops")
    rows = down(found, above, block).join(above.drop("path"), "tree")
    return _proved(rows, docs.schema["doc_id"].dataType.simpleString(), block)


def _proved(rows: DataFrame, id_type: str, block: int) -> DataFrame:
    def proved(batches):
        import pyarrow as pa

        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for whole in batches:
            for k in range(whole.num_rows):
                b = whole.slice(k, 1)
                alone, nodes, changed, above, subroot, root = (b.column(c)[0].as_py() for c in range(1, 7))
                ids = b.column(0)[0].values
                upper = _unpacked(above)
                tail = b"".join(x.hex().encode() for _, x in upper)
                proofs, folded = [], []
                for i, path in enumerate(whole_paths(nodes, height_of(len(nodes), alone, block))):
                    proofs.append(hashlib.sha256(b"".join(x.hex().encode() for _, x in path) + tail).hexdigest())
                    folded.append(fold(fold(nodes[i] if changed[i] is None else changed[i], path), upper))
                n, same = len(nodes), [x == root for x in folded]
                texts = [[x.hex() for x in nodes], [subroot.hex()] * n, [root.hex()] * n, proofs, [x.hex() for x in folded]]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.string()) for x in texts], pa.array(same)], names=names)

    kept = rows.select(F.col("nodes.doc_id").alias("ids"), "alone", F.col("nodes.node").alias("leaves"), F.col("nodes.changed").alias("changed"), "path", "subroot", "root")
    return kept.mapInArrow(proved, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}

_PARTS = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in FIELDS]
_SHOWN = " || ".join(_PARTS)
_TAMPERED = _SHOWN.replace(_PARTS[3], "strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)")
ORACLES = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE tab AS ({CRC_TABLE_SQL}), docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_SHOWN}) AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {crc_sql("doc_id::VARCHAR")} % 7 = 0 THEN sha256({_TAMPERED}) END AS changed
  FROM documents, tab
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs
), own AS (
  SELECT tree, 0 AS level, pos, n, leaf AS node FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM own WHERE n > 1 GROUP BY tree, level, pos // 2, n
), subroots AS MATERIALIZED (
  SELECT tree, node AS subroot, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM subroots
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), nodes AS MATERIALIZED (
  SELECT tree, level, pos, node FROM own UNION ALL SELECT NULL, level, pos, node FROM upper
), way AS (
  SELECT row_number() OVER () AS r, l.doc_id, l.tree, l.leaf, l.pos, 0 AS level, s.height, s.pos AS lang_pos, coalesce(l.changed, l.leaf) AS node, '' AS proof,
    s.height + (SELECT max(level) FROM upper) AS top
  FROM leaves l JOIN subroots s USING (tree)
  UNION ALL
  SELECT r, doc_id, w.tree, leaf, w.pos, w.level + 1, height, lang_pos,
    sha256(CASE WHEN o.node IS NULL THEN w.node WHEN p % 2 = 1 THEN o.node || w.node ELSE w.node || o.node END), proof || coalesce(o.node, ''), top
  FROM (SELECT *, CASE WHEN level < height THEN pos // (1 << level) ELSE lang_pos // (1 << (level - height)) END AS p FROM way WHERE level < top) w
  LEFT JOIN nodes o ON o.tree IS NOT DISTINCT FROM CASE WHEN w.level < w.height THEN w.tree END
    AND o.level = CASE WHEN w.level < w.height THEN w.level ELSE w.level - w.height END AND o.pos = xor(p, 1)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM way JOIN subroots USING (tree), (SELECT node AS root FROM upper WHERE n = 1) WHERE level = top
"""
}
