"""The input cache: digests of chunks, of sources over their chunks, and of the run over all, and what has changed between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(digest: Column, which: Column | None = None) -> Column:
    """A digest of a set of digests, of those rows that hold, that doesn't depend on their order: two sums, made where the rows lie. A set of any size is never gathered."""
    own = digest if which is None else F.when(which, digest)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(own, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return F.sha2(F.concat_ws(":", F.count(own).cast("string"), part(1), part(16)), 256)


def tree(chunks: DataFrame, templates: DataFrame, config: str = "") -> DataFrame:
    """Chunks (source_id, chunk_id, start, end, sha256) and templates (template_name, sha256) -> level, source_id, name, digest: leaves, their sources, the inventory of templates, the run over both and a configuration."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    leaf = F.sha2(F.concat_ws("|", text("source_id"), text("chunk_id"), text("start"), text("end"), text("sha256")), 256)
    row = lambda df, level, source, name, digest: df.select(F.lit(level).alias("level"), source.cast("string").alias("source_id"), name.cast("string").alias("name"), digest.alias("digest"))
    none = F.lit(None).cast("string")
    leaves = row(chunks, "chunk", F.col("source_id"), F.col("chunk_id"), leaf)
    sources = leaves.groupBy("source_id").agg(_sum(F.col("digest")).alias("digest"))
    sources = row(sources, "source", F.col("source_id"), none, F.sha2(F.concat_ws("|", F.coalesce("source_id", F.lit("-")), "digest"), 256))
    kinds = row(templates, "template", none, F.col("template_name"), F.sha2(F.concat_ws("|", text("template_name"), text("sha256")), 256))
    both = sources.unionByName(kinds).agg(_sum(F.col("digest"), F.col("level") == "source").alias("s"), _sum(F.col("digest"), F.col("level") == "template").alias("t"))
    return leaves.unionByName(sources).unionByName(kinds).unionByName(row(both, "run", none, F.lit("run"), F.sha2(F.concat_ws("|", "s", "t", F.lit(config)), 256)))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Two trees -> level, source_id, name, change (added, changed, deleted) of the leaves and templates that differ.

    The runs are compared first: if they are equal nothing else is read. Then sources, and of the sources that differ alone their chunks.
    """
    top = [d.where("level = 'run'").select("digest").collect() for d in (before, now)]
    keys = ("level", "source_id", "name")
    if top[0] and top[0] == top[1]:
        return now.select(*keys, F.lit("").alias("change")).limit(0)

    def compared(a: DataFrame, b: DataFrame) -> DataFrame:
        old = a.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("digest").alias("__digest"))
        both = b.join(old, F.col("level").eqNullSafe(F.col("__level")) & F.col("source_id").eqNullSafe(F.col("__source_id")) & F.col("name").eqNullSafe(F.col("__name")), "full")
        change = F.when(F.col("__level").isNull(), "added").when(F.col("level").isNull(), "deleted").when(F.col("digest") != F.col("__digest"), "changed")
        return both.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], change.alias("change")).where("change IS NOT NULL")

    at = lambda d, level: d.where(F.col("level") == level)
    unequal = compared(at(before, "source"), at(now, "source")).select(F.col("source_id").alias("__s"))
    of = lambda d: at(d, "chunk").join(unequal, F.col("source_id").eqNullSafe(F.col("__s")), "left_semi")
    return compared(of(before), of(now)).unionByName(compared(at(before, "template"), at(now, "template")))
