"""Merging many outputs into one canonical table: gates, first-wins items, provenance, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.operators.evidence import ordered_distinct


def merge_items(items: DataFrame, *, key: str, order: list[str], body: list[str], provenance: str) -> dict[str, DataFrame]:
    """Rows (key, order..., body..., provenance) of many bundles -> 'kept': one row for each key, its first by the order, with the
    provenance of all rows whose body equals its own, in order; 'conflicts': a row for each other row whose body differs.

    The first row is aggregated and joined back, so a key with very many rows is split like any skewed join.
    """
    digest = F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256)
    own = items.select("*", digest.alias("__digest"))
    first = own.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*order, provenance, "__digest", *body)).alias("f"))
    joined = own.join(first, F.col(key) == F.col("__key"))
    same = joined.where(F.col("__digest") == F.col("f.__digest")).select(key, F.col(provenance).alias("__p"), F.struct(*order).alias("__at"))
    lists = ordered_distinct(same, [key], "__p", "__at", "provenance").withColumnRenamed(key, "__k2")
    kept = first.select(F.col("__key").alias(key), "f.*").drop("__digest", *[c for c in order if c not in body]).drop(provenance)
    kept = kept.join(lists, F.col(key) == F.col("__k2")).drop("__k2")
    unequal = joined.where(F.col("__digest") != F.col("f.__digest"))
    conflicts = unequal.select(key, *order, F.col(f"f.{provenance}").alias("kept_from"), F.col(provenance).alias("conflicting"), F.lit("different_content").alias("reason"))
    return {"kept": kept, "conflicts": conflicts}


def merge_gate(bundles: DataFrame, *, statuses: list[str], require_review: bool = True) -> DataFrame:
    """Bundles (bundle_id, ready, reviewer_status, gate_status, open_must_fix) -> bundle_id, ok, reason: the first that stands against it."""
    reason = (
        F.when(~F.coalesce("ready", F.lit(False)), "not_ready_for_merge")
        .when(F.coalesce("open_must_fix", F.lit(0)) > 0, "open_must_fix_finding")
        .when(F.lit(require_review) & F.col("reviewer_status").isNull() & F.col("gate_status").isNull(), "review_missing")
        .when(F.lit(require_review) & ~F.coalesce("gate_status", "reviewer_status").isin(statuses), "review_not_passed")
    )
    return bundles.select("bundle_id", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


#: Review states by precedence: the first that any bundle is in holds for the graph. Fixed values.
REVIEW_ORDER = ("needs_incremental", "review_failed", "unreviewed", "reviewed")


def graph_review_status(states: DataFrame) -> DataFrame:
    """States (graph_id, state) -> graph_id, review_status."""
    rank = F.coalesce(*[F.when(F.col("state") == s, F.lit(i)) for i, s in enumerate(REVIEW_ORDER)], F.lit(len(REVIEW_ORDER) - 1))
    best = states.groupBy("graph_id").agg(F.min(rank).alias("r"))
    return best.select("graph_id", F.get(F.array(*[F.lit(s) for s in REVIEW_ORDER]), F.col("r")).alias("review_status"))


def latest(rows: DataFrame, group: list[str], by: Column) -> DataFrame:
    """The row of each group with the greatest `by` (compared as its type says), by aggregation."""
    rest = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(by, *rest)).alias("l")).select(*group, "l.*")


def supplement(base: DataFrame, extra: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Upsert by key: a field of the supplement wins where it isn't null."""
    right = extra.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in fields])
    joined = base.select(key, *fields).join(right, F.col(key) == F.col("__k"), "full")
    return joined.select(F.coalesce(key, "__k").alias(key), *[F.coalesce(f"__{c}", c).alias(c) for c in fields])


def overlay(current: DataFrame, refreshed: DataFrame, existing: DataFrame, key: str, value: str) -> DataFrame:
    """Current keys (key, ord) with the refreshed value, else the existing one: key, ord, value, origin (missing where neither has it)."""
    r = refreshed.select(F.col(key).alias("__r"), F.col(value).alias("__rv"))
    e = existing.select(F.col(key).alias("__e"), F.col(value).alias("__ev"))
    joined = current.join(r, F.col(key) == F.col("__r"), "left").join(e, F.col(key) == F.col("__e"), "left")
    origin = F.when(F.col("__r").isNotNull(), "refreshed").when(F.col("__e").isNotNull(), "existing").otherwise("missing")
    return joined.select(key, "ord", F.when(F.col("__r").isNotNull(), F.col("__rv")).otherwise(F.col("__ev")).alias(value), origin.alias("origin"))
