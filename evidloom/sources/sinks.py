"""Managed sinks: tables and texts written once each, to registered places; what a rendered document replaces."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ManagedWriter:
    """Writes DataFrames below a base folder. A path must fit a registered pattern, segment by segment, and is written once."""

    def __init__(self, base: str, managed: list[str]):
        self.base, self.managed, self.written = base.rstrip("/"), [self.checked(m, True) for m in managed], set()

    @staticmethod
    def checked(path: str, wildcards: bool = False) -> str:
        flat = path.replace("\\", "/")
        parts = [p for p in flat.split("/") if p not in ("", ".")]
        bad = not parts or flat.startswith("/") or ".." in parts or ":" in path or "\0" in path or (not wildcards and re.search(r"[*?\[\]]", path))
        if bad:
            raise ValueError(f"not a managed path: {path!r}")
        return "/".join(parts)

    def place(self, path: str) -> str:
        own = self.checked(path)
        parts = own.split("/")
        if not any(len(p := m.split("/")) == len(parts) and all(map(fnmatch.fnmatchcase, parts, p)) for m in self.managed):
            raise ValueError(f"path isn't registered: {own}")
        if own in self.written:
            raise ValueError(f"path was written before: {own}")
        self.written.add(own)
        return f"{self.base}/{own}"

    def table(self, df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(self.place(path))

    def json(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").json(self.place(path))

    def text(self, df: DataFrame, path: str) -> None:
        """Documents (template_name, text), a folder for each."""
        df.select("template_name", "text").write.mode("overwrite").partitionBy("template_name").text(self.place(path), lineSep="\n")


def render_targets(documents: DataFrame, existing: DataFrame, policy: str) -> DataFrame:
    """Documents (template_name) and existing targets (template_name) under a policy (draft, backup-and-overwrite, merge) -> template_name, target, action, will_overwrite."""
    if policy not in ("draft", "backup-and-overwrite", "merge"):
        raise ValueError(f"unknown overwrite policy: {policy}")
    there = existing.select(F.col("template_name").alias("__t")).distinct()
    joined = documents.select("template_name").join(there, F.col("template_name") == F.col("__t"), "left")
    exists, draft = F.col("__t").isNotNull(), F.lit(policy == "draft")
    action = F.when(~exists, "create").when(draft, "draft").otherwise("backup_and_overwrite" if policy == "backup-and-overwrite" else "merge")
    target = F.concat("template_name", F.when(draft & exists, ".draft.md").otherwise(".md"))
    return joined.select("template_name", target.alias("target"), action.alias("action"), (exists & ~draft).alias("will_overwrite"))


def manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Manifest rows (source_id, sha256, created_at, updated_at, status): created_at and status of a known source stay."""
    o = old.select(F.col("source_id").alias("__s"), F.col("created_at").alias("__c"), F.col("status").alias("__st"))
    joined = new.join(o, F.col("source_id") == F.col("__s"), "left")
    return joined.select("source_id", "sha256", F.coalesce("__c", "created_at").alias("created_at"), "updated_at", F.coalesce("__st", "status").alias("status"))
