"""Prompt packets for external agents, the hook that calls one, and what comes back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_DEPTH, QUERY_BUDGET, QUERY_LIMIT = 3, 2000, 30


def query_packets(templates: DataFrame) -> DataFrame:
    """Templates (template_name, headings: array) -> template_name, kind, prompt."""
    prompt = F.concat(F.lit("Query for template: "), "template_name", F.lit("\nSections: "), F.array_join("headings", "; "))
    return templates.select("template_name", F.lit("query").alias("kind"), prompt.alias("prompt"))


def draft_packets(templates: DataFrame, results: DataFrame) -> DataFrame:
    """Only templates with a query result (template_name, text)."""
    r = results.select(F.col("template_name").alias("__t"), F.col("text").alias("__x"))
    joined = templates.join(r, F.col("template_name") == F.col("__t"))
    return joined.select("template_name", F.lit("draft").alias("kind"), F.concat(F.lit("Draft for template: "), "template_name", F.lit("\n"), F.coalesce("__x", F.lit(""))).alias("prompt"))


def final_packets(templates: DataFrame, drafts: DataFrame) -> DataFrame:
    """Only templates whose draft (template_name, n_cases, content) has cases."""
    d = drafts.where("n_cases > 0").select(F.col("template_name").alias("__t"), F.col("content").alias("__x"))
    joined = templates.join(d, F.col("template_name") == F.col("__t"))
    return joined.select("template_name", F.lit("final").alias("kind"), F.concat(F.lit("Write template: "), "template_name", F.lit("\n"), F.coalesce("__x", F.lit(""))).alias("prompt"))


def query_hints(records: DataFrame) -> DataFrame:
    """Records (template_name, question, depth, token_budget, result_limit) with what isn't given filled in."""
    return records.select(
        F.col("template_name").alias("query_id"), F.coalesce("question", "template_name").alias("question"), F.lit("bfs").alias("mode"),
        F.coalesce("depth", F.lit(QUERY_DEPTH)).alias("depth"), F.coalesce("token_budget", F.lit(QUERY_BUDGET)).alias("token_budget"), F.coalesce("result_limit", F.lit(QUERY_LIMIT)).alias("result_limit"),
    )


def answered(packets: DataFrame, agent: Callable[[str, str], str] | None = None) -> DataFrame:
    """Packets (template_name, kind, prompt) with the agent's answer to each; without an agent a dry run. The agent is called on the executors, a packet at a time; its failure is an answer, too."""
    if agent is None:
        return packets.select("template_name", "kind", F.lit(None).cast("string").alias("raw"), F.lit("dry_run").alias("status"))

    def ask(frames):
        for f in frames:
            raw, status = [], []
            for kind, prompt in zip(f["kind"], f["prompt"], strict=True):
                try:
                    raw.append(agent(kind, prompt))
                    status.append("answered")
                except Exception as e:  # the row says so
                    raw.append(None)
                    status.append(f"failed: {type(e).__name__}")
            yield f[["template_name", "kind"]].assign(raw=raw, status=status)

    return packets.mapInPandas(ask, "template_name string, kind string, raw string, status string")


def findings(rows: DataFrame) -> DataFrame:
    """Review findings from (reviewer_role, chunk_id, lane_id, severity, probe): open, with an id of their own; those of severity must_fix need a repair."""
    own = F.substring(F.sha2(F.concat_ws("|", "reviewer_role", "chunk_id", "lane_id", "severity", "probe"), 256), 1, 16)
    return rows.select(F.concat(F.lit("finding:"), own).alias("finding_id"), "reviewer_role", "chunk_id", "lane_id", "severity", "probe", F.lit("open").alias("status"), (F.col("severity") == "must_fix").alias("repair_required"))
