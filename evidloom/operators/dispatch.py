"""Work packets, batches and their state; incremental rebuild decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def task_packets(chunks: DataFrame, lanes: DataFrame, attempt: int = 1) -> DataFrame:
    """Chunks (source_id, chunk_no, chunk_id) times required lanes (lane_no, lane_id, agent_role, required): a packet each. Lanes are a list in the configuration, so they go to the chunks."""
    wanted = F.broadcast(lanes.where("required").select("lane_no", "lane_id", "agent_role"))
    packet = F.format_string(f"%s:%s:%s:attempt-{attempt:03d}", F.col("source_id").cast("string"), "chunk_id", "lane_id")
    return chunks.select("source_id", "chunk_no", "chunk_id").crossJoin(wanted).withColumn("packet_id", packet)


def batches(packets: DataFrame, per_agent: int, group: list[str], order: list[str]) -> DataFrame:
    """packets with batch_no: `per_agent` neighbours of a group to a batch."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return packets.withColumn("batch_no", (F.floor(place / per_agent) + 1).cast("long"))


def transitions(state: DataFrame, outputs: DataFrame) -> DataFrame:
    """State (batch_id, status, claimed_at, completed_at) and outputs (batch_id, complete) -> the state now: running with its outputs becomes completed, completed without them pending again."""
    o = outputs.select(F.col("batch_id").alias("__b"), "complete")
    joined = state.join(o, F.col("batch_id") == F.col("__b"), "left")
    done = F.coalesce("complete", F.lit(False))
    now = F.when((F.col("status") == "running") & done, "completed").when((F.col("status") == "completed") & ~done, "pending").otherwise(F.col("status"))
    return joined.select("batch_id", "status", now.alias("now"), F.when(now != "pending", F.col("claimed_at")).alias("claimed_at"))


def claims(pending: DataFrame, running: DataFrame, capacity: DataFrame, limit: int | None) -> DataFrame:
    """Pending (batch_id, agent, ord), running (agent, n) and capacity (agent, cap) -> the batches to claim, in plan order: free places of an agent first, then the limit (negative or None: all)."""
    free = capacity.join(running.withColumnRenamed("agent", "__a"), F.col("agent") == F.col("__a"), "left").select(F.col("agent").alias("__agent"), (F.col("cap") - F.coalesce("n", F.lit(0))).alias("free"))
    placed = pending.withColumn("place", F.row_number().over(Window.partitionBy("agent").orderBy("ord")))
    fitting = placed.join(F.broadcast(free), F.col("agent") == F.col("__agent")).where(F.col("place") <= F.col("free")).select("batch_id", "agent", "ord")
    return fitting if limit is None or limit < 0 else fitting.orderBy("ord").limit(limit)


def serial_next(batch_rows: DataFrame, group: str) -> DataFrame:
    """Batches (group, ord, status): of each group the first that isn't completed, and none where one is running."""
    busy = F.max(F.when(F.col("status") == "running", 1).otherwise(0))
    first = F.min(F.when(F.col("status") != "completed", F.col("ord")))
    return batch_rows.groupBy(group).agg(busy.alias("busy"), first.alias("ord")).where("busy = 0 AND ord IS NOT NULL").select(group, "ord")


def status_counts(state: DataFrame, group: str, statuses: list[str]) -> DataFrame:
    return state.groupBy(group).agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def resolved_agents(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """Requests (request_id, preferred: agents by preference, lane_id) and agents (agent, lane_id, available, registered) -> request_id, agent: the first preferred that is there, else the first registered."""
    a = agents.where("available").select("agent", F.col("lane_id").alias("__l"), "registered")
    fit = requests.join(F.broadcast(a), F.col("lane_id") == F.col("__l"), "left")
    at = F.array_position("preferred", F.col("agent"))
    best = fit.groupBy("request_id").agg(F.min(F.when(F.col("agent").isNotNull(), F.struct(F.when(at > 0, at).otherwise(F.lit(10**9)).alias("p"), "registered", "agent"))).alias("b"))
    return best.select("request_id", F.col("b.agent").alias("agent"))


def cache_decision(previous: DataFrame, current: DataFrame, required: DataFrame) -> DataFrame:
    """Templates before and now (key, md5, sha256) and keys with requirements (key) -> key, decision: deleted, changed, missing_requirement or reused."""
    p = previous.select(F.col("key").alias("pk"), F.col("md5").alias("pm"), F.col("sha256").alias("ps"))
    r = required.select(F.col("key").alias("rk")).distinct()
    both = current.join(p, F.col("key") == F.col("pk"), "full").select(F.coalesce("key", "pk").alias("k"), "key", "pk", (F.col("md5").eqNullSafe(F.col("pm")) & F.col("sha256").eqNullSafe(F.col("ps"))).alias("same"))
    joined = both.join(r, F.col("k") == F.col("rk"), "left")
    decision = F.when(F.col("key").isNull(), "deleted").when(F.col("pk").isNull() | ~F.col("same"), "changed").when(F.col("rk").isNull(), "missing_requirement").otherwise("reused")
    return joined.select(F.col("k").alias("key"), decision.alias("decision"))


def affected_chunks(changed: DataFrame, supports: DataFrame) -> DataFrame:
    """Chunks (chunk_id) whose evidence (chunk_id, template_name) supports a changed template (template_name): a semi-join."""
    return supports.join(changed.select(F.col("template_name").alias("__t")), F.col("template_name") == F.col("__t"), "left_semi").select("chunk_id").distinct()


def stamped_packets(packets: DataFrame, selected: DataFrame) -> DataFrame:
    """Packets (packet_id, ...) with the agent selected for each (request_id, agent); null where none is there."""
    s = selected.select(F.col("request_id").alias("__r"), F.col("agent").alias("selected_agent"))
    return packets.join(s, F.col("packet_id") == F.col("__r"), "left").drop("__r")


def templates_to_refresh(templates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Templates (key, ...) whose decision (key, decision) is changed or missing_requirement: a semi-join."""
    d = decisions.where(F.col("decision").isin("changed", "missing_requirement")).select(F.col("key").alias("__k"))
    return templates.join(d, F.col("key") == F.col("__k"), "left_semi")


def dispatch_plan(phases: list[tuple[str, DataFrame]], review: bool = True) -> DataFrame:
    """Phases in order, each with its batches (batch_id, n_packets) -> phase_no, phase, batch_id, n_packets; a review phase only where review is required."""
    kept = [(n, d) for n, d in phases if review or n != "review"]
    parts = [d.select(F.lit(i + 1).cast("long").alias("phase_no"), F.lit(n).alias("phase"), F.col("batch_id").cast("string").alias("batch_id"), F.col("n_packets").cast("long").alias("n_packets")) for i, (n, d) in enumerate(kept)]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out
