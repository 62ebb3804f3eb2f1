"""Task packets with their payloads: what many packets share stands once in a dictionary by its digest, packets name it, a resolver puts it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A reference to content: the JSON object that stands for it in a packet.
REFERENCE = r'\{"sha256":"([0-9a-f]{64})"\}'
SHARED = ("lane_contract", "required_evidence_policy", "extraction_quality_rules")
#: Entries of a dictionary that may be broadcast: rules and lists, some tens of KB each.
MOST_ENTRIES = 2_000


def dictionary(lanes: DataFrame) -> DataFrame:
    """Lanes with JSON texts in SHARED -> sha256, content: each content once."""
    return lanes.select(F.explode(F.array(*SHARED)).alias("content")).where("content IS NOT NULL").distinct().select(F.sha2("content", 256).alias("sha256"), "content")


def payloads(chunks: DataFrame, lanes: DataFrame, *, requirements_path: str, packet_dir: str = "intermediate/task-packets", attempt: int = 1) -> DataFrame:
    """Chunks (source_id, source_path, chunk_id, start, end, hint) and lanes (lane_id, agent_role, schema, required, SHARED as JSON texts; null: left out) -> packet_id, raw: a packet for each chunk and required lane. Lanes are a list in the configuration, so they go to the chunks."""
    wanted = F.broadcast(lanes.where("required").select("lane_id", "agent_role", "schema", *SHARED))
    both = chunks.select("source_id", "source_path", "chunk_id", "start", "end", "hint").crossJoin(wanted)
    packet_id = F.format_string(f"%s:%s:%s:attempt-{attempt:03d}", F.col("source_id").cast("string"), "chunk_id", "lane_id")
    named = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.sha2(c, 256).alias("sha256"))).alias(c)
    body = F.struct(
        packet_id.alias("task_packet_id"), F.lit("stage1").alias("stage"), "chunk_id", "lane_id", "agent_role", "source_path", F.array("start", "end").alias("source_range"), F.col("hint").alias("chapter_hint"),
        F.struct(F.lit(requirements_path).alias("path")).alias("relevant_template_requirements"), named("lane_contract"), F.col("schema").alias("allowed_output_schema"), named("required_evidence_policy"),
        named("extraction_quality_rules"), F.lit(attempt).alias("attempt"), F.concat(F.lit(packet_dir + "/"), "chunk_id", F.lit("/"), "lane_id", F.lit(".json")).alias("task_packet_path"),
    )
    return both.select(packet_id.alias("packet_id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("raw"))


def resolved(packets: DataFrame, entries: DataFrame) -> DataFrame:
    """Packets (packet_id, raw) with every reference replaced by its content; raw is null where a digest isn't in the dictionary (sha256, content).

    All references of all packets meet the dictionary in one join. What is gathered again is the references of one packet.
    """
    side = F.broadcast(entries) if entries.count() <= MOST_ENTRIES else entries
    found = packets.select("packet_id", F.posexplode(F.regexp_extract_all("raw", F.lit(REFERENCE), F.lit(1))).alias("at", "d"))
    joined = found.join(side, F.col("d") == F.col("sha256"), "left")
    parts = joined.groupBy(F.col("packet_id").alias("__p")).agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("parts"))
    both = packets.join(parts, F.col("packet_id") == F.col("__p"), "left")
    between = F.split("raw", REFERENCE, -1)
    whole = F.concat(F.get(between, F.lit(0)), F.array_join(F.transform("parts", lambda x, i: F.concat(x["content"], F.get(between, i + 1))), ""))
    lost = F.exists("parts", lambda x: x["content"].isNull())
    return both.select("packet_id", F.when(F.col("parts").isNull(), F.col("raw")).when(~lost, whole).alias("raw"))


def sizes(packets: DataFrame, whole: DataFrame) -> DataFrame:
    """packet_id, n_bytes, whole_bytes: what a packet takes with references and with their contents."""
    w = whole.select(F.col("packet_id").alias("__p"), F.octet_length("raw").cast("long").alias("whole_bytes"))
    return packets.select("packet_id", F.octet_length("raw").cast("long").alias("n_bytes")).join(w, F.col("packet_id") == F.col("__p")).drop("__p")
