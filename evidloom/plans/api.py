"""An evidence graph as named tables: build, validate, query, save and load."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.operators import chunks as C
from evidloom.operators import evidence as E
from evidloom.operators import graph as G
from evidloom.operators import validate as V
from evidloom.sources.sinks import ManagedWriter
from evidloom.sources.tables import cut


@dataclass
class EvidenceGraph:
    chunks: DataFrame
    requirements: DataFrame
    evidence: DataFrame
    nodes: DataFrame
    events: DataFrame
    edges: DataFrame
    readiness: DataFrame

    @classmethod
    def build(cls, texts: DataFrame, templates: DataFrame, kinds: dict[str, str], *, patterns: tuple[str, ...] = (), max_chars: int = 20_000, overlap_chars: int = 1_200) -> EvidenceGraph:
        """Texts (source_id, text) and templates (template_name, a string array for each key of kinds) -> the graph of what the texts show of the templates' requirements."""
        ledger = C.chunks(texts, patterns=patterns, max_chars=max_chars, overlap_chars=overlap_chars)
        items = cut(E.requirement_items(templates, kinds))
        found = cut(E.evidence(E.first_hits(items, ledger)))
        parts = E.supplements(items, found)
        return cls(ledger, items, found, parts["nodes"], parts["events"], parts["edges"], E.readiness(parts["status"], parts["links"]))

    def save(self, base: str) -> None:
        writer = ManagedWriter(base, [f.name for f in fields(self)])
        for f in fields(self):
            writer.table(getattr(self, f.name), f.name)

    @classmethod
    def load(cls, spark: SparkSession, base: str) -> EvidenceGraph:
        return cls(*[spark.read.parquet(f"{base.rstrip('/')}/{f.name}") for f in fields(cls)])

    def errors(self) -> DataFrame:
        """Error rows (scope, item_id, code): repeated ids, dangling evidence and edge ends."""
        known = self.evidence.select(F.col("evidence_id").alias("id"))
        ends = self.nodes.select(F.col("node_id").alias("id")).unionByName(self.events.select(F.col("event_id").alias("id"))).distinct()
        refs = lambda d, c: d.select(F.col(c).alias("item_id"), F.col("evidence_id").alias("ref"))
        edge_ends = self.edges.select(F.col("edge_id").alias("item_id"), F.explode(F.array("source", "target")).alias("ref"))
        found = V.duplicate_ids(known, "evidence")
        for d, c, scope in ((self.nodes, "node_id", "node"), (self.events, "event_id", "event"), (self.edges, "edge_id", "edge")):
            found = found.unionByName(V.dangling(refs(d, c), known, scope, "dangling_evidence"))
        return found.unionByName(V.dangling(edge_ends, ends, "edge", "dangling_end"))

    def query(self, params: DataFrame) -> DataFrame:
        """Raw parameters, see graph.query_params -> query_id, question, mode, depth, nodes_found, edges_found, text, seeds: a row for each question."""
        p = G.query_params(params)
        nodes = self.nodes.select(F.col("node_id").alias("id"), "label", "node_type", F.lit(None).cast("string").alias("source_file")).distinct()
        events = self.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), F.lit("event").alias("node_type"), F.lit(None).cast("string").alias("source_file")).distinct()
        nodes = nodes.unionByName(events)
        edges = self.edges.select("source", "target", F.lit("supports").alias("relation"), F.lit("evidence").alias("context"), F.xxhash64("edge_id").alias("ord")).distinct()
        return G.queried(p, nodes, edges)
