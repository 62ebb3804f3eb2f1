"""python -m evidloom VERB ...: the graph's verbs; each prints one JSON object and ends with 0 if all is well, else with 2."""

from __future__ import annotations

import argparse
import json
import sys


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ValueError(message)


def parser() -> Parser:
    p = Parser(prog="evidloom")
    verbs = p.add_subparsers(dest="verb", required=True, parser_class=Parser)
    v = verbs.add_parser("config-check")
    v.add_argument("--config", required=True)
    v.add_argument("--local-override")
    v = verbs.add_parser("inspect-templates")
    v.add_argument("--template-dir", required=True)
    v.add_argument("--suffix", default="")
    v = verbs.add_parser("build-graph")
    v.add_argument("--source", required=True)
    v.add_argument("--template-dir", required=True)
    v.add_argument("--suffix", default="")
    v.add_argument("--heading", action="append", default=[])
    v.add_argument("--max-chars", type=int, default=20_000)
    v.add_argument("--overlap-chars", type=int, default=1_200)
    v.add_argument("--graph-dir", required=True)
    v = verbs.add_parser("validate-graph")
    v.add_argument("--graph-dir", required=True)
    v.add_argument("--artifacts", action="store_true", help="the folder holds JSON artifacts, not the tables of build-graph")
    v = verbs.add_parser("prepare-stage1")
    v.add_argument("--source", required=True)
    v.add_argument("--template-dir", required=True)
    v.add_argument("--suffix", default="")
    v.add_argument("--heading", action="append", default=[])
    v.add_argument("--max-chars", type=int, default=20_000)
    v.add_argument("--overlap-chars", type=int, default=1_200)
    v.add_argument("--lane", action="append", required=True, help="lane:role, or lane:role:optional")
    v.add_argument("--store", required=True)
    v = verbs.add_parser("ingest-stage1")
    v.add_argument("--bundles", required=True, help="a folder of bundles, a JSON file each")
    v.add_argument("--lane", action="append", required=True)
    v.add_argument("--store", required=True)
    v = verbs.add_parser("claim-batches")
    v.add_argument("--claimer", required=True)
    v.add_argument("--limit", type=int, required=True)
    v.add_argument("--store", required=True)
    v = verbs.add_parser("inspect-store")
    v.add_argument("--store", required=True)
    v = verbs.add_parser("query-graph")
    v.add_argument("--graph-dir", required=True)
    v.add_argument("--question", required=True)
    v.add_argument("--mode", default="bfs")
    v.add_argument("--depth", default="3")
    v.add_argument("--token-budget", default="2000")
    return p


def run(a: argparse.Namespace) -> dict:
    from evidloom.plans.config import load_config

    if a.verb == "config-check":
        return {"ok": True, "config": load_config(a.config, a.local_override)}
    from pyspark.sql import SparkSession

    from evidloom.plans.api import EvidenceGraph
    from evidloom.sources import files

    spark = SparkSession.builder.appName("evidloom").getOrCreate()
    if a.verb == "inspect-templates":
        found = files.templates(spark, a.template_dir, a.suffix).orderBy("template_name").collect()
        return {"ok": all(r["code"] is None for r in found), "templates": [r.asDict() for r in found]}
    if a.verb in ("prepare-stage1", "ingest-stage1", "claim-batches", "inspect-store"):
        return stage1(a, spark)
    if a.verb == "build-graph":
        folder, _, pattern = a.source.rpartition("/")
        texts = files.texts(spark, folder or ".", pattern)
        templates = files.templates(spark, a.template_dir, a.suffix).where("code IS NULL")
        g = EvidenceGraph.build(texts, templates, {"headings": "field"}, patterns=tuple(a.heading), max_chars=a.max_chars, overlap_chars=a.overlap_chars)
        g.save(a.graph_dir)
        bad = texts.where("code IS NOT NULL").count()
        return {"ok": not bad, "unreadable_sources": bad, "chunks": g.chunks.count(), "evidence": g.evidence.count(), "readiness": [r.asDict() for r in g.readiness.orderBy("template_name").collect()]}
    if a.verb == "validate-graph" and a.artifacts:
        from evidloom.operators.graph_dir import Directories

        base, _, name = a.graph_dir.rstrip("/").rpartition("/")
        d = Directories(files.catalogue(spark, base or ".", name))
        found = d.errors().cache()
        verdict = d.verdicts(found).first()
        out = {"ok": verdict["ok"], "n_errors": verdict["n_errors"], "errors": sorted(r["code"] for r in found.limit(1000).collect()), "review_status": verdict["review_status"], "warnings": [w for w in [verdict["warnings"]] if w]}
        found.unpersist()
        d.close()
        return out
    g = EvidenceGraph.load(spark, a.graph_dir)
    if a.verb == "validate-graph":
        found = g.errors().cache()
        n = found.count()
        return {"ok": not n, "n_errors": n, "errors": [r.asDict() for r in found.limit(1000).collect()]}
    kind = "query_id string, question string, mode string, depth string, token_budget string, result_limit string"
    rows = g.query(spark.createDataFrame([("q", a.question, a.mode, a.depth, a.token_budget, None)], kind)).collect()
    return {"ok": any(r["nodes_found"] for r in rows), "results": [r.asDict() for r in rows]}


def stage1(a: argparse.Namespace, spark) -> dict:
    """Verbs over a versioned store."""
    from pyspark.sql import functions as F

    from evidloom.operators import stage1 as S
    from evidloom.sources import files
    from evidloom.sources.versions import Store

    store = Store(spark, a.store)
    if a.verb == "inspect-store":
        m = store.manifest()
        return {"ok": bool(m["version"]), "version": m["version"], "notes": m["notes"], "tables": {name: store.read(name).count() for name in sorted(m["tables"])}}
    if a.verb == "claim-batches":
        # A batch is a packet here, in the order of its source and chunk.
        packets = store.read("packets")
        if packets is None:
            return {"ok": False, "error": "not_prepared"}
        plan = packets.select(F.col("packet_id").alias("batch_id"), F.struct("source_id", "chunk_no", "lane_no").alias("ord"))
        return {"ok": True, "claimed": S.claim(store, plan, a.claimer, a.limit)}
    if a.verb == "ingest-stage1":
        found = files.json_artifacts(spark, a.bundles)
        bundles = found.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("bundle_id"), F.coalesce("raw", F.lit("")).alias("raw"))
        out = S.ingest(store, bundles, a.lane)
        return {"ok": out["status"] == "success", **out}
    folder, _, pattern = a.source.rpartition("/")
    texts = files.texts(spark, folder or ".", pattern).where("code IS NULL").select("source_id", "text")
    templates = files.templates(spark, a.template_dir, a.suffix).where("code IS NULL").select("template_name", "sha256")
    parts = [(n, *(lane.split(":") + ["", ""])[:3]) for n, lane in enumerate(a.lane, 1)]
    lanes = spark.createDataFrame([(n, lane, role, kind != "optional") for n, lane, role, kind in parts], "lane_no int, lane_id string, agent_role string, required boolean")
    return {"ok": True, **S.prepare(store, texts, templates, lanes, patterns=tuple(a.heading), max_chars=a.max_chars, overlap_chars=a.overlap_chars)}


def main(argv: list[str] | None = None) -> int:
    try:
        out = run(parser().parse_args(argv))
    except ValueError as e:
        out = getattr(e, "payload", None) or {"ok": False, "error": "bad_arguments", "message": str(e)}
    except Exception as e:
        out = {"ok": False, "error": type(e).__name__, "message": str(e)[:2000]}
    print(json.dumps(out, ensure_ascii=False, default=str))
    return 0 if out["ok"] else 2


if __name__ == "__main__":
    sys.exit(main())
