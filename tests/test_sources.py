import json

import pytest
from pyspark.sql import functions as F

from evidloom.plans.api import EvidenceGraph
from evidloom.plans.config import Agent, Agents, ConfigError, load_config
from evidloom.sources import files
from evidloom.sources.sinks import ManagedWriter, manifest, render_targets


def test_texts_and_templates(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo é".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    got = {r["name"]: r for r in files.texts(spark, str(tmp_path)).collect()}
    assert got["a"]["text"] == "one\ntwo é" and got["a"]["size"] == 11 and got["a"]["code"] is None
    assert got["b"]["text"] is None and got["b"]["code"] == "source_not_utf8"
    (tmp_path / "People-form.md").write_text("# Who\n## Where\nx")
    (tmp_path / "README.md").write_text("- People-form.md\n- Gone-form.md\n- Gone-form.md again")
    t = files.templates(spark, str(tmp_path), "-form")
    assert [(r["template_name"], r["headings"]) for r in t.collect()] == [("People", ["Who", "Where"])]
    index = spark.createDataFrame([((tmp_path / "README.md").read_text(),)], "text string")
    assert [r["item"] for r in files.listed_templates(index, r"\S+-form\.md", t).collect()] == ["Gone-form.md"]


def test_json_artifacts_and_lane_outputs(spark, tmp_path):
    for run, text in (("run-001", '{"a": 1}'), ("run-002", '{"a": 2}'), ("run-003", "{oops"), ("run-004", "[" * 40 + "]" * 40)):
        place = tmp_path / "g" / "chunk-0001" / "main"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{run}.json").write_text(text)
    (tmp_path / "g" / "bom.json").write_bytes(b"\xef\xbb\xbf{}")
    (tmp_path / "g" / "bad.json").write_bytes(b"\xff")
    found = files.json_artifacts(spark, str(tmp_path / "g"), depth=20, refuse_bom=True)
    assert {r["path"].rsplit("/", 1)[1]: r["code"] for r in found.collect()} == {"run-001.json": None, "run-002.json": None, "run-003.json": "artifact_invalid_json", "run-004.json": "artifact_too_deep", "bom.json": "artifact_has_bom", "bad.json": "artifact_not_utf8"}
    assert [(r["chunk_id"], r["lane_id"], r["raw"]) for r in files.latest_lane_outputs(found).collect()] == [("chunk-0001", "main", '{"a": 2}')]


def test_folder_digest(spark, tmp_path):
    (tmp_path / "d" / "__pycache__").mkdir(parents=True)
    (tmp_path / "d" / "a").write_text("1")
    (tmp_path / "d" / "__pycache__" / "b").write_text("2")
    one = files.folder_digest(spark, str(tmp_path / "d")).first()
    (tmp_path / "d" / "__pycache__" / "b").write_text("3")
    assert files.folder_digest(spark, str(tmp_path / "d")).first() == one and one["files"] == 1
    (tmp_path / "d" / "a").write_text("2")
    assert files.folder_digest(spark, str(tmp_path / "d")).first()["digest"] != one["digest"]


def test_managed_writer(spark, tmp_path):
    w = ManagedWriter(str(tmp_path), ["tables/*", "docs"])
    df = spark.createDataFrame([("t", "a\nb")], "template_name string, text string")
    w.table(df, "tables/./x")
    w.text(df, "docs")
    assert spark.read.parquet(f"{tmp_path}/tables/x").count() == 1
    assert spark.read.text(f"{tmp_path}/docs", wholetext=True).first()["value"] == "a\nb\n"
    for bad in ("tables/x", "tables/x/y", "other", "../x", "/x", "tables/*", ""):
        with pytest.raises(ValueError):
            w.table(df, bad)


def test_render_targets_and_manifest(spark):
    d = spark.createDataFrame([("a",), ("b",)], "template_name string")
    there = d.where("template_name = 'a'")
    of = lambda p: {r["template_name"]: (r["target"], r["action"], r["will_overwrite"]) for r in render_targets(d, there, p).collect()}
    assert of("draft") == {"a": ("a.draft.md", "draft", False), "b": ("b.md", "create", False)}
    assert of("merge")["a"] == ("a.md", "merge", True) and of("backup-and-overwrite")["a"][1] == "backup_and_overwrite"
    with pytest.raises(ValueError):
        render_targets(d, there, "x")
    kind = "source_id string, sha256 string, created_at string, updated_at string, status string"
    new = manifest(spark.createDataFrame([("s", "1", "t0", "t0", "done")], kind), spark.createDataFrame([("s", "2", "t1", "t1", "new"), ("z", "3", "t1", "t1", "new")], kind))
    assert sorted(map(tuple, new.collect())) == [("s", "2", "t0", "t1", "done"), ("z", "3", "t1", "t1", "new")]


def test_config_and_agents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": {"b": 1, "c": [1]}, "x": 1}')
    (tmp_path / "l.json").write_text('{"a": {"c": [2]}}')
    assert load_config(tmp_path / "d.json", tmp_path / "l.json", {"x": 2}) == {"a": {"b": 1, "c": [2]}, "x": 2}
    for text, code in (("{", "config_invalid_json"), ("[]", "config_not_an_object"), (json.dumps({"a": eval("[" * 70 + "]" * 70)}), "config_too_deep")):
        (tmp_path / "d.json").write_text(text)
        with pytest.raises(ConfigError) as e:
            load_config(tmp_path / "d.json")
        assert e.value.payload["error"] == code
    a = Agents()
    a.register(Agent("one", frozenset({"x"}), 6))
    a.register(Agent("two", frozenset({"x", "y"}), 4))
    assert a.resolve("x").name == "one" and a.resolve("x", ["gone", "two"]).name == "two" and a.resolve("y", forced="one") is None and a.resolve("z") is None
    assert a.rows(spark).count() == 3
    with pytest.raises(ConfigError):
        Agent("bad", frozenset(), True)


def test_graph_is_built_saved_validated_and_queried(spark, tmp_path):
    texts = spark.createDataFrame([(1, "The lighthouse keeper lives on the northern island with two dogs."), (2, None), (3, "Nothing here.")], "source_id bigint, text string")
    templates = spark.createDataFrame([("People", ["lighthouse keeper lives", "missing thing here"], ["two dogs"])], "template_name string, fields array<string>, tables array<string>")
    g = EvidenceGraph.build(texts, templates, {"fields": "field", "tables": "table"}, max_chars=40, overlap_chars=10)
    assert [(r["total"], r["covered"], r["missing_kinds"]) for r in g.readiness.collect()] == [(3, 2, "field")]
    g.save(str(tmp_path / "graph"))
    h = EvidenceGraph.load(spark, str(tmp_path / "graph"))
    assert h.errors().count() == 0
    assert {(r["start"], r["end"]) for r in h.evidence.collect()} == {(4, 27), (56, 64)}
    kind = "query_id string, question string, mode string, depth string, token_budget string, result_limit string"
    out = h.query(spark.createDataFrame([("q", "Where does the keeper live?", None, "1", None, None), ("none", "zzz", None, None, None, None)], kind)).collect()
    rows = {r["query_id"]: r for r in out}
    assert set(rows) == {"q", "none"} and "NODE lighthouse keeper lives [src= loc= type=requirement]" in rows["q"]["text"] and rows["q"]["nodes_found"] == 2
    assert rows["none"]["nodes_found"] == 0 and rows["none"]["text"] == "No node holds a word of the question."
    broken = EvidenceGraph(h.chunks, h.requirements, h.evidence.where("start > 10"), h.nodes, h.events.where(F.lit(False)), h.edges, h.readiness)
    assert broken.errors().count() == 4  # a node, an edge and the far ends of two edges
