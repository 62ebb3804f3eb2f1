"""Packets with references, rendered documents, verified reading."""

import hashlib
import json

import pytest

from evidloom.operators import packets as P
from evidloom.sources import rendering as R

LANES = "lane_id string, agent_role string, schema string, required boolean, lane_contract string, required_evidence_policy string, extraction_quality_rules string"


def lanes(spark):
    rules = json.dumps({"content": "rule " * 3000}, separators=(",", ":"))
    return spark.createDataFrame([("a", "r", "s.json", True, '{"lane_id":"a"}', None, rules), ("b", "q", "t.json", True, '{"lane_id":"b"}', '{"least":1}', rules), ("c", "q", "t.json", False, "{}", None, None)], LANES)


def chunks(spark):
    return spark.createDataFrame([(1, "s.txt", "chunk-0001", 0, 9, 'a "hint" é'), (1, "s.txt", "chunk-0002", 9, 20, None)], "source_id bigint, source_path string, chunk_id string, start bigint, end bigint, hint string")


def test_packets_are_small_and_resolve_to_their_contents(spark):
    packets, entries = P.payloads(chunks(spark), lanes(spark), requirements_path="req.json"), P.dictionary(lanes(spark))
    whole = {r["packet_id"]: json.loads(r["raw"]) for r in P.resolved(packets, entries).collect()}
    assert set(whole) == {f"1:chunk-000{i}:{lane}:attempt-001" for i in (1, 2) for lane in "ab"}
    for name, p in whole.items():
        lane, b = name.split(":")[2], name.split(":")[2] == "b"
        assert p["lane_contract"] == {"lane_id": lane} and p["required_evidence_policy"] == ({"least": 1} if b else None) and p["extraction_quality_rules"]["content"] == "rule " * 3000
        assert p["chapter_hint"] == ('a "hint" é' if "0001" in name else None) and p["task_packet_id"] == name and p["source_range"] == ([0, 9] if "0001" in name else [9, 20])
    assert entries.count() == 5 and entries.where("sha256 <> sha2(content, 256)").count() == 0
    for r in P.sizes(packets, P.resolved(packets, entries)).collect():
        assert r["n_bytes"] < 1000 < 15_000 < r["whole_bytes"] == len(json.dumps(whole[r["packet_id"]], ensure_ascii=False, separators=(",", ":")).encode())


def test_a_digest_that_nobody_knows_leaves_no_packet(spark):
    packets = P.payloads(chunks(spark), lanes(spark), requirements_path="req.json")
    got = P.resolved(packets, P.dictionary(lanes(spark)).where("content NOT LIKE '%least%'")).collect()
    assert {r["packet_id"]: r["raw"] is None for r in got} == {f"1:chunk-000{i}:{lane}:attempt-001": lane == "b" for i in (1, 2) for lane in "ab"}
    plain = spark.createDataFrame([("p", "no reference"), ("q", None), ("r", '{"sha256":"short"}')], "packet_id string, raw string")
    assert sorted(map(tuple, P.resolved(plain, P.dictionary(lanes(spark))).collect())) == [("p", "no reference"), ("q", None), ("r", '{"sha256":"short"}')]


def lines(spark, rows):
    return spark.createDataFrame(rows, "template_name string, ord int, text string")


def test_documents_are_written_in_order_and_backed_up(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    first = [("a", 2, "two"), ("a", 1, "one é"), ("b c", 1, None), ("a", 2, "and")]
    got = {r["template_name"]: r.asDict() for r in R.render(lines(spark, first), folder).collect()}
    assert (tmp_path / "out/a.md").read_text() == "one é\nand\ntwo\n" and (tmp_path / "out/b c.md").read_text() == "\n"
    assert got["a"] == {"template_name": "a", "target": "a.md", "action": "create", "n_bytes": 15, "sha256": hashlib.sha256("one é\nand\ntwo\n".encode()).hexdigest()}
    assert {r["action"] for r in R.render(lines(spark, [("a", 1, "new"), ("d", 1, "x")]), folder).collect()} == {"create", "backup_and_overwrite"}
    assert (tmp_path / "out/a.md").read_text() == "new\n" and (tmp_path / "out/a.md.bak").read_text() == "one é\nand\ntwo\n" and not (tmp_path / "out/d.md.bak").exists()
    R.render(lines(spark, [("a", 1, "draft")]), folder, "draft")
    assert (tmp_path / "out/a.md").read_text() == "new\n" and (tmp_path / "out/a.draft.md").read_text() == "draft\n"
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix != ".crc") == ["a.draft.md", "a.md", "a.md.bak", "b c.md", "d.md"]
    assert R.render(lines(spark, []), folder).collect() == []


@pytest.mark.parametrize("name", ["../x", "a/b", ".hidden", "a:b", "", None])
def test_names_that_are_no_path_segment_are_refused(name, spark, tmp_path):
    with pytest.raises(ValueError, match="safe path segment"):
        R.render(lines(spark, [("fine", 1, "x"), (name, 1, "y")]), f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_only_files_of_the_ledger_are_read(spark, tmp_path):
    texts = {"a.md": b"alpha", "b.md": b"beta", "c.md": b"gamma", "d.md": b"\xff\xfe", "e.txt": b"no"}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    digest = lambda n: hashlib.sha256(texts[n]).hexdigest()
    ledger = [("a.md", 5, digest("a.md")), ("a.md", 5, digest("a.md")), ("b.md", 5, digest("b.md")), ("c.md", 5, digest("a.md")), ("d.md", 2, digest("d.md")), ("x.md", 1, digest("a.md")), ("e.txt", 2, digest("e.txt"))]
    got = R.verified_texts(spark, f"file://{tmp_path}", spark.createDataFrame(ledger, "file_name string, size int, sha256 string"))
    assert [tuple(r) for r in got.collect()] == [("a.md", "alpha")]
