"""The versioned store and the Stage 1 flows: killed runs, conflicts, scoped replacement, claims of several at once."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidloom.operators import chunks as K
from evidloom.operators import input_cache as I
from evidloom.operators import stage1 as S
from evidloom.sources import versions
from evidloom.sources.versions import Conflict, Store

LANES = [(1, "lane-1", "reader", True), (2, "lane-2", "writer", False)]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=8)


def texts(spark, rows):
    return spark.createDataFrame(rows, "source_id bigint, text string")


def templates(spark, names):
    return spark.createDataFrame([(n, n * 2) for n in names], "template_name string, sha256 string")


def lanes(spark):
    return spark.createDataFrame(LANES, "lane_no int, lane_id string, agent_role string, required boolean")


def rows(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


TEXTS = [(i, f"Chapter one\n{'word ' * (20 * i)}\nChapter two\nend {i}") for i in range(30)]


def prepare(store, spark, rows_, names=("a", "b")):
    return S.prepare(store, texts(spark, rows_), templates(spark, names), lanes(spark), patterns=("Chapter .*",), max_chars=100, overlap_chars=10)


def test_second_preparation_equals_a_full_rebuild_and_writes_changed_buckets_alone(spark, store, tmp_path):
    first = prepare(store, spark, TEXTS)
    assert first == {"status": "prepared", "version": 1, "source_flow": "refreshed", "templates": "refreshed", "changed_sources": None}
    same = prepare(store, spark, TEXTS)
    assert (same["source_flow"], same["templates"], same["changed_sources"], same["version"]) == ("reused", "reused", 0, 2)
    assert store.manifest(1)["tables"]["chunks"] == store.manifest(2)["tables"]["chunks"]
    later = [(i, t + " more" if i == 4 else t) for i, t in TEXTS if i != 9] + [(77, "new")]
    third = prepare(store, spark, later)
    assert (third["source_flow"], third["templates"], third["changed_sources"]) == ("refreshed", "reused", 3)
    whole = Store(spark, f"file://{tmp_path}/whole", buckets=3)
    prepare(whole, spark, later)
    for name in ("chunks", "packets", "runs", "cache", "templates"):
        assert rows(store.read(name)) == rows(whole.read(name)), name
    parts = [{b: f for b, f in store.manifest(v)["tables"]["chunks"]["parts"]} for v in (2, 3)]
    changed = {b for b in range(8) if parts[0].get(b) != parts[1].get(b)}
    hit = {r["b"] for r in spark.createDataFrame([(4,), (9,), (77,)], "k bigint").select(F.pmod(F.xxhash64("k"), F.lit(8)).alias("b")).collect()}
    assert changed == hit
    assert rows(store.read("chunks", 1)) != rows(store.read("chunks"))


def test_a_run_killed_before_its_manifest_leaves_the_state_before_it(spark, store, monkeypatch):
    prepare(store, spark, TEXTS)
    before = rows(store.read("chunks"))
    with monkeypatch.context() as m:
        m.setattr(versions.Store, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt("killed")))
        with pytest.raises(KeyboardInterrupt):
            prepare(store, spark, TEXTS[:3])
    assert store.version() == 1 and rows(store.read("chunks")) == before
    assert store.vacuum() == 1 and rows(store.read("chunks")) == before
    assert prepare(store, spark, TEXTS[:3])["changed_sources"] == 27
    assert store.read("chunks").select("source_id").distinct().count() == 3


def test_the_second_of_two_runs_from_one_version_conflicts(spark, store):
    one, two = store.begin(), store.begin()
    one.put("t", spark.range(3))
    two.put("t", spark.range(5))
    assert one.commit() == 1
    with pytest.raises(Conflict):
        two.commit()
    assert store.read("t").count() == 3 and store.read("other") is None


def test_replace_with_null_keys_and_no_rows(spark, store):
    change = store.begin()
    change.put("t", spark.createDataFrame([(None, 1), ("a", 2), ("b", 3), ("b", 4)], "k string, v int"), "k")
    change.commit()
    change = store.begin()
    change.replace("t", spark.createDataFrame([(None,), ("b",), ("zz",)], "k string"), spark.createDataFrame([(9, "b"), (8, "c")], "v int, k string"))
    change.commit()
    assert rows(store.read("t")) == Counter([("a", 2), ("b", 9), ("c", 8)])
    change = store.begin()
    change.replace("t", store.read("t").select("k"))
    change.commit()
    assert store.read("t").collect() == []


def test_evidence_of_changed_templates_and_lost_chunks_is_deleted(spark, store):
    prepare(store, spark, TEXTS)
    change = store.begin()
    evidence = [("3:chunk-0001", "a"), ("3:chunk-0001", "b"), ("4:chunk-0001", "b"), ("9:chunk-0001", "b"), ("5:chunk-0001", "b")]
    change.put("evidence", spark.createDataFrame(evidence, "chunk_key string, template_name string"), "chunk_key")
    change.commit()
    assert prepare(store, spark, [r for r in TEXTS if r[0] != 9], ("a2", "b"))["templates"] == "refreshed"
    assert sorted(map(tuple, store.read("evidence").collect())) == [("4:chunk-0001", "b"), ("5:chunk-0001", "b")]


def test_changes_by_brute_force(spark):
    tree = lambda r, names: I.tree(K.chunks(texts(spark, r), patterns=("Chapter .*",), max_chars=100, overlap_chars=10), templates(spark, names))
    leaves = lambda r: {(str(x["source_id"]), x["chunk_id"]): x["sha256"] for x in K.chunks(texts(spark, r), patterns=("Chapter .*",), max_chars=100, overlap_chars=10).collect()}
    later = [(i, t[::-1] if i == 2 else t) for i, t in TEXTS if i not in (5, 6)] + [(40, "x")]
    a, b = leaves(TEXTS), leaves(later)
    want = {("chunk", *k, "added" if k not in a else "deleted" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)} | {("template", None, "a", "deleted"), ("template", None, "c", "added")}
    assert set(map(tuple, I.changes(tree(TEXTS, ["a", "b"]), tree(later, ["b", "c"])).collect())) == want
    assert I.changes(tree(TEXTS, ["a"]), tree(list(reversed(TEXTS)), ["a"])).collect() == []
    assert I.changes(tree([], []), tree([], [])).collect() == []
    # A chunk that has moved to another source is deleted there and added here.
    moved = {(r["source_id"], r["change"]) for r in I.changes(tree([(1, "x")], []), tree([(2, "x")], [])).collect()}
    assert moved == {("1", "deleted"), ("2", "added")}


def test_good_bundles_are_published_though_others_fail(spark, store):
    fine = '{"chunk_id":"c","source_range":[0,9],"lane_outputs":[{"chunk_id":"c","lane_id":"l","output_status":"completed"}],"review_findings":[]}'
    bundles = spark.createDataFrame([(1, fine), (2, "3"), (3, fine), (4, fine.replace("completed", "pending"))], "bundle_id bigint, raw string")
    assert S.ingest(store, bundles, ["l"]) == {"status": "failed", "version": 1, "good": 2, "bad": 2}
    assert sorted(r["bundle_id"] for r in store.read("bundles").collect()) == [1, 3]
    assert {r["bundle_id"]: r["codes"] for r in store.read("bundle_errors").collect()} == {2: ["bundle_not_object"], 4: ["required_lane_not_completed:l"]}
    assert S.ingest(store, bundles.where("bundle_id % 2 = 1"), ["l"])["status"] == "success"
    assert store.read("bundle_errors").collect() == [] and store.read("bundles", 1).count() == 2
    assert S.ingest(store, bundles.limit(0), ["l"]) == {"status": "success", "version": 3, "good": 0, "bad": 0}


def test_a_refused_merge_changes_no_items(spark, store):
    fine = '{"chunk_id":"c","source_range":[0,9],"lane_outputs":[{"chunk_id":"c","lane_id":"l","output_status":"completed"}],"review_findings":[]}'
    S.ingest(store, spark.createDataFrame([(1, fine)], "bundle_id bigint, raw string"), ["l"])
    items = spark.createDataFrame([(1, "n", 1, "x", "p"), (1, "n", 2, "y", "q"), (2, "m", 3, "z", "r")], "bundle_id bigint, item_id string, at int, label string, lane_output_path string")
    queue = lambda status: spark.createDataFrame([("q", status, ["b"], ["l"])], "queue_id string, status string, bundle_paths array<string>, lanes array<string>")
    assert S.merge(store, queue("waiting"), items, ["l"], order=["at"], body=["label"])["status"] == "failed"
    assert store.read("items") is None and store.read("queue_errors").count() == 1
    assert S.merge(store, queue("ready"), items, ["l"], order=["at"], body=["label"])["status"] == "success"
    assert [(r["item_id"], r["label"], r["provenance"]) for r in store.read("items").collect()] == [("n", "x", ["p"])] and store.read("conflicts").count() == 1


def test_claimers_at_once_never_share_a_batch(spark, store):
    plan = spark.createDataFrame([(f"batch-{i:02d}", i) for i in range(23)], "batch_id string, ord int")
    got: dict = {}

    def work(name):
        own = Store(spark, store.base)
        got[name] = []
        while found := S.claim(own, plan, name, 4, retries=60):
            got[name] += found

    threads = [threading.Thread(target=work, args=(f"agent-{k}",)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    held = [b for batches in got.values() for b in batches]
    assert sorted(held) == [f"batch-{i:02d}" for i in range(23)]
    log = store.read("claims")
    assert {(r["batch_id"], r["claimer"]) for r in S.winners(log.unionByName(log)).collect()} == {(b, n) for n, batches in got.items() for b in batches}


def test_replayed_claims_have_one_winner(spark):
    log = spark.createDataFrame([("a", "y", 2), ("a", "x", 2), ("a", "z", 5), ("b", "z", None), ("b", "y", 9)], "batch_id string, claimer string, seq bigint")
    assert {tuple(r) for r in S.winners(log.where("seq IS NOT NULL")).collect()} == {("a", "x", 2, 3), ("b", "y", 9, 1)}


def test_verbs_prepare_claim_ingest_and_inspect(spark, tmp_path, capsys):
    import json

    from evidloom.__main__ import main

    (tmp_path / "texts").mkdir()
    (tmp_path / "templates").mkdir()
    (tmp_path / "bundles").mkdir()
    (tmp_path / "texts/one.txt").write_text("Chapter one\nwords\nChapter two\nmore words")
    (tmp_path / "templates/a.md").write_text("# A")
    (tmp_path / "bundles/b1.json").write_text('{"chunk_id":"c","source_range":[0,9],"lane_outputs":[{"chunk_id":"c","lane_id":"l","output_status":"completed"}],"review_findings":[]}')
    (tmp_path / "bundles/b2.json").write_text("[]")
    store = f"file://{tmp_path}/store"

    def said(*argv):
        code = main([*argv, "--store", store])
        return code, json.loads(capsys.readouterr().out)

    assert said("inspect-store")[0] == 2 and said("claim-batches", "--claimer", "x", "--limit", "1")[1] == {"ok": False, "error": "not_prepared"}
    code, out = said("prepare-stage1", "--source", f"{tmp_path}/texts/*.txt", "--template-dir", f"{tmp_path}/templates", "--heading", "Chapter .*", "--lane", "l:reader", "--lane", "m:writer:optional")
    assert code == 0 and out["version"] == 1 and out["status"] == "prepared"
    first, second = (said("claim-batches", "--claimer", n, "--limit", "1")[1]["claimed"] for n in ("x", "y"))
    assert len(first) == len(second) == 1 and first != second and said("claim-batches", "--claimer", "z", "--limit", "9")[1]["claimed"] == []
    code, out = said("ingest-stage1", "--bundles", f"{tmp_path}/bundles", "--lane", "l")
    assert code == 2 and (out["status"], out["good"], out["bad"]) == ("failed", 1, 1)
    code, out = said("inspect-store")
    assert code == 0 and out["tables"] == {"bundle_errors": 1, "bundles": 1, "cache": 5, "chunks": 2, "claims": 2, "packets": 2, "runs": 2, "templates": 1}
