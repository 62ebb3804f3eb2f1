import json

from evidloom.__main__ import main
from evidloom.operators import agents as A


def test_packets_and_answers(spark):
    t = spark.createDataFrame([("a", ["H"]), ("b", [])], "template_name string, headings array<string>")
    assert {r["template_name"]: r["prompt"] for r in A.query_packets(t).collect()}["a"].endswith("Sections: H")
    assert [r["template_name"] for r in A.draft_packets(t, spark.createDataFrame([("a", None)], "template_name string, text string")).collect()] == ["a"]
    assert [r["template_name"] for r in A.final_packets(t, spark.createDataFrame([("a", 0, "x"), ("b", 2, "y")], "template_name string, n_cases int, content string")).collect()] == ["b"]
    assert {r["status"] for r in A.answered(A.query_packets(t)).collect()} == {"dry_run"}

    def agent(kind, prompt):
        if "template: b" in prompt:
            raise KeyError("no")
        return json.dumps({"title": kind})

    assert {(r["template_name"], r["raw"], r["status"]) for r in A.answered(A.query_packets(t), agent).collect()} == {("a", '{"title": "query"}', "answered"), ("b", None, "failed: KeyError")}
    r = A.query_hints(spark.createDataFrame([("t", None, None, 9, None)], "template_name string, question string, depth int, token_budget int, result_limit int")).first()
    assert (r["question"], r["depth"], r["token_budget"], r["result_limit"]) == ("t", 3, 9, 30)
    f = A.findings(spark.createDataFrame([("r", "c", "l", "must_fix", "{}")], "reviewer_role string, chunk_id string, lane_id string, severity string, probe string")).first()
    assert f["finding_id"].startswith("finding:") and f["repair_required"] and f["status"] == "open"


def test_verbs(spark, tmp_path, capsys):
    def call(*argv):
        code = main(list(argv))
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    (tmp_path / "one.txt").write_text("The old lighthouse keeper lives here.")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "People.md").write_text("# lighthouse keeper lives\n# Nobody at all\n")
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert call("config-check", "--config", f"{tmp_path}/c.json") == (0, {"ok": True, "config": {"a": 1}})
    assert call("config-check", "--config", f"{tmp_path}/gone.json")[1]["error"] == "config_missing"
    assert call("nothing")[1]["error"] == call("validate-graph")[1]["error"] == "bad_arguments"
    assert call("inspect-templates", "--template-dir", f"{tmp_path}/t")[1]["templates"][0]["template_name"] == "People"
    code, built = call("build-graph", "--source", f"{tmp_path}/*.txt", "--template-dir", f"{tmp_path}/t", "--graph-dir", f"{tmp_path}/g")
    assert code == 0 and built["readiness"][0]["covered"] == 1 and built["evidence"] == 1
    assert call("validate-graph", "--graph-dir", f"{tmp_path}/g") == (0, {"ok": True, "n_errors": 0, "errors": []})
    assert call("query-graph", "--graph-dir", f"{tmp_path}/g", "--question", "keeper")[1]["results"][0]["nodes_found"] == 2
    assert call("query-graph", "--graph-dir", f"{tmp_path}/g", "--question", "zzz")[0] == 2
