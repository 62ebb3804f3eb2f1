"""Queries over the whole of their tables: each of these would have failed while a part was left out."""

import pytest

from evidloom.plans import registry
from tests.compare import connection, differences

ORACLES, QUERIES = registry.oracle_sql(), registry.queries()
#: Query -> the filter in its oracle's SQL that leaves rows out; without it the SQL is over the whole table.
CUTS = {
    "jn_01_dangling_evidence": " WHERE c_custkey < 140",
    "val_19_repairs": " WHERE c_custkey < 400",
    "win_07_claims": " AND batch_id < 30",
    "agg_09_gap_report": " WHERE event_id % 9 = 0",
    "mrg_04_provenance": " WHERE event_id % 20 < 3",
    "prj_19_markdown": " WHERE l_orderkey % 10 = 0",
}


@pytest.mark.parametrize("name", sorted(CUTS))
def test_query_covers_the_whole_table(name, spark):
    sf_dir = "/root/testdata/sf0.01"
    assert differences(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLES[name].replace(CUTS[name], "")) == ([], [])


def test_provenance_of_a_hot_id_nulls_and_ties(spark):
    from evidloom.operators.ledgers import provenance_union

    rows = [("hot", k, [f"c{k % 3}"], ["l", None]) for k in range(500)] + [("none", 1, [], None), ("tie", 1, ["b", "a"], ["z"]), ("tie", 1, ["a"], ["y", "z"]), (None, 2, None, ["q"])]
    out = provenance_union(spark.createDataFrame(rows, "id string, ord int, chunk_ids array<string>, lane_paths array<string>"))
    assert {r["id"]: (r["chunk_ids"], r["lane_paths"]) for r in out.collect()} == {"hot": (["c0", "c1", "c2"], ["l", None]), "none": ([], []), "tie": (["a", "b"], ["y", "z"]), None: ([], ["q"])}


def test_questions_walk_by_their_own_mode_and_depth(spark):
    from evidloom.operators import graph as G

    nodes = spark.createDataFrame([(f"n{i}", "start" if i == 0 else f"x{i}", "a" if i else "b", None) for i in range(8)], "id string, label string, node_type string, source_file string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "r", "even" if i % 2 == 0 else "odd", i) for i in range(7)], "source string, target string, relation string, context string, ord bigint")
    kind = "query_id string, question string, mode string, depth string, token_budget string, result_limit string, include_terms array<string>, target_node_types array<string>, context_filter array<string>"
    asked = [("six", "start", "bfs", "6"), ("one", "start", "bfs", "1"), ("dfs", "start", "dfs", "6"), ("dfs2", "start", "dfs", "2")]
    rows = [(*q, None, None, None, None, None) for q in asked] + [("more", "zz", "bfs", "1", None, None, ["X7"], None, None), ("type", "start x3", "bfs", "1", None, None, None, ["a"], None), ("odd", "start", "bfs", "4", None, None, None, None, ["odd"])]
    out = {r["query_id"]: (r["nodes_found"], r["edges_found"], r["text"].count("EDGE ")) for r in G.queried(G.query_params(spark.createDataFrame(rows, kind)), nodes, edges).collect()}
    assert out == {"six": (7, 6, 6), "one": (2, 1, 1), "dfs": (6, 6, 5), "dfs2": (2, 2, 1), "more": (2, 1, 1), "type": (3, 2, 2), "odd": (5, 2, 2)}


def test_a_very_long_document_has_its_chunk_99(spark, tmp_path):
    text = "word " * 60_000
    docs = spark.createDataFrame([(9, text, "en", "s", len(text)), (18, "short", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r["item_id"], r["code"]) for r in QUERIES["jn_03_range_containment"](spark, str(tmp_path)).collect()}
    assert ("18", "chunk_unknown") in found and ("9", "source_range_outside_chunk") in found and ("9", "chunk_unknown") not in found
