import pytest

from evidloom.plans import registry
from tests.compare import connection, differences

ORACLES, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(name, spark, sf_dir, con):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ([], [])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_depth_first_walk_equals_a_stack(spark, sf_dir):
    from evidloom.plans import graph_queries as g

    edges = sorted(g.edges(spark, sf_dir).collect(), key=lambda r: r["ord"])
    hubs = {r["node"] for r in g._hubs(spark, sf_dir).collect()}
    out = {}
    for e in edges:
        out.setdefault(e["source"], []).append(e["target"])
        out.setdefault(e["target"], []).append(e["source"])
    starts = {}
    for r in g._starts(spark, sf_dir).collect():
        starts.setdefault(r["query_id"], []).append(r["node"])
    want = set()
    for q, roots in starts.items():
        stack, seen = [(n, 0) for n in reversed(sorted(roots))], []
        while stack:
            node, d = stack.pop()
            if node in seen or d >= 3:
                continue
            seen.append(node)
            if node in hubs and node not in roots:
                continue
            stack += [(v, d + 1) for v in out.get(node, []) if v not in seen]
        want |= {(q, n, i) for i, n in enumerate(seen)}
    assert {tuple(r) for r in g.gr_05_dfs(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_depth_first_walk_of_random_graphs_needs_no_group(seed, spark):
    import random

    from evidloom.operators import graph as G

    r, n, depth = random.Random(seed), 14, (3, 5, 1, 4)[seed]
    edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.randrange(20)) for _ in range(30)]
    hubs, starts = {"n1", "n5"}, {"a": ["n1", "n3"], "b": ["n7"], "c": ["n2", "n4", "n9"], "d": ["alone"]}
    out = {}
    for s, t, o in edges:
        out.setdefault(s, []).append((o, 0, t))
        out.setdefault(t, []).append((o, 1, s))
    want = set()
    for q, roots in starts.items():
        stack, seen = [(x, 0) for x in reversed(roots)], []
        while stack:
            node, d = stack.pop()
            if node in seen or d >= depth:
                continue
            seen.append(node)
            if node not in hubs or node in roots:
                ordered = sorted(sorted(out.get(node, []), key=lambda e: e[2], reverse=True), key=lambda e: e[:2])
                stack += [(v, d + 1) for _, _, v in ordered]
        want |= {(q, x, i) for i, x in enumerate(seen)}
    found = G.dfs(
        spark.createDataFrame([(q, x) for q, xs in starts.items() for x in xs], "query_id string, node string"),
        spark.createDataFrame([(*e, "r", "k") for e in edges], "source string, target string, ord bigint, relation string, context string"),
        spark.createDataFrame([(h,) for h in hubs], "node string"), depth,
    )
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Pandas" not in found._jdf.queryExecution().toString()


def test_rendered_text_keeps_its_budget(spark, sf_dir):
    from evidloom.operators import graph as G
    from evidloom.plans import graph_queries as g

    rows = {r["query_id"]: r for n in ("gr_08_query_graph", "gr_08_query_graph_depth_first") for r in QUERIES[n](spark, sf_dir).collect()}
    budget = {r["query_id"]: r["token_budget"] for r in g.fn_11_query_params(spark, sf_dir).collect()}
    assert set(rows) == set(budget) and rows["q3"]["text"] == rows["q6"]["text"] == G.NO_TERMS and rows["q7"]["text"] == G.NO_MATCH
    for q, r in rows.items():
        text, _, note = r["text"].partition(G.CUT[0])
        assert len(text) <= 3 * budget[q]
        if r["nodes_found"]:
            shown = sum(x.startswith("NODE ") for x in text.split("\n"))
            assert text.startswith("NODE ") and r["nodes_found"] - shown == (int(note.split()[0]) if note else 0)
    assert any(G.CUT[0] in r["text"] for r in rows.values()) and rows["q2"]["mode"] == "dfs"
