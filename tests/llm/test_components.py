import random

import pytest

from evidloom.llm.components import connected_components


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(r.choice([5, 30, 45]))] + [(i, i + 1) for i in range(1000, 1000 + 20 * seed)] + [(5, 5), (3, None), (None, None)]
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = sorted((find(u), find(v)))
            group[b] = a
    want = {(x, find(x)) for x in group if find(x) != x}
    got = connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_a_star_and_no_edges(spark):
    got = connected_components(spark.createDataFrame([(7, i) for i in range(8, 400)], "u bigint, v bigint")).collect()
    assert {tuple(x) for x in got} == {(i, 7) for i in range(8, 400)}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
