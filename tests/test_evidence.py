"""Requirement search by automata against a plain search, letters whose lower case is longer, readiness counts."""

import random
from collections import Counter

import pytest

from evidloom.operators import evidence as E


def fold(text):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def plain(requirements, chunks):
    out = {}
    for key, no, name, start, text in sorted(chunks, key=lambda c: (c[0], c[1])):
        for r, value in requirements:
            at = fold(text or "").find(fold(value)) if value else -1
            if at >= 0 and (r, key) not in out:
                out[r, key] = (r, key, no, name, start + at, start + at + len(value))
    return Counter(out.values())


@pytest.mark.parametrize("most", [1, 40, 4_000_000])
def test_first_hits_equal_a_plain_search(most, spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcAB éİΣς") for _ in range(r.randint(1, 6)))
    requirements = [(f"r{i}", word()) for i in range(60)] + [("same", "ab"), ("again", "AB"), ("long", "ab ab ab ab"), ("none", "zzz"), ("empty", ""), ("null", None)]
    chunks = [(k, no, f"chunk-{no}", 100 * no, "".join(r.choice("aabbcc AB éİΣς\n") for _ in range(r.choice([0, 5, 80])))) for k in range(12) for no in range(1, 4)] + [(99, 1, "chunk-1", 0, None), (99, 2, "chunk-2", 5, "ab ab ab ab" * 3)]
    want = plain([x for x in requirements if x[1]], chunks)
    got = E.first_hits(spark.createDataFrame(requirements, "requirement_id string, value string"), spark.createDataFrame(chunks, "source_id bigint, chunk_no bigint, chunk_id string, start bigint, text string"), most_chars=most)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100


def test_places_are_those_of_the_text(spark):
    chunks = spark.createDataFrame([(1, 1, "chunk-1", 10, "İİ The Answer İ")], "source_id bigint, chunk_no bigint, chunk_id string, start bigint, text string")
    got = E.first_hits(spark.createDataFrame([("r", "the answer"), ("s", "answer İ")], "requirement_id string, value string"), chunks)
    assert sorted(map(tuple, got.collect())) == [("r", 1, 1, "chunk-1", 13, 23), ("s", 1, 1, "chunk-1", 17, 25)]


def test_nothing_to_search(spark):
    chunks = spark.createDataFrame([(1, 1, "chunk-1", 0, "x")], "source_id bigint, chunk_no bigint, chunk_id string, start bigint, text string")
    assert E.first_hits(spark.createDataFrame([], "requirement_id string, value string"), chunks).collect() == []
    assert E.automata([("a", "bb"), ("b", "BB"), ("c", "x" * 9), ("d", "")], 3) == [{"bb": ["a", "b"]}, {"x" * 9: ["c"]}]


def test_readiness_counts_what_supports_a_template(spark):
    status = [("t", "field", 1, "covered"), ("t", "table", 0, "not_found_in_source"), ("t", "field", 2, "not_found_in_source"), ("t", "card", 3, "needs_review"), ("u", "field", 1, "covered")]
    links = [("t", "n1", "e1", "d1", "v1"), ("t", "n1", "e2", "d2", "v1"), ("t", "n2", "e2", "d2", "v2")]
    got = E.readiness(spark.createDataFrame(status, "template_name string, kind string, ord int, status string"), spark.createDataFrame(links, "template_name string, node_id string, event_id string, edge_id string, evidence_id string"))
    assert sorted(map(tuple, got.collect())) == [("t", 4, 1, 0.25, "table,field", 2, 2, 2, 2, "3 of its requirements stand in no chunk"), ("u", 1, 1, 1.0, "", 0, 0, 0, 0, "")]
