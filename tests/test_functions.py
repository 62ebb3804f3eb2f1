import pytest
from pyspark.sql import functions as F

from evidloom.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("n", range(0, 40))
def test_bounded_ranges_equal_the_loop(spark, n):
    for most, overlap in ((0, 3), (1, 0), (7, 2), (10, 9), (10, 30), (13, 0)):
        want, step, at = [], most - max(0, min(overlap, most - 1)), 0
        if most <= 0 or n <= most:
            want = [(0, n)]
        else:
            while True:
                want.append((at, min(at + most, n)))
                if at + most >= n:
                    break
                at += step
        got = one(spark, lambda c, m=most, o=overlap: T.bounded(F.lit(0).cast("long"), c, m, o), n, "bigint")
        assert [tuple(r) for r in got] == want
        if n > 3:
            break


def test_sections_and_their_edges(spark):
    cut = lambda text: [tuple(r) for r in one(spark, lambda c: T.sections(c, ("Chapter .*",)), text) or []]
    assert cut("") == []
    assert cut("no heading") == [(0, 10, None)]
    assert cut("a\n Chapter 1 \nb\nChapter 2") == [(0, 2, None), (2, 16, "Chapter 1"), (16, 25, "Chapter 2")]
    assert cut("Chapter 1\nx") == [(0, 11, "Chapter 1")]
    assert cut(None) == []


def test_query_terms(spark):
    assert one(spark, T.query_terms, "The cat, the Dog of x1 \u7ea2\u697c\u68a6") == ["the", "cat", "dog", "x1", "\u7ea2\u697c", "\u697c\u68a6", "\u7ea2\u697c\u68a6"]
    assert one(spark, T.query_terms, "") == []
    assert one(spark, T.query_terms, "\u7ea2") == ["\u7ea2"]


def test_paths(spark):
    path = lambda x: one(spark, T.relative_path, x)
    assert path("a\\b/./c") == "a/b/c"
    for bad in (None, "", "/a", "a/../b", "C:/x", "a*", ".", "x\0y"):
        assert path(bad) is None
    assert one(spark, T.portable_key, "C:\\a\\b.md") == "b.md"
    assert [one(spark, T.safe_segment, x) for x in ("a.b", "..", "a/b", "", None)] == [True, False, False, False, False]


def test_headings_and_labels(spark):
    assert one(spark, T.headings, "# A \r\n####### no\n   ## B\n    # code\n#no") == ["A", "B"]
    assert one(spark, T.bare_label, "name()((") == "name"
    df = spark.createDataFrame([(None, "", "b")], "a string, b string, c string")
    assert df.select(T.first_text("a", "b", "c").alias("y")).first()["y"] == "b"


def test_merge_with_ties_nulls_and_no_rows(spark):
    from evidloom.operators import merge as M

    rows = [("k", 1, "x", "c1"), ("k", 2, "x", "c2"), ("k", 3, "y", "c3"), ("k", 1, "x", "c1"), ("n", 5, None, "c5")]
    df = spark.createDataFrame(rows, "id string, o bigint, body string, chunk string")
    out = M.merge_items(df, key="id", order=["o"], body=["body"], provenance="chunk")
    assert {(r["id"], r["body"], tuple(r["provenance"])) for r in out["kept"].collect()} == {("k", "x", ("c1", "c2")), ("n", None, ("c5",))}
    assert [(r["id"], r["kept_from"], r["conflicting"]) for r in out["conflicts"].collect()] == [("k", "c1", "c3")]
    none = M.merge_items(df.limit(0), key="id", order=["o"], body=["body"], provenance="chunk")
    assert none["kept"].count() == none["conflicts"].count() == 0


def test_merged_enums():
    from evidloom.operators.contracts import ENUMS, merged_enums

    assert merged_enums(None) == (ENUMS, []) and merged_enums([]) == (ENUMS, ["bad_status_enums"])
    found, codes = merged_enums({"confidence_levels": ["SURE", 3], "verification_statuses": "x", "other": []})
    assert found == ENUMS | {"confidence_levels": ("SURE",), "other": ()} and sorted(codes) == ["bad_status_enum:verification_statuses", "bad_status_enum_item:confidence_levels"]


def test_folded(spark):
    for text, want in (("Caf\u00e9 \u00c5NGSTR\u00d6M e\u0301", "cafe angstrom e"), ("PLAIN", "plain"), ("", ""), (None, None), ("\ufb01", "\ufb01")):
        assert one(spark, T.folded, text) == want
