"""Relevance by patterns, comparisons on request and the golden set's next version, against plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import compare, evaluate


@pytest.mark.parametrize(
    "pattern, words",
    [
        ("abc", ["abc"]), ("(?i)AbC", ["abc"]), ("ab?c", ["a"]), ("주차장.*현황", ["주차장"]), ("(주차장|도로)", ["주차장", "도로"]), ("(주차장|.)", []), ("[abc]", []),
        ("(abcd)+x", ["abcd"]), ("(abcd)*x", ["x"]), ("^ab$", ["ab"]), (r"a\0b", []), ("[a[b]]", []), (r"\p{L}abc", []), ("a(", []), ("", []), ("éa", ["a"]),
    ],
)
def test_literals_of(pattern, words):
    assert sorted(evaluate.literals_of(pattern)) == sorted(words)


@pytest.mark.parametrize("block", [1, 1000])
def test_relevance_equals_a_plain_loop(spark, block):
    asked = [("a", "(?iu)park", None), ("b", "(?iu)(parking|주차)", "KR-11"), ("c", ".", "KR-26"), ("d", "(?iu)ski", None), ("e", None, None), ("f", "주차장$", "KR-99"), ("a", "도로", None)]
    docs = [(1, "Parking 주차장", ["KR-11", "KR-26"]), (2, "PARK", []), (3, "ſKİ trails", None), (4, None, ["KR-26"]), (5, "", ["KR-26"]), (6, "도로 주차", ["KR-11"]), (7, "도로 주차", ["KR-26"]), (8, "x" * 50_000 + "park", None)]
    got = evaluate.relevant_by_pattern(
        spark.createDataFrame(asked, "query_id string, pattern string, region string"), spark.createDataFrame(docs, "id long, t string, areas array<string>"), "id", "t", "areas", block
    )
    folded = lambda s: s.translate(str.maketrans("ſKİı", "skii"))
    plain = [(q, k) for q, p, r in asked if p for k, t, areas in docs if t and re.search(p.replace("(?iu)", "(?i)"), folded(t)) and (r is None or r in (areas or []))]
    assert sorted(map(tuple, got.collect())) == sorted(plain)
    none = evaluate.relevant_by_pattern(spark.createDataFrame([], "query_id string, pattern string"), spark.createDataFrame(docs, "id long, t string, areas array<string>"), "id", "t")
    assert none.isEmpty()


def test_compare_requests(spark):
    facts = {c: F.lit("same") for c in compare.FACTS.values()} | {"formats": F.array("title"), "row_count": F.when(F.col("record_id") == "a", 1), "keywords": F.array().cast("array<string>")}
    listings = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("c", "3", "x")], "record_id string, list_key string, title string").withColumns(facts)
    columns = spark.createDataFrame([("1", "p"), ("1", "q"), ("2", "q"), ("2", "r"), ("1", "q")], "list_key string, column_name string")
    groups = {1: "ab", 2: "abc", 3: "a", 4: "aaaabb", 5: "az", 6: "aa", 7: ["a", None], None: "ab"}
    asked = spark.createDataFrame([(g, r) for g, rs in groups.items() for r in rs], "group_id int, record_id string")
    got = {r.group_id: r for r in compare.compare_requests(asked, listings, columns).collect()}
    assert {g: r.error for g, r in got.items()} == {1: None, 2: None, 3: "TOO_FEW", 4: "TOO_MANY", 5: "NOT_FOUND", 6: None, 7: "NOT_FOUND"}
    assert {d.field: d["values"] for d in got[1].differences} == {"formats": {"a": '["x"]', "b": '["y"]'}, "rowCount": {"a": "1", "b": "null"}}
    assert {s.field: s.value for s in got[1].shared_fields}["keywords"] == "[]" and len(got[1].shared_fields) == 13
    assert got[1].structure.asDict() == {"common": ["q"], "only_in": {"a": ["p"], "b": ["r"]}, "counts": {"a": 2, "b": 2}} and got[1].warning is None
    assert got[2].structure is None and got[2].warning == "STRUCTURE_OF_SOME_ONLY"
    assert got[6].differences == [] and got[6].structure.common == ["p", "q"]
    assert got[3].differences is None and got[4].structure is None
    assert compare.compare_requests(asked.where("false"), listings, columns).isEmpty()


def test_promotion(spark):
    cand = [("q", 1, 10, False, "R"), ("q", 2, 11, True, "N"), ("q", 3, 12, True, None), ("q", 4, 13, None, ""), ("p", 1, 10, True, None)]
    more = [("q", 1, 99), ("q", 2, 12), ("q", 3, 11), ("q", 4, 99), ("other", 1, 10)]
    docs = spark.createDataFrame([(i,) for i in (10, 11, 12, 13)], "id long")
    golden = evaluate.promoted(spark.createDataFrame(cand, "query_id string, rank int, doc long, auto boolean, verdict string"), spark.createDataFrame(more, "query_id string, place int, doc long"), docs, "id")
    got = {r.query_id: r for r in golden.collect()}
    assert (got["q"].relevant, got["q"].excluded, got["q"].reviewed, got["q"].missing) == ([10, 12, 99, 11], [11, 13], 5, [99])
    assert (got["p"].relevant, got["p"].reviewed) == ([10], 0) and set(got) == {"p", "q"}
    assert evaluate.promotion_summary(golden, "2026-06").head().asDict() == {"version": "v1", "snapshot": "2026-06", "queries": 2, "relevant": 5, "reviewed_verdicts": 5, "human_reviewed": True, "missing": 1}
