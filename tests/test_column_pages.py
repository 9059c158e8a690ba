from catalogspark.operators import columns

from test_search_rows import shuffled


def test_pages_gather_their_own_evidence(spark, tmp_path):
    """The page equals the one cut from all matches; names that match in keys of no page aren't shuffled."""
    rows = [(k, [f"name{(k * 3 + j) % 50}" for j in range(40)] + ["Shared", f"only{k}"]) for k in range(3000)] + [(7, ["name1", "again"]), (5000, []), (5001, None)]
    docs = spark.createDataFrame(rows, "list_key long, names array<string>")
    asked = spark.createDataFrame([(f"q{i}", w) for i in range(40) for w in ("name", f"E{i}", "shared")] + [("none", " "), ("absent", "name"), ("absent", "zzz"), ("twice", "aga"), ("twice", "aga")], "query_id string, keyword string")
    columns.write_names(docs, f"file://{tmp_path}/names")
    index = columns.read_names(spark, f"file://{tmp_path}/names")
    columns.write_grams(index, f"file://{tmp_path}/grams")
    grams = columns.read_grams(spark, f"file://{tmp_path}/grams")
    listings = docs.select("list_key", docs["list_key"].alias("record_id")).selectExpr("*", "case when list_key % 7 = 3 then 'API' else 'FILE' end as list_type")
    said = lambda df: {(r.query_id, r.place, r.list_key, r.record_id, str(r.matched)) for r in df.collect()}
    want = said(columns.column_page(columns.column_search(asked, index, grams), listings, 5))
    before = shuffled(spark)
    assert said(columns.column_pages(asked, index, grams, listings, 5)) == want
    assert shuffled(spark) - before < 400_000  # 40 queries meet 40 names of 3,000 keys
    assert len(want) > 100 and any(q == "twice" for q, *_ in want)
