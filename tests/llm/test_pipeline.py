import corpus_pipeline as cp
from catalogspark.llm.jaccard import jaccard_components
from catalogspark.llm.pii import anchors, find_spans
from catalogspark.llm.sentencepiece import decode, load_pieces


def test_stages_and_their_decisions(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "sentencepiece"]
    kept, counts = docs, {}
    for name, stage in cp.STAGES[:-1]:
        kept = cp.written(stage(spark, kept, sf), name)
        assert tuple(kept.columns) == cp.COLUMNS
        counts[name] = kept.count()
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
            gone = set(before) - {r.doc_id for r in kept.collect()}
            assert len(gone & toxic) > 0.6 * len(toxic) and len(gone - toxic) < 0.25 * len(before)
        if name == "near_copies":
            ids = [r.doc_id for r in kept.collect()]
            assert len(ids) == len(set(ids))
            assert jaccard_components(kept).where("doc_id <> component_id").count() == 0
    a = anchors()
    rows = kept.collect()
    assert not any(find_spans(r.text, a) for r in rows)
    assert counts["mixing"] >= counts["personal_data"] and {r.doc_id for r in rows} == set(ids)
    pieces = load_pieces(spark)
    out = cp.STAGES[-1][1](spark, kept, sf)
    assert decode(out, pieces).where("decoded <> text").count() == 0 and out.count() == counts["mixing"]
    left = r'token = "[0-9a-f]{40}"|password=[0-9a-f]{8,}|AKIA[A-Z0-9]{16}'
    assert docs.where(f"text rlike '{left}'").count() > 0 and out.where(f"text rlike '{left}'").count() == 0


ROW = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeated_rows_leave_one(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "en", "s", 3), (1, text, "en", "s", 3), (2, text, "en", "s", 3), (3, "", "en", "s", 0), (None, "other words", None, None, None)], ROW)
    got = cp.keep_one_of_near_copies(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "None"]


def test_one_id_with_unlike_texts_and_null_ids(spark):
    one, two, three = ("alpha beta gamma delta epsilon", "red green blue white black grey", "un deux trois quatre cinq six")
    rows = [(5, one), (5, two), (None, one), (None, one), (9, two), (None, three), (None, three), (None, None), (None, None), (6, ""), (7, ""), (4, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], ROW).selectExpr("*", "1 as key", "2 as component_id", "3 as _row", "4 as h").repartition(3)
    got = cp.keep_one_of_near_copies(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(5, one), (5, two), (None, three), (None, None), (6, ""), (7, ""), (4, None)], key=str)


def test_every_stage_takes_empty_tables_nulls_and_clashing_columns(spark):
    sf = "/root/testdata/sf0.001"
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "plain words that nobody minds", None, "s", 5), (3, "long " * 60_000, "en", None, 1)]
    clash = ["1 as pii", "2 as toxicity_score", "3 as ids", "4 as seg", "5 as tokens", "6 as weight", "7 as block", "8 as use", "9 as _row"]
    for name, stage in cp.STAGES:
        for n, rows in ((0, []), (5, odd)):
            docs = spark.createDataFrame(rows, ROW).selectExpr("*", *clash)
            got = stage(spark, docs, sf)
            assert tuple(got.columns[:5]) == cp.COLUMNS, name
            texts = [r.text for r in got.collect()]
            assert len(texts) == 0 if not n else {None, "", odd[3][1], odd[4][1]} == set(texts), name
