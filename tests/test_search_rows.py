"""Rows that searches shuffle: not occurrences times phrases, nor documents times queries."""

import pytest

from catalogspark.operators import bm25


def shuffled(spark):
    """Rows that the session's stages have written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    jvm = spark._jvm
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("stored", [False, True])
def test_phrases_of_common_words(spark, tmp_path, stored):
    """Hundreds of phrases share a word that stands everywhere."""
    docs = spark.createDataFrame([(i, " ".join(f"the w{(i * 7 + j) % 300}" for j in range(200))) for i in range(40)], "id long, text string")
    asked = spark.createDataFrame([(q, f"the-w{q} w{q + 1}-the the-w{q}-the-x the-w{q}-the") for q in range(290)], "query_id long, text string")
    index = None
    if stored:
        bm25.write_index(docs, "id", {"text": 1.0}, f"file://{tmp_path}/index")
        index = bm25.read_index(spark, f"file://{tmp_path}/index")
    before = shuffled(spark)
    got = {(r.query_id, r.rank): r.doc for r in bm25.bm25(asked, None if stored else docs, "id", {"text": 1.0}, 3, index=index).collect()}
    assert shuffled(spark) - before < 200_000  # 8,000 times "the", 870 phrases with it
    assert len(got) == 290 * 3
    has = lambda doc, q: (q - doc * 7) % 300 < 199 and (q + 1 - doc * 7) % 300 < 199 and not (q + 1 - doc * 7) % 300 == 0
    assert all(has(doc, q) for (q, _), doc in got.items())


def test_documents_alike_are_scored_once(spark):
    docs = spark.createDataFrame([(i, f"brand {i % 5} large", f"2024-01-{i * 13 % 28 + 1:02}" if i % 9 else None) for i in range(4000)], "id long, text string, day string")
    asked = spark.createDataFrame([(q, f"brand {q % 5} large {'zzz' if q % 10 == 9 else ''}") for q in range(400)], "query_id long, text string")
    before = shuffled(spark)
    found = {(r.query_id, r["rank"]): (r.mode, r.doc) for r in bm25.bm25(asked, docs, "id", {"text": 1.0}, 4).collect()}
    late = {(r.query_id, r["rank"]): r.doc for r in bm25.newest(asked, docs, "id", {"text": 1.0}, "day", 4).collect()}
    assert shuffled(spark) - before < 400_000  # 800 documents of each of 400 queries
    day = {r.id: r.day for r in docs.collect()}
    first = {m: [i for i in range(4000) if i % 5 == m] for m in range(5)}
    new = lambda ids: sorted(sorted(ids), key=lambda i: day[i] or "", reverse=True)[:4]
    for q in range(400):
        mode = "OR" if q % 10 == 9 else "AND"
        assert [found[q, n] for n in range(1, 5)] == [(mode, i) for i in first[q % 5][:4]]
        assert [late[q, n] for n in range(1, 5)] == new(day if mode == "OR" else first[q % 5])
