import math
import re

import pytest

from catalogspark.operators.evaluate import relevant_by_passage
from catalogspark.plans import registry

DOCS = {
    1: "alpha beta gamma delta", 2: "alpha beta gamma delta epsilon zeta", 3: "zeta zeta eta", 4: "theta iota",
    5: "one alpha beta gamma delta epsilon zeta two", 6: "x" * 70 + " que", 7: "Alpha beta gamma delta, epsilon eta. Zeta!",
}
ASKED = {10: "alpha beta gamma delta epsilon zeta", 11: "nothing of this is epsilon", 12: "nil nil nil nil que", 13: None}


@pytest.fixture
def tables(spark, tmp_path):
    docs = [(i, t, "en" if i % 2 else "de", "src1", len(t)) for i, t in DOCS.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(ASKED.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(k):
    docs = {i: words(t) for i, t in DOCS.items()}
    average = sum(map(len, docs.values())) / len(docs)
    out = set()
    for q, text in ASKED.items():
        asked, found = set(words(text)), []
        for i, t in docs.items():
            s = 0.0
            for w in asked & set(t):
                df, tf = sum(w in x for x in docs.values()), t.count(w)
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / average))
            if s:
                found.append((-round(s, 6), i, asked <= set(t)))
        exact = any(f[2] for f in found)
        best = sorted(f for f in found if f[2] or not exact)[:k]
        out |= {(q, "AND" if exact else "OR", at + 1, f[1]) for at, f in enumerate(best)}
    return out


def test_search_takes_every_word(spark, tables):
    assert {tuple(r) for r in registry.QUERIES["bm25_topk"](spark, tables).collect()} == brute(10)
    got = {tuple(r) for r in registry.QUERIES["golden_export"](spark, tables).collect()}
    assert got == {(q, at, doc, q == 10 and doc in (2, 5)) for q, _, at, doc in brute(20)}


def test_plans_take_whole_texts(spark, tables):
    got = {(r.plan_id, r.role): r.n_matched for r in registry.QUERIES["plan_batch"](spark, tables).collect()}
    assert got[12, "PRIMARY"] == 1 and got[12, "REFERENCE"] == 1  # both by words behind the cuts
    keys = {(r.plan_id, r.key): r.observed_in for r in registry.QUERIES["plan_join_keys"](spark, tables).collect()}
    assert sorted(keys[11, "language"].split(",")) == ["5", "7"]


def test_relevance_by_whole_passages(spark, tables):
    got = {r.query_id: (r.relevant, r.retrieved, r.hits, float(r.ndcg)) for r in registry.QUERIES["ranking_eval"](spark, tables).collect()}
    # documents 2 and 5 hold passage 10; 7 has all its words, but not in sequence
    rank = {doc: at for q, _, at, doc in brute(10) if q == 10}
    gain = sum(1 / math.log2(rank[x] + 1) for x in (2, 5)) / (1 + 1 / math.log2(3))
    assert got == {10: (2, 3, 2, round(gain, 6))}


def test_passages_of_all_lengths(spark):
    text = [f"w{i % 11}" for i in range(40)]
    docs = {i: " ".join(text[i : i + 14]) for i in range(20)} | {99: None, 98: ""}
    asked = {m: " ".join(text[5 : 5 + m]) for m in range(1, 13)} | {50: None, 51: "...", 52: "w5 w6 w7 w8 w9 w10 w0 w1 w3"}
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    got = sorted(tuple(r) for r in relevant_by_passage(q, spark.createDataFrame(list(docs.items()), "id long, body string"), "id", "body").collect())
    assert got == sorted((a, i) for a, x in asked.items() for i, y in docs.items() if words(x) and f" {x} " in f" {y} ")
