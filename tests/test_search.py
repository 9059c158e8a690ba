import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import bm25, columns, search

FIELDS = {"text": 1.0, "title": 4.0}


def bare(c):
    """The letter without marks, where it is a Latin one."""
    d = unicodedata.normalize("NFD", c)
    return "" if "̀" <= c < "Ͱ" else d[0] if "a" <= d[0] <= "z" and ord(c) < 0x2000 else c


def words(t):
    return re.findall(r"[^\W_]+", "".join(map(bare, (t or "").lower())))


def units(t):
    return [tuple(w) for tok in (t or "").split() if (w := words(tok))]


def brute(docs, asked, k):
    fields = {i: [(words(text), 1.0), (words(title), 4.0)] for i, text, title in docs}
    size = {i: sum(len(t) for t, _ in f) for i, f in fields.items()}
    average = sum(size.values()) / len(size)
    tf = lambda i, u: sum(w for t, w in fields[i] for a in range(len(t)) if tuple(t[a : a + len(u)]) == u)
    out = set()
    for q, text in asked:
        us, found = units(text), []
        for i in fields:
            s = 0.0
            for u in us:
                if f := tf(i, u):
                    df = sum(tf(j, u) > 0 for j in fields)
                    s += math.log(1 + (len(fields) - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / average))
            if s:
                found.append((-round(s, 6), i, all(tf(i, u) for u in us)))
        exact = any(x[2] for x in found)
        if exact or len(set(us)) > 1:
            out |= {(q, "AND" if exact else "OR", at + 1, x[1]) for at, x in enumerate(sorted(x for x in found if x[2] or not exact)[:k])}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ranking_equals_brute_force(spark, tmp_path, seed):
    """Phrases, repeats, diacritics, fields, stop words, both modes, few and many results; texts and stored index alike."""
    rng = random.Random(seed)
    vocabulary = ["the"] * 8 + ["of"] * 4 + ["a", "b", "c", "Café", "café", "naïve", "서울", "x1", "rare", "ß", "-", "…"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "-", "　", ". "]) for _ in range(n))
    docs = [(i, rng.choice([None, text(rng.randrange(30))]), rng.choice([None, text(4)])) for i in range(70)] + [(90, "a b rare c", "b-c"), (91, "rare", "a")]
    asked = [(f"q{i}", text(rng.randrange(1, 5))) for i in range(25)] + [("and", "a-b c"), ("or", "a-b-c zz rare"), ("one", "zzz"), ("phrase", "b-c-rare"), ("no", "- …"), ("null", None), ("twice", "rare the the the")]
    df = spark.createDataFrame(docs, "id long, text string, title string").repartition(3)
    q = spark.createDataFrame(asked, "query_id string, text string")
    bm25.write_index(df, "id", FIELDS, f"file://{tmp_path}/index")
    index = bm25.read_index(spark, f"file://{tmp_path}/index")
    for k in (2, 100):
        want = brute(docs, asked, k)
        rows = lambda found: {(r.query_id, r.mode, r["rank"], r.doc) for r in found.collect()}
        assert rows(bm25.bm25(q, df, "id", FIELDS, k)) == want
        assert rows(bm25.bm25(q, None, "id", FIELDS, k, index=index)) == want
    assert {(r.query_id, r.doc) for r in bm25.matches(q, df, "id", FIELDS).collect()} == {(x[0], x[3]) for x in brute(docs, asked, 10**6)}


def test_phrases_need_neighbours_in_one_field(spark):
    docs = spark.createDataFrame([(1, "a b", ""), (2, "a x b", ""), (3, "a", "b"), (4, "b a", ""), (5, "A.́B!", "")], "id long, text string, title string")
    q = spark.createDataFrame([("q", "a-b")], "query_id string, text string")
    assert sorted(r.doc for r in bm25.bm25(q, docs, "id", FIELDS).collect()) == [1, 5]
    plan = bm25.postings(docs, "id", FIELDS)
    assert {(r.term, r.tf) for r in plan.where("doc = 3").collect()} == {("a", 1.0), ("b", 4.0)}


def test_floor_leaves_common_words_unread(spark):
    """Any-of queries don't form rows for words that can't lift a document over the floor."""
    docs = spark.createDataFrame([(i, "the the of " + (f"rare key{i}" if i < 20 else "filler"), "") for i in range(2000)], "id long, text string, title string")
    q = spark.createDataFrame([("q", "the of rare missing key3")], "query_id string, text string")
    assert bm25.scored(q, docs, "id", FIELDS).count() == 2000
    assert bm25.matches(q, docs, "id", FIELDS, k=5).count() == 20
    assert [r.doc for r in bm25.bm25(q, docs, "id", FIELDS, 5).collect()][:2] == [3, 0]


def sequential(text, skip, axes):
    out, rest = dict.fromkeys(axes), []
    for t in (text or "").split():
        for a, (aliases, upper) in axes.items():
            v = aliases.get(t.upper() if upper else t)
            if v is not None and out[a] is None and a not in skip:
                out[a] = v
                break
        else:
            rest.append(t)
    return (*out.values(), " ".join(rest))


def test_interpretation_equals_the_walk(spark):
    rng = random.Random(4)
    axes = {"a": ({"x": "X", "y": "Y", "csv": "C1"}, False), "b": ({"CSV": "C", "X": "BX", "Z": "BZ"}, True), "c": ({"z": "CZ", "y": "CY", "x": "CX"}, False)}
    rows = [(i, rng.choice([None, "", " "]) if i % 9 == 0 else " ".join(rng.choice(["x", "X", "y", "z", "Z", "csv", "CSV", "other", "ß"]) for _ in range(rng.randrange(1, 9))), rng.choice([None, [], ["a"], ["b", "c"], ["c"]])) for i in range(200)]
    got = search.interpret(spark.createDataFrame(rows, "query_id long, text string, skip array<string>"), axes).collect()
    assert {r.query_id: (r.a, r.b, r.c, r.rest) for r in got} == {i: sequential(t, s or [], axes) for i, t, s in rows}


def brute_columns(index, asked, size=5):
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    out = {}
    for q, said in asked.items():
        ks = list(dict.fromkeys(k.strip() for k in said if k and k.strip()))
        if not ks or len([k for k in said if k and k.strip()]) > 5 or any(len(k) > 50 for k in ks):
            continue
        for key in {k for k, _ in index}:
            hit = {k: sorted({n for x, n in index if x == key and n is not None and low(k) in low(n)})[:size] for k in ks}
            if all(hit.values()):
                out[q, key] = [(k, v) for k, v in hit.items()]
    return out


def test_column_search_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    index = [(f"k{rng.randrange(30)}", "".join(rng.choice("ab%_ÄäAB위도") for _ in range(rng.randrange(1, 9)))) for _ in range(400)]
    index += [("k1", None), ("big", "shared name")] + [("big", f"column {i}") for i in range(300)] + index[:20]
    asked = {f"q{i}": ["".join(rng.choice("ab%_äA위도") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4))] for i in range(30)}
    asked |= {"none": ["", None], "many": list("abcdef"), "long": ["a" * 51], "evidence": ["COLUMN", "umn 1"], "absent": ["column", "zzz"], "trim": [" a ", "a"], "literal": ["%"]}
    df = spark.createDataFrame(index, "list_key string, column_name string").repartition(3)
    q = spark.createDataFrame([(n, k) for n, ks in asked.items() for k in ks], "query_id string, keyword string").coalesce(1)
    want = brute_columns(index, asked)
    read = lambda found: {(r.query_id, r.list_key): [(m.keyword, m.columns) for m in r.matched] for r in found.collect()}
    columns.write_grams(df, f"file://{tmp_path}/grams")
    assert read(columns.column_search(q, df)) == want
    found = columns.column_search(q, df, columns.read_grams(spark, f"file://{tmp_path}/grams"))
    assert read(found) == want
    listings = spark.createDataFrame([(f"r{i}", f"k{i}", "FILE" if i % 3 else "API") for i in range(30)] + [("r99", "k1", "FILE")], "record_id string, list_key string, list_type string")
    page = columns.column_page(found, listings, 3).collect()
    for name in asked:
        keys = sorted(k for n, k in want if n == name)[:3]
        files = {f"k{i}": f"r{i}" for i in range(30) if i % 3}
        assert [(r.place, r.list_key, r.record_id) for r in sorted(page, key=lambda r: r.place) if r.query_id == name] == [(at + 1, k, files[k]) for at, k in enumerate(keys) if k in files]
    totals = {r.query_id: (r.error, r.total, r.has_more, r.searched, r.file_listings) for r in columns.column_totals(q, found, df, listings, 3).collect()}
    n = {name: sum(x == name for x, _ in want) for name in asked}
    assert totals["literal"] == (None, n["literal"], n["literal"] > 3, len({k for k, _ in index}), 21)
    assert [totals[x][0] for x in ("none", "many", "long")] == ["no keywords", "more than 5 keywords", "a keyword of over 50 characters"] and totals["none"][1:] == (None,) * 4
    plan = columns.names_with(q.select("keyword"), columns.name_grams(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and all("=" in x for x in re.findall(r"Join \w+, \((.*)\)", plan))
