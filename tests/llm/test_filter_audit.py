import itertools
import random
import re

import pytest

from catalogspark.llm import filter_audit


def brute(docs, labels):
    """The audit row by row and order by order."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for o in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(o):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                failing = sum(r[1][f] for r in mine)
                out[part, "".join(o), k + 1] = [len(left), len(gone), failing - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, o, k), v in out.items():
            if p == part:
                v.append(shapley[o[k - 1]])
    return out


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def got(docs, labels):
    return {(r.part, r.filter_order, r.step): [r[n] for n in NAMES] for r in filter_audit.audit(docs, labels).collect()}


@pytest.mark.parametrize("hot", [1, 256])
def test_equals_brute_force(spark, monkeypatch, hot):
    """Copies in hot and cold groups, null and repeated ids, null and empty texts, langs and labels, clashing extra columns."""
    monkeypatch.setattr(filter_audit, "HOT", 4 if hot == 1 else hot)
    rng = random.Random(hot)
    texts = [None, "", "A B C", "a # b", "one two\x85three", " ".join(f"w{i}" for i in range(120)), " ".join(f"W{i % 60}" for i in range(150)), " ".join(["same"] * 120), "Ü" * 40 + "X" * 5]
    docs = [(rng.randrange(80), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    docs += [(100 + i, "held by many", "en") for i in range(90)] + [(None, "held by many", "fr"), (None, None, None), (3, "x" * 50_000, "en")]
    docs += [docs[0]] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as h", "2 as mask", "3 as n", "4 as cell", "'x' as part", "5 as hot").repartition(4)
    assert got(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as n", "2 as good")) == brute(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(docs.limit(0), labels) == {}
    assert got(docs, labels) == brute([(1, "a", "en")], [])
