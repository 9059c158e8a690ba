import random

import numpy as np
import pytest

from catalogspark.llm import topk


def brute(rows, queries, k):
    out = set()
    for q, v in queries:
        if v:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in rows if w and c != q and len(w) == len(v))
            out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for i in range(160):
        scale = rng.choice([0, 1, 10, 300])
        rows.append((i, [float(rng.randrange(-9, 10) * scale) for _ in range(rng.choice([8, 8, 8, 3]))]))
    rows += [(1000 + i, list(rows[5][1])) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(df.where("id % 5 = 0"), df, 5).collect()}
    assert got == brute(rows, [r for r in rows if r[0] % 5 == 0], 5)


def test_high_cosines_prune_by_coordinates(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=16) * 500
    rows = [(i, [float(round(x)) for x in (centre + rng.normal(size=16) * 5 if i < 40 else rng.normal(size=16) * 500)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(df.where("id < 10"), df, 5).collect()}
    assert got == brute(rows, rows[:10], 5)


@pytest.mark.parametrize("block", [2, 4096])
def test_repeated_rows_take_a_rank_each(spark, monkeypatch, block):
    """Copies of candidates and queries, and ids with several vectors: one place for each pair of rows, as in the oracle SQL."""
    monkeypatch.setattr(topk, "BLOCK", block)
    rows = [(7, [9.0, 1.0])] * 3 + [(8, [8.0, 1.0])] * 6 + [(8, [1.0, 8.0])] + [(i, [float(i), 2.0]) for i in range(1, 6)]
    rows += [(20, [1.0, 0.0]), (21, [0.0, 1.0]), (21, [0.0, 1.0]), (22, [1.0, 1.0]), (22, [-1.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    for k in (5, 12):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(df.where("id >= 20"), df, k).collect())
        want = []
        for q in (20, 21, 22):
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for i, v in rows if i == q for c, w in rows if c != q)
            want += [(q, at + 1, c, -s) for at, (s, c) in enumerate(scores[:k])]
        assert got == want


@pytest.mark.parametrize("block", [2, 4096])
def test_products_beyond_doubles(spark, monkeypatch, block):
    """Scores of up to 63 bits, some of which differ by less than a double can tell."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "PAIRS_A_SALT", 1)
    rng = random.Random(1)
    rows = [(i, [float(300_000_000 + rng.randrange(3)), float(-300_000_000 - rng.randrange(3)), float(rng.randrange(9)), 1.0]) for i in range(40)]
    rows += [(i, [float(rng.randrange(-9, 9)) for _ in range(4)]) for i in range(40, 60)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(df.where("id % 4 = 0"), df, 5).collect()}
    assert got == brute([(i, [int(x) for x in v]) for i, v in rows], [(i, [int(x) for x in v]) for i, v in rows if i % 4 == 0], 5)


def test_edges(spark):
    rows = [(1, [1.0, None]), (2, None), (3, [float("nan")]), (4, [float("inf"), 1.0]), (None, [1.0]), (5, []), (6, [2.0]), (7, [3.0])]
    df = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v"), "vec_id", "embedding")
    assert sorted(r.id for r in df.collect()) == [6, 7]
    assert [tuple(r) for r in topk.top_products(df.where("id = 6"), df, 5).collect()] == [(6, 1, 7, 6)]
    assert topk.top_products(df.limit(0), df.limit(0), 5).count() == 0
