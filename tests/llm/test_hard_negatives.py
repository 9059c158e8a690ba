import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogspark.llm import hard_negatives as hn
from catalogspark.llm.queries_negatives import op12_hard_negatives


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """rows: (id, label, vector)."""
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
    out = []
    for i, label, v in anchors:
        near = sorted((-dot(v, w), j, m) for j, m, w in rows if j != i and len(w) == len(v))
        mine = [(j, -s) for s, j, m in near if m == label][:positives]
        for at, (j, p) in enumerate(mine):
            window = [(n, -s) for s, n, m in near if m != label and low * p <= -100 * s <= high * p]
            out += [(i, at + 1, j, p, k + 1, n, s) for k, (n, s) in enumerate(window[:negatives])]
    return sorted(out)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, label long, v array<double>").repartition(3)
    return hn.distinct_rows(df.selectExpr("*", "1 as copies", "2 as dim"), "id", F.col("label"), "v")


def mined(df, anchors):
    return sorted(map(tuple, hn.hard_negatives(df, anchors).collect()))


@pytest.mark.parametrize("block", [8, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    """Several blocks, batches, dimensions and steps; copies and ties; a label of one row; an id with several vectors."""
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    monkeypatch.setattr(hn, "BATCH_BYTES", 3000 if block == 8 else 1 << 24)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(4, 20)) * 30
    rows = [(i, i % 4, [float(round(x)) for x in centres[(i * 7) % 4 if i % 3 else i % 4] + rng.normal(size=20) * (10 + i % 30)]) for i in range(140)]
    rows += [(200 + i, 9, list(rows[5][2])) for i in range(12)] + [rows[10]] * 4 + [rows[20]] * 2 + [(20, 3, list(rows[7][2])), (300, 77, list(rows[0][2]))]
    rows += [(400 + i, i % 2, [float(i), 3.0]) for i in range(8)] + [(500, 0, [0.0] * 20), (501, 1, [0.0] * 20)]
    df = frame(spark, rows)
    assert mined(df, df.where("id % 20 = 0")) == brute(rows, [r for r in rows if r[0] % 20 == 0])


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(3)
    for _ in range(60):
        q, c = (np.round(rng.normal(size=(n, 24)) * rng.choice([1, 40], size=(n, 1)) * np.geomspace(1, 0.01, 24) * 100) for n in (7, 50))
        full = q @ c.T
        least = np.quantile(full, rng.uniform(0.2, 0.999), axis=1) * rng.choice([1, 1, 1.5], size=7)
        i, j = hn.within_reach(q, c, least)
        got = np.zeros_like(full, bool)
        got[i, j] = True
        assert (got | (full < least[:, None])).all()
        assert (hn._products(q, c, i, j) == full[i, j]).all()
    # high thresholds leave most pairs out before all coordinates are read
    i, _ = hn.within_reach(q, c, np.full(7, full.max()))
    assert 1 <= len(i) <= 3


def test_products_beyond_doubles(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, [float(300_000_000 + rng.randrange(3)), float(-300_000_000 - rng.randrange(3)), float(rng.randrange(-10**8, 10**8) * (i % 3)), 1.0]) for i in range(40)]
    df = frame(spark, rows)
    assert mined(df, df.where("id % 5 = 0")) == brute(rows, [r for r in rows if r[0] % 5 == 0])


def test_query_edges(spark, tmp_path):
    """Rows that take no part, moved labels, fewer rows than asked for; empty tables."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-0.2, 1) for _ in range(6)], i % 3) for i in range(0, 130)]
    rows += [(None, [1.0] * 6, 1), (131, None, 1), (132, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (133, [float("nan")] * 6, 1), (134, [float("inf")] * 6, 1), (135, [1.0] * 6, None), (136, [], 1), (150, [0.5] * 6, 2)]
    kind = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/embeddings.parquet")
    used = [(i, (y + 1) % 10 if i % 7 == 0 else y, [np.floor(256 * float(np.float32(x))) for x in v]) for i, v, y in rows if i is not None and (i < 131 or i == 150)]
    got = op12_hard_negatives(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("anchor_id", "positive_rank", "positive_id", "positive_score", "rank", "negative_id", "negative_score").collect())) == brute(used, [r for r in used if r[0] % 50 == 0])
    empty = frame(spark, rows=[(1, 1, [1.0])]).limit(0)
    assert mined(empty, empty) == []
