import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from catalogspark.llm.queries_mixing import op3_source_mixing
from catalogspark.llm.mixing import find_mix, mix_sources, plan_sources


def rows_of(sizes):
    return [(i * 1000 + j, s, " ".join(["w"] * (1 + (j * 7) % 13))) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]


def test_weights_meet_the_target(spark):
    df = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    plan, mix = plan_sources(df, target_entropy=0.9, max_repeat=1e9)
    p = {"a": 0.9, "b": 0.09, "c": 0.01}
    h = lambda e: -sum(x / z * math.log(x / z) for x in [v**e for v in p.values()]) / math.log(3) if (z := sum(v**e for v in p.values())) else 0
    assert h(mix.exponent) == pytest.approx(0.9, abs=1e-5) and mix.entropy == pytest.approx(0.9, abs=1e-5)
    assert sum(r.weight for r in plan.collect()) == pytest.approx(1)
    plan, mix = plan_sources(df, target_entropy=0.99, max_repeat=3.0)
    quota = {r.source: r.quota / r.n_tokens for r in plan.collect()}
    assert min(quota.values()) == pytest.approx(1, abs=1e-6) and max(quota.values()) == pytest.approx(3, abs=1e-4)


def test_permutations_fill_the_budget(spark):
    docs = spark.createDataFrame(rows_of({"a": 400, "b": 60, None: 20}), "doc_id long, source string, text string").selectExpr("*", "5 as block", "'n' as n_tokens")
    plan, mix = plan_sources(docs.selectExpr("source", "size(split(text, ' ')) as tokens"), 0.99, 2.5)
    quota = {r.source: r.quota for r in plan.collect()}
    got = mix_sources(docs, 0.99, 2.5, block_tokens=300).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    used, per_block, times = Counter(), defaultdict(Counter), Counter()
    for r in got:
        used[r.source] += r.tokens
        per_block[r.block][r.source] += r.tokens
        times[r.doc_id, r.epoch] += 1
        assert r.tokens == len(r.text.split()) and r.n_tokens == "n"
    assert max(times.values()) == 1
    for s, q in quota.items():
        assert q - 1e-6 <= used[s] < q + 13
    n = len(per_block)
    for b in per_block.values():
        assert all(abs(b[s] - q / n) <= 26 for s, q in quota.items())
    for b in per_block:
        assert sorted(r.position for r in got if r.block == b) == list(range(1, 1 + sum(r.block == b for r in got)))


def test_bisection_in_jobs_equals_one_by_one(spark):
    """Many sources, in any order and partitioning, whatever a job looks at."""
    n = 20_001
    df = spark.range(n).select((1 / (F.col("id") + 1)).alias("w"))
    total = df.agg(F.sum(F.col("w").cast("decimal(38,20)"))).head()[0]
    shares = df.select((F.col("w") / F.lit(float(total))).alias("share"))
    found = [find_mix(d, 100, 0.95, 10.0, 1.0, at_once=k) for d, k in ((shares, 5), (shares.repartition(7), 5), (shares.orderBy("share"), 2))]
    assert found[0] == found[1] == found[2]
    h = [1 / (i + 1) / float(total) for i in range(n)]

    def entropy(e):
        z = sum(x**e for x in h)
        return -sum(x**e / z * math.log(x**e / z) for x in h) / math.log(n)

    e = found[0].exponent
    assert entropy(e) >= 0.95 - 1e-9 > entropy(e + 1e-6) or (max(h) / min(h)) ** (1 - e) >= 10 - 1e-6


def test_callers_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z")], "doc_id long, source string, text string").selectExpr("*", "doc_id as u1", "'k' as u2", "9 as h")
    assert {(r.doc_id, r.u1, r.u2, r.h) for r in mix_sources(docs).collect()} == {(1, 1, "k", 9), (2, 2, "k", 9)}


def test_query_against_plain_python(spark):
    """Every use of every document of sf0.01, from the units' hashes on in plain Python."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"u1": F.xxhash64("doc_id", "source", "text"), "u2": F.xxhash64("text", "source", F.lit(1), "doc_id")})
    rows = docs.select("doc_id", "source", "text", "u1", "u2", *[F.xxhash64("u1", "u2", F.lit(e), F.lit(11)).alias(f"h{e}") for e in (1, 2)], *[F.xxhash64(F.xxhash64("u1", "u2", F.lit(e), F.lit(11)), F.lit(12)).alias(f"m{e}") for e in (1, 2)]).collect()
    words = {r.u1: max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in rows}
    units = {}
    for r in rows:
        units.setdefault((r.u1, r.u2), [r, 0])[1] += words[r.u1]
    tokens, n_docs = Counter(), Counter()
    for r, t in units.values():
        tokens[r.source] += t
        n_docs[r.source] += 1
    total = sum(tokens.values())
    share = {s: t / total for s, t in tokens.items()}

    def at(e):
        p = {s: x**e for s, x in share.items()}
        z = sum(p.values())
        h = -sum(x / z * math.log(x / z) for x in p.values()) / math.log(len(p))
        ratio = [p[s] / share[s] / z for s in p]
        return h, min(ratio), max(ratio)

    def fine(e):
        h, lo, hi = at(e)
        return h >= 0.97 or hi / lo >= 1.5

    best, steep = (1.0, 1.0) if fine(1.0) else (0.0, 1.0)
    for _ in range(0 if best else 30):
        mid = (best + steep) / 2
        best, steep = (mid, steep) if fine(mid) else (best, mid)
    budget = total / at(best)[1]
    z = sum(x**best for x in share.values())
    quota = {s: max(min(x**best / z * budget, tokens[s] * 1.5), tokens[s]) for s, x in share.items()}
    blocks = max(1, math.ceil(sum(quota.values()) / 1_000_000))
    want, placed = {}, defaultdict(list)
    for s in tokens:
        done = 0
        for e in (1, 2):
            order = sorted((math.floor(((r[f"h{e}"] % 2**64) >> 32) / 2**32 * math.ceil(n_docs[s] / 2000)), r[f"h{e}"], r.u1, r.u2, t, r) for r, t in units.values() if r.source == s)
            for *_, u1, u2, t, r in order:
                if done < quota[s] - 1e-6:
                    placed[min(blocks - 1, math.floor(done / quota[s] * blocks))].append((r[f"m{e}"], u1, u2, e, t))
                done += t
    for b, uses in placed.items():
        for at_, (_, u1, u2, e, t) in enumerate(sorted(uses)):
            want[u1, u2, e] = (t, b, at_ + 1)
    expected = sorted((r.doc_id, e, *want[r.u1, r.u2, e]) for r in rows for e in (1, 2) if (r.u1, r.u2, e) in want)
    got = sorted((r.doc_id, r.epoch, r.tokens, r.block, r.position) for r in op3_source_mixing(spark, sf).collect())
    assert got == expected


def test_edges(spark):
    rows = [(1, "a", None), (2, "a", ""), (2, "a", ""), (None, None, "x y"), (3, "b", "long " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix_sources(docs)
    again = mix_sources(docs)
    key = lambda d: sorted((str(r.doc_id), r.epoch, r.block, r.position, r.tokens) for r in d.collect())
    assert key(got) == key(again) and sum(r[0] == "2" and r[1] == 1 for r in key(got)) == 2
    assert mix_sources(docs.limit(0)).count() == 0
    assert {r.epoch for r in mix_sources(docs.where("source = 'a'")).collect()} == {1}
