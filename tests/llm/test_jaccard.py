import random
import re

import pytest

from catalogspark.llm.jaccard import jaccard_components


def brute(rows, size=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return sorted(((d, len(sets[i]), best.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as key", "1 as n", "2 as component_id").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 5, 20, 60, 120]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        rows.append((1000 - i, rng.choice([" ", "\n", "\x0b "]).join(w).title() if rng.random() < 0.3 else " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \t "), (None, rows[0][1]), (None, "alone here"), (7, rows[3][1]), (7, rows[3][1])]
    assert run(spark, rows) == brute(rows)


def test_chain_across_the_star(spark):
    """Members that link with each other but not with the first of their list."""
    base = [f"a{i}" for i in range(200)]
    rows = [(k, " ".join(base[: 200 - 4 * k] + [f"z{k}{i}" for i in range(4 * k)])) for k in range(20)]
    assert run(spark, rows) == brute(rows)


def test_long_text_and_empty_table(spark):
    rng = random.Random(0)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, "x")]
    assert run(spark, rows) == brute(rows)
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    from catalogspark.llm.queries_jaccard import op10_ngram_jaccard

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op10_ngram_jaccard(spark, sf).collect()), key=str)
    assert got == brute(rows)
