import random

import numpy as np

from catalogspark.llm.toxicity import Machine, _fit, margins, score, terms, train


def test_pairs_beat_single_terms(spark):
    """Label 1 only where an insult and a group meet: no additive weights can tell."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        a, b = rng.random() < 0.25, rng.random() < 0.25
        words = [f"w{rng.randrange(400)}" for _ in range(8)] + ["insult"] * a + ["group"] * b
        rows.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = train(docs, known, epochs=30, min_z=3.0, max_share=1.0)
    got = {r.text: r.score for r in score(spark.createDataFrame([("insult group",), ("insult",), ("group",), (None,), ("",), ("Group! INSULT?",)], "text string"), m).collect()}
    assert got["insult group"] > 0.5 and got["Group! INSULT?"] == got["insult group"]
    assert max(got["insult"], got["group"], got[""]) < 0.5 and got[None] == got[""]


def _learnt(spark, label, shares, n):
    """Scores of a machine with the production defaults, by text; label(words) of rows that hold each word of shares by chance."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        has = {w for w, s in shares.items() if rng.random() < s}
        rows.append((i, " ".join([f"w{rng.randrange(400)}" for _ in range(8)] + sorted(has))))
        labels.append((i, int(label(has))))
    m = train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    return lambda *texts: [r.score for r in score(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), m).collect()]


def test_pairs_and_frequent_terms_with_production_defaults(spark):
    got = _learnt(spark, lambda w: {"insult", "group"} <= w, {"insult": 0.25, "group": 0.25}, 1500)
    both, *single = got("insult group", "insult", "group", "")
    assert both > 0.5 and max(single) < 0.5
    # a word of a third of the rows, and of every toxic one
    marked, plain = _learnt(spark, lambda w: "marker" in w, {"marker": 0.33}, 1500)("marker", "")
    assert marked > 0.5 > plain


def test_pair_of_a_word_that_is_neutral_alone(spark):
    """Half of the rows hold the group word, and toxic ones are as frequent with it as without."""
    got = _learnt(spark, lambda w: "insult" in w if "group" in w else "scum" in w, {"insult": 0.3, "group": 0.5, "scum": 0.3}, 3000)
    a, b, *none = got("insult group", "scum", "insult", "scum group", "group", "")
    assert min(a, b) > 0.5 and max(none) < 0.5


def test_margin_against_all_pairs():
    rng = np.random.default_rng(0)
    m = Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    r = np.array([0, 2, 3, 5])
    want = 0.3 + m.weights[r].sum() + sum(m.vectors[i] @ m.vectors[j] for i in r for j in r if i < j)
    assert abs(margins([r, np.array([], int)], m.bias, m.weights, m.vectors)[0] - want) < 1e-9


def test_fit_against_plain_loops():
    """The same descent with scalars, a pair at a time."""
    rng = np.random.default_rng(5)
    rows = [np.array(sorted(rng.choice(7, rng.integers(0, 5), replace=False)), int) for _ in range(25)]
    labels, pace, rank, epochs, decay = rng.integers(0, 2, 25).astype(float), np.array([1, 1, 0.5, 1, 0.1, 1, 1], np.float32), 2, 3, 1e-3
    bias, w, v = _fit(rows, labels, pace, rank, epochs, 7, decay)
    rng = np.random.default_rng(7)
    vv = (rng.standard_normal((7, rank), np.float32) * (0.05 * pace[:, None])).astype(float)
    ww, gw, gv = np.zeros(7), np.full(7, 1e-3), np.full((7, rank), 1e-3)
    share = (labels.sum() + 1) / 27
    b, gb = np.log(share / (1 - share)), 1e-3
    for epoch in range(epochs):
        rate = 0.3 / (1 + epoch)
        for i in rng.permutation(25):
            r = rows[i]
            margin = b + sum(ww[j] for j in r) + sum(float(vv[j] @ vv[k]) for j in r for k in r if j < k)
            g = 1 / (1 + np.exp(-margin)) - labels[i]
            gb += g * g
            b -= rate * g / gb**0.5
            old = vv.copy()
            for j in r:
                dw = g + decay * ww[j]
                gw[j] += dw * dw
                ww[j] -= rate * pace[j] * dw / gw[j] ** 0.5
                for f in range(rank):
                    dv = g * sum(old[k, f] for k in r if k != j) + decay * old[j, f]
                    gv[j, f] += dv * dv
                    vv[j, f] -= rate * pace[j] * dv / gv[j, f] ** 0.5
    assert abs(bias - b) < 1e-3 and np.abs(w - ww).max() < 1e-3 and np.abs(v - vv).max() < 1e-3


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "x"), (2, None)], "doc_id long, text string").selectExpr("*", "9 as score")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = score(docs, train(docs, none)).collect()
    assert len(out) == 4 and len({r.score for r in out}) == 1
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    assert score(docs, train(docs, one)).count() == 4
    assert b"^insu" in terms("insults") and terms(None) == set()


def test_held_out_accuracy(spark):
    from catalogspark.llm.queries_toxicity import op5_toxicity_fm

    sf = "/root/testdata/sf0.1"
    got = op5_toxicity_fm(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.97
    assert sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got) > 0.85
