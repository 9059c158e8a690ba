import math
import random
import re
import zlib
from collections import Counter, defaultdict

from catalogspark.llm.kneser_ney import discounts, score, train


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


class Brute:
    """The same model from its definition, over dictionaries."""

    def __init__(self, texts):
        pair, self.count = Counter(), Counter()
        for t in texts:
            before = "<start>"
            for w in words(t):
                pair[before, w] += 1
                self.count[w] += 1
                before = (w,)
        self.pair, self.n = pair, sum(self.count.values())
        self.used = Counter(w for _, w in pair)
        self.follow = defaultdict(Counter)
        for (c, w), k in pair.items():
            self.follow[c][w] = k
        coc = lambda x: [sum(v == i for v in x.values()) for i in range(1, 5)]
        self.d2, self.d1 = discounts(coc(pair)), discounts(coc(self.used))
        self.spare = sum(self.off(c, self.d1) for c in self.used.values()) / len(pair) if pair else 1.0
        self.total = {c: (sum(f.values()), sum(self.off(k, self.d2) for k in f.values())) for c, f in self.follow.items()}

    def off(self, c, d):
        return d[min(c, 3) - 1] if c else 0.0

    def single(self, w):
        a = len(self.pair)
        if not a:
            return 1.0
        return max(0, self.used[w] - self.off(self.used[w], self.d1)) / a + self.spare / (len(self.used) + 1)

    def p(self, c, w):
        f = self.follow.get(c)
        if not f:
            return self.single(w)
        total, left = self.total[c]
        return max(0, f[w] - self.off(f[w], self.d2)) / total + left / total * self.single(w)

    def text(self, t):
        s, before, base = 0.0, "<start>", 0.0
        for w in words(t):
            s += math.log10(self.p(before, w))
            base += math.log10((self.count[w] + 1) / (self.n + len(self.count) + 1))
            before = (w,)
        return base, s


def test_equals_definition_and_sums_to_one(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(30))) for _ in range(300)] + [None, "", "Only ONCE", "only once"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as lm").repartition(3)
    model, brute = train(df.where("doc_id % 3 > 0")), Brute([t for i, t in enumerate(texts) if i % 3])
    assert (model.tokens, model.types, model.links) == (brute.n, len(brute.count), len(brute.pair))
    for r in score(df, model).collect():
        base, s = brute.text(r.text)
        assert abs(r.lm.score - s) < 1e-8 and abs(r.lm.base_score - base) < 1e-8
        assert r.lm.n_tokens == len(words(r.text)) and r.lm.n_known == sum(brute.count[w] > 0 for w in words(r.text))
    for c in ("<start>", ("w3",), ("never",)):
        assert abs(sum(brute.p(c, w) for w in brute.used) + brute.p(c, "unseen") - 1) < 1e-9


def test_empty_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.lm.score for r in score(df, train(df.limit(0))).collect()] == [0.0, 0.0]
    assert score(df.limit(0), train(df)).count() == 0


def test_query(spark):
    from catalogspark.llm.queries_lm import op2_lm_kneser_ney

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    brute = Brute([d.text for d in docs if zlib.crc32(str(d.doc_id).encode()) % 7 != 2])
    got = {r.doc_id: r for r in op2_lm_kneser_ney(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs[:200]:
        r = got[d.doc_id]
        base, s = brute.text(d.text)
        assert r.train_tokens == brute.n and abs(r.base_score - base) < 1e-6 and abs(r.score - s) < 1e-6
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
