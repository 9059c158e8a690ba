"""Language-model scoring: an interpolated modified Kneser-Ney bigram model counted in Spark.

Counting: a pass over the training texts packs blocks of distinct (context, word) hashes with counts and deals them to
ranges of the context's hash. A range sums them, writes its sorted array of pair hashes with counts to the shared
folder, and passes on each context's totals and each word's continuation counts, which a second grouping by the
word's hash turns into sorted word arrays. Counts of counts and totals reach the driver as a few numbers a range.

Scoring: workers memory-map the arrays and look the distinct words and pairs of a batch of texts up in hash order.

The order is two: distinct triples of the whole corpus don't fit the disk budget (see README). All texts count; nothing
is pruned or sampled.

Defined results: words are maximal runs without ASCII white space, ASCII letters lower-cased, then one end token; null and
empty texts are the end token alone; a word that training lacks gets the share that unigram discounting
leaves for one unknown word; with no training rows every probability is 1; rows with a null text train as
empty; other columns stay; repeated rows score equal.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.llm.packed import Mapped, bounded_batches, by_range, make_folder, pack, range_of, ranges_for, store, unpack
from catalogspark.sources.shared import new_path

#: Tokens of a block: the bound of what a counting task holds.
BLOCK = 3_000_000
#: Text whose pairs a range of the model holds, in bytes.
RANGE_BYTES = 32_000_000
_START, _END = np.uint64(0x51A27), np.uint64(0xE0D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (context * _STEP) ^ (word + (context >> np.uint64(17)))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


class _Ids:
    """Numbers for the words seen so far; 0 is the start and 1 the end."""

    def __init__(self):
        self.of = defaultdict()
        self.of.default_factory = lambda: len(self.of) + 2

    def sequences(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text as start, words, end."""
        out = []
        for t in texts:
            w = _words(t)
            ids = np.empty(len(w) + 2, np.int64)
            ids[0], ids[-1] = 0, 1
            ids[1:-1] = np.fromiter(map(self.of.__getitem__, w), np.int64, len(w))
            out.append(ids)
        return out

    def hashes(self) -> np.ndarray:
        return np.concatenate([[_START, _END], np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.of), np.uint64, len(self.of))])


def _pairs_of(seqs: list[np.ndarray], n: int) -> np.ndarray:
    """context * n + word for each predicted token of the sequences."""
    flat = np.concatenate(seqs)
    last = np.cumsum([len(s) for s in seqs]) - 1
    keep = np.ones(len(flat), bool)
    keep[last] = False
    at = np.flatnonzero(keep)
    return flat[at] * n + flat[at + 1]


_ROUTED = "part int, kind int, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=["part", "kind", "payload"])


def _block_rows(seqs: list[np.ndarray], hashes: np.ndarray, parts: int) -> list[tuple]:
    n = len(hashes)
    keys, counts = np.unique(_pairs_of(seqs, n), return_counts=True)
    context, word = hashes[keys // n], hashes[keys % n]
    order = np.lexsort((word, context))
    context, word, counts = context[order], word[order], counts[order].astype(np.uint32)
    return [(p, 0, pack(np.diff(context[a:b], prepend=np.uint64(0)), word[a:b], counts[a:b])) for p, a, b in by_range(context, parts)]


def _counted_blocks(parts: int):
    def run(batches):
        ids, seqs, held = _Ids(), [], 0
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), 500):
                part = ids.sequences(texts.slice(at, 500).to_pylist())
                seqs += part
                held += sum(map(len, part))
                if held >= BLOCK:
                    yield _batch(_block_rows(seqs, ids.hashes(), parts))
                    ids, seqs, held = _Ids(), [], 0
        if seqs:
            yield _batch(_block_rows(seqs, ids.hashes(), parts))

    return run


def _of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].astype(np.int64)


def _contexts(base: str, parts: int):
    """One range of contexts: write its pairs, pass on context totals, continuation counts and counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        pieces = [unpack(x, np.uint64, np.uint64, np.uint32) for x in table.column("payload").to_pylist()]
        part = table.column("part")[0].as_py()
        context = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in pieces])
        word, count = (np.concatenate([p[i] for p in pieces]) for i in (1, 2))
        order = np.lexsort((word, context))
        context, word, count = context[order], word[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
        context, word, count = context[first], word[first], np.add.reduceat(count, first)
        pair = _pair(context, word)
        by = np.argsort(pair, kind="stable")
        store(f"{base}/pairs-{part}", pair[by], np.minimum(count[by], 2**32 - 1).astype(np.uint32))
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        kinds = [np.add.reduceat((count == i).astype(np.int64) if i < 3 else (count >= 3).astype(np.int64), start) for i in (1, 2, 3)]
        out = [(part, 1, pack(context[start], np.add.reduceat(count, start), *kinds)), (part, 3, pack(_of_counts(count)))]
        by = np.argsort(word, kind="stable")
        word, count = word[by], count[by]
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        used = np.diff(np.append(start, len(word)))
        word, count = word[start], np.add.reduceat(count, start)
        out += [(p, 2, pack(np.diff(word[a:b], prepend=np.uint64(0)), used[a:b], count[a:b])) for p, a, b in by_range(word, parts)]
        return pa.Table.from_batches([_batch(out)])

    return run


_TOTALS = "tokens bigint, types bigint, links bigint, pair_coc array<bigint>, word_coc array<bigint>"
_WORD = np.dtype([("hash", np.uint64), ("count", np.int64), ("used", np.int64), ("total", np.int64), ("n1", np.int32), ("n2", np.int32), ("n3", np.int32)])


def _word_range(base: str):
    """One range of words: counts and continuation counts as a word, totals as a context, in one sorted array."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = table.to_pylist()
        words = [unpack(r["payload"], np.uint64, np.int64, np.int64) for r in rows if r["kind"] == 2]
        contexts = [unpack(r["payload"], np.uint64, *[np.int64] * 4) for r in rows if r["kind"] == 1]
        coc = [unpack(r["payload"], np.int64)[0] for r in rows if r["kind"] == 3]
        seen = [np.concatenate([np.cumsum(w[0], dtype=np.uint64) for w in words])] if words else []
        seen += [c[0] for c in contexts]
        known = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        out = np.zeros(len(known), _WORD)
        out["hash"] = known
        for w in words:
            at = np.searchsorted(known, np.cumsum(w[0], dtype=np.uint64))
            out["used"][at] += w[1]
            out["count"][at] += w[2]
        for c in contexts:
            at = np.searchsorted(known, c[0])
            for name, column in zip(("total", "n1", "n2", "n3"), c[1:], strict=True):
                out[name][at] = column
        store(f"{base}/words-{part}", out)
        used = out["used"]
        pair_coc = np.sum(coc, axis=0) if coc else np.zeros(4, np.int64)
        return pa.table(
            {
                "tokens": pa.array([int(out["count"].sum())], pa.int64()),
                "types": pa.array([int((used > 0).sum())], pa.int64()),
                "links": pa.array([int(used.sum())], pa.int64()),
                "pair_coc": pa.array([pair_coc.tolist()], pa.list_(pa.int64())),
                "word_coc": pa.array([_of_counts(used[used > 0]).tolist()], pa.list_(pa.int64())),
            }
        )

    return run


def discounts(coc: list[int]) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the numbers of items seen one to four times."""
    n1, n2, n3, n4 = coc
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that hold for all."""

    base: str
    parts: int
    tokens: int
    types: int
    links: int
    pair_discounts: tuple
    word_discounts: tuple
    spare: float  # mass that discounting of words leaves


def train(docs: DataFrame, text: str = "text", parts: int | None = None) -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = parts or ranges_for(docs, text, RANGE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = make_folder(new_path(spark, "ngrams"))
    blocks = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_counted_blocks(parts), _ROUTED)
    counted = blocks.groupBy("part").applyInArrow(_contexts(base, parts), _ROUTED)
    totals = counted.groupBy("part").applyInArrow(_word_range(base), _TOTALS)
    sums = lambda c: [F.coalesce(F.sum(F.col(c)[i]), F.lit(0)).alias(f"{c}{i}") for i in range(4)]
    t = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "links")], *sums("pair_coc"), *sums("word_coc")).head()
    pair, word = (tuple(discounts([t[f"{c}{i}"] for i in range(4)])) for c in ("pair_coc", "word_coc"))
    n1, n2 = t["word_coc0"], t["word_coc1"]
    spare = (word[0] * n1 + word[1] * n2 + word[2] * (t["types"] - n1 - n2)) / t["links"] if t["links"] else 1.0
    return Model(base, parts, t["tokens"], t["types"], t["links"], pair, word, spare)


class Arrays:
    """The memory-mapped arrays of a model, opened range by range when a lookup needs them."""

    def __init__(self, model: Model):
        self.model, self.files = model, Mapped(model.base)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """The entries of sorted hashes; zeros where training has none."""
        out = np.zeros(len(hashes), _WORD)
        for p, a, b in by_range(hashes, self.model.parts):
            raw = self.files(f"words-{p}")
            if raw is not None:
                table = raw.view(_WORD)
                at = np.minimum(np.searchsorted(table["hash"], hashes[a:b]), len(table) - 1)
                hit = table[at]
                ok = hit["hash"] == hashes[a:b]
                out[a:b][ok] = hit[ok]
        return out

    def pairs(self, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The counts of pairs."""
        out = np.zeros(len(pair), np.int64)
        of = range_of(context, self.model.parts).astype(np.int64)
        order = np.lexsort((pair, of))
        cuts = np.searchsorted(of[order], np.arange(self.model.parts + 1))
        for p in range(self.model.parts):
            mine = order[cuts[p] : cuts[p + 1]]
            raw = self.files(f"pairs-{p}") if len(mine) else None
            if raw is not None:
                n = len(raw) // 12
                keys, counts = raw[: 8 * n].view(np.uint64), raw[8 * n :].view(np.uint32)
                at = np.minimum(np.searchsorted(keys, pair[mine]), n - 1)
                out[mine] = np.where(keys[at] == pair[mine], counts[at], 0)
        return out


def _discounted(count: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(0.0, count - np.choose(np.minimum(count, 3), [0.0, *d]))


def log_probabilities(texts: list[str | None], arrays: Arrays) -> list[tuple[int, int, float, float]]:
    """n_tokens, n_known, base and model score of each text."""
    m = arrays.model
    ids = _Ids()
    seqs = ids.sequences(texts)
    hashes = ids.hashes()
    n = len(hashes)
    order = np.argsort(hashes, kind="stable")
    info = np.zeros(n, _WORD)
    info[order] = arrays.words(hashes[order])
    pairs, where = np.unique(_pairs_of(seqs, n), return_inverse=True)
    c, w = pairs // n, pairs % n
    count = arrays.pairs(hashes[c], _pair(hashes[c], hashes[w]))
    single = _discounted(info["used"], m.word_discounts) / max(m.links, 1) + m.spare / (m.types + 1)
    total = np.maximum(info["total"][c], 1)
    d1, d2, d3 = m.pair_discounts
    left = np.where(info["total"][c] > 0, (d1 * info["n1"][c] + d2 * info["n2"][c] + d3 * info["n3"][c]) / total, 1.0)
    model = np.log10(_discounted(count, m.pair_discounts) / total + left * single[w])[where]
    seen = info["count"][w]
    base = np.log10((seen + 1) / (m.tokens + m.types + 1))[where]
    known = (seen > 0)[where]
    cuts = np.concatenate([[0], np.cumsum([len(s) - 1 for s in seqs])])
    return [(int(b - a), int(known[a:b].sum()), float(base[a:b].sum()), float(model[a:b].sum())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


SCORES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def score(df: DataFrame, model: Model, text: str = "text", into: str = "lm") -> DataFrame:
    """Add column ``into``: struct of n_tokens, n_known, base_score and score (log10 of the text's probability)."""

    @F.arrow_udf(SCORES)
    def _score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        arrays = Arrays(model)  # one a task
        for texts in batches:
            rows = [r for at in range(0, len(texts), 2000) for r in log_probabilities(texts.slice(at, 2000).to_pylist(), arrays)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=SCORES.names)

    return df.withColumn(into, _score(F.col(text)))
