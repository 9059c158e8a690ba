"""SentencePiece encoding and decoding with a public model.

Texts are cut where no piece can lie across: between two characters that no piece holds side by side (so before each space mark that
follows another character). Distinct segments are encoded by a relational lattice: substrings of bounded length are exploded and equi-joined
to the piece table (bounded by the model, so broadcast), the edges are grouped by segment, and one higher-order aggregate folds Viterbi over
them: it keeps the best costs of the last positions and each position's best edge, so it is linear in the edges. A second one walks back.

Costs are negative log-probabilities in whole fractions of a nat (Pieces.scale), so sums are exact. A unigram model's scores are taken as they
stand. A BPE model holds merge ranks instead; its pieces get the probabilities that Zipf's law gives to these ranks. The result then is
the likeliest segmentation into the model's pieces, not the merge order's one; nothing is learnt from the texts, so ids don't depend on them.
A character that no piece is becomes byte pieces, at the worst cost and 10 nats. Of equal costs the longer last piece wins.

Segments' ids go to sorted hash arrays in the shared folder (a segment is known by its 64-bit hash); workers memory-map them and put texts
together with arrays. Decoding maps ids to piece bytes.

Defined results: null and empty texts have no ids; decoding takes the dummy space off the front, ignores ids outside the model and gives back
every text, but that a literal space mark reads as a space; other columns stay, a column named as the new one is replaced; repeated rows
encode equal; empty tables give none; texts of any length are encoded whole, and so is a stretch without a cut: its positions are folded in blocks, and
the costs that a piece can reach back to go over from one block to the next. A stretch whose last position doesn't fit a packed edge (2 billion characters
with the public model) is an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.llm.packed import Mapped, bounded_batches, by_range, lean, make_folder, range_of, store
from catalogspark.sources.shared import drop_written, new_path, written

SPACE = "▁"
#: Characters that a worker looks at at a time, or one segment; positions that are folded at a time.
CHUNK = 1 << 18
BLOCK = 256
#: Segments of a task of the lattice, and of a range of the dictionary.
SEGMENTS_A_TASK = 40_000
SEGMENTS_A_RANGE = 500_000
#: Hashes that a worker remembers to have sent already.
SEEN = 200_000
#: Nats that an unknown character costs beyond the worst piece.
UNKNOWN_NATS = 10
#: Bits of a piece's length.
_LENGTH_BITS = 6


@dataclass(frozen=True)
class Pieces:
    """A model's normal pieces with ids and costs (``scale`` to a nat), and the id of byte piece 0."""

    ids: dict
    costs: dict
    scale: int
    byte0: int
    size: int

    @staticmethod
    def load(model_path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = [i for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ids = {sp.id_to_piece(i): i for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece goes over the start of a word")
        byte0 = next(i for i in range(len(sp)) if sp.is_byte(i))
        nats, scale = log_costs({sp.id_to_piece(i): sp.get_score(i) for i in normal})
        costs = {p: round(scale * c) for p, c in nats.items()}
        out = Pieces(ids, costs, scale, byte0, len(sp))
        if max(map(len, ids)) >= 1 << _LENGTH_BITS or out.end_at > 47:
            raise ValueError("pieces, ids or costs don't fit a packed edge")
        return out

    # Bits of a packed edge, from the left: end, length, cost, id.
    @property
    def unknown(self) -> int:
        """What stands for the id of an unknown character."""
        return (1 << self.size.bit_length()) - 1

    @property
    def cost_at(self) -> int:
        return self.size.bit_length()

    @property
    def length_at(self) -> int:
        return self.cost_at + self.unknown_cost.bit_length()

    @property
    def end_at(self) -> int:
        return self.length_at + _LENGTH_BITS

    @property
    def unknown_cost(self) -> int:
        return max(self.costs.values()) + UNKNOWN_NATS * self.scale

    def touching(self) -> frozenset:
        """Pairs of characters that some piece holds side by side."""
        return frozenset(p[i : i + 2] for p in self.ids for i in range(len(p) - 1))

    def bytes_of(self) -> list[bytes]:
        out = [b""] * self.size
        for b in range(256):
            out[self.byte0 + b] = bytes([b])
        for p, i in self.ids.items():
            out[i] = p.replace(SPACE, " ").encode()
        return out


def log_costs(scores: dict[str, float]) -> tuple[dict[str, float], int]:
    """(nats of each piece, whole fractions of a nat to count in). Scores that are whole numbers, all different but the least one, are merge ranks."""
    low = min(scores.values())
    ranks = [s for s in scores.values() if s > low]
    if any(s != int(s) for s in ranks) or len(set(ranks)) < len(ranks):
        return {p: -s for p, s in scores.items()}, 4096
    last = max((-s for s in ranks), default=0) + 1
    rank = {p: min(-s, last) + 2 for p, s in scores.items()}
    total = math.log(sum(1 / r for r in rank.values()))
    return {p: math.log(r) + total for p, r in rank.items()}, 32


# ---- cutting texts


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Cutter:
    """Segments of texts as arrays: where they start, and their hashes."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, touching: frozenset):
        # each character is numbered apart as the left and as the right one of a pair; 0 is any other
        sides = [{c: i + 1 for i, c in enumerate(sorted({p[k] for p in touching}))} for k in (0, 1)]
        self.left, self.right = (np.zeros(0x110000, np.int32) for _ in sides)
        for column, of in zip((self.left, self.right), sides, strict=True):
            column[[ord(c) for c in of]] = list(of.values())
        self.wide = len(sides[1]) + 1
        self.holds = np.zeros((len(sides[0]) + 1) * self.wide, bool)
        self.holds[[sides[0][p[0]] * self.wide + sides[1][p[1]] for p in touching]] = True
        self._reach(CHUNK + 1)

    def _reach(self, n: int) -> None:
        self.up, self.down = _powers(self.BASE, n), _powers(pow(self.BASE, -1, 1 << 64), n)

    def starts(self, c: np.ndarray, texts_at: np.ndarray) -> np.ndarray:
        """Where segments start in code points c, with a cut at the start of each text."""
        cut = np.ones(len(c), bool)
        cut[1:] = ~self.holds[self.left[c[:-1]] * self.wide + self.right[c[1:]]]
        cut[texts_at] = True
        return np.flatnonzero(cut)

    def hashes(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        v = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(32)
        if len(c) > len(self.up):
            self._reach(2 * len(c))
        v *= self.up[: len(c)]
        upto = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(v, out=upto[1:])
        end = np.append(at[1:], len(c))
        h = (upto[end] - upto[at]) * self.down[at] + (end - at).astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def __call__(self, texts: list[str | None]):
        """(marked, starts, hashes, number) of runs of segments; number: how many segments each of the texts has in the run. A text of over CHUNK characters comes in several runs."""
        sizes = [len(t) + 1 if t else 0 for t in texts]
        a = 0
        while a < len(texts):
            b, held = a + 1, sizes[a]
            while b < len(texts) and held + sizes[b] <= CHUNK:
                held += sizes[b]
                b += 1
            yield from self._runs("".join([SPACE + t.replace(" ", SPACE) for t in texts[a:b] if t]), sizes[a:b], a, len(texts))
            a = b

    def _runs(self, text: str, sizes: list[int], first: int, n: int):
        at_text = np.concatenate([[0], np.cumsum(sizes)])
        done, size = 0, CHUNK
        while done < len(text):
            part = text[done : done + size]
            c = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            inside = at_text[:-1][np.array(sizes) > 0] - done
            at = self.starts(c, inside[(inside >= 0) & (inside < len(c))])
            if done + len(part) < len(text):  # the last segment may go on
                if len(at) == 1:
                    size *= 2  # it is the only one
                    continue
                part, c, at = part[: at[-1]], c[: at[-1]], at[:-1]
            number = np.zeros(n, np.int64)
            number[first : first + len(sizes)] = np.diff(np.searchsorted(at, at_text - done))
            yield part, at, self.hashes(c, at), number
            done, size = done + len(part), CHUNK


def _slices(batches, rows: int = 200):
    """Small parts of the batches: what a worker holds of them at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def distinct_segments(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """h, seg: the distinct segments of all texts."""
    bounded_batches(docs.sparkSession)
    touching = docs.sparkSession.sparkContext.broadcast(pieces.touching())

    def run(batches):
        cutter, seen = Cutter(touching.value), set()
        for part in _slices(batches):
            for marked, at, h, _ in cutter(part.column(0).to_pylist()):
                end = np.append(at[1:], len(marked))
                h, where = np.unique(h, return_index=True)
                signed = h.view(np.int64).tolist()
                new = [i for i, x in enumerate(signed) if x not in seen]
                if len(seen) > SEEN:
                    seen = set()
                seen.update(signed[i] for i in new)
                spans = zip(at[where[new]].tolist(), end[where[new]].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array([marked[s:e] for s, e in spans], pa.string())], names=["h", "seg"])

    return docs.select(F.col(text).cast("string")).mapInArrow(lean(run), "h bigint, seg string").distinct()


# ---- the lattice


def _byte_ids(char: Column, byte0: int) -> Column:
    digits = F.hex(F.encode(char, "UTF-8"))
    at = F.sequence(F.lit(1), F.octet_length(char))
    return F.transform(at, lambda i: (F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int") + byte0))


def _once(value: Column, use) -> Column:
    """use(value) with value evaluated once: a bound variable, where a column inlined into a lambda would be evaluated anew in each turn."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bits(x: Column, at: int, below: int) -> Column:
    return F.shiftright(x, at).bitwiseAND(F.lit((1 << (below - at)) - 1).cast("bigint"))


def lattice(segs: DataFrame, pieces: Pieces) -> DataFrame:
    """h, seg -> h, seg, edges: packed longs in order of end and length; each position ends an edge of length 1."""
    table = segs.sparkSession.createDataFrame([(p, (c << pieces.cost_at) + pieces.ids[p]) for p, c in pieces.costs.items()], "piece string, scored bigint")
    n, longest = F.length("seg"), max(map(len, pieces.ids))
    fits = F.when(n < 1 << (63 - pieces.end_at), n).otherwise(F.raise_error(F.lit("a stretch is too long for a packed edge")).cast("int"))
    # a window holds BLOCK starts and what their pieces reach, so that no row repeats a long segment; number -1 is the segment itself
    windows = segs.select("h", "seg", F.explode(F.sequence(F.lit(-1), F.floor((fits - 1) / BLOCK).cast("int"))).alias("k"))
    part = F.substring("seg", F.col("k") * BLOCK + 1, F.lit(BLOCK + longest - 1))
    windows = windows.select("h", "k", F.when(F.col("k") < 0, F.col("seg")).alias("head"), F.when(F.col("k") >= 0, part).alias("part"))
    size = F.length("part")
    spans = windows.withColumn("s", F.explode(F.when(F.col("k") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.least(F.lit(BLOCK), size) - 1))))
    spans = spans.withColumn("l", F.explode(F.when(F.col("k") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("s"))))))
    spans = spans.withColumn("piece", F.substring("part", F.col("s") + 1, F.col("l")))
    met = spans.join(F.broadcast(table), "piece", "left").where("scored is not null or l <= 1")
    place = F.shiftleft((F.col("k") * BLOCK + F.col("s") + F.col("l")).cast("bigint"), pieces.end_at) + F.shiftleft(F.col("l").cast("bigint"), pieces.length_at)
    edge = place + F.coalesce("scored", F.lit((pieces.unknown_cost << pieces.cost_at) + pieces.unknown))
    edges = met.select("h", F.when(F.col("l") > 0, edge).alias("edge"), "head")
    return edges.groupBy("h").agg(F.max("head").alias("seg"), F.sort_array(F.collect_list("edge")).alias("edges"))


def _blocks(edges: Column, n: Column, end_at: int, length_at: int) -> Column:
    """The edges of BLOCK ends after the other; the first edge of each end has length 1."""

    def cut(e: Column) -> Column:
        first = lambda x: (_bits(x, length_at, end_at) == 1) & (F.shiftright(x, end_at) % BLOCK == 1)
        starts = F.array_compact(F.transform(e, lambda x, i: F.when(first(x), i)))
        # by position: a slice would copy all edges for each block
        sliced = lambda s: F.transform(s, lambda at, k: F.transform(F.sequence(at, F.coalesce(F.get(s, k + 1), F.size(e)) - 1), lambda i: F.get(e, i)))
        return _once(starts, sliced)

    return F.when(n <= BLOCK, F.array(edges)).otherwise(_once(edges, cut))


def viterbi(edges: Column, n: Column, pieces: Pieces) -> Column:
    """The edges of the cheapest path over n positions, first to last.

    Arrays that grow by an element at a time hold a block's positions at most; a finished block is put aside whole.
    """
    longest, end_at, length_at = max(map(len, pieces.ids)), pieces.end_at, pieces.length_at
    cost_of, length_of, end_of = lambda x: _bits(x, pieces.cost_at, length_at), lambda x: _bits(x, length_at, end_at), lambda x: F.shiftright(x, end_at)
    whole = lambda *fields: F.struct(*[c.alias(f) for c, f in zip(fields, ("before", "at", "cost", "edge", "best"), strict=True)])
    big = lambda v: F.lit(v).cast("bigint")
    none, no_blocks = F.array().cast("array<bigint>"), F.array().cast("array<array<bigint>>")

    def relax(a: Column, x: Column) -> Column:
        cost = F.get(a["before"], (length_of(x) - 1).cast("int")) + cost_of(x)
        better = F.when(cost <= a["cost"], whole(a["before"], a["at"], cost, x, a["best"])).otherwise(a)
        # the next end begins with its edge of length 1
        before = F.concat(F.array(a["cost"]), F.slice(a["before"], 1, longest - 1))
        following = whole(before, a["at"] + 1, a["cost"] + cost_of(x), x, F.concat(a["best"], F.array(a["edge"])))
        return F.when(end_of(x) == a["at"], better).otherwise(following)

    def forward(a: Column, block: Column) -> Column:
        folded = F.aggregate(block, whole(a["s"]["before"], a["s"]["at"], a["s"]["cost"], a["s"]["edge"], none), relax)
        return _once(folded, lambda s: F.struct(s.alias("s"), F.concat(a["done"], F.array(s["best"])).alias("done")))

    start = whole(F.array(big(0)), big(1), big(1 << 60), big(0), none)
    best = F.aggregate(_blocks(edges, n, end_at, length_at), F.struct(start.alias("s"), no_blocks.alias("done")), forward, lambda a: F.concat(a["done"], F.array(F.array(a["s"]["edge"]))))

    def step(a: Column, x: Column) -> Column:
        taken = F.struct((a["at"] - length_of(x)).alias("at"), F.concat(a["path"], F.array(x)).alias("path"))
        return F.when(end_of(x) == a["at"], taken).otherwise(a)

    def backward(a: Column, block: Column) -> Column:
        walked = F.aggregate(F.reverse(block), F.struct(a["at"].alias("at"), none.alias("path")), step)
        return _once(walked, lambda s: F.struct(s["at"].alias("at"), F.concat(a["done"], F.array(s["path"])).alias("done")))

    return F.reverse(F.flatten(F.aggregate(F.reverse(best), F.struct(n.cast("bigint").alias("at"), no_blocks.alias("done")), backward)["done"]))


def encoded_segments(segs: DataFrame, pieces: Pieces) -> DataFrame:
    """h, seg -> h, ids by the lattice."""
    path = lattice(segs, pieces).select("h", "seg", viterbi(F.col("edges"), F.length("seg"), pieces).alias("path"))
    of_edge = lambda x: _bits(x, 0, pieces.cost_at).cast("int")
    char = lambda x: F.substring("seg", F.shiftright(x, pieces.end_at).cast("int"), F.lit(1))
    with_bytes = F.flatten(F.transform("path", lambda x: F.when(of_edge(x) == pieces.unknown, _byte_ids(char(x), pieces.byte0)).otherwise(F.array(of_edge(x)))))
    return path.select("h", F.when(F.exists("path", lambda x: of_edge(x) == pieces.unknown), with_bytes).otherwise(F.transform("path", of_edge)).alias("ids"))


# ---- the dictionary of segments


def store_dictionary(encoded: DataFrame, parts: int) -> str:
    """Write h -> ids as sorted hash arrays, a file for each of ``parts`` ranges of hashes; the folder."""
    base = make_folder(new_path(encoded.sparkSession, "segments"))

    def ranged(batches):
        for batch in batches:
            part = range_of(batch.column(0).to_numpy().view(np.uint64), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], names=["part", "h", "ids"])

    def stored(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64)
        ids = table.column("ids").combine_chunks()
        order = np.argsort(h, kind="stable")
        flat, cuts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy().astype(np.int64)
        size = np.diff(cuts)[order]
        start = cuts[:-1][order]
        to = np.concatenate([[0], np.cumsum(size)])
        picked = flat[np.repeat(start - to[:-1], size) + np.arange(to[-1])]
        store(f"{base}/ids-{table.column('part')[0].as_py()}", np.array([len(h)], np.int64), h[order], to.astype(np.int64), picked.astype(np.int32))
        return pa.table({"n": pa.array([len(h)], pa.int64())})

    rows = encoded.select("h", "ids").mapInArrow(lean(ranged), "part int, h bigint, ids array<int>")
    rows.groupBy("part").applyInArrow(stored, "n bigint").agg(F.sum("n")).collect()
    return base


class Dictionary:
    def __init__(self, base: str, parts: int):
        self.files, self.parts = Mapped(base), parts

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, flat ids) of sorted hashes."""
        sizes, flat = [], []
        for p, a, b in by_range(h, self.parts):
            raw = self.files(f"ids-{p}")
            n = int(raw[:8].view(np.int64)[0]) if raw is not None else 0
            if not n:
                raise ValueError("a text has changed since its segments were found")
            keys, to, ids = raw[8 : 8 + 8 * n].view(np.uint64), raw[8 + 8 * n : 16 + 16 * n].view(np.int64), raw[16 + 16 * n :].view(np.int32)
            at = np.minimum(np.searchsorted(keys, h[a:b]), n - 1)
            if (keys[at] != h[a:b]).any():
                raise ValueError("a text has changed since its segments were found")
            start, size = to[at], to[at + 1] - to[at]
            sizes.append(size)
            flat.append(ids[_ranges(start, size)])
        return np.concatenate(sizes), np.concatenate(flat)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    upto = np.cumsum(size)
    return np.repeat(start - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)


def _with_column(df: DataFrame, source: str, into: str, kind: T.DataType, begin) -> DataFrame:
    """df with column ``into``: begin() in each task gives the function from a slice of ``source`` to the new column's values."""
    df = df.drop(into)
    names = df.columns

    def run(batches):
        make = begin()
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, make(part.column(names.index(source)))], names=[*names, into])

    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, T.StructField(into, kind)]))


def encode(df: DataFrame, pieces: Pieces, text: str = "text", into: str = "ids") -> DataFrame:
    """Add column ``into``: array<int>, the ids of each whole text. df is read twice and must give the same texts."""
    spark = df.sparkSession
    segs = written(distinct_segments(df, pieces, text), "segs")
    n = segs.count()
    tasks, parts = n // SEGMENTS_A_TASK + 1, n // SEGMENTS_A_RANGE + 1
    base = store_dictionary(encoded_segments(segs.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "h"), pieces), parts)
    drop_written(segs)
    touching = spark.sparkContext.broadcast(pieces.touching())

    def begin():
        known, cutter = Dictionary(base, parts), Cutter(touching.value)

        def ids(texts: pa.Array) -> pa.Array:
            flat, ends = [], np.zeros(len(texts), np.int64)
            for _, _, h, number in cutter(texts.to_pylist()):
                uniq, which = np.unique(h, return_inverse=True)
                size, ids = known(uniq)
                start = np.cumsum(size) - size
                flat.append(ids[_ranges(start[which], size[which])])
                upto = np.concatenate([[0], np.cumsum(size[which])])
                to = np.cumsum(number)
                ends += upto[to] - upto[to - number]
            to = np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(to), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))

        return ids

    return _with_column(df, text, into, T.ArrayType(T.IntegerType()), begin)


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add column ``into``: the text of the ids."""
    bounded_batches(df.sparkSession)
    table = df.sparkSession.sparkContext.broadcast(pieces.bytes_of())

    def begin():
        of = [*table.value, b""]

        def one(x) -> str:
            if not x.is_valid or not len(x):
                return ""
            i = x.values.to_numpy(zero_copy_only=False)
            raw = b"".join(map(of.__getitem__, np.where((i >= 0) & (i < len(of)), i, len(of) - 1).tolist()))
            return raw[raw[:1] == b" " :].decode("utf-8", "replace")

        return lambda col: pa.array([one(x) for x in col], pa.string())

    return _with_column(df, ids, into, T.StringType(), begin)


def load_pieces(spark: SparkSession, path: str | None = None) -> Pieces:
    """path: the model file, by default the setting catalogspark.sentencepiece.model, then the public 32k model."""
    return Pieces.load(path or spark.conf.get("spark.catalogspark.sentencepiece.model", "/opt/tokenizers/piece_bpe_32k.model"))
