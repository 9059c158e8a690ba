"""Hard-negative mining by threshold joins with suffix-norm bounds, in the manner of L2AP.

Rows of whole-numbered vectors are packed into blocks. Anchors are dealt to batches of a fixed number of bytes; a batch meets all blocks by a
broadcast equi-join on dimension, so no vector is shuffled for a pair. A meeting is a threshold join: coordinates are ordered by the block's energy and
taken in groups; the inverted lists of a group leave out every candidate whose remaining coordinates are covered by the norm of its suffix
(it can't reach any threshold by them alone); partial scores are accumulated list by list, and a candidate goes when partial score and remaining norms can't
reach any anchor's threshold. What is left is verified with exact products.

An anchor's positives are the best rows of its label: the first block of the label gives scores to beat, one join with these thresholds gives
the rest. The negatives of a positive lie in a window below its score. The join begins with high thresholds and lowers them step by step, down to the
window's end; a window that has its rows leaves, since all later rows score less.

Defined results: rows with a null label, a null id, or a null or empty vector or one with null or non-finite components take no part; vectors of different
dimension don't meet; rows with the anchor's id are its own and never its positives or negatives; other repeated rows count as often as they
occur, and a repeated anchor has its rows as often; ties go to the smaller id; fewer rows than asked for give fewer; positives of negative
score have no window; scores are exact where they fit a long; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.llm.packed import bounded_batches, lean
from catalogspark.sources.shared import written

#: Rows of a block, and groups that labels are dealt to (positives meet blocks of their label's group only).
BLOCK = 4096
LABEL_GROUPS = 64
#: Bytes of anchors that are broadcast at a time.
BATCH_BYTES = 16 << 20
#: Anchors that meet a block at a time, and coordinates of an inverted list.
ANCHORS = 512
GROUP = 8
#: Percents of the positive's score that the thresholds go down by, before the window's end.
STEPS = (85, 70)
_SLACK = 1e-9


def distinct_rows(df: DataFrame, id_col: str, label: Column, vec_col: str) -> DataFrame:
    """id, label, v array<double>, copies: the rows that take part, equal ones as one."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & label.isNotNull() & (F.size(v) > 0) & fine)
    return rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), v.cast("array<double>").alias("v")).groupBy("id", "label", "v").agg(F.count("*").alias("copies"))


def _blocks(rows: DataFrame) -> DataFrame:
    """dim, grp, cut, ids, labels, copies, flat: blocks of about BLOCK rows whose labels share a group."""
    rows = rows.withColumn("dim", F.size("v")).withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int"))
    cuts = rows.groupBy("dim", "grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    rows = rows.join(F.broadcast(cuts), ["dim", "grp"]).withColumn("cut", F.pmod(F.xxhash64("id", "v"), F.col("cuts")))  # a row for each dimension and group
    packed = rows.groupBy("dim", "grp", "cut").agg(F.collect_list(F.struct("id", "label", "copies", "v")).alias("r"))
    return packed.select("dim", "grp", "cut", F.col("r.id").alias("ids"), F.col("r.label").alias("labels"), F.col("r.copies").alias("copies"), F.flatten("r.v").alias("flat"))


def within_reach(q: np.ndarray, c: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, candidates) positions of the pairs whose product may reach the anchor's threshold; none that does is left out."""
    dim = c.shape[1]
    order = np.argsort(-(c * c).sum(0), kind="stable")
    q, c = q[:, order], c[:, order]
    at = np.arange(0, dim, GROUP)
    rest = lambda x: np.sqrt(np.cumsum(np.add.reduceat(x * x, at, axis=1)[:, ::-1], axis=1)[:, ::-1])  # noqa: E731  norms of the coordinates from each group on
    qr, cr = (np.hstack([rest(x), np.zeros((len(x), 1))]) * (1 + _SLACK) for x in (q, c))
    slack = _SLACK * qr[:, :1]
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(least[:, None] > 0, least[:, None] / qr, -np.inf).min(0, initial=np.inf)  # the suffix norm that some anchor needs, group by group
    # a candidate is in the lists up to the last group whose suffix norm isn't covered
    depth = np.where(cr[:, :-1] >= need[:-1], np.arange(1, len(at) + 1), 0).max(1, initial=0)
    live = np.argsort(-depth, kind="stable")
    live = live[depth[live] > 0]
    scores = np.zeros((len(q), len(live)))
    for g, start in enumerate(at):
        inside = int(np.searchsorted(-depth[live], -(g + 1), side="right"))  # the candidates of this group's lists
        if inside:
            scores[:, :inside] += q[:, start : start + GROUP] @ c[live[:inside], start : start + GROUP].T
        if g % 2 and g + 1 < len(at):
            done = np.minimum(g + 1, depth[live])
            hope = (scores + qr[:, done] * cr[live, done] + slack * cr[live, 0] >= least[:, None]).any(0)
            if not hope.all():
                live, scores = live[hope], scores[:, hope]
    done = depth[live]
    i, j = np.nonzero(scores + qr[:, done] * cr[live, done] + slack * cr[live, 0] >= least[:, None])
    return i, live[j]


def _products(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact products of pairs: doubles below 2**53, whole numbers modulo 2**64 beyond."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < 2.0**53:
        if len(i) * 8 > len(q) * len(c):
            return (q @ c.T)[i, j].astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 65536]], c[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)]).astype(np.int64)
    q, c = q.astype(np.int64), c.astype(np.int64)
    return np.concatenate([(q[i[a : a + 65536]] * c[j[a : a + 65536]]).sum(1) for a in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])


def _joined(k: int, same_label: bool):
    """Rows of (anchors, block) -> of each anchor's window (lo <= score <= hi) the best k rows of the same or of other labels."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(n)[row] for n in batch.schema.names}
                dim = r["dim"].as_py()
                as_np = lambda x: x.values.to_numpy(zero_copy_only=False)
                cid, clabel, copies, c = as_np(r["ids"]), as_np(r["labels"]), as_np(r["copies"]), as_np(r["flat"]).reshape(-1, dim)
                qkey, qid, qlabel, q = as_np(r["keys"]), as_np(r["qids"]), as_np(r["qlabels"]), as_np(r["qflat"]).reshape(-1, dim)
                los, his, names = (x.as_py() for x in (r["lo"], r["hi"], r["at"]))
                for a in range(0, len(q), ANCHORS):
                    some = range(a, min(a + ANCHORS, len(q)))
                    least = np.array([min(los[x]) for x in some], float)
                    i, j = within_reach(q[a : a + ANCHORS], c, np.nextafter(least, -np.inf))
                    s = _products(q[a : a + ANCHORS], c, i, j)
                    fit = ((qlabel[a + i] == clabel[j]) == same_label) & (qid[a + i] != cid[j])
                    i, j, s = i[fit], j[fit], s[fit]
                    order = np.lexsort((cid[j], -s, i))
                    i, j, s = i[order], j[order], s[order]
                    cut = np.searchsorted(i, np.arange(len(some) + 1))
                    out: list[tuple] = []
                    for x in some:
                        mine = slice(cut[x - a], cut[x - a + 1])
                        down = -s[mine]
                        for lo, hi, name in zip(los[x], his[x], names[x], strict=True):
                            first, last = np.searchsorted(down, -hi), np.searchsorted(down, -lo, side="right")
                            got = j[mine][first : min(last, first + k)]
                            out += zip([int(qkey[x])] * len(got), [name] * len(got), cid[got].tolist(), (-down[first : first + len(got)]).tolist(), np.minimum(copies[got], k).tolist(), strict=True)
                    found = zip(*out, strict=True) if out else ((),) * 5
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, types, strict=True)], names=["key", "at", "vec_id", "score", "copies"])

    return run


_FOUND = "key bigint, at int, vec_id bigint, score bigint, copies int"


def _meet(windows: DataFrame, blocks: DataFrame, on: list[str], k: int, same_label: bool) -> DataFrame:
    """windows(key, id, label, v, dim, grp, batch, lo[], hi[], at[]) against blocks -> key, at, vec_id, score, copies: k rows a window, block and batch."""
    cols = {"key": "keys", "id": "qids", "label": "qlabels", "lo": "lo", "hi": "hi", "at": "at"}
    one = F.collect_list(F.struct(*cols, "v")).alias("r")
    packed = windows.groupBy(*on).agg(one).select(*on, *[F.col(f"r.{c}").alias(n) for c, n in cols.items()], F.flatten("r.v").alias("qflat"))
    # packed holds one batch: BATCH_BYTES at most
    return blocks.join(F.broadcast(packed), on).select("dim", "ids", "labels", "copies", "flat", *cols.values(), "qflat").mapInArrow(lean(_joined(k, same_label)), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each window, with their rank; each copy takes a rank. No window is gathered: ranks are limited before the shuffle as well."""
    each = found.select("key", "at", "vec_id", "score", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("key", "at").orderBy(F.desc("score"), "vec_id", "copy"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).drop("copy")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """rows and anchors as of distinct_rows() -> anchor_id, positive_rank, positive_id, positive_score, rank, negative_id, negative_score.

    A negative's score s is in the window low % p <= s <= high % p of the positive's score p; all percents are whole numbers.
    """
    bounded_batches(rows.sparkSession)
    blocks = written(_blocks(rows), "blocks")
    size = anchors.agg(F.sum(8 * F.size("v") + 64)).head()[0] or 0
    batches = 1 if size <= BATCH_BYTES else -(-11 * size // (10 * BATCH_BYTES))  # a tenth more, since hashes deal unevenly
    key = F.xxhash64("id", "label", "v")
    asked = anchors.withColumn("key", key).withColumn("dim", F.size("v")).withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int"))
    asked = written(asked.withColumn("batch", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(batches))), "anchors")
    every = F.lit(-(1 << 62)).cast("bigint")
    window = lambda df, lo, hi: df.withColumn("lo", F.array(lo)).withColumn("hi", F.array(hi)).withColumn("at", F.array(F.lit(0)))
    top = F.lit(1 << 62).cast("bigint")
    out = None
    for number in range(batches):
        batch = asked.where(F.col("batch") == number)
        head = blocks.where("cut = 0")
        beat = _first(_meet(window(batch, every, top), head, ["dim", "grp"], positives, True), positives)
        beat = beat.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("key", F.when(F.col("n") >= positives, F.col("least")).alias("least"))
        known = batch.join(beat, "key", "left")
        found = _meet(window(known, F.coalesce("least", every), top), blocks, ["dim", "grp"], positives, True)
        best = written(_first(found, positives).select("key", F.col("rank").alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("p")), "positives")

        percent = lambda f, up: F.expr(f"(p div 100) * {f} + ((p % 100) * {f} + {99 if up else 0}) div 100")
        part, ends = None, [*[s for s in STEPS if low < s < high], low]
        open_, above = best.where("p >= 0"), percent(high, False)
        for step in ends:
            lo = percent(step, True)
            left = open_.withColumn("lo", lo).withColumn("hi", above).where("lo <= hi").groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "at")).alias("w"))
            left = batch.join(left.select("key", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"), F.col("w.at").alias("at")), "key")
            part_now = written(_first(_meet(left, blocks, ["dim"], negatives, False), negatives), "negatives")
            part = part_now if part is None else part.unionByName(part_now)
            full = part.groupBy("key", "at").count().where(F.col("count") >= negatives)
            open_, above = open_.join(full, ["key", "at"], "left_anti"), lo - 1
        rank = F.row_number().over(Window.partitionBy("key", "at").orderBy(F.desc("score"), "vec_id", "rank"))
        chosen = part.withColumn("rank", rank).where(F.col("rank") <= negatives).join(best, ["key", "at"])
        out = chosen if out is None else out.unionByName(chosen)
    named = out.join(asked.select("key", F.col("id").alias("anchor_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col"), "key")
    return named.select("anchor_id", F.col("at").alias("positive_rank"), "positive_id", F.col("p").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
