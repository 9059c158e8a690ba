"""Exact top-k by inner product with norm buckets.

Vectors of integers are grouped by length, equal rows as one with their count; a large group is cut into blocks of bounded size by a hash of id and vector. Every query first meets
the longest vectors, which gives it k scores to beat. For each other block the length of its longest vector turns that score into
a cosine that a member must reach: above one the query skips the block, and otherwise the block picks its
pruning: by coordinates where the required cosine is high (a member's part along the query's heaviest
coordinates must come within the feasible distance), by length alone where it is low. What is left is verified
with exact products. Query and candidate blocks meet by an equi-join on block numbers; only top scores come back.

Defined results: vectors that are null, empty or hold null, NaN or infinite components take no part, nor do rows with
a null id; vectors of different dimension don't meet; ties go to the smaller id; a query's own row is no
candidate (repeated ids are all "own"); other repeated rows count as often as they occur, on both sides, so that copies of
a candidate take a rank each; fewer than k candidates give fewer rows; empty tables give none; scores are exact where they fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.sources.shared import written

#: Rows of a block of candidates and of queries.
BLOCK = 4096
#: Required cosine from which coordinates prune better than length.
COORD = 0.8
#: Candidate blocks whose numbers meet the query blocks in one task.
PAIRS_A_SALT = 256


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v array<double>: the rows that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("v"))


def _blocks(rows: DataFrame, bucket: bool) -> DataFrame:
    """Blocks of at most about BLOCK different rows: dim, bucket, longest, ids, copies (how often each row occurs), flat (row after row).

    Buckets are quarter octaves of length; their number is bounded by the range of a double.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("norm", norm).withColumn("dim", F.size("v"))
    rows = rows.withColumn("bucket", F.floor(4 * F.log2(F.greatest("norm", F.lit(1.0)))).cast("int") if bucket else F.lit(0))
    cuts = rows.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    rows = rows.join(F.broadcast(cuts), ["dim", "bucket"])  # one row for each dimension and quarter octave
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("id", "v"), F.col("cuts")))
    packed = rows.groupBy("dim", "bucket", "cut").agg(F.max("norm").alias("longest"), F.collect_list(F.struct("id", "copies", "norm", "v")).alias("r"))
    return packed.select("dim", "bucket", "cut", "longest", F.col("r.id").alias("ids"), F.col("r.copies").alias("copies"), F.col("r.norm").alias("norms"), F.flatten("r.v").alias("flat"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _met(k: int):
    """Rows of (query block, candidate block) -> the best candidates of each query there."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(n)[row] for n in batch.schema.names}
                dim = r["dim"].as_py()
                as_np = lambda x: x.values.to_numpy(zero_copy_only=False)
                qid, cid = as_np(r["qids"]), as_np(r["ids"])
                qtimes, ctimes = as_np(r["qcopies"]), as_np(r["copies"])
                q, c = as_np(r["qflat"]).reshape(-1, dim), as_np(r["flat"]).reshape(-1, dim)
                beat = as_np(r["beat"]).astype(float) if "beat" in r else np.full(len(qid), -np.inf)
                beat = beat - 1 - 1e-12 * np.abs(np.where(np.isfinite(beat), beat, 0))  # a double holds a long only so far; a few candidates more do no harm
                # doubles are exact below 2**53 in any order of summing; beyond, whole numbers modulo 2**64 are, as long as scores are longs
                exact = dim * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < 2.0**53
                qi, ci = (q, c) if exact else (q.astype(np.int64), c.astype(np.int64))
                qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(qn * r["longest"].as_py() > 0, beat / (qn * r["longest"].as_py()), np.where(beat > 0, np.inf, -np.inf))
                out: list[tuple] = []
                live = np.flatnonzero(need <= 1 + 1e-9)
                coord = live[need[live] >= COORD]
                plain = live[need[live] < COORD]
                if len(plain):
                    # the longest candidates first; those too short for the easiest query drop out
                    slack = np.where(beat[plain] > 0, beat[plain] / np.maximum(qn[plain], 1e-300), -np.inf).min()
                    reach = np.flatnonzero(cn >= slack * (1 - 1e-9))
                    scores = qi[plain] @ ci[reach].T
                    for i, s in zip(plain, scores, strict=True):
                        ok = np.flatnonzero((s >= beat[i]) & (cid[reach] != qid[i]))
                        best = ok[_best(s[ok], cid[reach][ok], k)]
                        out += [(int(qid[i]), int(cid[reach][b]), int(s[b]), int(qtimes[i] * ctimes[reach][b])) for b in best]
                for i in coord:
                    # |c/|c| - q/|q||^2 = 2 - 2 cos bounds the distance along the heaviest coordinates too
                    focus = np.argsort(-np.abs(q[i]))[: max(1, dim // 8)]
                    lacking = np.where(cn > 0, beat[i] / (qn[i] * np.maximum(cn, 1e-300)), np.inf)
                    near = ((c[:, focus] / np.maximum(cn, 1e-300)[:, None] - q[i][focus] / qn[i]) ** 2).sum(1) <= 2 - 2 * lacking + 1e-9
                    ok = np.flatnonzero(near & (cid != qid[i]))
                    s = ci[ok] @ qi[i]
                    ok, s = ok[s >= beat[i]], s[s >= beat[i]]
                    best = _best(s, cid[ok], k)
                    out += [(int(qid[i]), int(cid[ok[b]]), int(s[b]), int(qtimes[i] * ctimes[ok[b]])) for b in best]
                found = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score", "n"])

    return run


_FOUND = "query_id bigint, vec_id bigint, score bigint, n bigint"


def top_products(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """queries(id, v), vectors(id, v), whole-numbered components -> query_id, rank, vec_id, score."""
    every = written(_blocks(vectors, bucket=True), "candidates").withColumn("number", F.struct("dim", "bucket", "cut"))
    asked = written(_blocks(queries, bucket=False), "queries")
    q = asked.select("dim", F.col("cut").alias("qcut"), F.col("ids").alias("qids"), F.col("copies").alias("qcopies"), F.col("flat").alias("qflat"))

    # the first block of the longest bucket of each dimension, for scores to beat
    head = every.groupBy("dim").agg(F.max("number").alias("number"))
    first = every.join(head.select("number"), "number")
    tried = q.join(first.drop("number"), "dim").mapInArrow(_met(k), _FOUND)
    least = tried.groupBy("query_id").agg(F.sum("n").alias("m"), F.min("score").alias("least")).where(F.col("m") >= k)
    beat = written(least.select("query_id", "least"), "beat")

    each = asked.select("dim", F.col("cut").alias("qcut"), "norms", F.posexplode("ids").alias("at", "query_id"))
    each = each.select("dim", "qcut", "at", "query_id", F.col("norms")[F.col("at")].alias("norm")).join(beat, "query_id", "left")
    score = F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))
    slack = F.when((score > 0) & (F.col("norm") > 0), score / F.col("norm")).otherwise(float("-inf"))
    known = each.groupBy("dim", "qcut").agg(F.array_sort(F.collect_list(F.struct("at", score.alias("s")))).alias("b"), F.min(slack).alias("slack"))
    q = written(q.join(known.select("dim", "qcut", F.col("b.s").alias("beat"), "slack"), ["dim", "qcut"]), "asked")
    # block numbers meet by dimension, unless no query of the block can reach that far; then each side's rows follow
    # the numbers of candidate blocks are dealt over salts, so that one dimension isn't one task
    salts = every.count() // PAIRS_A_SALT + 1
    blocks = every.select("dim", "number", "longest", F.pmod(F.xxhash64("number"), F.lit(salts)).alias("salt"))
    asking = q.select("dim", "qcut", "slack", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    pairs = blocks.join(asking, ["dim", "salt"]).where(F.col("longest") * (1 + 1e-9) >= F.col("slack")).drop("salt")
    met = pairs.drop("longest", "slack").join(q, ["dim", "qcut"]).join(every.drop("dim", "bucket", "cut", "norms"), "number")
    found = met.select("dim", "qids", "qcopies", "qflat", "beat", "longest", "ids", "copies", "flat").mapInArrow(_met(k), _FOUND)
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id", "n"))), 1, k).alias("t"))
    rows = F.flatten(F.transform("t", lambda x: F.array_repeat(x, F.least(x["n"], F.lit(k)).cast("int"))))  # a row for each copy
    best = best.select("query_id", F.slice(rows, 1, k).alias("t"))
    return best.select("query_id", F.posexplode("t").alias("at", "t")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "t.vec_id", (-F.col("t.m")).alias("score"))
