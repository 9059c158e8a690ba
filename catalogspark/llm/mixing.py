"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's share of the tokens is raised to an exponent and normalised. The exponent is bisected: from 1 (natural shares) down
to the first at which the entropy of the weights reaches a target share of the possible, or at which some source would repeat more often than the limit,
whichever comes first. The budget in tokens is such that the least repeated source is used ``least_epochs`` times.

Each source is a run of permutations of its documents, each in a seeded hash order; the last is cut where the budget ends. The
stream is dealt into blocks of ``block_tokens``: a block takes the same part of every source's run, so each block has the weights, and
orders its documents by hash. Running sums of tokens are exact without one task a source: hash ranges are summed
first and the sums of ranges carried into each.

Defined results: tokens are words, at least one a document (null and empty texts count one); a null source is a source of its own; repeated
rows (equal doc_id, source and text) are one unit, used together and at one position; one source gets weight 1; an empty table
gives no rows; the columns of docs stay, and those of the same name as a new one are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catalogspark.sources.shared import written

#: Documents of a hash range, about: the bound of a running sum's window.
RANGE_DOCS = 2000


@dataclass(frozen=True)
class Mix:
    exponent: float
    budget: float  # tokens
    entropy: float  # of the weights, over that of equal ones


def _at(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(entropy share, least and greatest of weight / natural share) at each exponent: a job over the sources, with sums that are exact in any order."""
    ends = sources.agg(F.count("*").alias("n"), F.min("share").alias("least"), F.max("share").alias("most")).head()
    if ends["n"] < 2:
        return [(1.0, 1.0, 1.0)] * len(exponents)
    exact = lambda c: F.sum(c.cast("decimal(38,20)"))
    each = sources.select("share", F.posexplode(F.array(*map(F.lit, exponents))).alias("i", "e")).withColumn("p", F.pow("share", F.col("e")))
    rows = {r["i"]: r for r in each.groupBy("i").agg(exact(F.col("p")).alias("z"), exact(F.col("p") * F.log("share")).alias("s")).collect()}  # a row an exponent
    out = []
    for i, e in enumerate(exponents):
        z, s = float(rows[i]["z"]), float(rows[i]["s"])
        # -sum(w log w) with w = share ** e / z; weight / share falls with the share
        out.append(((math.log(z) - e * s / z) / math.log(ends["n"]), ends["most"] ** (e - 1) / z, ends["least"] ** (e - 1) / z))
    return out


def find_mix(sources: DataFrame, tokens: float, target_entropy: float, max_repeat: float, least_epochs: float, rounds: int = 30, at_once: int = 5) -> Mix:
    """sources(share): shares of all tokens. The greatest exponent that meets the target within the limit, else the limit's.

    Bisection; a job looks at all middles that the next ``at_once`` halvings may need.
    """

    def fine(found: tuple[float, float, float]) -> bool:
        """Flat enough, or already at the limit."""
        h, lo, hi = found
        return h >= target_entropy or hi / lo * least_epochs >= max_repeat

    (natural,) = _at(sources, [1.0])
    if fine(natural):
        best = 1.0
    else:
        best, steep = 0.0, 1.0
        for done in range(0, rounds, at_once):
            steps = min(at_once, rounds - done)
            middles = [best + (steep - best) * i / (1 << steps) for i in range(1, 1 << steps)]
            met = dict(zip(middles, map(fine, _at(sources, middles)), strict=True))
            lo, hi = 0, 1 << steps
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if met[middles[mid - 1]] else (lo, mid)
            best, steep = best + (steep - best) * lo / (1 << steps), best + (steep - best) * hi / (1 << steps)
    ((h, lo, _),) = _at(sources, [best])
    return Mix(best, tokens * least_epochs / lo, h)


def plan_sources(docs: DataFrame, target_entropy: float = 0.97, max_repeat: float = 1.5, least_epochs: float = 1.0) -> tuple[DataFrame, Mix]:
    """docs(source, tokens) -> (one row a source: source, n_docs, n_tokens, share, weight, quota), and the mix."""
    sums = written(docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("n_tokens")), "sources")
    total = sums.agg(F.sum("n_tokens")).head()[0] or 0
    if not total:
        return sums.withColumns({c: F.lit(0.0) for c in ("share", "weight", "quota")}), Mix(1.0, 0.0, 1.0)
    shares = sums.withColumn("share", F.col("n_tokens") / total)
    mix = find_mix(shares, total, target_entropy, max_repeat, least_epochs)
    z = float(shares.agg(F.sum(F.pow("share", F.lit(mix.exponent)).cast("decimal(38,20)"))).head()[0])
    weight = F.pow("share", F.lit(mix.exponent)) / z
    quota = F.least(weight * mix.budget, F.col("n_tokens") * max_repeat)
    # rounding of the bisection may leave the least repeated source a fraction short of its whole permutations
    quota = F.greatest(quota, F.col("n_tokens") * least_epochs)
    return shares.withColumn("weight", weight).withColumn("quota", quota), mix


def _running(rows: DataFrame) -> DataFrame:
    """rows with ``before``: the tokens of the source's permutation that come before each row's."""
    of = ["source_key", "epoch", "range"]
    sums = rows.groupBy(*of).agg(F.sum("tokens").alias("t"))
    carried = sums.select(*of, (F.sum("t").over(W.partitionBy("source_key", "epoch").orderBy("range")) - F.col("t")).alias("carried"))
    inside = F.sum("tokens").over(W.partitionBy(*of).orderBy("h", "_unit1", "_unit2").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(carried, of).withColumn("before", F.col("carried") + F.col("inside"))


_NEW = ("tokens", "epoch", "block", "position")


def mix_sources(docs: DataFrame, target_entropy: float = 0.97, max_repeat: float = 1.5, least_epochs: float = 1.0, block_tokens: int = 1_000_000, seed: int = 11) -> DataFrame:
    """docs(doc_id, text, source, ...) -> its columns with tokens, epoch, block and position: one row each time a document is used."""
    n_words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    # two hashes name a unit: the rows that are equal in doc_id, source and text, used together
    named = docs.drop(*_NEW).withColumns({"_unit1": F.xxhash64("doc_id", "source", "text"), "_unit2": F.xxhash64("text", "source", F.lit(1), "doc_id")})
    units = named.groupBy("_unit1", "_unit2", "source").agg(F.sum(F.greatest(F.lit(1), n_words)).cast("bigint").alias("tokens"))
    units = written(units, "units")
    sources, mix = plan_sources(units, target_entropy, max_repeat, least_epochs)
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("source_key")
    plan = sources.select(key, "n_tokens", "quota", "n_docs")
    blocks = max(1, math.ceil((sources.agg(F.sum("quota")).head()[0] or 0) / block_tokens))
    rows = units.select("_unit1", "_unit2", "tokens", key).join(plan, "source_key")
    runs = F.ceil(F.col("quota") / F.col("n_tokens") - 1e-9).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), runs))))
    rows = rows.withColumn("h", F.xxhash64("_unit1", "_unit2", "epoch", F.lit(seed)))
    rows = rows.withColumn("range", F.floor(F.shiftrightunsigned("h", 32) / F.lit(2.0**32) * F.ceil(F.col("n_docs") / RANGE_DOCS)))
    # whole permutations, and of the last what begins within the budget
    used = _running(rows).withColumn("at", (F.col("epoch") - 1) * F.col("n_tokens") + F.col("before")).where(F.col("at") < F.col("quota") - 1e-6)
    block = F.least(F.lit(blocks - 1), F.floor(F.col("at") / F.col("quota") * blocks)).cast("bigint")
    used = used.select("_unit1", "_unit2", "tokens", "epoch", block.alias("block"), F.xxhash64("h", F.lit(seed + 1)).alias("mixed"))
    order = W.partitionBy("block").orderBy("mixed", "_unit1", "_unit2", "epoch")
    used = used.select("_unit1", "_unit2", "tokens", "epoch", "block", F.row_number().over(order).cast("bigint").alias("position"))
    return named.join(used, ["_unit1", "_unit2"]).drop("_unit1", "_unit2")
