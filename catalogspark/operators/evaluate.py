"""Ranking evaluation and the golden set's life."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from re import _constants, _parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from catalogspark.operators.bm25 import decided, scored, terms_of
from catalogspark.sources.shared import written

GRAM = 8


def relevant_by_passage(passages: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """passages(query_id, text) -> query_id, doc: the documents that hold all words of the passage in its order, without gaps.

    Both sides meet by a hash of the passage's first GRAM words (all of a shorter one); the whole passage is then compared.
    Passages without words are in no document.
    """
    p = passages.select("query_id", terms_of(F.col("text")).alias("p")).where(F.size("p") > 0)
    p = p.withColumn("m", F.least(F.size("p"), F.lit(GRAM))).withColumn("h", F.xxhash64(F.array_join(F.slice("p", 1, F.col("m")), " ")))
    t = docs.select(F.col(key).alias("doc"), terms_of(F.col(text)).alias("t"))
    out = None
    for m in sorted(r["m"] for r in p.select("m").distinct().collect()) or [1]:  # at most GRAM lengths
        keys = p.where(F.col("m") == m)
        grams = F.transform(F.sequence(F.lit(1), F.size("t") - (m - 1)), lambda i: F.xxhash64(F.array_join(F.slice("t", i, F.lit(m)), " ")))  # noqa: B023
        met = t.where(F.size("t") >= m).select("doc", F.explode(F.array_distinct(grams)).alias("h")).join(keys.select("query_id", "h"), "h").select("query_id", "doc")
        out = met if out is None else out.unionByName(met)
    line = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return out.join(p.select("query_id", "p"), "query_id").join(t, "doc").where(F.contains(line("t"), line("p"))).select("query_id", "doc").distinct()


#: Characters beyond ASCII that match an ASCII letter where case is ignored, and these letters.
FOLDED = ("ſKİı", "skii")


def _held(tree) -> list[str]:
    best, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is _constants.LITERAL and (arg < 128 or chr(arg).lower() == chr(arg).upper()):
            run += chr(arg).lower()
            continue
        if op is _constants.AT:
            continue
        found = [[run]] if run else []
        run = ""
        if op is _constants.SUBPATTERN:
            found.append(_held(arg[3]))
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and arg[0] > 0:
            found.append(_held(arg[2]))
        elif op is _constants.BRANCH:
            each = [_held(t) for t in arg[1]]
            found.append([w for words in each for w in words] if all(each) else [])
        best = max([best, *found], key=lambda words: min(map(len, words), default=0))
    return best


def literals_of(pattern: str) -> list[str]:
    """Texts in lower case, of which every match of the pattern holds one or more; none where the pattern is read unalike by Java and Python, or tells no such."""
    if r"\0" in pattern or "&&" in pattern or re.search(r"\[[^\]]*\[", re.sub(r"\\.", "", pattern)):  # octal numbers, sets within sets
        return []
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        try:
            return _held(_parser.parse(pattern))
        except (re.error, Warning, OverflowError, RecursionError):
            return []


def _asking(words: dict[str, list[int]]):
    """The numbers of the queries that have one of the words in a text, by one pass over it."""

    @F.pandas_udf("array<int>")
    def asking(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word, numbers in words.items():
            machine.add_word(word, numbers)
        machine.make_automaton()
        for part in texts:
            yield part.map(lambda t: sorted({n for _, numbers in machine.iter(t) for n in numbers}))

    return asking


def relevant_by_pattern(queries: DataFrame, docs: DataFrame, key: str, title: str, regions: str | None = None, block: int = 1000) -> DataFrame:
    """queries(query_id, pattern, region where there is one) -> query_id, doc: the documents whose title matches the pattern.

    With ``regions``, a column of region codes, a query with a region takes only documents that have its code. Queries are a stated set, met in
    blocks. Of each pattern the literals that every match holds are taken; one pass over a title finds all literals of a block, and only the
    patterns of those are run. Patterns without such literals are run on every title. Null patterns and titles match nothing.
    """
    spark = queries.sparkSession
    region = F.col("region") if "region" in queries.columns else F.lit(None).cast("string")
    asked = queries.select("query_id", "pattern", region.alias("region")).where("pattern is not null")
    blocks = max(1, -(-asked.count() // block))
    numbered = asked.withColumn("b", F.pmod(F.xxhash64("query_id", "pattern"), F.lit(blocks)))
    areas = F.col(regions) if regions else F.lit(None).cast("array<string>")
    titles = docs.select(F.col(key).alias("doc"), F.col(title).alias("title"), areas.alias("areas"))
    out = None
    for b in range(blocks):
        rows = numbered.where(F.col("b") == b).drop("b").collect()  # a block
        words: dict[str, list[int]] = {}
        for n, r in enumerate(rows):
            for w in literals_of(r["pattern"]):
                words.setdefault(w, []).append(n)
        found = {n for numbers in words.values() for n in numbers}
        block_of = lambda keep: F.broadcast(spark.createDataFrame([(n, *r) for n, r in enumerate(rows) if keep(n)], T.StructType([T.StructField("n", T.IntegerType()), *asked.schema.fields])))  # noqa: B023, E731
        parts = []
        if found:
            folded = F.lower(F.translate(F.coalesce("title", F.lit("")), *FOLDED))
            hit = titles.withColumn("n", F.explode(_asking(words)(folded)))
            parts.append(hit.join(block_of(lambda n: n in found), "n").where("title rlike pattern"))  # noqa: B023
        if len(found) < len(rows) or not rows:
            parts.append(titles.join(block_of(lambda n: n not in found), F.expr("title rlike pattern")))  # noqa: B023
        for part in parts:
            part = part.where(F.lit(regions is None) | F.col("region").isNull() | F.array_contains("areas", F.col("region"))).select("query_id", "doc")
            out = part if out is None else out.unionByName(part)
    return out


def ranked_in_region(queries: DataFrame, listings: DataFrame, weights: dict[str, float], k: int = 10) -> DataFrame:
    """queries(query_id, text, region), listings(record_id, regions array<struct<code, ...>>, texts) -> query_id, rank, doc, score: the first k of each query in its region,
    or anywhere without one; whether all units are asked for is decided within the region."""
    found = scored(queries.select("query_id", "text"), listings, "record_id", weights)
    areas = listings.select(F.col("record_id").alias("doc"), F.transform("regions", lambda r: r["code"]).alias("areas"))
    near = found.join(queries.select("query_id", "region"), "query_id").join(areas, "doc").where(F.col("region").isNull() | F.array_contains("areas", F.col("region")))
    kept = decided(written(near.select("query_id", "n_units", "doc", "hit", "score"), "in-region"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc", "score")


def rank_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """ranked(query_id, rank, doc), relevant(query_id, doc) -> per query: relevant, retrieved, hits, dcg, idcg.

    Precision divides by k always and recall by min(relevant, k); means skip queries without relevant documents.
    """
    hit = ranked.join(relevant.distinct().withColumn("hit", F.lit(1)), ["query_id", "doc"], "left")
    gain = F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    got = hit.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("retrieved"), F.count("hit").alias("hits"), F.sum(gain).alias("dcg"))
    rel = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    out = got.join(rel, "query_id", "full_outer").fillna(0, ["retrieved", "hits", "relevant"]).fillna(0.0, ["dcg"])
    out = out.withColumn("idcg", F.when(F.col("relevant") > 0, ideal).otherwise(0.0))
    return out.withColumns({"precision": F.col("hits") / k, "recall": F.try_divide(F.col("hits").cast("double"), F.least("relevant", F.lit(k))), "ndcg": F.try_divide("dcg", "idcg")})


def mean_metrics(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries, means over those with relevant documents and the share of these with a hit, share of all without any result."""
    m = queries.select("query_id").join(metrics, "query_id", "left")
    has = F.col("relevant") > 0
    means = [F.avg(F.when(has, F.col(x))).alias(x) for x in ("precision", "recall", "ndcg")]
    success = F.avg(F.when(has, (F.col("hits") > 0).cast("int"))).alias("success_rate")
    return m.agg(F.count("*").alias("queries"), F.count_if(has).alias("judged"), *means, success, F.avg((F.coalesce("retrieved", F.lit(0)) == 0).cast("int")).alias("zero_rate"))


def _judged(verdict: str, auto: str):
    return F.coalesce(F.nullif(F.col(verdict), F.lit("")) == "R", F.col(auto), F.lit(False))


def resolve_verdicts(candidates: DataFrame, additional: DataFrame) -> DataFrame:
    """candidates(query_id, doc, auto, verdict) + additional(query_id, doc): a human verdict wins over the automatic one, which a blank one leaves."""
    kept = candidates.where(_judged("verdict", "auto")).select("query_id", "doc")
    return kept.union(additional.select("query_id", "doc")).distinct()


def promoted(candidates: DataFrame, additional: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The next golden set: candidates(query_id, rank, doc, auto, verdict), additional(query_id, place, doc) -> query_id, relevant, excluded, reviewed, missing.

    relevant is the candidates judged so, by rank, and then those that people added, without what is there already; excluded the other candidates.
    reviewed counts verdicts, blank ones included, and additions that were new; missing holds the relevant ids that docs no longer has. Queries
    without candidates are left out. A query has its export's candidates (golden_candidates: at most 20) and what people added.
    """
    judged = _judged("verdict", "auto")
    shown = candidates.select("query_id", F.lit(0).alias("turn"), F.col("rank").cast("bigint").alias("place"), "doc", judged.alias("relevant"), F.col("verdict").isNotNull().alias("seen"))
    new = additional.join(candidates.where(judged).select("query_id", "doc").distinct(), ["query_id", "doc"], "left_anti").groupBy("query_id", "doc").agg(F.min("place").cast("bigint").alias("place"))
    new = new.join(candidates.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.lit(1).alias("turn"), "place", "doc", F.lit(True).alias("relevant"), F.lit(True).alias("seen"))
    known = docs.select(F.col(key).alias("doc")).distinct().withColumn("known", F.lit(True))
    rows = shown.unionByName(new).join(known, "doc", "left")
    of = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "place", "doc")))), lambda r: r["doc"])
    return rows.groupBy("query_id").agg(
        of(F.col("relevant")).alias("relevant"), of(~F.col("relevant")).alias("excluded"), F.count_if("seen").alias("reviewed"), of(F.col("relevant") & F.col("known").isNull()).alias("missing")
    )


def promotion_summary(golden: DataFrame, snapshot: str) -> DataFrame:
    """One row about promoted(): version, snapshot, queries, relevant, reviewed verdicts, whether people reviewed at all, missing ids."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    row = golden.agg(F.count("*").alias("queries"), total(F.size("relevant")).alias("relevant"), total("reviewed").alias("reviewed_verdicts"), total(F.size("missing")).alias("missing"))
    return row.select(F.lit("v1").alias("version"), F.lit(snapshot).alias("snapshot"), "queries", "relevant", "reviewed_verdicts", (F.col("reviewed_verdicts") > 0).alias("human_reviewed"), "missing")


def drifted(relevant: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Relevant ids that the snapshot no longer has."""
    return relevant.join(docs.select(F.col(key).alias("doc")), "doc", "left_anti")


def enriched_cases(cases: DataFrame, listings: DataFrame, key: str, snapshot: str) -> DataFrame:
    """cases(case_id, case_snapshot, candidates array<struct<id, role>>) -> a row a candidate with presence and a warning for another snapshot."""
    rows = cases.select("case_id", "case_snapshot", F.posexplode("candidates").alias("at", "c")).select("case_id", "case_snapshot", "at", F.col("c.id").alias("id"), F.col("c.role").alias("role"))
    out = rows.join(listings.withColumn("present", F.lit(True)), rows["id"] == F.col(key), "left").drop(key)
    return out.withColumns({"present": F.coalesce("present", F.lit(False)), "stale": ~F.col("case_snapshot").eqNullSafe(F.lit(snapshot))})
