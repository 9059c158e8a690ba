"""Gazetteer match: which regions a row names, in which of its ranked texts, how surely."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions import vocabulary as V
from catalogspark.functions.text import ttrim


def match_gazetteer(evidence: dict[str, tuple[Column, float]], gazetteer=V.REGIONS, penalty: float = V.AMBIGUOUS_PENALTY) -> Column:
    """array<struct<code, name, evidence, confidence>> in order of first evidence, then of the gazetteer.

    Per code the first text that holds an alias counts; ambiguous aliases are tried where no plain one is found.
    """
    names = list(evidence)
    texts = [F.coalesce(c, F.lit("")) for c, _ in evidence.values()]
    hits = []
    for order, (code, name, plain, unsure) in enumerate(gazetteer):
        is_in = lambda t, aliases: F.coalesce(*[F.when(F.contains(t, F.lit(a)), True) for a in aliases], F.lit(False)) if aliases else F.lit(False)
        at = None
        for rank, ((_, sure), t) in reversed(list(enumerate(zip(evidence.values(), texts, strict=True)))):
            held = lambda p, rank=rank, sure=sure, order=order, code=code, name=name: F.struct(
                F.lit(rank).alias("rank"), F.lit(order).alias("order"), F.lit(code).alias("code"), F.lit(name).alias("name"), F.lit(names[rank]).alias("evidence"), F.lit(round(sure - p, 2)).alias("confidence")
            )
            usable = ttrim(t) != "-"
            here = F.when(usable & is_in(t, plain), held(0.0)).when(usable & is_in(t, unsure), held(penalty))
            at = here if at is None else F.coalesce(here, at)
        hits.append(at)
    found = F.array_sort(F.array_compact(F.array(*hits)))
    return F.transform(found, lambda x: F.struct(x["code"], x["name"], x["evidence"], x["confidence"]))
