"""Search beside ranking (see bm25.py): filters, query interpretation and column search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import vocabulary as V

def filtered(df: DataFrame, *, theme: str | None = None, org: str | None = None, fmt: str | None = None, cycle: str | None = None, licence: str | None = None, kind: str | None = None, since: str | None = None, region: str | None = None, inferred: bool = True) -> DataFrame:
    """Listing filters; substrings are literal and ASCII case-insensitive."""
    c = F.col
    tests = [
        theme and ((c("theme_top") == theme) | (c("theme_raw") == theme)),
        org and contains_literal(c("org_name"), org),
        fmt and F.array_contains("formats", fmt.upper()),
        cycle and (c("update_cycle") == cycle.upper()),
        licence and (c("license_code") == licence.upper()),
        kind and (c("list_type") == kind.upper()),
        since and (c("modified_date") >= since),
        region and F.exists("regions", lambda r: (r["code"] == region) & (F.lit(inferred) | (r["evidence"] == "EXPLICIT_SPATIAL"))),
    ]
    for t in tests:
        df = df if t is None else df.where(t)
    return df


def contains_literal(c: Column, what: str | Column) -> Column:
    return F.contains(F.lower(c), F.lower(F.lit(what) if isinstance(what, str) else what))


def matched_fields(fields: list[str], tokens: Column) -> Column:
    """Names of the fields that hold any of the tokens."""

    def held(f: str) -> Column:
        return F.when(F.exists(tokens, lambda t: F.contains(F.lower(F.col(f)), F.lower(t))), F.lit(f))

    return F.array_compact(F.array(*[held(f) for f in fields]))


AXES = {
    "region": (V.REGION_TOKENS, False),
    "format": (V.FORMAT_ALIASES, True),
    "updateCycle": (V.CYCLE_ALIASES, False),
    "listType": (V.TYPE_ALIASES, True),
}


def interpret(queries: DataFrame, axes: dict[str, tuple[dict, bool]] = AXES) -> DataFrame:
    """queries(query_id, text, skip array<string>) -> query_id, rest, one column an axis.

    Each token serves the first axis, in order, that knows it and is neither skipped nor taken; the rest stays text. So an axis has the first
    token that it knows and no earlier axis has: a minimum of positions, found without walking token by token.
    """
    whole = F.coalesce("text", F.lit(""))
    words = lambda c: F.array_remove(F.split(c, r"(?U)\s+"), "")
    q = queries.select("query_id", F.coalesce("skip", F.array().cast("array<string>")).alias("skip"), words(whole).alias("t"))
    if any(upper for _, upper in axes.values()):
        q = q.withColumn("u", words(F.upper(F.array_join("t", " "))))
    earlier: dict[str, set] = {}
    for a, (aliases, upper) in axes.items():
        tokens = F.col("u" if upper else "t")
        for b, names in earlier.items():
            if names & {x.upper() for x in aliases}:  # what an axis before has taken is taken
                at = F.col(f"at_{b}").cast("int")
                tokens = F.when(at > 0, F.concat(F.slice(tokens, 1, at - 1), F.array(F.lit("")), F.slice(tokens, at + 1, F.size("t")))).otherwise(tokens)
        earlier[a] = {x.upper() for x in aliases}
        first = F.get(F.array_intersect(tokens, F.array(*map(F.lit, aliases))), F.lit(0))
        q = q.withColumn(f"by_{a}", F.when(~F.array_contains("skip", a), first))
        q = q.withColumn(f"at_{a}", F.array_position(tokens, F.col(f"by_{a}")))
    # a token that an axis has taken goes blank, and blanks go: whole arrays are copied once an axis, no token is looked at alone
    q = q.withColumn("rest", F.col("t"))
    for a in axes:
        at = F.col(f"at_{a}").cast("int")
        q = q.withColumn("rest", F.when(at > 0, F.concat(F.slice("rest", 1, at - 1), F.array(F.lit("")), F.slice("rest", at + 1, F.size("t")))).otherwise(F.col("rest")))
    value = lambda a: F.try_element_at(F.create_map(*[F.lit(x) for kv in axes[a][0].items() for x in kv]), F.col(f"by_{a}"))
    return q.select("query_id", F.array_join(F.array_remove("rest", ""), " ").alias("rest"), *[value(a).alias(a) for a in axes])
