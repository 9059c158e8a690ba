"""Column functions of the normalization rules."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions import vocabulary as V


def ttrim(c: Column) -> Column:
    """Trim of any Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def empty_to_null(c: Column, sentinels=V.EMPTY) -> Column:
    t = ttrim(c)
    return F.when(~t.isin(*sentinels), t)


def blank_to_null(c: Column) -> Column:
    return F.nullif(ttrim(c), F.lit(""))


def safe_int(c: Column) -> Column:
    """Whole number with thousands commas, else null."""
    return F.replace(empty_to_null(c), F.lit(","), F.lit("")).try_cast("bigint")


def tokens(c: Column, pattern: str, upper: bool = False) -> Column:
    """Ordered distinct trimmed tokens; null and empty sentinels give none."""
    parts = F.transform(F.split(F.coalesce(empty_to_null(c), F.lit("")), pattern), lambda x: F.upper(ttrim(x)) if upper else ttrim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def split_first(c: Column, sep: str = " - ") -> tuple[Column, Column]:
    """What stands before and after the first separator; null after where there is none."""
    parts = F.split(c, sep, 2)
    return blank_to_null(F.get(parts, F.lit(0))), blank_to_null(F.get(parts, F.lit(1)))


def coded(c: Column, codes: dict, other: str = "OTHER") -> Column:
    """Dictionary lookup of the trimmed value; null counts as empty, unknown as other."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(ttrim(c), F.lit(""))), F.lit(other))


def norm_title(c: Column) -> Column:
    """Family title: brackets and digits to space, then separators and date suffixes removed."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), V.TITLE_BRACKETS, " ")
    return F.regexp_replace(F.regexp_replace(t, V.TITLE_DIGITS, " "), f"(?U){V.TITLE_SEPARATORS}", "")


def title_tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"(?U){V.TITLE_TOKENS}"), lambda t: t != "")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it stands."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def _latin() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their bare letters, by Unicode's canonical decomposition; then the combining marks, which go."""
    marked = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c) == chr(c).lower()}
    marked = {c: bare for c, bare in marked.items() if bare != c and "a" <= bare <= "z"}
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(marked.values())


def latin_folded(c: Column) -> Column:
    """Lower case without Latin diacritics."""
    low = F.lower(c)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, *_latin()))


def hmac_sha256(key: bytes, c: Column) -> Column:
    """Lower-case hex of HMAC-SHA256 of a text, by the definition of HMAC."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = key.ljust(64, b"\0")
    inner = F.concat(F.lit(bytearray(x ^ 0x36 for x in pad)), F.encode(c, "UTF-8"))
    return F.sha2(F.concat(F.lit(bytearray(x ^ 0x5C for x in pad)), F.unhex(F.sha2(inner, 256))), 256)


def short_id(*cols: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, length)
