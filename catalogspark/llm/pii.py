"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, digits, plus-digit pairs, schemes and
identifier cues. From each anchor a small deterministic parser walks to the borders of the candidate and
validates it (label structure, octet range, Luhn, digit counts, IBAN remainder, user info of an address).
A region is parsed once per kind, so the work is linear in the text.

Defined results: null and empty texts have no spans; offsets are code points with exclusive ends; spans come
by kind in the order of KINDS, then by start; spans of different kinds may overlap; texts of any length are searched whole; empty tables give
none; repeated rows give equal spans; other columns stay, and a column of the same name as the new one is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from catalogspark.llm.packed import bounded_batches, release

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the anchors add: user info in an address, bank accounts, numbers behind a cue, street lines, secrets behind a cue or of a known form.
KINDS = (*BASE, "userinfo", "iban", "account", "street", "secret")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

# Cue words.
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "ssn", "social security")
STREET_CUES = (" Street", " Avenue", " Road", " Boulevard", " Lane", " Drive")
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "secret_key", "private_key", "bearer")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE_TAIL = re.compile(r"[ ().0-9-]*")
_IBAN = re.compile(r"[\s:#.]{0,6}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\s{1,2}(?i:number|no\.?|nr\.?))?[\s:#.=]{1,6}([0-9](?:[ -]?[0-9]){5,17})(?![0-9A-Za-z])")
_USERINFO = re.compile(r"([A-Za-z0-9._~%!$&'()*+,;=-]+:[A-Za-z0-9._~%!$&'()*+,;=-]+)@[A-Za-z0-9]")
_SECRET = re.compile(r"""["']?\s{0,3}(?:[:=]|(?<=[Bb]earer)\s)\s{0,3}["']?([A-Za-z0-9_+/.~=-]{8,})""")
_KEY = re.compile(r"[A-Za-z0-9-]{16,}")
#: Characters before a street cue that a street line can have at most, by its form.
STREET_REACH = 110
_STREET = re.compile(r"(?<![0-9A-Za-z])([0-9]{1,5}[A-Za-z]?(?: [A-Z][a-z]{1,30}){1,3})$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def anchors():
    """The automaton: every anchor string with the parser group it wakes."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
        a.add_word("+" + d, ("plus", 2))
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for group, cues in (("iban", IBAN_CUES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                a.add_word(form, (group, len(form)))
    for prefix in KEY_PREFIXES:
        a.add_word(prefix, ("key", len(prefix)))
    for cue in STREET_CUES:
        a.add_word(cue, ("street", len(cue)))
    a.make_automaton()
    return a


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """floor: nothing before it may be taken again."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    m = start < at and _LABEL.match(text, at + 1)
    if not m:
        return None
    end, dots = m.end(), 0
    while end < len(text) and text[end] == "." and (m := _LABEL.match(text, end + 1)):
        end, dots = m.end(), dots + 1
    return (start, end) if dots else None


def _ips(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Every four parts in a row within a run of digits and dots."""
    out, at, run = [], start, []
    for part in text[start:end].split("."):
        run = [*run, (at, part)] if part else []
        at += len(part) + 1
        if len(run) == 4:
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for _, p in run):
                out.append((run[0][0], run[3][0] + len(run[3][1])))
            run = []
    return out


def find_spans(text: str, automaton) -> list[tuple[str, int, int]]:
    """All spans of a text, base kinds first as listed, each by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    size = len(text)
    for last, (group, length) in automaton.iter(text):
        at, after = last - length + 1, last + 1
        if group == "digit":
            if at >= done["ip"]:
                done["ip"] = _DOTTED.match(text, at).end()
                found["ip"] += _ips(text, at, done["ip"])
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif group == "at":
            if m := _email(text, at, done["email"]):
                found["email"].append(m)
                done["email"] = m[1]
            else:
                # no later match starts at or before this sign
                done["email"] = max(done["email"], at + 1)
        elif group == "plus":
            if at >= done["phone"]:
                run = _PHONE_TAIL.match(text, after)
                tail = run[0].rstrip(" ().-")
                if len(tail) >= 2:
                    done["phone"] = after + len(tail)
                    if 8 <= 1 + sum(c.isdigit() for c in tail) <= 15:
                        found["phone"].append((at, done["phone"]))
        elif group == "scheme":
            if m := _USERINFO.match(text, after):
                found["userinfo"].append(m.span(1))
        elif group == "street":
            word_goes_on = after < size and text[after].isalnum()
            m = None if word_goes_on else _STREET.search(text[max(0, at - STREET_REACH) : at])
            if m:
                found["street"].append((max(0, at - STREET_REACH) + m.start(1), after))
        elif at and text[at - 1].isalnum():
            continue
        elif group == "secret":
            if at >= done["secret"] and (m := _SECRET.match(text, after)):
                done["secret"] = m.end()
                if any(c.isdigit() for c in m[1]):
                    found["secret"].append((m.start(1), m.start(1) + len(m[1].rstrip("."))))
        elif group == "key":
            if at >= done["secret"] and (m := _KEY.match(text, after)):
                done["secret"] = m.end()
                found["secret"].append((at, m.end()))
        else:
            m = (_IBAN if group == "iban" else _ACCOUNT).match(text, after)
            if m and m.start(1) >= done[group] and (group == "account" or iban_ok(m[1])):
                found[group].append(m.span(1))
                done[group] = m.end(1)
    return [(k, a, b) for k in KINDS for a, b in sorted(set(found[k]))]


@F.arrow_udf(SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    automaton = anchors()
    out = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py() or "", automaton)] for t in texts]
    release()
    return pa.array(out, to_arrow_type(SPANS))


def find_pii(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Add column ``into``: array<struct<kind, start, end>>."""
    bounded_batches(df.sparkSession)
    return df.withColumn(into, _spans(F.col(text)))


def _redacted_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


@F.arrow_udf(T.StringType())
def _redacted(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = [_redacted_text(t.as_py(), [(x["kind"], x["start"], x["end"]) for x in s.as_py() or []]) for t, s in zip(texts, spans, strict=True)]
    return pa.array(out, pa.string())


def redact(df: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Replace each span in ``text`` by its kind in brackets; overlapping spans count as one, named by the first."""
    return df.withColumn(text, _redacted(F.col(text), F.col(pii)))


@F.arrow_udf(T.StringType())
def _searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    automaton = anchors()
    for texts in batches:
        out = []
        for t in texts:
            text = t.as_py()
            out.append(_redacted_text(text, find_spans(text or "", automaton)))
        done = pa.array(out, pa.string())
        del out
        release()
        yield done


def redact_found(df: DataFrame, text: str = "text") -> DataFrame:
    """As ``redact(find_pii(df, text), text)`` without the spans: a task needs one worker instead of two, and texts go there and back once."""
    bounded_batches(df.sparkSession)
    return df.withColumn(text, _searched(F.col(text)))
