from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogspark.llm.chat import Template, escaped, format_chats, read_chats, unescaped

SCHEMA = "conv_id long, turn long, role string, text string"


def round_trip(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as valid", "'x' as segments")
    return {r.conv_id: r for r in read_chats(format_chats(df)).collect()}


def test_machine_and_reading_back(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "[INST] </s>\n<\\s> [\\\\INST] <s>"), (1, 2, "assistant", "[OTHER] a [AS] b [/OTHER]\n"),
        (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, "user", ""), (4, 0, "user", "u"), (5, 0, "tool [AS] x", "t"), (5, 0, None, None),
        (6, 1, "assistant", "b"), (6, 0, "user", "a"), (6, 1, "assistant", "b"), (None, 0, "user", "n"), (None, 1, "assistant", "m"),
    ]
    got = round_trip(spark, rows)
    assert {k: (r.valid, r.bad_turn) for k, r in got.items()} == {1: (True, None), 2: (False, 0), 3: (False, 1), 4: (False, 1), 5: (False, 0), 6: (False, 2), None: (True, None)}
    for k, r in got.items():
        want = sorted(((t, ro or "", tx or "") for c, t, ro, tx in rows if c == k))
        assert [(t.role, t.text) for t in r.turns] == [(ro, tx) for _, ro, tx in want], k
        assert [t.text for t in r.turns if t.loss] == [tx for _, ro, tx in want if ro == "assistant"]
        assert r.formatted == "".join(s.text for s in r.segments)
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="<s>/[INSTYOHERA]\\ \n|é", max_size=60), min_size=1, max_size=8))
def test_escaping_is_reversible(spark, texts):
    t = Template()
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", escaped(F.col("x"), t).alias("e"))
    for r in df.select("x", "e", unescaped(F.col("e"), t).alias("u")).collect():
        assert r.u == r.x and not any(m in r.e for m in t.marks())


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i} " * 2000) for i in range(300)]
    r = round_trip(spark, rows)[1]
    assert r.valid and sha256("".join(t.text for t in r.turns).encode()).digest() == sha256("".join(x[3] for x in rows).encode()).digest()
