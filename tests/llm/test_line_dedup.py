import hashlib
import random

import pytest
from pyspark.sql import functions as F

from catalogspark.llm import line_dedup
from catalogspark.llm.queries_line_dedup import op11_line_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least_chars=20, least_docs=3):
    """(id, text) -> flags of kept lines."""
    order = lambda i: (i is not None, i or 0)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    held = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(order(i))
    gone = {k: max(ids) for k, ids in held.items() if len(k) >= least_chars and len(ids) >= least_docs}
    return {(i, t or ""): [not (key(x) in gone and order(i) < gone[key(x)]) for x in (t or "").split("\n")] for i, t in docs}


def table():
    rng = random.Random(5)
    lines = ["", "short", "Ünïcode KEY of twenty chars", "ünïcode key of twenty chars", "A line that many documents share", "  a LINE that many documents share\t", "only blanks \x85 and more here", " " * 30, "\x0bvertical tab before this line\r"]
    lines += [f"line number {i} of a smaller group" for i in range(30)]
    docs = [(rng.randrange(60), "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12)))) for _ in range(90)]
    docs += [(None, "A line that many documents share\nx"), (None, "another text of no id, twenty"), (70, None), (71, ""), (72, "\n\n"), (73, "\n".join(["a line that many documents share"] * 500) + "\n")]
    docs += [docs[0]] * 3 + [(100 + i, "another text of no id, twenty\nown " + str(i)) for i in range(4)]
    return docs


@pytest.mark.parametrize("hot", [1, 10_000])
def test_equals_brute_force(spark, monkeypatch, hot):
    """Hot keys judged in place and others streamed; repeated and null ids, copies, blank and empty lines, clashing extra columns."""
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot if hot > 1 else 40)
    monkeypatch.setattr(line_dedup, "HOT", 20)
    docs = table()
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as pos", "2 as h", "3 as keep", "4 as th").repartition(4)
    rows = line_dedup.with_keep(df).withColumn("kept", line_dedup.kept_text(line_dedup.whole_text(), F.col("keep"))).collect()
    assert len(rows) == len(docs)
    for r in rows:
        flags = [k % 2 == 0 for k, n in enumerate(r["keep"]) for _ in range(n)]
        assert flags == want[r.doc_id, r.text or ""]
        assert all(n > 0 for n in r["keep"][1:-1]) and (r.pos, r.h, r.th) == (1, 2, 4)
        assert r.kept == "\n".join(x for x, f in zip((r.text or "").split("\n"), flags, strict=True) if f)
    bitmaps = line_dedup.keep_bitmaps(df)
    assert bitmaps.count() == len({(i, t or "") for i, t in docs})


def test_query(spark, tmp_path):
    docs = table()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    flags = brute(docs)
    for i, t in docs:
        f = flags[i, t or ""]
        kept = "\n".join(x for x, k in zip((t or "").split("\n"), f, strict=True) if k)
        want.append((i, len(f), f.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op11_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_plan_is_native_and_streams_sorted_ranges(spark):
    docs = spark.createDataFrame(table(), "doc_id long, text string")
    plan = line_dedup.with_keep(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert "rangepartitioning(h" in plan
    window = plan[plan.index("Window") :]
    assert "Exchange" not in window[: window.index("rangepartitioning") - 40].replace("Exchange range", "")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.with_keep(docs).count() == 0 and line_dedup.keep_bitmaps(docs).count() == 0
