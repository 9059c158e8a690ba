import csv
import hashlib
import random

import pytest

from catalogspark.sources import catalog as src


def make(path, rows, encoding="utf-8", end="\r\n", bom=False):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write("﻿" if bom else "")
        csv.writer(f, lineterminator=end).writerows(rows)


@pytest.fixture
def small_splits(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "900"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


@pytest.mark.parametrize("encoding,end,bom", [("utf-8", "\n", True), ("utf-8", "\r\n", False), ("cp949", "\r\n", False)])
def test_splits_read_as_one(spark, small_splits, tmp_path, encoding, end, bom):
    """Quotes, commas and line ends inside fields, over many splits and three files; row numbers are those of reading from front to back."""
    rng = random.Random(end)
    field = lambda: "".join(rng.choice(['"', ",", "\n", "a", "한", "글", " ", "xyz"]) for _ in range(rng.randrange(1, 30)))
    header = ["번호", "na,me", 'quo"te', "d"]
    tables = [[[f"k{f}-{i}", field(), field(), "\n" * 1500 if i == 5 else field()] for i in range(n)] for f, n in enumerate((120, 0, 60))]
    for f, t in enumerate(tables):
        make(f"{tmp_path}/part{f}.csv", [header, *t], encoding, end, bom)
    with open(f"{tmp_path}/part2.csv", "ab") as f:
        f.write(b"\n\r\n")  # blank lines are no rows
    df = src.read_csv(spark, f"{tmp_path}/*.csv", "CP949" if encoding == "cp949" else "UTF-8")
    assert df.columns == [*header, "row_no"]
    assert spark.read.text(f"{tmp_path}/*.csv").rdd.getNumPartitions() > 10
    got = [tuple(r) for r in df.orderBy("row_no").collect()]
    want = [(*r, n + 2) for n, r in enumerate(r for t in tables for r in t)]
    assert [(r[0], r[-1]) for r in got] == [(r[0], r[-1]) for r in want]
    assert got == want


def test_unlike_headers_stop(spark, tmp_path):
    make(f"{tmp_path}/a.csv", [["a", "b"], ["1", "2"]])
    make(f"{tmp_path}/b.csv", [["a", "c"], ["1", "2"]])
    with pytest.raises(src.SourceError):
        src.read_csv(spark, f"{tmp_path}/*.csv")


def test_manifest_streams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "_CHUNK", 7)
    texts = [b"", b"a", b"a\n", b"a\r\nb\rc\n\n", b"123456\r\n12345\r\n", b"123456\r", b"x\n" * 10_000]
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_bytes(t)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256, r.lines) for r in src.manifest(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {f"f{i}.csv": (len(t), hashlib.sha256(t).hexdigest(), len(t.decode().splitlines())) for i, t in enumerate(texts)}
