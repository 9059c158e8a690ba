import gzip
import uuid
from hashlib import sha256

from catalogspark.llm.warc import RECORD, assemble, read_archives, read_warc, write_warc
from catalogspark.sources.shared import new_path

EVIL = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 5


def test_round_trip(spark):
    rows = [(5, "http://a/x", EVIL), (3, "http://b/\r\nX: y", EVIL), (9, None, EVIL), (1, "http://c", None), (2, "http://d", "short"), (4, "http://d", "short"), (7, "u", "é" * 200), (7, "u", "é" * 200), (None, "n", "zz" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as type").repartition(2)
    path = new_path(spark, "t")
    write_warc(df, path)
    got = assemble(read_warc(spark, path)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        pid = r.metadata[0].payload.decode().split(": ")[1].strip()
        by.setdefault(pid, []).append(r)
        assert len(r.requests) >= 1 and len(r.metadata) >= 1
    assert by["3"][0].response.type == "response" and by["3"][0].response.payload.decode() == EVIL
    assert by["5"][0].response.type == by["9"][0].response.type == "revisit" and by["5"][0].response.refers_to == by["3"][0].response.record_id
    assert {by[k][0].response.type for k in ("1", "2", "4")} == {"response"} and by["1"][0].response.payload == b""
    assert len(by["7"]) == 2 and all(sha256(r.response.payload).hexdigest() == sha256(("é" * 200).encode()).hexdigest() for r in by["7"])
    write_warc(df.limit(0), empty := new_path(spark, "t"))
    assert assemble(read_warc(spark, empty)).count() == 0


def test_links_either_way_and_through_a_request(spark):
    i = lambda: f"<urn:uuid:{uuid.uuid4()}>"
    resp, req, meta, alone = i(), i(), i(), i()
    rows = [(resp, "response", [req], None, "u", None, "", b"x"), (req, "request", [], None, "u", None, "", b""), (meta, "metadata", [req], None, "u", None, "", b"m"), (alone, "metadata", [], None, "u", None, "", b"n")]
    rows = [(*r, len(r[-1]), sha256(r[-1]).hexdigest()) for r in rows]
    got = assemble(spark.createDataFrame(rows, RECORD)).collect()
    assert len(got) == 1 and [r.record_id for r in got[0].requests] == [req] and [r.record_id for r in got[0].metadata] == [meta]


def test_few_very_long_pages_go_to_several_archives(spark):
    size = 12_000_000
    df = spark.range(9).selectExpr("id as page_id", f"concat('http://h/', id) as url", f"repeat(cast(id % 5 as string), {size}) as html").coalesce(1)
    write_warc(df, path := new_path(spark, "t"), file_bytes=20_000)
    names = [r.name for r in spark.read.parquet(f"{path}/_archives").collect()]
    assert len(names) > 2
    got = {r.response.record_id.split(":")[2]: r.response for r in assemble(read_warc(spark, path, payload_of=("metadata",))).collect()}
    assert len(got) == 9 and {k for k, r in got.items() if r.type == "revisit"} == {"5", "6", "7", "8"}
    assert all(r.payload is None and r.payload_bytes == size and r.payload_sha256 == sha256(k.encode() * size).hexdigest() for k, r in got.items() if r.type == "response")
    assert read_warc(spark, path).count() == 27


def test_a_third_of_all_rows_is_one_page(spark):
    df = spark.range(900).selectExpr("if(id % 3 = 0, -1, id) as page_id", "'http://h/' as url", "if(id % 3 = 0, repeat('x', 200), concat('page ', id)) as html")
    write_warc(df, path := new_path(spark, "t"))
    got = assemble(read_warc(spark, path)).collect()
    assert len(got) == 900 and max(len(r.requests) for r in got) == 1
    assert sum(r.response.record_id.startswith("<urn:page:-1:") for r in got) == 300


def test_archives_of_others(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one + one) + gzip.compress(one))
    uris = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.warc", "b.warc.gz")], "uri string")
    assert [r.payload for r in read_archives(uris).collect()] == [b"abc"] * 5
