"""WARC archives: write captures, read records, and assemble each transaction into one nested row.

A page becomes a request, a response (or a revisit of an equal payload) and a metadata record; the latter two name the
response in WARC-Concurrent-To. Which page answers for a payload is found on digests alone. Tasks write archives of bounded size to the
shared folder, a gzip member a record, and report their names; only the names of tasks that succeeded are listed, so what a lost or
repeated task left behind is never read. Archives are read as streams, a record at a time.

Assembly uses identifiers only: WARC-Concurrent-To links in either direction, and over one record in between, lead each record
to its response or revisit; records that no link leads to one are left out of the captures. Records of one identifier are copies: they are
counted first, linked once, and their capture comes as often as its response occurs.

Defined results: null html is an empty payload; a null url is empty; a null page_id is written as such and read as null;
rows with equal page_id, url and payload give as many captures; revisits refer to the smallest page_id with the payload (null
ids are never the smallest; if all are null, all are responses); an archive of no rows reads as none; other columns are ignored; a payload of
any length is one record, which must fit a row.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.packed import bounded_batches, lean, make_folder

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
#: Compressed bytes from which a task goes on in another archive.
FILE_BYTES = 32_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = ("request", "response", "revisit", "metadata", "warcinfo", "resource", "conversion", "continuation")


def _id(page_id: int | None, url: str, digest: str, kind: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest[:16]}:{zlib.crc32(url.encode()):08x}:{kind}>"


def _record(kind: str, ident: str, block: bytes, *headers: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", "WARC-Date: 2024-01-01T00:00:00Z", *headers, f"Content-Length: {len(block)}", "", ""]
    return b"".join(["\r\n".join(head).encode(), block, b"\r\n\r\n"])


def _records_of_page(page_id: int | None, url: str, html: bytes, digest: str, first: dict | None) -> list[bytes]:
    revisit = first is not None and page_id != first["page_id"]
    response = _id(page_id, url, digest, "response")
    uri, beside = f"WARC-Target-URI: {url}", f"WARC-Concurrent-To: {response}"
    host = url.split("://", 1)[-1].split("/", 1)[0] if "://" in url else ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    refers = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(first['page_id'], first['url'], digest, 'response')}"] if revisit else []
    asked = f"GET {url} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    fields = f"page_id: {'' if page_id is None else page_id}\r\n".encode()
    return [
        _record("request", _id(page_id, url, digest, "request"), asked, uri, beside, "Content-Type: application/http; msgtype=request"),
        _record("revisit" if revisit else "response", response, http + (b"" if revisit else html), uri, f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", *refers),
        _record("metadata", _id(page_id, url, digest, "metadata"), fields, uri, beside, "Content-Type: application/warc-fields"),
    ]


def _archived(base: str, file_bytes: int):
    """Batches of pages -> the names of the archives that this attempt of a task has written in full."""

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(base)
        out = path = None
        names = []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, held = fs.open_output_stream(path, compression=None), 0
                for r in _records_of_page(*[x.as_py() for x in row]):
                    held += out.write(gzip.compress(r, 4, mtime=0))
                if held >= file_bytes:
                    out.close()
                    names.append(path.rsplit("/", 1)[1])
                    out = None
        if out is not None:
            out.close()
            names.append(path.rsplit("/", 1)[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return run


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """pages(page_id, url, html) -> gzipped archives in path, listed in path/_archives."""
    bounded_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("bigint"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    again = p.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(least.alias("first"), F.count("*").alias("m")).where("m > 1")
    p = p.join(again.select("digest", "first"), "digest", "left").select("page_id", "url", "html", "digest", "first")
    p.mapInArrow(lean(_archived(make_folder(path), file_bytes)), "name string").write.parquet(f"{path}/_archives")


RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, payload_digest string, http string, payload binary, payload_bytes bigint, payload_sha256 string"
_TYPES = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string()]
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def _records(stream):
    """The records of an archive, one after the other; only one is held."""
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record where {line[:40]!r} stands")
        names: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.partition(b":")
            names.setdefault(name.decode("utf-8", "replace").lower(), []).append(value.strip(b" \t\r\n").decode("utf-8", "replace"))
        size = int(names["content-length"][0])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        stream.read(4)
        yield names, block


def _row(names: dict[str, list[str]], block: bytes, payload_of: tuple) -> tuple:
    one = lambda n: names.get(n, [None])[0]
    http, payload = "", block
    if (one("content-type") or "").startswith("application/http"):
        cut = block.index(b"\r\n\r\n") + 4
        http, payload = block[:cut].decode("utf-8", "replace"), block[cut:]
    kept = payload if one("warc-type") in payload_of else None
    return (one("warc-record-id"), one("warc-type"), names.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-payload-digest"), http, kept, len(payload), hashlib.sha256(payload).hexdigest())


def _read(payload_of: tuple):
    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
                    plain = io.BufferedReader(raw)
                    stream = gzip.GzipFile(fileobj=plain) if plain.peek(2)[:2] == b"\x1f\x8b" else plain
                    for names, block in _records(stream):
                        rows.append(_row(names, block, payload_of))
                        held += len(rows[-1][7] or b"") + 500
                        if held > 8_000_000:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return run


def read_warc(spark: SparkSession, path: str, payload_of: tuple = TYPES) -> DataFrame:
    """One row a record of the archives that write_warc listed in path. Payloads are hashed as they are read; those of types out of payload_of are then let go."""
    names = spark.read.schema("name string").parquet(f"{path}/_archives")
    return read_archives(names.select(F.concat(F.lit(f"{path}/"), "name").alias("uri")), payload_of)


def read_archives(uris: DataFrame, payload_of: tuple = TYPES) -> DataFrame:
    """One row a record of the archives, gzipped or not, that the only column of uris names."""
    n = int(uris.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return uris.repartition(n).mapInArrow(lean(_read(payload_of)), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: response struct, requests and metadata arrays. records is read several times: pass a table, not the reading of archives."""
    fields = [c for c in records.columns if c != "record_id"]
    once = records.groupBy("record_id").agg(*[F.first(c).alias(c) for c in fields], F.count("*").alias("copies"))
    ids = records.select("record_id", "type", "concurrent_to")
    main = F.col("type").isin("response", "revisit")
    said = ids.where(F.size("concurrent_to") > 0).select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    link = said.union(said.select("b", "a")).distinct()
    ends = ids.where(main).select(F.col("record_id").alias("b")).distinct()
    near = link.join(ends, "b").select("a", F.col("b").alias("capture"))
    far = link.join(near.withColumnsRenamed({"a": "b"}), "b").select("a", "capture").join(near.select("a"), "a", "left_anti")
    of = near.union(far).join(ends.withColumnRenamed("b", "a"), "a", "left_anti").distinct().withColumnRenamed("a", "record_id")
    rest = once.where(~main).join(of, "record_id")
    side = rest.groupBy("capture").agg(*[F.collect_list(F.when(F.col("type") == t, F.struct("record_id", "target_uri", "http", "payload"))).alias(n) for t, n in (("request", "requests"), ("metadata", "metadata"))])
    named = [c for c in fields if c != "concurrent_to"]
    response = once.where(main).select(F.col("record_id").alias("capture"), F.struct("record_id", *named).alias("response"), "copies")
    whole = response.join(side, "capture", "left")
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies", "copy")
