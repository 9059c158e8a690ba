import struct
import sys
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalogspark.llm.gif import _blocks, load_gif, lzw_decoded, lzw_encoded, read_gif, store_gif, write_gif


def lzw_plain(samples: bytes, min_size: int = 8, clear_when_full: bool = True) -> bytes:
    """A plain table-driven encoder, as any GIF writer has."""
    clear, out, bits, n = 1 << min_size, bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits |= code << n
        n += width
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8

    def fresh():
        return {bytes([i]): i for i in range(clear)}, clear + 2, min_size + 1

    table, nxt, width = fresh()
    put(clear, width)
    word = b""
    for s in samples:
        longer = word + bytes([s])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        if nxt < 4096:
            table[longer] = nxt
            nxt += 1
            if nxt - 1 == 1 << width and width < 12:
                width += 1
        elif clear_when_full:
            put(clear, width)
            table, nxt, width = fresh()
        word = bytes([s])
    if word:
        put(table[word], width)
        if nxt == 1 << width and width < 12:
            width += 1
    put(clear + 1, width)
    if n:
        out.append(bits & 255)
    return bytes(out)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 40))
def test_decodes_compressed_streams(chunk, times):
    data = chunk * times
    assert lzw_decoded(lzw_plain(data), 8, len(data)) == data


@pytest.mark.parametrize("clear", [True, False])
def test_full_table_and_deferred_clear(clear):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 5, 400_000).astype(np.uint8).tobytes()
    assert lzw_decoded(lzw_plain(data, 8, clear), 8, len(data)) == data
    assert lzw_decoded(lzw_plain(data, 3, clear), 3, len(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(1, 200))
def test_encoder_streams_read_back(chunk, times):
    data = chunk * times
    assert lzw_decoded(lzw_encoded(data), 8, len(data)) == data


def test_encoder_uses_the_table():
    text = b"the same words come again and again, " * 4000
    assert len(lzw_encoded(text)) < len(text) / 10
    noise = np.random.default_rng(4).integers(0, 256, 90_000).astype(np.uint8).tobytes()
    assert lzw_decoded(lzw_encoded(noise), 8, len(noise)) == noise


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=3000))
def test_written_payload_reads_back(raw):
    payload = raw + b"\0" * (-len(raw) % 64)
    frames, note = read_gif(write_gif(payload, "n"))
    assert b"".join(f["samples"] for f in frames) == payload and note == "n"


def test_disposal_transparency_and_local_palette():
    def frame(disposal, transparent, left, top, w, h, px, palette=None):
        flag = disposal << 2 | (transparent is not None)
        out = b"\x21\xf9\x04" + struct.pack("<BHB", flag, 5, transparent or 0) + b"\0\x2c"
        out += struct.pack("<HHHHB", left, top, w, h, 0x80 if palette else 0) + (palette or b"")
        return out + b"\x02" + _blocks(lzw_plain(bytes(px), 2))

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80 | 1, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    gif = head + frame(1, None, 0, 0, 2, 2, [1, 1, 1, 1]) + frame(3, 0, 0, 0, 2, 1, [0, 2]) + frame(2, None, 0, 1, 1, 1, [1], bytes([9, 9, 9, 255, 255, 255])) + frame(0, 0, 0, 0, 1, 1, [0]) + b"\x3b"
    frames, _ = read_gif(gif)
    red, green, white = 3 << 4, 3 << 2, 63
    h = [{i: n for i, n in enumerate(f["histogram"]) if n} for f in frames]
    assert h == [{red: 4}, {red: 1, green: 1}, {white: 1}, {red: 1}]
    assert [f["at_ms"] for f in frames] == [0, 50, 100, 150]


def test_columns(spark):
    long = "héllo wörld " * 20_000
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, long), (4, long)], "doc_id long, text string").withColumn("media", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    rows = load_gif(store_gif(df)).collect()
    for r in rows:
        raw = (r.text or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert b"".join(f.samples for f in r.image.frames) == want and r.image.note == f"n_bytes={len(raw)}"
    assert len(rows) == 5 and len(rows[3].image.frames) > 1
    whole = write_gif(b"ab" * 320)
    bare = whole[:10] + b"\0" + whole[11:13] + whole[13 + 768 :]  # no palette
    wide = whole[:6] + b"\xff\xff\xff\xff" + whole[10:]  # a canvas of 4 billion pixels, of which the frame needs a few
    odd = [b"GIF89a broken", None, b"", bare, whole[:-300], wide, whole]
    got = load_gif(spark.createDataFrame([(x,) for x in odd], "media binary")).select("image.frames").collect()
    assert [len(r[0]) for r in got] == [0] * (len(odd) - 2) + [1, 1]
    assert load_gif(store_gif(df.limit(0))).count() == 0


def test_query(spark):
    from catalogspark.llm.queries_gif import op7_gif_media

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op7_gif_media(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        raw = (d.text or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[d.doc_id]
        cells = Counter((b >> 6 << 4) | (b >> 3 & 3) << 2 | b & 3 for b in want)
        assert r.feature == f"{-(-len(want) // 65536)}|" + ",".join(f"{c}:{cells[c]}" for c in sorted(cells))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert sum(r.media_bytes for r in got.values()) < 0.8 * sum(r.payload_bytes for r in got.values())


def test_large_canvas_and_frames_beyond_a_value(spark):
    """A canvas of 4 billion pixels with a small frame is read; a frame of over 2 GB is an error, not a broken file."""
    def image(wide, high, w, h, samples):
        palette = bytes(range(12))
        return b"GIF89a" + struct.pack("<HHBBB", wide, high, 0x81, 0, 0) + palette + b"," + struct.pack("<HHHHB", 3, 2, w, h, 0) + b"\x02" + _blocks(samples) + b";"

    codes = 0
    stream = [4, 1, 2, 5]  # clear, two samples, end
    for i, c in enumerate(stream):
        codes |= c << (3 * i)
    body = codes.to_bytes(2, "little")
    frames, _ = read_gif(image(65535, 65535, 2, 1, body))
    assert [f["samples"] for f in frames] == [b"\x01\x02"]
    with pytest.raises(OverflowError):
        read_gif(image(65535, 65535, 65535, 65535, body))


def test_decoding_takes_no_step_for_each_code():
    """Python lines that run while a frame is decoded: fewer than its codes, so the work is done in arrays."""
    rng = np.random.default_rng(3)
    data = rng.integers(0, 40, 60_000).astype(np.uint8).tobytes()
    stream, lines = lzw_encoded(data), 0

    def seen(frame, event, arg):
        nonlocal lines
        lines += event == "line" and frame.f_code.co_filename.endswith("gif.py")
        return seen

    before = sys.gettrace()
    sys.settrace(seen)
    try:
        got = lzw_decoded(stream, 8, len(data))
    finally:
        sys.settrace(before)
    assert got == data and lines < 3000 < len(stream) * 8 // 12


def test_streams_without_clear_codes_and_broken_ones():
    def packed(codes, width):
        return sum(c << i * width for i, c in enumerate(codes)).to_bytes(-(-len(codes) * width // 8), "little")

    assert lzw_decoded(packed([1, 4 + 2, 2, 5], 3), 2, 4) == b"\1\1\1\2"  # begins without a clear code, with an entry that its own code makes
    assert lzw_decoded(packed([4, 4, 1, 2, 5], 3), 2, 2) == b"\1\2"
    for broken in ([4, 6, 1, 5], [4, 1, 7, 5], [4, 5], [4, 1, 5], [4]):
        with pytest.raises(ValueError):
            lzw_decoded(packed(broken, 3), 2, 2)
    with pytest.raises(ValueError):
        lzw_decoded(b"", 2, 2)
