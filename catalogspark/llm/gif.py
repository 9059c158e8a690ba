"""GIF media columns: store bytes losslessly as 8-bit samples, decode frames, keep colour histograms.

Writing: each payload becomes one GIF89a file, 64 samples wide; payloads of more than ``MAX_ROWS`` lines go on
in further frames. The palette gives each sample a colour of its own (three bits of red and green, two of blue). Samples are LZW-coded
with a growing table, which is cleared when it is full.

Reading takes any GIF: global and local palettes, interlace, transparency, disposal 0-3, deferred clear
codes. A histogram has two bits a channel and counts the rectangle of a frame as it is shown, so samples count once.

Defined results: a null payload is empty; an empty payload has one frame of padding; a null or broken GIF (cut
short, without a palette) reads as no frames, and one that a value can't hold (over ``MOST_PIXELS``) is an error; texts of any length are stored whole, in frames; repeated rows give equal bytes; other columns stay as they are, and a column of the same
name as a new one is replaced.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from catalogspark.llm.packed import bounded_batches

WIDTH = 64
MAX_ROWS = 1024
DELAY_CS = 10
#: Entries of a code table, which the format fixes.
TABLE = 4096
#: A pixel that nothing has been drawn on.
BLANK = 255
#: Samples of a frame that a binary value can hold.
MOST_PIXELS = (1 << 31) - 64
PALETTE = bytes(x for i in range(256) for x in ((i >> 5) * 36, (i >> 2 & 7) * 36, (i & 3) * 85))
FRAME = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("at_ms", "delay_ms")]
    + [T.StructField(n, T.IntegerType()) for n in ("left", "top", "width", "height", "disposal")]
    + [T.StructField("samples", T.BinaryType()), T.StructField("histogram", T.ArrayType(T.LongType()))]
)
IMAGE = T.StructType([T.StructField("frames", T.ArrayType(FRAME)), T.StructField("note", T.StringType())])


# ---- writing


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes, each behind its length, and the terminator."""
    full = len(data) // 255
    out = b""
    if full:
        rows = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
        out = np.concatenate([np.full((full, 1), 255, np.uint8), rows], axis=1).tobytes()
    rest = data[full * 255 :]
    return out + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


@functools.cache
def _widths(min_size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, running sum of bits) of the n codes after a clear code: a reader's table has grown by one entry less than codes have come."""
    size = np.minimum((1 << min_size) + 2 + np.maximum(0, np.arange(n) - 1), TABLE - 1)
    width = np.floor(np.log2(size)).astype(np.int64) + 1
    return width, np.cumsum(width)


def _codes(samples: bytes) -> list[int]:
    """LZW codes of 8-bit samples: the longest known run each time, a clear code when the table is full, end of information."""
    longer: list[dict[int, int]] = [{} for _ in range(258)]  # of each run, by the next sample, the run with it
    out, free = [], 258
    emit, add = out.append, longer.append
    run = samples[0]
    known = longer[run]
    for b in samples[1:]:
        if b in known:
            run = known[b]
            known = longer[run]
            continue
        emit(run)
        known[b] = free
        free += 1
        add({})
        run = b
        if free == TABLE:
            emit(256)
            longer = [{} for _ in range(258)]
            add, free = longer.append, 258
        known = longer[b]
    return [*out, run, 257]


def lzw_encoded(samples: bytes) -> bytes:
    """A GIF code stream for samples of 8 bits, least significant bit first."""
    codes = np.array([256, *_codes(samples)], np.int64)
    # a full table has had TABLE - 258 codes, and the clear code ends its run
    width = np.concatenate([[9], np.resize(_widths(8, TABLE - 257)[0], len(codes) - 1)])
    upto = np.cumsum(width)
    at = upto - width
    value = codes << (at & 7)
    n = int(upto[-1] + 7) // 8
    out = np.zeros(n + 2)
    for k in range(3):  # bits of different codes never meet, so adding bytes is setting bits
        out += np.bincount((at >> 3) + k, (value >> 8 * k) & 255, n + 2)[: n + 2]
    return out[:n].astype(np.uint8).tobytes()


def write_gif(payload: bytes, note: str = "") -> bytes:
    """payload: a positive multiple of WIDTH bytes."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, MAX_ROWS), 0xF7, 0, 0), PALETTE]
    if note:
        out += [b"\x21\xfe", _blocks(note.encode())]
    for top in range(0, rows, MAX_ROWS):
        part = payload[top * WIDTH : (top + MAX_ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY_CS, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08"]
        out.append(_blocks(lzw_encoded(part)))
    return b"".join([*out, b"\x3b"])


# ---- reading


def _joined_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += size + 1
    return b"".join(parts), at + 1


def _codes_at(bits: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    byte = at >> 3
    window = bits[byte] | bits[byte + 1] << 8 | bits[byte + 2] << 16
    return (window >> (at & 7)) & ((1 << width) - 1)


def lzw_decoded(data: bytes, min_size: int, n_pixels: int) -> bytes:
    """The samples of a GIF code stream of any kind, n_pixels of them; ValueError if it has fewer or is broken."""
    if not 2 <= min_size <= 8:
        raise ValueError("code size")
    clear, total = 1 << min_size, len(data) * 8
    bits = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.int64)
    full = np.full(TABLE, 12), np.arange(12, 12 * TABLE + 1, 12)
    begin = np.array([min_size + 1])
    at = int(begin[0]) if _codes_at(bits, begin - begin, begin)[0] == clear else 0  # a stream usually begins with a clear code
    have, table, out = 0, None, []
    while have < n_pixels:
        # the widths of the next codes are known up to a clear code
        width, upto = _widths(min_size, TABLE) if table is None else full
        n = int(np.searchsorted(upto, total - at, "right"))
        if not n:
            raise ValueError("a frame ends early")
        codes = _codes_at(bits, at + upto[:n] - width[:n], width[:n])
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        ends = len(stop) > 0
        n = int(stop[0]) if ends else n
        if n:
            table = _table(codes[:n], clear) if table is None else table
            out.append(_samples(codes[:n], *table))
            have += len(out[-1])
        if ends and codes[n] == clear + 1:
            break
        at += int(upto[n] if ends else upto[n - 1])
        table = None if ends else table  # TABLE codes without a clear code have filled it
    if have < n_pixels:
        raise ValueError("a frame ends early")
    return b"".join(out)[:n_pixels]


def _table(codes: np.ndarray, clear: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry without the last sample, last sample, length) of each entry that codes make after a clear code: a code's run with the next run's first sample."""
    low = clear + 2
    if (codes >= low + np.arange(len(codes))).any():  # only the entry that this code makes may be missing
        raise ValueError("code before its entry")
    n = min(len(codes) - 1, TABLE - low)
    shorter = np.concatenate([np.full(low, -1), codes[:n]])
    first, length = np.concatenate([np.arange(low), codes[:n]]), (np.arange(low + n) >= low).astype(np.int64)
    while (first >= low).any():  # twice as far up each time, to the entry of one sample
        length, first = length + length[first], first[first]
    last = np.concatenate([np.arange(low), first[codes[1 : n + 1]]]).astype(np.uint8)
    return shorter, last, length + 1


def _samples(codes: np.ndarray, shorter: np.ndarray, last: np.ndarray, length: np.ndarray) -> bytes:
    """The runs of codes, written from their last samples to their first: those of the longest runs go on."""
    size = length[codes]
    at = np.cumsum(size) - 1
    out = np.empty(at[-1] + 1, np.uint8)
    order = np.argsort((-size).astype(np.int16), kind="stable")
    codes, at = codes[order], at[order]
    for n in (len(codes) - np.cumsum(np.bincount(size))[:-1]).tolist():  # runs longer than 0, 1, 2 ... samples
        codes, at = codes[:n], at[:n]
        out[at] = last[codes]
        codes, at = shorter[codes], at - 1
    return out.tobytes()


def _cells(colours: np.ndarray) -> np.ndarray:
    """The histogram cell of each sample; samples beyond the palette have its last colour."""
    cell = (colours[:, 0] >> 6 << 4) | (colours[:, 1] >> 6 << 2) | colours[:, 2] >> 6
    return np.pad(cell, (0, 256 - len(cell)), "edge")


def read_gif(data: bytes) -> tuple[list[dict], str]:
    """Timed frames with their own samples and the histogram of what a viewer shows in their rectangle; the comment."""
    wide, high, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    canvas = np.full((0, 0), BLANK, np.uint8)  # of each pixel the histogram's cell, as far as frames have reached
    frames, note, clock = [], "", 0
    disposal, delay, clear_index = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = _joined_blocks(data, at + 2)
            if kind == 0xF9:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            elif kind == 0xFE:
                note += body.decode("utf-8", "replace")
            continue
        left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        colours = palette
        if packed & 0x80:
            n = 3 << ((packed & 7) + 1)
            colours = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        size = data[at]
        body, at = _joined_blocks(data, at + 1)
        if colours is None:
            raise ValueError("a frame without palette")
        if w * h > MOST_PIXELS:
            raise OverflowError(f"a frame of {w} x {h} samples doesn't fit a value")
        raster = np.frombuffer(lzw_decoded(body, size, w * h), np.uint8).reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            lines = np.empty_like(raster)
            lines[order] = raster
            raster = lines
        reach = (min(high, top + h), min(wide, left + w))
        if reach[0] > canvas.shape[0] or reach[1] > canvas.shape[1]:
            canvas = np.pad(canvas, [(0, max(0, r - n)) for r, n in zip(reach, canvas.shape, strict=True)], constant_values=BLANK)
        before = canvas.copy() if disposal == 3 else None
        h2, w2 = max(0, min(h, high - top)), max(0, min(w, wide - left))
        shown = raster[:h2, :w2]
        drawn = _cells(colours)[shown]
        area = canvas[top : top + h2, left : left + w2]
        if clear_index is None:
            area[...] = drawn
        else:
            np.copyto(area, drawn, where=shown != clear_index)
        counts = np.bincount(area.ravel(), minlength=64)[:64]
        frames.append({"at_ms": clock, "delay_ms": delay * 10, "left": left, "top": top, "width": w, "height": h, "disposal": disposal, "samples": raster.tobytes(), "histogram": counts.tolist()})
        clock += delay * 10
        if disposal == 2:
            area[...] = BLANK
        elif disposal == 3:
            canvas = before
        disposal, delay, clear_index = 0, 0, None
    return frames, note


# ---- columns


@F.arrow_udf(T.BinaryType())
def _stored(payload: pa.Array, n_bytes: pa.Array) -> pa.Array:
    return pa.array([write_gif(p or b"\0" * WIDTH, f"n_bytes={n or 0}") for p, n in zip(payload.to_pylist(), n_bytes.to_pylist(), strict=True)], pa.binary())


@F.arrow_udf(IMAGE)
def _frames(media: pa.Array) -> pa.Array:
    out = []
    for m in media:
        try:
            frames, note = read_gif(m.as_py() or b"")
        except (IndexError, ValueError, struct.error):
            frames, note = [], ""
        out.append({"frames": frames, "note": note})
    return pa.array(out, to_arrow_type(IMAGE))


def padded(text: Column) -> Column:
    """UTF-8 bytes of text, with bytes 0 up to a positive multiple of WIDTH."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.greatest(F.lit(WIDTH), F.ceil(F.octet_length(raw) / WIDTH) * WIDTH).cast("int")
    return F.rpad(raw, n, F.lit(bytearray(b"\0")))


def store_gif(df: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """Add column ``into``: the text's payload as a GIF file."""
    bounded_batches(df.sparkSession)
    return df.withColumn(into, _stored(padded(F.col(text)), F.octet_length(F.coalesce(F.col(text), F.lit("")))))


def load_gif(df: DataFrame, media: str = "media", into: str = "image") -> DataFrame:
    """Add column ``into``: struct of the timed frames and the comment that the stored bytes hold."""
    return df.withColumn(into, _frames(F.col(media)))
