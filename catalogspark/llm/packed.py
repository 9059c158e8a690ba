"""Arrays of numbers: packed into compressed binary values for shuffles, and stored in the shared folder for memory-mapped reading."""

from __future__ import annotations

import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import functions as F


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte planes apart, compressed."""
    planes = [c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(columns[0]).to_bytes(8, "little"), *planes]))


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for t in map(np.dtype, types):
        size = n * t.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += size
    return out


def range_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The range of the hash space, of ``parts`` equal ones, that each hash is in."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def by_range(h: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(range, from, to) over a sorted array of hashes, for ranges that have any."""
    cuts = np.searchsorted(range_of(h, parts), np.arange(parts + 1))
    return [(p, cuts[p], cuts[p + 1]) for p in range(parts) if cuts[p + 1] > cuts[p]]


def ranges_for(docs, text: str, range_bytes: int, least: int) -> int:
    """How many ranges to deal the n-grams of all texts to, so that each has those of about range_bytes of text."""
    size = docs.select(F.sum(F.octet_length(F.col(text).cast("string")))).head()[0] or 0
    return max(least, -(-size // range_bytes))


def make_folder(uri: str) -> str:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path)
    return uri


def store(uri: str, *arrays: np.ndarray) -> None:
    """Write arrays one after the other; a task that is run again replaces the same bytes."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    fs.move(part, path)


class Mapped:
    """Stored files of a folder by name; None for a file that isn't there.

    Files of a mounted folder are memory-mapped when first needed. From other stores they are read into memory, the last few
    of them are kept: ``HELD`` bytes at most, or one file.
    """

    HELD = 256_000_000

    def __init__(self, base: str):
        self.fs, self.path = pafs.FileSystem.from_uri(base)
        self.open: dict[str, np.ndarray | None] = {}

    def __call__(self, name: str) -> np.ndarray | None:
        if name in self.open:
            return self.open[name]
        path = f"{self.path}/{name}"
        info = self.fs.get_file_info(path)
        if info.type != pafs.FileType.File:
            self.open[name] = None
        elif isinstance(self.fs, pafs.LocalFileSystem):
            self.open[name] = np.memmap(path, np.uint8, "r")
        else:
            while self.open and sum(len(x) for x in self.open.values() if x is not None) + info.size > self.HELD:
                self.open.pop(next(iter(self.open)))
            with self.fs.open_input_stream(path) as source:
                self.open[name] = np.frombuffer(source.read(), np.uint8)
        return self.open[name]


BATCH_BYTES = "4m"


def bounded_batches(spark) -> None:
    """Unless the session says otherwise, Arrow batches for workers end at BATCH_BYTES: the usual count of 10,000 rows would be a gigabyte of long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def release() -> None:
    """Give freed memory back to the system: a worker waits for its next task with what it needs only."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not with this C library


def lean(run):
    """A mapInArrow function that releases its memory when its partition ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
