"""N-gram Jaccard join: near copies by rare-first prefix filtering.

Documents become sets of hashed word n-grams; two link when the intersection is at least ``threshold`` percent of the
union. The work moves in packed arrays, not in a row for each n-gram:

1. A pass over the texts packs blocks of sets. Equal sets in a block are one class. Each block sends its
   (n-gram, class) pairs, sorted and delta-coded, to ranges of the hash space.
2. A range counts in how many classes each n-gram occurs and sends those with two or more back to their blocks.
   An n-gram of one class can't be shared, so each block now has all that can overlap, rarest first, and drops
   the classes with too few shared n-grams to link at all.
3. Prefix n-grams of what is left (exact rare-first order; the unshared ones head the prefix) are joined under length
   and positional filters: first each list's classes against a few pivots (stars, so a group of near copies costs its
   size and not its square), then only pairs in one list that all links so far leave in different components.
   These last pairs pass a suffix filter in the join: parity maps bound how many n-grams only one of the two has.
4. Each candidate pair is verified once, behind a bound from partition sizes.

A set's 128-bit digest is its class; classes link, documents inherit. Components are found by star contraction.

Defined results: words are maximal runs without ASCII white space, ASCII letters lower-cased; a text with fewer words
than ``size`` has one n-gram, the whole sequence; null, empty and blank texts have none, link with nothing and are
their own component; repeated rows link with each other; a null doc_id never names a component unless all are
null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.packed import bounded_batches, lean, pack, ranges_for, release, unpack
from catalogspark.operators.graph import connected_components
from catalogspark.sources.shared import drop_written, let_shuffles_go, written

#: n-grams of a block; the bound of what a task holds at a time.
BLOCK = 1_500_000
#: Classes of one n-gram's list that are tried against each other in one go.
LIST = 256
#: Text whose n-grams a range of the hash space counts, in bytes.
RANGE_BYTES = 16_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def ngram_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    seen: dict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    split = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    ids = [np.fromiter(map(seen.__getitem__, w), np.int64, len(w)) for w in split]
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))
    out = []
    for i in ids:
        if not len(i):
            out.append(np.zeros(0, np.uint64))
            continue
        w = of_word[i]
        n = min(size, len(w))
        h = np.full(len(w) - n + 1, np.uint64(n))
        for k in range(n):
            h = h * _STEP + w[k : len(w) - n + 1 + k]
        out.append(np.unique(_mixed(h)))
    return out


_ROUTED = "part int, block bigint, kind int, payload binary"


def _routed(rows: list[tuple]) -> pa.RecordBatch:
    part, block, kind, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=["part", "block", "kind", "payload"])


def _block_rows(block: int, ids: list[int | None], sets: list[np.ndarray], parts: int) -> list[tuple]:
    slots: dict[bytes, int] = {}
    members = []
    of_doc = np.empty(len(ids), np.int32)
    for i, s in enumerate(sets):
        key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"\0" * 16
        if key not in slots:
            slots[key] = len(members)
            members.append(s)
        of_doc[i] = slots[key]
    known = np.array([i is not None for i in ids], np.uint8)
    head = pack(np.array([i or 0 for i in ids], np.int64), known, of_doc)
    keys = np.frombuffer(b"".join(slots), "<u8").reshape(-1, 2)
    lens = np.array([len(s) for s in members], np.int64)
    head = len(head).to_bytes(8, "little") + head + pack(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]), lens)
    rows = [(block % parts, block, 0, head)]
    grams = np.concatenate(members)
    slot = np.repeat(np.arange(len(members), dtype=np.uint32), lens)
    order = np.argsort(grams, kind="stable")
    grams, slot = grams[order], slot[order]
    edges = np.searchsorted(grams, np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)) if parts > 1 else []
    for p, (a, b) in enumerate(zip([0, *edges], [*edges, len(grams)], strict=True)):
        if b > a:
            part = grams[a:b]
            rows.append((p, block, 1, pack(np.diff(part, prepend=np.uint64(0)), slot[a:b])))
    return rows


def _packed_blocks(size: int, parts: int):
    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        ids, sets, held = [], [], 0
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(docs), 500):
                part = ngram_sets(texts.slice(at, 500).to_pylist(), size)
                ids += docs[at : at + 500]
                sets += part
                held += sum(map(len, part))
                if held >= BLOCK:
                    yield _routed(_block_rows(block, ids, sets, parts))
                    block, ids, sets, held = block + 1, [], [], 0
        if ids:
            yield _routed(_block_rows(block, ids, sets, parts))

    return run


def _counted(table: pa.Table) -> pa.Table:
    """One range of the hash space: n-grams of two or more classes go back to their blocks, with their counts."""
    rows = table.to_pylist()
    out = [(0, r["block"], 0, r["payload"]) for r in rows if r["kind"] == 0]
    data = [r for r in rows if r["kind"] == 1]
    if data:
        pieces = [unpack(r["payload"], np.uint64, np.uint32) for r in data]
        grams = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in pieces])
        slot = np.concatenate([p[1] for p in pieces])
        where = np.repeat(np.arange(len(data)), [len(p[0]) for p in pieces])
        order = np.argsort(grams, kind="stable")
        grams, slot, where = grams[order], slot[order], where[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        times = np.diff(np.append(first, len(grams)))
        count = np.repeat(times, times)
        shared = count > 1
        grams, slot, where, count = grams[shared], slot[shared], where[shared], count[shared].astype(np.uint32)
        order = np.lexsort((grams, where))
        grams, slot, where, count = grams[order], slot[order], where[order], count[order]
        cuts = np.searchsorted(where, np.arange(len(data) + 1))
        for i, r in enumerate(data):
            a, b = cuts[i], cuts[i + 1]
            if b > a:
                out.append((0, r["block"], 1, pack(np.diff(grams[a:b], prepend=np.uint64(0)), slot[a:b], count[a:b])))
    return pa.Table.from_batches([_routed(out)]) if out else table.slice(0, 0).select(["part", "block", "kind", "payload"])


_SETS = "doc_id bigint, key binary, n bigint, grams binary"


def _sets_of_block(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r["payload"] for r in rows if r["kind"] == 0)
        cut = 8 + int.from_bytes(head[:8], "little")
        ids, known, of_doc = unpack(head[8:cut], np.int64, np.uint8, np.int32)
        hi, lo, lens = unpack(head[cut:], np.uint64, np.uint64, np.int64)
        keys = [k.tobytes() for k in np.stack([hi, lo], axis=1)]
        pieces = [unpack(r["payload"], np.uint64, np.uint32, np.uint32) for r in rows if r["kind"] == 1]
        kept: list[bytes | None] = [None] * len(keys)
        if pieces:
            grams = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in pieces])
            slot, count = (np.concatenate([p[i] for p in pieces]) for i in (1, 2))
            shared = np.bincount(slot, minlength=len(keys))
            able = 100 * shared >= threshold * lens
            live = able[slot]
            grams, slot, count = grams[live], slot[live], count[live]
            order = np.lexsort((grams, count, slot))
            grams, slot = grams[order], slot[order]
            cuts = np.searchsorted(slot, np.arange(len(keys) + 1))
            for i in np.flatnonzero(able & (lens > 0)):
                kept[i] = grams[cuts[i] : cuts[i + 1]].tobytes()
        release()
        first = np.zeros(len(ids), bool)
        first[np.unique(of_doc, return_index=True)[1]] = True
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=known == 0),
                "key": pa.array([keys[s] if lens[s] else None for s in of_doc], pa.binary()),
                "n": pa.array(lens[of_doc], pa.int64()),
                "grams": pa.array([kept[s] if f else None for s, f in zip(of_doc, first, strict=True)], pa.binary()),
            }
        )

    return run


def shared_sets(docs: DataFrame, size: int = 5, threshold: int = 80, parts: int | None = None) -> DataFrame:
    """doc_id, key, n, grams: the class digest, the size of the set and, once a block and class that can link at all, its shared n-grams from rarest to most frequent (eight bytes each)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = parts or ranges_for(docs, "text", RANGE_BYTES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(_packed_blocks(size, parts)), _ROUTED)
    back = blocks.groupBy("part").applyInArrow(_counted, _ROUTED)
    return back.groupBy("block").applyInArrow(_sets_of_block(threshold), _SETS)


# ---- candidates


def _prefixes(threshold: int):
    """Prefix n-grams with their position in the whole rare-first order."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                grams, keys, ns, pos = [], [], [], []
                for key, n, raw in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    g = np.frombuffer(raw, np.int64)
                    g = g[: max(0, len(g) + (-threshold * n // 100) + 1)]
                    grams.append(g)
                    keys += [key] * len(g)
                    ns.append(np.full(len(g), n, np.int64))
                    pos.append(np.arange(len(g)) + n - len(raw) // 8)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(keys, pa.binary()), pa.array(np.concatenate(ns)), pa.array(np.concatenate(pos))], names=["gram", "key", "n", "pos"])

    return run


def _verified(threshold: int):
    def run(batches):
        cells = np.uint64(60)
        for batch in batches:
            nx, ny, gx, gy = (c.to_pylist() for c in batch.columns[4:])
            keep = []
            for a, b, g, h in zip(nx, ny, gx, gy, strict=True):
                p, q = np.frombuffer(g, np.uint64), np.frombuffer(h, np.uint64)
                # 100 * overlap >= threshold * (a + b - overlap)
                least = -(-threshold * (a + b) // (100 + threshold))
                bound = np.minimum(np.bincount((p >> cells).astype(np.int64), minlength=16), np.bincount((q >> cells).astype(np.int64), minlength=16)).sum()
                keep.append(bool(bound >= least and len(np.intersect1d(p, q, assume_unique=True)) >= least))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[:4]], names=["x", "y", "xc", "yc"])

    return run


def _passing(threshold: int):
    """Length filter and positional filter of a pair that meets at one n-gram."""
    most = F.greatest("xn", "yn")
    least = F.least("xn", "yn")
    rest = F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos"))
    return (100 * least >= threshold * most) & ((100 + threshold) * rest >= threshold * (F.col("xn") + F.col("yn")))


def _parity(batches):
    """The number of shared n-grams of each class, and the parity of how many fall on each of 256 bits."""
    for batch in batches:
        shared, maps = [], []
        for raw in batch.column(1).to_pylist():
            g = np.frombuffer(raw, np.uint64)
            odd = np.bincount((g & np.uint64(255)).astype(np.int64), minlength=256) & 1
            shared.append(len(g))
            maps.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        m = np.stack(maps) if maps else np.zeros((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.int64()), *[pa.array(np.ascontiguousarray(m[:, i])) for i in range(4)]], names=["key", "s", "p0", "p1", "p2", "p3"])


_MAPS = [f"p{i}" for i in range(4)]


def _near_enough(threshold: int):
    """Suffix filter: bits in which two parity maps differ are as many n-grams at least that only one side has."""
    differ = sum((F.bit_count(F.col(f"x{p}").bitwiseXOR(F.col(f"y{p}"))) for p in _MAPS), F.lit(0))
    return (100 + threshold) * (F.col("xs") + F.col("ys") - differ) >= 2 * threshold * (F.col("xn") + F.col("yn"))


def _links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("grams").alias(f"g{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "xc", "yc", "nx", "ny", "gx", "gy")
    return both.mapInArrow(lean(_verified(threshold)), "x binary, y binary, xc binary, yc binary")


def _placed(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """rows with the component c of their class; a class without a link is its own."""
    rows = rows.select("gram", "key", "n", "pos")
    if parts is None:
        return rows.withColumn("c", F.col("key"))
    return rows.join(parts.withColumnRenamed("vertex", "key"), "key", "left").select(*rows.columns, F.coalesce("component", "key").alias("c"))


def _merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """parts(vertex, component) after links(x, y, xc, yc) between components: only these are searched anew."""
    moved = connected_components(links.select("xc", "yc"), "xc", "yc")
    if parts is None:
        return written(moved, "components")
    moved = moved.select(F.col("vertex").alias("component"), F.col("component").alias("to"))
    old = parts.join(moved, "component", "left").select("vertex", F.coalesce("to", "component").alias("component"))
    # components of one class are not in parts yet
    new = moved.select(F.col("component").alias("vertex"), F.col("to").alias("component")).join(parts, "vertex", "left_anti")
    return written(old.unionByName(new), "components")


def class_links(sets: DataFrame, threshold: int = 80, stars: int = 4, pivots: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """(links, components) of the classes in sets(key, n, grams): enough verified links to join every linked pair of
    classes into one component, and the component of each class that has a link.

    In each star round every list that holds more than one component tries its members against a few pivots, the same
    ones in all lists of a group. What is still apart after that is tried pair by pair, so no link is lost; this last
    round comes at once where the lists have hardly more pairs than members.
    """
    rows = kept = written(sets.select("key", "n", "grams").mapInArrow(lean(_prefixes(threshold)), "gram bigint, key binary, n bigint, pos bigint"), "prefixes")
    links = parts = tried = None
    for turn in range(stars + 1):
        rows = _placed(rows, parts)
        tops = [F.min(F.struct(F.xxhash64("key", F.lit(17 * turn + i)).alias("h"), "key", "n", "pos", "c")) for i in range(pivots if turn else 1)]
        # written, so that the join that follows has two plain sides and Spark can split a gram of many rows
        lists = rows.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.array(*tops).alias("tops")).where("lo <> hi").select("gram", "m", "tops")
        lists = written(lists, "lists")
        rows = written(rows.join(lists, "gram"), "open")
        drop_written(lists)
        drop_written(kept)
        kept = rows
        work = rows.agg(F.count("*").alias("rows"), F.sum(F.col("m") - 1).alias("pairs")).head()
        if not work["rows"]:
            break
        last = turn == stars or (turn and work["pairs"] <= 4 * work["rows"] + 100_000)
        side = lambda s: [F.col(c).alias(s + c) for c in ("key", "n", "pos", "c")]
        if last:
            maps = sets.select("key", "grams").mapInArrow(lean(_parity), "key binary, s bigint, " + ", ".join(f"{p} bigint" for p in _MAPS))
            full = written(rows.select("gram", "m", "key", "n", "pos", "c").join(maps, "key"), "mapped")
            with_map = lambda s: [F.col(c).alias(s + c) for c in ("key", "n", "pos", "c", "s", *_MAPS)]
            # a list of m classes is dealt over cells of LIST x LIST pairs: each pair meets once, and no task has a whole list
            sized = full.withColumn("parts", F.ceil(F.col("m") / LIST).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
            every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
            left = sized.select("gram", F.col("own").alias("a"), every.alias("b"), *with_map("x"))
            right = sized.select("gram", every.alias("a"), F.col("own").alias("b"), *with_map("y"))
            met = left.join(right, ["gram", "a", "b"]).drop("a", "b").where("xc < yc").where(_near_enough(threshold))
        else:
            met = rows.select(*side("x"), F.explode("tops").alias("t")).select("*", *[F.col(f"t.{c}").alias(f"y{c}") for c in ("key", "n", "pos", "c")])
        met = met.where((F.col("xc") != F.col("yc")) & _passing(threshold))
        swap = F.col("xkey") > F.col("ykey")
        either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
        met = met.select(either("xkey", "ykey").alias("x"), either("ykey", "xkey").alias("y"), either("xc", "yc").alias("xc"), either("yc", "xc").alias("yc")).distinct()
        # a pair in two components that was tried before does not link
        met = written(met if tried is None else met.join(tried, ["x", "y"], "left_anti"), "pairs")
        if last:
            drop_written(full)
        ids = met.select("x", "y")
        tried = ids if tried is None else tried.unionByName(ids)
        more = written(_links(met, sets, threshold), "links")
        if not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            parts = _merged(parts, more)
        if last:
            break
    return links, parts


def jaccard_components(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, one row for each row of docs."""
    every = written(shared_sets(docs, size, threshold), "sets")
    let_shuffles_go(docs.sparkSession)
    sets = every.where("grams is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    sets = written(sets, "classes")
    let_shuffles_go(docs.sparkSession)
    _, parts = class_links(sets, threshold)
    least = every.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("d"))
    named = least.withColumn("c", F.col("key"))
    if parts is not None:
        named = least.join(parts.withColumnRenamed("vertex", "key"), "key", "left").withColumn("c", F.coalesce("component", "key"))
    ids = named.groupBy("c").agg(F.min("d").alias("component_id"))
    of_class = named.select("key", "c").join(ids, "c").select("key", "component_id")
    out = every.select("doc_id", "n", "key").join(of_class, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
