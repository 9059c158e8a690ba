import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from catalogspark.llm.queries_sentencepiece import op9_sentencepiece
from catalogspark.llm.sentencepiece import BLOCK, CHUNK, SPACE, Cutter, Pieces, decode, encode, encoded_segments, load_pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pieces(spark):
    return load_pieces(spark, MODEL)


@pytest.fixture(scope="module")
def unigram(pieces, tmp_path_factory):
    """The public pieces with the same costs as a unigram model, which the library encodes by Viterbi."""
    m = proto.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for p in m.pieces:
        if p.piece in pieces.costs:
            p.score = -pieces.costs[p.piece] / pieces.scale
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def cheapest(seg: str, pieces: Pieces, unknown: int) -> int:
    """The least cost of all segmentations, one by one."""
    if not seg:
        return 0
    costs = [(n, pieces.costs.get(seg[:n], unknown if n == 1 else None)) for n in range(1, len(seg) + 1)]
    return min(c + cheapest(seg[n:], pieces, unknown) for n, c in costs if c is not None)


def test_every_segmentation_of_short_words(spark, pieces):
    rng = random.Random(5)
    segs = sorted({"".join(rng.choice("the▁inaor漢✿") for _ in range(rng.randrange(1, 10))) for _ in range(150)})
    of = {i: p for p, i in pieces.ids.items()}
    got = encoded_segments(spark.createDataFrame(list(enumerate(segs)), "h bigint, seg string"), pieces).collect()
    assert len(got) == len(segs)
    for r in got:
        seg = segs[r.h]
        raw = b"".join(of[i].encode() if i in of else bytes([i - pieces.byte0]) for i in r.ids)
        assert raw.decode() == seg
        chars = [c for c in seg if c not in pieces.ids]
        assert sum(pieces.costs[of[i]] for i in r.ids if i in of) + pieces.unknown_cost * len(chars) == cheapest(seg, pieces, pieces.unknown_cost), seg


def test_equals_the_library(spark, pieces, unigram):
    sp = sentencepiece.SentencePieceProcessor(model_file=unigram)
    as_scored = Pieces.load(unigram)
    assert as_scored.scale == 4096 and {p: c * pieces.scale / as_scored.scale for p, c in as_scored.costs.items()} == pieces.costs
    rng = random.Random(2)
    texts = [None, "", " ", "  a  b\n\tc ", "ﬁ é é ▁x <s> 中文字 🙂‍", "aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 300, "".join(rng.choice("abcdefgh") for _ in range(500))]
    texts += ["".join(rng.choice("etaoin shr.,\n") for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as seg", "2 as h", "'x' as decoded", "'y' as ids").repartition(2)
    for model in (pieces, as_scored):
        for r in decode(encode(df, model), model).collect():
            assert r.ids == sp.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ") and (r.seg, r.h) == (1, 2), r.text


def test_query_gives_every_document_back(spark, unigram):
    sp = sentencepiece.SentencePieceProcessor(model_file=unigram)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op9_sentencepiece(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.round_trip and r.n_pieces == len(r.ids)
        # the library sums in 32 bits, which bends ties of very long texts
        assert r.ids == sp.encode(docs[r.doc_id] or "") or len(docs[r.doc_id]) > 20_000


def test_edges(spark, pieces):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode(empty, pieces).count() == 0
    odd = spark.createDataFrame([([5, -1, 10**6],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in decode(odd, pieces).collect()] == ["\x02", "", ""]
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    got = sorted((r.ids for r in encode(same, pieces).collect()), key=len)
    assert got[0] == got[1] == [] and got[2] == got[3] == [pieces.ids["▁a"], pieces.ids["▁b"]]


def by_hand(seg, pieces):
    """The cheapest path position by position; of equal costs the longer last piece."""
    longest, unknown, cost, back = max(map(len, pieces.ids)), pieces.unknown_cost, [0], [0]
    for end in range(1, len(seg) + 1):
        best = min((cost[end - n] + pieces.costs.get(seg[end - n : end], unknown if n == 1 else 1 << 40), -n) for n in range(1, min(longest, end) + 1))
        cost.append(best[0])
        back.append(-best[1])
    out, at = [], len(seg)
    while at:
        piece = seg[at - back[at] : at]
        out.append([pieces.ids[piece]] if piece in pieces.ids else [pieces.byte0 + b for b in piece.encode()])
        at -= back[at]
    return [i for ids in reversed(out) for i in ids]


@pytest.mark.parametrize("n", [BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 3 * BLOCK + 7])
def test_blocks_don_t_show(spark, pieces, n):
    rng = random.Random(n)
    segs = ["".join(rng.choice("thein漢") for _ in range(n)), "a" * n, "-" * n]
    got = encoded_segments(spark.createDataFrame(list(enumerate(segs)), "h bigint, seg string"), pieces).collect()
    assert {r.h: r.ids for r in got} == {i: by_hand(x, pieces) for i, x in enumerate(segs)}


@pytest.mark.parametrize("n", [65_535, 65_537, 200_000])
def test_long_stretches_are_encoded_whole(spark, pieces, n):
    """One stretch without a cut, longer than any block and, with the last, than what ends used to fit."""
    text = ("theinandthe" * (n // 11 + 1))[: n - 1]
    got = encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), pieces).head()
    assert got.ids == by_hand(SPACE + text, pieces)


def test_very_long_texts_are_cut_alike(spark, pieces):
    cutter = Cutter(pieces.touching())
    long, whole = "word and other " * (CHUNK // 10), "a" * (3 * CHUNK + 5)
    texts = ["a b", None, long, "", whole, "z"]
    segs = {i: [] for i in range(len(texts))}
    hashes = set()
    for marked, at, h, number in cutter(texts):
        cut = [marked[a:b] for a, b in zip(at, [*at[1:], len(marked)], strict=True)]
        of = np.repeat(np.arange(len(texts)), number)
        for i, s, x in zip(of, cut, h.tolist(), strict=True):
            segs[int(i)].append(s)
            hashes.add((s, x))
    for i, t in enumerate(texts):
        assert "".join(segs[i]) == (SPACE + t.replace(" ", SPACE) if t else "")
    assert segs[4] == [SPACE + whole] and len(set(segs[2])) <= len(segs[0]) + 8
    assert len(hashes) == len({s for s, _ in hashes}) == len({x for _, x in hashes})
