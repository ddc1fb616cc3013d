"""Operator 13: ids as the tokenizers library gives them, sequences without gaps, few of them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from texts import corpus

from revlens.llm import packing as P

SCHEMA = "doc_id long, text string, bin long, fill string, TEXT string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "own", "other") for i, t in rows], SCHEMA).repartition(5)


def texts():
    rng = random.Random(8)
    rows = corpus(6, 50)
    rows += [(500, "L'été d'Élodie's don't WE'LL  naïve Å Å ẹ́ ﬁ İ ΣΑΣ x y　z\x85q 12345 ½ ٣"), (501, "a<|endoftext|>b <|startoftext|> <|endof text|>"), (502, "日本語テキスト" * 3000), (503, "w" * 5000)]
    rows += [(504, " ".join(rng.choice(["alpha", "beta", "Gamma!", "x1"]) for _ in range(9000)))]
    signs = list("ab1 2.,'s'tré’“”<|>endoftext-_́\n\x00\x1f!S ½")
    rows += [(600 + k, "".join(rng.choice(signs) for _ in range(rng.randint(1, 300)))) for k in range(60)]
    rows += [(700, "x<|endoftext|>,y.<|startoftext|>9'LL ...'s a.'s 'S x'set 'ré we've,'d(e)1a2b,,3'm")]
    return rows + [(505, " ́ a ́b\nc\t̸d")]


def expected(rows, size):
    t = P.Encoder(open(P.default_path(), encoding="utf-8").read()).tokenizer()
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out += [(str(i), k, a, len(ids[a : a + size]), zlib.crc32(np.array(ids[a : a + size], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), size))]
    return sorted(out)


@pytest.mark.parametrize("size,limits", [(2048, {}), (100, {"group": 7, "slack": 2}), (64, {"group": 3, "slack": 0, "least_gain": 0.0}), (1, {})])
def test_pieces_and_sequences(spark, size, limits):
    rows = texts()
    out = P.pack(frame(spark, rows), size=size, **limits).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected(rows, size)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()] and sum(n for _, n in s) <= size
    least = -(-sum(r.length for r in out) // size)
    assert len(sequences) <= 1.1 * least + 2


def test_rounds_join_what_tasks_left(spark):
    bins = spark.createDataFrame([(i, f) for i, f in enumerate([30] * 40 + [60] * 40 + [99, 100, 41])], "bin long, fill int")
    moves = P.merged(bins, size=100, slack=0, group=10, least_gain=0.0).collect()
    fills = {r.bin: r.fill for r in bins.collect()}
    held = defaultdict(list)
    for r in moves:
        held[r.to].append((r.shift, fills[r.bin]))
    for s in held.values():
        s.sort()
        assert [a for a, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()] and sum(n for _, n in s) <= 100
    assert len(held) <= 52  # 42 at best: 40 of 60 + 30, and two more
    whole = P.merged(bins, size=100, slack=0).collect()
    assert len({r.to for r in whole}) == 42


def test_best_fit_leaves_no_two_bins_that_fit_together():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 60, rng.integers(1, 200))
        bins, offset, fill = P.best_fit(sizes, 64)
        assert (np.bincount(bins, sizes) == fill).all() and fill.max() <= 64
        assert len(fill) < 2 or np.sort(fill)[:2].sum() > 64
        order = np.lexsort((offset, bins))
        assert (offset[order] == np.concatenate([np.append(0, np.cumsum(sizes[order][bins[order] == b])[:-1]) for b in range(len(fill))])).all()


def test_no_documents_and_other_tokenizers(spark):
    out = P.pack(frame(spark, []))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        P.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_the_cache_of_words_may_be_cleared():
    e = P.Encoder(open(P.default_path(), encoding="utf-8").read())
    cache, column = P.Cache(), pa.array(["a b é c a don't 12", None, "", "b"])
    first = [x.tolist() for x in e.encode(column, cache)]
    assert first == [x.tolist() for x in e.encode(column, cache)]
    cache.clear()
    assert first == [x.tolist() for x in e.encode(column, cache)]
