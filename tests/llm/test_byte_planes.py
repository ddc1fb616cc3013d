"""Word hashes against plain numbers, and the layout and cost of packed arrays."""

import time

import numpy as np
import pyarrow as pa

from revlens.llm import arrays as A
from revlens.llm import blocks as B

M64 = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_hash(word, seed):
    """A sum of mixed numbers of eight bytes, each under the key of its position, and the length."""
    total = 0
    for j in range(max(1, -(-len(word) // 8))):
        total += plain_mix(int.from_bytes(word[8 * j : 8 * j + 8], "little") ^ plain_mix(((j + 1) * 0x9E3779B97F4A7C15 + seed) & M64))
    return plain_mix((total + len(word) * 0xA24BAED4963EE407) & M64)


def test_hashes_of_all_lengths():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 256, 400).astype(np.uint8)
    start = rng.integers(0, 401, 300)
    end = np.minimum(start + np.arange(300) % 43, 400)
    want = [plain_hash(buf[a:b].tobytes(), int(A.P_BYTE)) for a, b in zip(start, end)]
    for chunk in (1 << 22, 64):
        assert A.hash_bytes(buf, start, end, A.P_BYTE, chunk).tolist() == want


def test_short_words_are_not_spread_out(monkeypatch):
    """Only what goes on after eight bytes is spread over rows of its own."""
    asked, f = [], A._span_eights
    monkeypatch.setattr(A, "_span_eights", lambda eights, start, size: asked.append(len(start)) or f(eights, start, size))
    start = np.arange(0, 900, 9)
    A.hash_bytes(np.arange(909, dtype=np.uint16).astype(np.uint8), start, start + np.where(start % 90 == 0, 9, 8), A.P_BYTE)
    assert sum(asked) == 10


def plain_dump(a):
    """Planes of bytes of equal weight, compressed."""
    return pa.Codec("zstd", 1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), asbytes=True)


def test_dump_layout_and_cost():
    a = np.random.default_rng(1).geometric(0.1, 400_000).astype(np.uint64)
    took = {plain_dump: [], B.dump: []}
    for _ in range(7):
        for f in took:
            began = time.process_time()
            body = f(a)
            took[f].append(time.process_time() - began)
    assert body.endswith(plain_dump(a)) and (B.load(body)[0] == a).all()
    assert min(took[B.dump]) < 0.8 * min(took[plain_dump])
    for dtype in (np.uint8, bool, np.uint16, np.int64, np.float64):
        for n in (0, 1, 9):
            (x,) = B.load(B.dump(np.arange(n).astype(dtype)))
            assert x.dtype == dtype and (x == np.arange(n).astype(dtype)).all()


def test_byte_tables():
    """Bytes are looked up as by indexing, in well under its CPU time."""
    buf = np.random.default_rng(2).integers(0, 256, 1 << 21).astype(np.uint8)
    took = {"index": [], "words": []}
    for _ in range(7):
        for name, f in (("index", lambda: (A.LOWER[buf], A.PLAIN[buf])), ("words", lambda: (A.each_byte(A.LOWER, buf), A.each_byte(A.PLAIN, buf)))):
            began = time.process_time()
            got = f()
            took[name].append(time.process_time() - began)
            assert (got[0] == A.LOWER[buf]).all() and (got[1] == A.PLAIN[buf]).all()
    assert min(took["words"]) < 0.7 * min(took["index"])
    assert [len(A.each_byte(x, buf[:0])) for x in (A.LOWER, A.PLAIN)] == [0, 0]
