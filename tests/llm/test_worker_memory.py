"""Memory of Python workers, which share an executor's limit: while a block's repeats are cut out, and when a task has ended."""

import ctypes
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from revlens.llm import arrays, bpe
from revlens.llm import blocks as B
from revlens.llm import suffix_dedup as S


def resident() -> float:
    return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024


class Frame:
    """Runs the functions of one block here."""

    sparkSession = None
    columns = ["doc_id", "text"]

    def __init__(self, rows):
        self.rows = rows

    def unionByName(self, other):
        return Frame(pa.concat_tables([self.rows, other.rows]))

    def toDF(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


@pytest.fixture
def block(monkeypatch):
    monkeypatch.setattr(B, "ranges", lambda _: 12)
    monkeypatch.setattr(B, "each_block", lambda blocks, fn, _: Frame(fn(0, blocks.rows)))
    monkeypatch.setattr(B, "with_answers", lambda blocks, marks, fn, _: Frame(fn(0, blocks.rows, marks.rows)))

    def meet(sent, fn, kind):
        rows = []
        for start, body in zip(sent.rows["start"].to_pylist(), sent.rows["body"].to_pylist()):
            items = B.load(body)
            rows.append((0, kind, start, B.dump(fn(items, np.zeros(len(items[0]), np.int64)))))
        return Frame(B.table(B.ANSWER, rows))

    monkeypatch.setattr(B, "meet", meet)


def texts(n: int, size: int) -> pa.Table:
    r = np.random.default_rng(3)
    rows = [r.integers(97, 123, size).astype(np.uint8).tobytes().decode() for _ in range(n)]
    rows[5] = rows[2][10:200] + "é" * 30 + rows[4][:90] + "é" * 40
    rows[7] = rows[5][150:] + rows[6]
    rows[8] = None
    return pa.table({"doc_id": np.arange(n), "text": rows})


def repeats(t: pa.Table, kind: str) -> list[tuple]:
    def finish(rows, x, removed):
        return pa.table({"doc_id": rows["doc_id"], "text": rows["text"], "removed": [removed[a:b].tobytes() for a, b in zip(x.off[:-1], x.off[1:])]})

    return S.removed_bytes(Frame(t), finish, kind).rows.to_pylist()


def test_cutting_holds_numbers_of_some_rows_only(block, monkeypatch):
    monkeypatch.setattr(B, "pack", lambda docs, *_: Frame(docs.rows))
    t = texts(1000, 3000)
    docs = Frame(t)
    docs.schema = ""
    S.remove_repeats(docs)  # the tables of powers stay
    tracemalloc.start()
    try:
        out = S.remove_repeats(docs).rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.num_rows == 1000 and out["text"][8].as_py() is None and len(out["text"][7].as_py()) < 3200
    assert peak < 64 << 20


def test_rows_finished_some_at_a_time_are_the_same(block, monkeypatch):
    t = texts(30, 700)
    whole = repeats(t, "")
    monkeypatch.setattr(S, "FINISHED_AT_ONCE", 1000)
    assert repeats(t, "") == whole and [r["doc_id"] for r in whole] == list(range(30))
    assert any(any(r["removed"]) for r in whole) and repeats(t.slice(0, 0), "") == []


@pytest.mark.parametrize("width", [1, 2, 24, 49, 50, 63])
def test_covered_bytes(width):
    r = np.random.default_rng(width)
    for n in (0, 1, width - 1, width, 500):
        start = r.random(n) < 0.01
        want = np.zeros(n, bool)
        for i in np.flatnonzero(start):
            want[i : i + width] = True
        assert (S._covered(start, width) == want).all()


def test_powers_that_stay_are_small(monkeypatch):
    monkeypatch.setattr(arrays, "_POWERS", {})
    v = np.random.default_rng(1).integers(0, 256, 3_000_000).astype(np.uint8)
    at = np.arange(0, len(v) - 24, 7)
    got = arrays.poly_spans(v, at, at + 24, arrays.P_BYTE)
    assert sum(x.nbytes for x in arrays._POWERS.values()) <= 4 << 20
    assert (got == arrays.poly_spans(v, at, at + 24, arrays.P_BYTE, 1 << 20)).all()


def pieces() -> list[np.ndarray]:
    return [np.zeros(1000) for _ in range(60_000)]  # some 480 MB of pieces under the C library's limit for own mappings


def given_back(monkeypatch):
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("not glibc")
    given = []
    monkeypatch.setattr(B, "give_back", lambda f=B.give_back: given.append((resident(), f(), resident())))
    return given


def test_task_gives_back_what_it_held_to_its_end(monkeypatch):
    given, keep = given_back(monkeypatch), []

    def fn(batches):
        held = pieces()
        keep.extend(held[::20_000])
        yield from batches
        assert len(held) == 60_000

    made = B.map_rows(Frame(None), fn, "")
    batch = pa.RecordBatch.from_pydict({"c0": [1], "c1": ["a"]})
    assert [b.schema.names for b in made.run(iter([batch]))] == [["doc_id", "text"]]
    assert len(given) == 1 and given[0][2] < given[0][0] - 50 and len(keep) == 3


def test_group_gives_back_what_it_held_to_its_end(monkeypatch):
    given, keep = given_back(monkeypatch), []

    def fn(t):
        held = pieces()
        keep.extend(held[::20_000])
        return t.slice(0, len(held))

    assert B.group_gives_back(fn)(pa.table({"x": [1, 2]})).num_rows == 2
    assert len(given) == 1 and given[0][2] < given[0][0] - 50 and len(keep) == 3


def test_splitting_holds_numbers_of_some_rows_only():
    r = np.random.default_rng(4)
    words = np.array([("".join(map(chr, r.integers(97, 123, k)))) for k in r.integers(2, 9, 20_000)])
    rows = [" ".join(words[r.integers(0, len(words), 500)]) + " it's é <|x|>" for _ in range(1000)]
    t = arrays.Texts.of(pa.array(rows))
    whole = bpe.split_words(t, [b"<|x|>"])
    tracemalloc.start()
    try:
        names, start, end, index, first = bpe._words(t, [b"<|x|>"])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20
    assert first.tolist() == whole[2].tolist() and len(index) == len(whole[0])
    assert (arrays.hash_spans(t.buf, whole[0], whole[1], arrays.P_BYTE) == names[index]).all()
    none = bpe._words(arrays.Texts.of(pa.array([], pa.string())), [])
    assert [len(x) for x in none] == [0, 0, 0, 0, 1]
