"""Numpy views of a column of texts: words, rolling hashes, byte masks.

A ``Texts`` holds the UTF-8 bytes of some rows back to back, so that words and hashes of all of
them come from a few vector operations.  All functions work on whole texts; a null text is empty.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial hashes (any odd 64-bit numbers with mixed bits do).
P_BYTE, P_BYTE2, P_WORD, P_WORD2 = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03), U(0xC2B2AE3D27D4EB4F), U(0x8CB92BA72F3D8DD7)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (one to one)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(p: np.uint64, n: int) -> np.ndarray:
    """p**0 .. p**(n-1) modulo 2**64; kept and grown as longer ones are asked for."""
    have = _POWERS.get(int(p))
    if have is None or len(have) < n:
        x = np.full(1 << max(n - 1, 1).bit_length(), p, U)
        x[0] = 1
        _POWERS[int(p)] = have = np.multiply.accumulate(x)
    return have[:n]


def inverse(p: np.uint64) -> np.uint64:
    return U(pow(int(p), -1, 1 << 64))


def prefix_hash(values: np.ndarray, p: np.uint64) -> np.ndarray:
    """Prefix sums of value * p**i; ``span_hash`` takes the hash of any span from them."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * powers(p, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.uint64) -> np.ndarray:
    """Equal spans have equal hashes wherever they stand (before the length is mixed in)."""
    inv = powers(inverse(p), len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))


def poly_spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.uint64, chunk: int = 1 << 17) -> np.ndarray:
    """``span_hash`` of many spans, a stretch of values at a time (numbers of the stretch's length are held, not of all;
    its powers stay for as long as the worker does).

    A polynomial modulo 2**64: for spans of some tens of values, as windows of words (whose values are
    mixed hashes themselves) or rolling triggers.  Long runs of few different values can collide, so
    bytes of any length take ``hash_bytes``.
    """
    out = np.empty(len(start), U)
    if len(start) > 1 and (start[1:] < start[:-1]).any():
        order = np.argsort(start, kind="stable")
        out[order] = poly_spans(values, start[order], end[order], p, chunk)
        return out
    i = 0
    while i < len(start):
        base = start[i]
        j = int(np.searchsorted(start, base + chunk))
        prefix = prefix_hash(values[base : end[i:j].max()], p)
        out[i:j] = span_hash(prefix, start[i:j] - base, end[i:j] - base, p)
        i = j
    return out


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one number (zeros after the end)."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


#: Keeps the first k bytes of a number that was read from eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def _span_eights(eights: np.ndarray, start: np.ndarray, size: np.ndarray):
    """The spans' bytes, eight at a time: (numbers, position within the span, where each span begins)."""
    n = np.maximum((size + 7) >> 3, 1)
    begin = np.cumsum(n) - n
    j = np.arange(int(n.sum())) - np.repeat(begin, n)
    left = np.minimum(np.repeat(size, n) - 8 * j, 8)
    return eights[np.repeat(start, n) + 8 * j] & _FIRST[left], j, begin


def _stretches(size: np.ndarray, chunk: int):
    """Spans i to k of about ``chunk`` bytes in all; a longer one is alone with those before it."""
    ends, i = np.cumsum((size >> 3) + 1), 0
    while i < len(size):
        k = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (chunk >> 3), "right")))
        yield i, k
        i = k


def hash_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.uint64, chunk: int = 1 << 19) -> np.ndarray:
    """64-bit hashes of spans of bytes: a sum of mixed numbers of eight bytes, each under the key of its
    position, so that no arrangement of the same bytes cancels out.  Seeds give hashes that do not depend
    on each other."""
    size, out, eights = end - start, np.empty(len(start), U), _eights(buf)
    keys = mix((np.arange((int(size.max()) >> 3) + 1 if len(size) else 1, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + seed)
    for i, k in _stretches(size, chunk):
        total = mix((eights[start[i:k]] & _FIRST[np.minimum(size[i:k], 8)]) ^ keys[0])
        more = i + np.flatnonzero(size[i:k] > 8)  # few words go on after their first eight bytes
        if len(more):
            v, j, begin = _span_eights(eights, start[more] + 8, size[more] - 8)
            total[more - i] += np.add.reduceat(mix(v ^ keys[j + 1]), begin)
        out[i:k] = mix(total + size[i:k].astype(U) * U(0xA24BAED4963EE407))
    return out


def same_spans(buf: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """True where the bytes [a, a_end) and [b, b_end) are the same: hashes propose, this decides."""
    out = (a_end - a) == (b_end - b)
    ask = np.flatnonzero(out & (a != b))
    size, eights = (a_end - a)[ask], _eights(buf)
    for i, k in _stretches(size, chunk):
        at = ask[i:k]
        x, _, begin = _span_eights(eights, a[at], size[i:k])
        y, _, _ = _span_eights(eights, b[at], size[i:k])
        out[at] = np.logical_and.reduceat(x == y, begin)
    return out


def exact_names(buf: np.ndarray, start: np.ndarray, end: np.ndarray, name: np.ndarray):
    """(sorted distinct names, one span of each, the name's index of every span).  Spans that share a
    hash and are not the same bytes get names apart: the bytes decide, the hash only sorts."""
    names, one, index = np.unique(name, return_index=True, return_inverse=True)
    other = np.flatnonzero(~same_spans(buf, start, end, start[one][index], end[one][index]))
    if len(other):
        name, raw, given = name.copy(), buf.tobytes(), {}
        taken = set(names.tolist())
        for i in other.tolist():
            key = (int(name[i]), raw[start[i] : end[i]])
            if key not in given:
                free = int(mix(name[i : i + 1] + U(len(given) + 1))[0])
                while free in taken:
                    free = (free + 1) % (1 << 64)
                taken.add(free)
                given[key] = free
            name[i] = given[key]
        names, one, index = np.unique(name, return_index=True, return_inverse=True)
    return names, one, index


def hash_spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.uint64) -> np.ndarray:
    """Hashes of spans of bytes, or of short spans of 64-bit numbers."""
    return hash_bytes(values, start, end, p) if values.dtype == np.uint8 else poly_spans(values, start, end, p)


def row_groups(off: np.ndarray, size: int = 1 << 19) -> list[tuple[int, int]]:
    """Rows a to b of about ``size`` bytes each; a longer row is alone with those before it."""
    out, a = [], 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def byte_table(inside) -> np.ndarray:
    table = np.zeros(256, bool)
    for b in range(256):
        table[b] = inside(b)
    return table


#: Bytes of words: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
PLAIN = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = byte_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def each_byte(table: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """The table's entry (a byte or a bool) of every byte, as ``table[buf]`` but several times faster; not writable."""
    return np.frombuffer(buf.tobytes().translate(table.tobytes()), table.dtype) if len(buf) else np.zeros(0, table.dtype)


@dataclass
class Texts:
    buf: np.ndarray  # uint8, all texts back to back
    off: np.ndarray  # int64, row i is buf[off[i]:off[i + 1]]

    @property
    def n(self) -> int:
        return len(self.off) - 1

    @staticmethod
    def of(column: pa.Array) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if pa.types.is_string(column.type):
            column = column.cast(pa.large_string())
        column = column.cast(pa.large_binary()).fill_null(b"")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not len(column):
            return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, o, b = column.buffers()
        off = np.frombuffer(o, np.int64)[column.offset : column.offset + len(column) + 1]
        buf = np.frombuffer(b, np.uint8)[off[0] : off[-1]] if b is not None else np.zeros(0, np.uint8)
        return Texts(buf, off - off[0])

    def rows(self, a: int, b: int) -> Texts:
        return Texts(self.buf[self.off[a] : self.off[b]], self.off[a : b + 1] - self.off[a])

    def lowered(self) -> Texts:
        return Texts(each_byte(LOWER, self.buf), self.off)


@dataclass
class Words:
    start: np.ndarray  # byte positions in Texts.buf
    end: np.ndarray
    doc: np.ndarray  # row of each word
    first: np.ndarray  # index of each row's first word; one longer than there are rows

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(t: Texts, table: np.ndarray) -> Words:
    """Maximal runs of bytes in ``table``; a run ends with its row."""
    inside = each_byte(table, t.buf)
    n = len(t.buf)
    flag = np.zeros(n + 1, bool)
    flag[:n] = inside
    if n:
        flag[1:n] &= ~inside[:-1]
        row_starts = t.off[:-1][t.off[:-1] < n]
        flag[row_starts] = inside[row_starts]
    start = np.flatnonzero(flag)
    flag[:] = False
    if n:
        flag[1 : n + 1] = inside
        flag[1:n] &= ~inside[1:]
        row_ends = t.off[1:][t.off[1:] > 0]
        flag[row_ends] = inside[row_ends - 1]
    end = np.flatnonzero(flag)
    first = np.searchsorted(start, t.off)
    return Words(start, end, np.repeat(np.arange(t.n), np.diff(first)), first)


def word_hash(t: Texts, w: Words) -> np.ndarray:
    return hash_spans(t.buf, w.start, w.end, P_BYTE)


def kept_texts(t: Texts, w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each row's kept words, joined by one space."""
    buf = t.buf.copy()
    mask = np.zeros(len(buf) + 1, np.int8)
    np.add.at(mask, w.start[keep], 1)
    np.add.at(mask, w.end[keep], -1)
    mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    idx = np.flatnonzero(keep)
    more = np.zeros(len(idx), bool)
    more[:-1] = w.doc[idx[1:]] == w.doc[idx[:-1]]
    gaps = w.end[idx[more]]
    buf[gaps] = 0x20
    mask[gaps] = True
    ends = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(mask, out=ends[1:])
    return buf[mask], ends[t.off]


def cut_bytes(t: Texts, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of what is left of each row."""
    ends = np.zeros(len(t.buf) + 1, np.int64)
    np.cumsum(keep, out=ends[1:])
    return t.buf[keep], ends[t.off]


def shas(buf: np.ndarray, off: np.ndarray) -> list[str]:
    view = memoryview(np.ascontiguousarray(buf)).cast("B") if len(buf) else memoryview(b"")
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def strings(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """A large_string column over the given bytes (which are valid UTF-8 by rows)."""
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))


def spread(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of length n, true in every [start, end)."""
    diff = np.zeros(n + 1, np.int64)
    np.add.at(diff, start, 1)
    np.add.at(diff, end, -1)
    return np.cumsum(diff[:-1]) > 0


def gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin[i], begin[i] + 1, ... (size[i] of them) for all i, end to end."""
    at = np.cumsum(size) - size
    return np.repeat(begin - at, size) + np.arange(int(size.sum()))


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        same = np.ones(len(out) - 1, bool)
        for k in keys:
            same &= k[1:] == k[:-1]
        out[1:] = ~same
    return out
