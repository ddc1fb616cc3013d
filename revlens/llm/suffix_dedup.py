"""Suffix-array dedup by prefix-free parsing (dealt operator 3).

A rolling hash of ``TRIGGER`` bytes picks trigger strings: the least hash of every window of
``width`` bytes, so that no window is without one and which one depends on the window alone.  The
triggers cut the corpus into overlapping phrases: a phrase is a trigger with the windows that it
answers for.  Equal phrases are one dictionary entry, however often the text repeats.

1. Every block sends its dictionary (trigger, phrase, smallest document).  A range of trigger hashes
   joins them: a phrase that stands in a smaller document has only windows that do so, too.  A
   trigger with one phrase decides the rest: nothing else in the corpus has these windows.
2. Triggers with several phrases are left.  The first holder of each sends the phrase's bytes; the
   range sorts the suffixes of this dictionary by their first ``width`` bytes (corpus order, as far
   as ``width`` bytes can tell), and neighbours that agree in all of them are equal windows.
3. Blocks remove the bytes of windows that also start in a smaller document.

Defined cases: a null text is empty; a text of under ``width`` bytes keeps all; documents are ordered
by number, a null number last; rows that share a number do not precede each other; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from revlens.llm import blocks as B
from revlens.llm.arrays import P_BYTE, P_BYTE2, U, Texts, cut_bytes, hash_spans, mix, poly_spans, row_groups, run_starts, shas

WIDTH = 50
TRIGGER = 24
PHRASES, SUFFIXES = 1, 2
#: Bytes of rows that are parsed at a time (a longer row is alone): some ten numbers are held for each.
BYTES_AT_ONCE = 1 << 17
#: Bytes of rows that are finished at a time: some four numbers are held for each.
FINISHED_AT_ONCE = 1 << 19


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours."""
    k, m = 1, x
    while 2 * k <= n:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(m) - (n - k)], m[n - k :]) if n > k else m


def _parse(t: Texts, width: int, trigger: int):
    n = len(t.buf)
    if n < width:
        return None
    at = np.arange(n - trigger + 1)
    h = poly_spans(t.buf, at, at + trigger, P_BYTE)  # a rolling hash
    key = (h & U(0xFFFFFFFF00000000)) | at.astype(U)  # ties: the leftmost
    place = (_least(key, width - trigger + 1) & U(0xFFFFFFFF)).astype(np.int64)
    whole = np.ones(n - width + 1, bool)
    for back in t.off[1:][np.diff(t.off) > 0].tolist():
        whole[max(back - width + 1, 0) : back] = False
    start = np.flatnonzero(whole)
    place = place[start]
    heads = np.flatnonzero(run_starts(place))
    first, place = start[heads], place[heads]
    count = np.diff(np.append(heads, len(start)))
    left = place - first
    phrase = hash_spans(t.buf, first, first + count + width - 1, P_BYTE2)
    row = np.searchsorted(t.off, first, "right") - 1
    # a least hash is a small number: mixed, or the first ranges would get most of the triggers
    return mix(h[place]), mix(phrase + left.astype(U)), row, first, count


def parse(t: Texts, width: int, trigger: int):
    """(trigger hash, phrase hash, row, first window, windows) of every phrase; some rows at a time."""
    none = np.zeros(0, np.int64)
    out = [(none.astype(U), none.astype(U), none, none, none)]
    for a, b in row_groups(t.off, BYTES_AT_ONCE):
        got = _parse(t.rows(a, b), width, trigger)
        if got:
            out.append((got[0], got[1], got[2] + a, got[3] + t.off[a], got[4]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _covered(start: np.ndarray, width: int) -> np.ndarray:
    """The bytes of windows, from the flags of their first bytes."""
    out, k = start.copy(), 1
    while 2 * k <= width:
        out[k:] |= out[:-k]
        k *= 2
    if width > k:
        out[width - k :] |= out[: k - width]
    return out


def _dictionary(t: Texts, ids: np.ndarray, width: int, trigger: int):
    name, phrase, row, first, count = parse(t, width, trigger)
    order = np.lexsort((ids[row], phrase, name))
    name, phrase, row, first, count = (x[order] for x in (name, phrase, row, first, count))
    heads = run_starts(name, phrase)
    entry = np.cumsum(heads) - 1
    one = np.flatnonzero(heads)
    least = ids[row[one]]
    later = ids[row] > least[entry]
    return name[one], phrase[one], least, one, entry, later, first, count


def _phrases(items, sender):
    name, phrase, ids = items
    order = np.lexsort((ids, phrase, name))
    heads, names = run_starts(name[order], phrase[order]), run_starts(name[order])
    least = ids[order][np.flatnonzero(heads)][np.cumsum(heads) - 1]
    many = (np.add.reduceat(heads.astype(np.int64), np.flatnonzero(names)) > 1)[np.cumsum(names) - 1]
    out = np.zeros(len(name), np.uint8)
    out[order] = (ids[order] > least) + 2 * many
    return out


def _suffixes(width: int, at_once: int = 1 << 16):
    def later(ids, size, data):
        """For every string of a dictionary the bits of its suffixes that a smaller document has, too."""
        item = np.repeat(np.arange(len(size)), size)
        j = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
        start = (np.cumsum(size + width - 1) - (size + width - 1))[item] + j
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").reshape(-1).astype(U)

        def key(k):
            v = word[np.minimum(start + k, len(word) - 1)]
            return v >> U(8 * (k + 8 - width)) if k + 8 > width else v

        order = np.lexsort((ids[item], *(key(k) for k in reversed(range(0, width, 8)))))
        same = np.ones(max(len(item) - 1, 0), bool)
        for k in range(0, width, 8):
            v = key(k)[order]
            same &= v[1:] == v[:-1]
        heads = np.append(True, ~same)[: len(item)]
        least = ids[item][order][np.flatnonzero(heads)][np.cumsum(heads) - 1]
        out = np.zeros(len(item), U)
        out[order] = ids[item][order] > least
        return np.bitwise_or.reduceat(out << j.astype(U), np.cumsum(size) - size)

    def fn(items, sender):
        name, ids, count, data = items
        size = count.astype(np.int64)
        at = np.cumsum(size + width - 1) - (size + width - 1)
        order = np.argsort(name, kind="stable")  # equal windows have the same trigger: some triggers at a time
        heads = np.flatnonzero(run_starts(name[order]))
        ends = np.cumsum(size[order])
        out, a = np.zeros(len(name), U), 0
        while a < len(order):
            upto = np.searchsorted(ends, (ends[a - 1] if a else 0) + at_once, "right")
            k = int(np.searchsorted(heads, max(upto, a + 1), "right")) - 1
            b = int(heads[k]) if heads[k] > a else int(np.append(heads, len(order))[k + 1])
            if upto >= len(order):
                b = len(order)
            i = order[a:b]
            n = size[i] + width - 1
            out[i] = later(ids[i], size[i], data[np.repeat(at[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
            a = b
        return out

    return fn


def removed_bytes(blocks: DataFrame, finish, schema: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, trigger: int = TRIGGER) -> DataFrame:
    """``finish(rows, texts, removed)`` for every block, ``removed`` over all its bytes."""
    if not 1 <= trigger <= width <= trigger + 63:
        raise ValueError("a phrase has at most 64 windows: trigger <= width <= trigger + 63")
    n = B.ranges(blocks.sparkSession)

    def send_phrases(block, t):
        name, phrase, least, *_ = _dictionary(Texts.of(t[text_col]), B.ids_of(t, id_col), width, trigger)
        return B.sends(block, n, name, phrase, least)

    def open_entries(name, marks):
        got = B.answers(marks, PHRASES, len(name), np.uint8)
        return got, np.flatnonzero(got == 2)

    def send_suffixes(block, t, marks):
        texts = Texts.of(t[text_col])
        name, _, least, one, _, _, first, count = _dictionary(texts, B.ids_of(t, id_col), width, trigger)
        _, k = open_entries(name, marks)
        begin, windows = first[one[k]], count[one[k]]
        size = windows + width - 1
        at = np.concatenate([[0], np.cumsum(size)])
        data = texts.buf[np.repeat(begin - at[:-1], size) + np.arange(at[-1])] if len(k) else np.zeros(0, np.uint8)
        return B.sends(block, n, name[k], least[k], windows.astype(np.uint8), beside=lambda a, b: [data[at[a] : at[b]]])

    def apply(block, t, marks):
        texts = Texts.of(t[text_col])
        name, _, _, _, entry, later, first, count = _dictionary(texts, B.ids_of(t, id_col), width, trigger)
        got, k = open_entries(name, marks)
        bits = np.zeros(len(name), U)
        bits[k] = B.answers(marks, SUFFIXES, len(k), U)
        all_of = later | ((got & 1) == 1)[entry]
        steps = np.zeros(len(texts.buf) + 1, np.int8)  # phrases share no window
        np.add.at(steps, first[all_of], 1)
        np.add.at(steps, first[all_of] + count[all_of], -1)
        gone = np.cumsum(steps[:-1], dtype=np.int8) > 0
        some = np.flatnonzero(~all_of & (bits[entry] != 0))
        for j in range(width - trigger + 1):
            hit = some[(bits[entry[some]] >> U(j)) & U(1) == 1]
            gone[first[hit] + j] = True
        gone = _covered(gone, width)
        groups = row_groups(texts.off, FINISHED_AT_ONCE) or [(0, 0)]
        return pa.concat_tables([finish(t.slice(a, b - a), texts.rows(a, b), gone[texts.off[a] : texts.off[b]]) for a, b in groups])

    phrases = B.meet(B.each_block(blocks, send_phrases, B.SENT), _phrases, PHRASES)
    suffixes = B.meet(B.with_answers(blocks, phrases, send_suffixes, B.SENT), _suffixes(width), SUFFIXES)
    return B.with_answers(blocks, phrases.unionByName(suffixes), apply, schema)


def _counts(t: Texts, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.append(0, np.cumsum(removed))[t.off]
    head = removed.copy()
    head[1:] &= ~removed[:-1]
    begin = t.off[:-1][np.diff(t.off) > 0]
    head[begin] = removed[begin]
    return np.diff(total), np.diff(np.append(0, np.cumsum(head))[t.off])


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def finish(t, texts, removed):
        n, spans = _counts(texts, removed)
        return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "n_bytes": np.diff(texts.off), "n_removed": n, "n_spans": spans, "kept_sha256": shas(*cut_bytes(texts, ~removed))})

    blocks = B.pack(B.chosen(docs, "doc_id", "text"))
    return removed_bytes(blocks, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", width=width)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs``, all columns, without the repeated bytes of ``text_col``; a character goes only as a
    whole.  A null text stays null."""

    def finish(t, texts, removed):
        lead = (texts.buf & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        whole = np.ones(int(char[-1]) + 1 if len(char) else 0, bool)
        whole[char[~removed]] = False
        buf, off = cut_bytes(texts, ~whole[char] if len(char) else ~removed)
        i = t.schema.get_field_index(text_col)
        new = pa.LargeStringArray.from_buffers(t.num_rows, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(np.ascontiguousarray(buf)))
        null = t[text_col].combine_chunks().is_null()
        return t.set_column(i, t.schema.field(i), pc.if_else(null, None, new).cast(t.schema.field(i).type))

    return removed_bytes(B.pack(docs, text_col), finish, docs.schema, id_col, text_col, width)
