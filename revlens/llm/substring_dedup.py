"""Substring dedup by recompression (dealt operator 2).

Rounds of recompression name the corpus bottom-up: runs of one word first, then pairs of
neighbours, where a round's names are split into left and right ones and a left name followed by a
right one becomes one symbol.  A name is a hash of what it stands for, so it is global without a
dictionary, and whether two neighbours are joined depends on them alone: equal passages get the
same symbols but for a few at their ends.  Each symbol carries the stretch of words that its making
looked at (``lo``, ``hi``); wherever a window of words holds that stretch, it holds that symbol.

1. Every block sends its distinct top symbols; a range of names finds those that occur twice.
2. A window that holds a symbol which occurs once occurs once itself.  Only windows over shared
   symbols are left; blocks send each of them once (96-bit name and smallest document), and a range
   finds which also start in a smaller document.
3. Blocks remove the words of windows that started earlier.

Defined cases: a null or empty text has no words; a document of under ``width`` words keeps all;
documents are ordered by number, a null number last; rows that share a number neither precede nor
follow each other (each is compared with smaller numbers and with its own earlier words); an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revlens.llm import blocks as B
from revlens.llm.arrays import PLAIN, P_WORD, P_WORD2, U, Texts, Words, hash_spans, kept_texts, mix, run_starts, shas, spread, strings, word_hash, words_of

WIDTH = 20
#: Rounds of pairs.  A top symbol has about (4/3)**5 = 4 words, and a window of 20 nearly always holds one whole.
ROUNDS = 5
REPEATED, EARLIER = 1, 2


def recompress(h: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the top symbols and the words [lo, hi) that decide each of them.

    At a document's edge a symbol's making has looked at what is not there; its stretch then ends
    one beyond the edge, and no window holds it.
    """
    n = len(h)
    head = np.flatnonzero(run_starts(h, doc))
    size = np.diff(np.append(head, n))
    name = np.where(size > 1, mix(h[head] + mix(size.astype(U))), h[head])
    at = doc[head]
    lo, hi = head - 1, head + size + 1  # that a run ends is known from its neighbours
    for k in range(rounds):
        if len(name) < 2:
            break
        right = (mix(name ^ U(0x5851F42D4C957F2D * (k + 1) & (2**64 - 1))) & U(1)).astype(bool)
        same = at[1:] == at[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & same
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # a single right symbol looked to its left, a single left one to its right
        new_lo, new_hi = lo.copy(), hi.copy()
        i = np.flatnonzero(right & ~second)
        j = i[(i > 0)]
        j = j[same[j - 1]]
        new_lo[j], new_hi[j] = np.minimum(lo[j], lo[j - 1]), np.maximum(hi[j], hi[j - 1])
        i = np.flatnonzero(~right & ~pair)
        j = i[i < len(name) - 1]
        j = j[same[j]]
        new_lo[j], new_hi[j] = np.minimum(lo[j], lo[j + 1]), np.maximum(hi[j], hi[j + 1])
        i = np.flatnonzero(pair)
        new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
        new = name.copy()
        new[i] = mix(name[i] * U(0x2545F4914F6CDD1D) + mix(name[i + 1] + U(k + 1)))
        keep = ~second
        name, at, lo, hi = new[keep], at[keep], new_lo[keep], new_hi[keep]
    return name, lo, hi


def _symbols(t: Texts, w: Words, h: np.ndarray, rounds: int):
    name, lo, hi = recompress(h, w.doc, rounds)
    distinct, index, count = np.unique(name, return_inverse=True, return_counts=True)
    return distinct, count > 1, index, lo, hi


def _windows(w: Words, h: np.ndarray, ids: np.ndarray, width: int, shared: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Windows without a symbol that occurs once: their distinct names with the smallest document,
    which of them start earlier in this block, and the name that each has."""
    n = len(h)
    whole = np.zeros(n, bool)
    if n >= width:
        whole[: n - width + 1] = w.doc[: n - width + 1] == w.doc[width - 1 :]
    once = np.flatnonzero(~shared & (hi - lo <= width))
    start = np.maximum(hi[once] - width, 0)
    dead = spread(n, start, np.maximum(np.minimum(lo[once] + 1, n), start)) if n else whole
    at = np.flatnonzero(whole & ~dead)
    a = hash_spans(h, at, at + width, P_WORD)
    b = (hash_spans(h, at, at + width, P_WORD2) >> U(32)).astype(np.uint32)
    order = np.lexsort((at, ids[w.doc[at]], b, a))
    at, a, b = at[order], a[order], b[order]
    heads = run_starts(a, b)
    group = np.cumsum(heads) - 1
    first = np.flatnonzero(heads)
    least = ids[w.doc[at[first]]]
    row = w.doc[at]
    earlier = ids[row] > least[group]
    if len(at):  # an earlier start in the same row
        earlier[1:] |= ~heads[1:] & (row[1:] == row[:-1])
    return at, group, earlier, a[first], b[first], least


def _repeated(items, sender):
    name, twice = items
    order = np.argsort(name, kind="stable")
    heads = run_starts(name[order])
    group = np.cumsum(heads) - 1
    many = np.bincount(group) > 1
    np.logical_or.at(many, group, twice[order].astype(bool))
    out = np.zeros(len(name), bool)
    out[order] = many[group]
    return out


def _earlier(items, sender):
    a, b, ids = items
    order = np.lexsort((ids, b, a))
    heads = run_starts(a[order], b[order])
    least = ids[order][np.flatnonzero(heads)][np.cumsum(heads) - 1]
    out = np.zeros(len(a), bool)
    out[order] = ids[order] > least
    return out


def removed_words(blocks: DataFrame, finish, schema: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """``finish(rows, texts, words, removed)`` for every block, ``removed`` over all its words."""
    n = B.ranges(blocks.sparkSession)

    def read(t: pa.Table):
        texts = Texts.of(t[text_col])
        w = words_of(texts, PLAIN)
        return texts, w, word_hash(texts, w)

    def send_symbols(block, t):
        names, twice, *_ = _symbols(*read(t), rounds)
        return B.sends(block, n, names, twice.astype(np.uint8))

    def windows(t, marks):
        texts, w, h = read(t)
        names, _, index, lo, hi = _symbols(texts, w, h, rounds)
        shared = B.answers(marks, REPEATED, len(names))[index]
        return texts, w, _windows(w, h, B.ids_of(t, id_col), width, shared, lo, hi)

    def send_windows(block, t, marks):
        _, _, (_, _, _, a, b, least) = windows(t, marks)
        return B.sends(block, n, a, b, least)

    def apply(block, t, marks):
        texts, w, (at, group, earlier, a, _, _) = windows(t, marks)
        gone = at[earlier | B.answers(marks, EARLIER, len(a))[group]]
        removed = spread(len(w.start), gone, gone + width) if len(w.start) else np.zeros(0, bool)
        return finish(t, texts, w, removed)

    repeated = B.meet(B.each_block(blocks, send_symbols, B.SENT), _repeated, REPEATED)
    earlier = B.meet(B.with_answers(blocks, repeated, send_windows, B.SENT), _earlier, EARLIER)
    return B.with_answers(blocks, repeated.unionByName(earlier), apply, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_words, n_removed, text): ``text`` has the words that are left, joined by one space."""

    def finish(t, texts, w, removed):
        buf, off = kept_texts(texts, w, ~removed)
        return pa.table({id_col: t[id_col].cast(pa.int64()), "n_words": w.per_doc, "n_removed": np.diff(np.append(0, np.cumsum(removed))[w.first]), "text": strings(buf, off).cast(pa.string())})

    blocks = B.pack(B.chosen(docs, id_col, text_col), text_col)
    return removed_words(blocks, finish, f"{id_col} long, n_words long, n_removed long, text string", id_col, text_col, width)


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""

    def finish(t, texts, w, removed):
        buf, off = kept_texts(texts, w, ~removed)
        return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "n_words": w.per_doc, "n_removed": np.diff(np.append(0, np.cumsum(removed))[w.first]), "kept_sha256": shas(buf, off)})

    blocks = B.pack(B.chosen(docs, "doc_id", "text"))
    return removed_words(blocks, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", width=width)
