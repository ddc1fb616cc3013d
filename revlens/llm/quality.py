"""Quality rules on repetition, from suffix arrays (dealt operator 4).

Each document's suffix array over its words (all documents of a batch are sorted together, document
first) is refined by prefix doubling, where only suffixes that still tie are sorted again.  The ranks
of the rounds give the longest common prefix of neighbours.  The deepest interval of common prefixes
that holds a suffix is the longest substring that starts there and stands elsewhere in the document,
too; those of ``min_repeat`` words or more are the maximal repeats.  A document is rejected when the
union of their spans covers more than ``max_covered`` of its words or one is longer than
``max_longest`` of them (and than ``free_repeat`` words).

All work is row-local, in batches of some MB: nothing is shuffled.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; a text with
under 50 words fails; a very long text is a batch of its own; repeated rows are judged each; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revlens.llm import blocks as B
from revlens.llm.arrays import PLAIN, P_BYTE, U, Texts, byte_table, exact_names, hash_spans, mix, run_starts, spread, word_hash, words_of

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
SHINGLE = 3
MIN_REPEAT = 10
MAX_COVERED = 0.3
MAX_LONGEST = 0.2
FREE_REPEAT = 20
SYMBOLS = byte_table(lambda b: b in b"#*$%&|<>")


def suffix_array(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of all documents in order (by document, then by words in the order of their hashes),
    and ranks of every position by the first 1, 2, 4, ... words, until none tie."""
    n = len(h)
    order = np.lexsort((h, doc))
    heads = run_starts(doc[order], h[order])
    levels, k = [], 1
    while True:
        group = np.cumsum(heads) - 1
        first = np.flatnonzero(heads)
        rank = np.empty(n, np.int32)
        rank[order] = first[group]
        levels.append(rank)
        tie = np.flatnonzero((np.diff(np.append(first, n)) > 1)[group]) if n else first
        if not len(tie):
            return order, levels
        i = order[tie]
        after = np.minimum(i + k, n - 1)
        key = np.where((i + k < n) & (doc[after] == doc[i]), rank[after], -1)
        o = np.lexsort((key, rank[i]))
        order[tie] = i[o]
        heads[tie] = run_starts(rank[i][o], key[o])
        k *= 2


def longest_repeats(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every word, the length of the longest substring from it that also stands elsewhere in its document."""
    n = len(h)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    order, levels = suffix_array(h, doc)
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[near], order[near + 1]
    common = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        inside = (i < n) & (j < n)
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        equal = inside & (doc[i] == doc[a]) & (doc[j] == doc[b]) & (levels[k][i] == levels[k][j])
        common[equal] += 1 << k
    best[a] = common
    best[b] = np.maximum(best[b], common)
    return best


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[off])


def _equal_lines(t: Texts, inside: np.ndarray) -> np.ndarray:
    """Per row, its lines with a word that are equal to an earlier one."""
    newline = np.flatnonzero(t.buf == 0x0A)
    start = np.sort(np.concatenate([t.off[:-1], newline + 1]))
    row = np.searchsorted(t.off[:-1], start, "right") - 1
    ends = np.append(start[1:], len(t.buf))
    end = np.where(np.isin(ends, newline + 1), ends - 1, ends)
    end = np.minimum(np.maximum(end, start), t.off[1:][row]) if len(start) else end
    worded = (np.append(0, np.cumsum(inside))[end] - np.append(0, np.cumsum(inside))[np.minimum(start, end)]) > 0
    start, end, row = start[worded], end[worded], row[worded]
    a = exact_names(t.buf, start, end, hash_spans(t.buf, start, end, P_BYTE))[2]
    order = np.lexsort((a, row))
    again = ~run_starts(row[order], a[order])
    return np.bincount(row[order][again], minlength=t.n)


def measure(column: pa.Array, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    t = Texts.of(column)
    w = words_of(t, PLAIN)
    inside = PLAIN[t.buf]
    names = exact_names(t.buf, w.start, w.end, word_hash(t, w))[2]
    best = longest_repeats(mix(names.astype(U)), w.doc)
    n = len(best)
    again = np.flatnonzero(best >= SHINGLE)
    long = np.flatnonzero(best >= min_repeat)
    longest = np.zeros(t.n, np.int64)
    some = w.per_doc > 0
    if some.any():
        longest[some] = np.maximum.reduceat(best, w.first[:-1][some])
    return {
        "n_words": w.per_doc.astype(np.int64),
        "word_chars": _per_row(inside & ((t.buf & 0xC0) != 0x80), t.off),
        "n_symbols": _per_row(SYMBOLS[t.buf], t.off),
        "n_dup_lines": _equal_lines(t, inside),
        "n_repeat_words": _per_row(spread(n, again, again + SHINGLE), w.first),
        "n_covered": _per_row(spread(n, long, long + best[long]), w.first),
        "longest_repeat": longest,
    }


def verdict(m: dict[str, np.ndarray], max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, free_repeat: int = FREE_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    n = m["n_words"]
    failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * n)
    long = (m["longest_repeat"] > max_longest * n) & (m["longest_repeat"] > free_repeat)
    return failed, ~failed & (m["n_covered"] <= max_covered * n) & ~long


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, **limits) -> DataFrame:
    """The id, all counts, base_failed and kept of every document."""

    def run(batches):
        for b in B.slices(batches, text_col):
            m = measure(b.column(b.schema.get_field_index(text_col)), min_repeat)
            failed, kept = verdict(m, **limits)
            ids = b.column(b.schema.get_field_index(id_col)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(m[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(kept)], [id_col, *COUNTS, "base_failed", "kept"])

    schema = f"{id_col} long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return B.chosen(docs, id_col, text_col).mapInArrow(B.task_gives_back(run), schema)


def keep(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT, **limits) -> DataFrame:
    """``docs``, all columns, without the rejected rows."""

    def run(batches):
        for b in B.slices(batches, text_col):
            _, kept = verdict(measure(b.column(b.schema.get_field_index(text_col)), min_repeat), **limits)
            yield b.filter(pa.array(kept))

    return B.map_rows(docs, run, docs.schema)
