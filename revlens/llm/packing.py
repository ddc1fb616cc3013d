"""Best-fit packing by levels of residual bins (dealt operator 13).

1. A task encodes its documents (ids, then an end id), cuts those of over ``size`` tokens into pieces and
   packs some ten thousand pieces at a time: longest first, each into the bin with the least room that
   takes it.  Ids do not leave the task; a piece is its place, length and checksum.  The result is
   written once, since encoding is what costs.
2. Bins that are full, or nearly so (at most ``slack`` tokens free), are done.  The others are items of
   the next round: they are dealt to groups of bounded size, and best fit joins whole bins there.  A
   bin that swallows another one only shifts its offsets.  Each round deals anew, into fewer groups as
   bins are used up.
3. Rounds end when one group held all residual bins, or when a round joins no more than ``least_gain`` of
   them: what is left are bins that hardly any other one fits into (all more than half full, say), and
   they stay as they are.  No group holds more than about ``group`` bins, whatever the input.

Within a group no two bins that are left fit together, so at most one of them is half empty.

Text is encoded by distinct words: the tokenizer file drops white space and cuts its pieces where letters,
digits and signs meet, so a word's ids do not depend on its neighbours.  Words are cut there between
plain ASCII letters, digits and signs only (next to other letters, to an apostrophe or to a sign of an
added token the tokenizer decides).  Files that do not cut like this are refused.

Defined cases: a null text is empty, and an empty text is its end id alone; rows that share a number,
repeated ones too, are documents of their own (their pieces have the same doc_id and piece); a null
number stays null; a text of any length is encoded whole; a document of exactly ``size`` tokens is one
full sequence; an empty table gives an empty result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import blocks as B
from revlens.llm.arrays import P_BYTE, Texts, exact_names, gather, hash_bytes
from revlens.session import scratch_path

SIZE = 2048
END = 0
SLACK = 8
#: Pieces that are packed together within a task, and bins in a group of a later round.
PIECES = 1 << 16
GROUP = 1 << 14
LEAST_GAIN = 0.01
#: Ids of distinct words that a task keeps from one batch for the next.
CACHE = 1 << 19
#: How the tokenizer file cuts text; white space is between the pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill int"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """A tokenizer file's text; ids of whole texts from those of distinct words."""

    def __init__(self, text: str):
        self.text = text
        if not _by_words(json.loads(text)):
            raise ValueError("this tokenizer does not drop white space between words")

    def __reduce__(self):
        return Encoder, (self.text,)

    @lru_cache(1)
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.text)
        t.no_truncation()
        t.no_padding()
        return t

    @lru_cache(1)
    def classes(self) -> np.ndarray:
        """Of every byte: 0 white space, 1 letter, 2 digit, 3 sign, 4 what the tokenizer has to look at."""
        held = set("'") | {c for a in json.loads(self.text)["added_tokens"] for c in a["content"]}
        kind = lambda c: 0 if c in " \t\n\v\f\r" else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isprintable() and c not in held else 4
        return np.array([kind(chr(i)) if i < 128 else 4 for i in range(256)], np.uint8)

    def words(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and the index of each row's first one."""
        kind, n = self.classes()[t.buf], len(t.buf)
        edge = np.zeros(n + 1, bool)  # where a word may begin or end
        edge[t.off] = True
        if n:
            a, b = kind[:-1], kind[1:]
            edge[1:n] |= ((a != b) & ((a == 0) | (b == 0) | ((a < 4) & (b < 4)))) | ((a == 2) & (b == 2))
        inside = kind > 0
        start = np.flatnonzero(edge[:n] & inside)
        end = np.flatnonzero(edge[1:] & inside) + 1
        return start, end, np.searchsorted(start, t.off)

    @lru_cache(1)
    def ends(self) -> np.ndarray:
        """Whether an id is the last one of a cut of the text."""
        model = json.loads(self.text)["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
        return out

    def encode_words(self, words: list[bytes], plain: np.ndarray) -> list[np.ndarray]:
        """Ids of words end to end, and their number for each.  ``plain`` words, which the tokenizer does not
        cut, go through it by the hundred, with a space between: where a cut ends shows which ids are whose."""
        run = lambda x: [np.array(g.ids, np.uint32) for g in self.tokenizer().encode_batch_fast(x, add_special_tokens=False)]
        simple, size = np.flatnonzero(plain), np.zeros(len(words), np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *run([b" ".join([words[i] for i in simple[k : k + 256]]).decode() for k in range(0, len(simple), 256)])])
        last = np.flatnonzero(self.ends()[flat] if len(flat) else flat)
        if len(last) != len(simple) or (len(last) and last[-1] != len(flat) - 1):
            plain = np.zeros(len(words), bool)  # some word has no end: one by one
            simple, flat, last = simple[:0], flat[:0], last[:0]
        other = np.flatnonzero(~plain)
        own = run([words[i].decode() for i in other])
        size[simple], size[other] = np.diff(last, prepend=-1), [len(x) for x in own]
        both, at = np.concatenate([flat, *own]), np.zeros(len(words), np.int64)
        order = np.concatenate([simple, other])
        at[order] = np.cumsum(size[order]) - size[order]
        return [both[gather(at, size)], size]

    def encode(self, column: pa.Array, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each row's begin (one more than there are rows)."""
        t = Texts.of(column)
        start, end, first = self.words(t)
        _, one, index = exact_names(t.buf, start, end, hash_bytes(t.buf, start, end, P_BYTE))
        raw, hard = t.buf.tobytes(), np.append(0, np.cumsum(self.classes()[t.buf] == 4))
        plain = hard[end[one]] == hard[start[one]]
        words = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]
        held = np.array([cache.of.get(x, -1) for x in words], np.int64)
        new = np.flatnonzero(held < 0)
        held[new] = cache.add([words[i] for i in new], *self.encode_words([words[i] for i in new], plain[new]))
        begin, size = cache.begin[held][index], cache.size[held][index]
        ids = cache.flat[gather(begin, size)]
        if len(cache.of) > CACHE:
            cache.clear()
        return ids, np.append(0, np.cumsum(size))[first]


class Cache:
    """Words that a task has met and their ids."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.of: dict[bytes, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: list[bytes], flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = np.arange(len(self.size), len(self.size) + len(words))
        self.of.update(zip(words, at.tolist()))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)
        self.size, self.flat = np.append(self.size, size), np.append(self.flat, flat)
        return at


def _by_words(spec: dict) -> bool:
    """Cutting into words first changes nothing: the pre-tokenizer cuts by PATTERN and drops white space, no
    added token holds or takes any, and nothing is put before a word."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = bool(steps) and steps[0].get("pattern") == {"Regex": PATTERN} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    plain = all(not s.get("add_prefix_space") and not s.get("use_regex") for s in steps[1:]) and spec.get("post_processor") is None
    kinds = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}
    tokens = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["content"].split() != [a["content"]]) for a in spec.get("added_tokens", []))
    return split and plain and kinds and tokens


def best_fit(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin): longest first, each into the fullest bin that takes it.

    Bins are kept by room; the rooms that some bin has are the set bits of one number, so that the least
    room which is large enough is found by its lowest bit.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, n = 0, 0
    fill: list[int] = []
    order = np.argsort(-sizes, kind="stable")
    for i, k in zip(order.tolist(), sizes[order].tolist()):
        fit = rooms >> k
        if fit:
            room = k + (fit & -fit).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                rooms ^= 1 << room
        else:
            room, b = size, n
            fill.append(0)
            n += 1
        bins[i], offsets[i] = b, fill[b]
        fill[b] += k
        if room > k:
            by_room[room - k].append(b)
            rooms |= 1 << (room - k)
    return bins, offsets, np.array(fill, np.int64)


def pieces(docs: DataFrame, held, id_col: str, text_col: str, size: int, end: int) -> DataFrame:
    """ROWS: every piece, and where its task has put it; ``held`` is a broadcast ``Encoder``."""

    def packed(rows: list, first: int):
        doc, null, piece, start, length, crc = (np.concatenate(x) for x in zip(*rows))
        bins, offset, fill = best_fit(length, size)
        yield from pa.table({"doc_id": pa.array(doc, pa.int64(), mask=null), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc, "bin": bins + first, "offset": offset, "fill": fill[bins].astype(np.int32)}).to_batches(max_chunksize=1 << 15)
        return len(fill)

    def run(batches):
        cache, rows, waiting, next_bin = Cache(), [], 0, TaskContext.get().partitionId() << 36
        for b in B.slices(batches, text_col):
            ids, off = held.value.encode(b.column(1), cache)
            n = np.diff(off) + 1  # and the end id
            many = -(-n // size)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * size
            length = np.minimum(n[row] - start, size)
            last = np.array([end], "<u4").tobytes()
            raw, crc = ids.astype("<u4").tobytes(), np.empty(len(row), np.int64)
            upto = np.minimum(start + length, n[row] - 1)
            for i, (a, z, ends) in enumerate(zip((4 * (off[row] + start)).tolist(), (4 * (off[row] + upto)).tolist(), (start + length == n[row]).tolist())):
                c = zlib.crc32(raw[a:z])
                crc[i] = zlib.crc32(last, c) if ends else c
            doc = b.column(0)
            null = np.asarray(doc.is_null())
            rows.append((np.asarray(doc.fill_null(0), np.int64)[row], null[row], piece, start, length, crc))
            waiting += len(row)
            if waiting >= PIECES:
                next_bin += yield from packed(rows, next_bin)
                rows, waiting = [], 0
        if waiting:
            yield from packed(rows, next_bin)

    docs = B.chosen(docs, id_col, text_col)
    return docs.select(F.col(docs.columns[0]).cast("long"), F.col(docs.columns[1]).cast("string").alias(text_col)).mapInArrow(run, ROWS)


def _merge(size: int):
    def run(t: pa.Table) -> pa.Table:
        fill = np.asarray(t["fill"].combine_chunks(), np.int64)
        bins, shift, total = best_fit(fill, size)
        name = np.asarray(t["cur"].combine_chunks(), np.int64)
        lead = np.empty(len(total), np.int64)
        lead[bins[shift == 0]] = name[shift == 0]  # the bin that came first gives its name
        return pa.table({"cur": name, "to": lead[bins], "shift": shift, "filled": total[bins].astype(np.int32)})

    return run


def _kept(rows: DataFrame) -> DataFrame:
    """Written and read again: lineage and size estimates of earlier rounds end here."""
    path = scratch_path(rows.sparkSession, "bins")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def merged(bins: DataFrame, size: int = SIZE, slack: int = SLACK, group: int = GROUP, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(bin, to, shift) of residual bins (``bin``, ``fill``): the bin that took each one, and where it begins there."""
    state = _kept(bins.where(F.col("fill") < size - slack).select("bin", F.col("bin").alias("to"), F.lit(0).cast("long").alias("shift"), "fill"))
    level, groups, before = 0, 0, None
    while True:
        # a bin that has moved is a part of the one that took it, which stands for it from here on
        open_ = state.where((F.col("bin") == F.col("to")) & (F.col("fill") < size - slack)).select(F.col("bin").alias("cur"), "fill")
        n = open_.count()
        if n < 2 or groups == 1 or (before is not None and before - n <= least_gain * before):
            return state.select("bin", "to", "shift")
        groups = max(1, -(-n // group))
        dealt = open_.withColumn("g", F.pmod(F.xxhash64("cur", F.lit(level)), F.lit(groups)))
        moved = dealt.groupBy("g").applyInArrow(_merge(size), "cur long, to long, shift long, filled int")
        moved = moved.select("cur", F.col("to").alias("into"), F.col("shift").alias("by"), "filled")
        after = state.join(moved, state["to"] == moved["cur"], "left")
        state = _kept(after.select("bin", F.coalesce("into", "to").alias("to"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"), F.coalesce("filled", "fill").alias("fill")))
        level, before = level + 1, n


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, path: str | None = None, **limits) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    ``limits``: slack, group and least_gain of ``merged``."""
    spark = docs.sparkSession
    with open(path or default_path(), encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(Encoder(f.read()))
    to = scratch_path(spark, "pieces")
    pieces(docs, held, id_col, text_col, size, end).write.parquet(to)
    placed = spark.read.parquet(to)
    # a bin's first piece stands for it
    moves = merged(placed.where("offset = 0").select("bin", "fill"), size, **limits)
    out = placed.join(moves, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
