"""BPE encoding and decoding through a distinct-word table (dealt operator 8).

Blocks split their texts into the tokenizer's words with vector operations over character classes
and send each *distinct* word once; a range of word hashes encodes each distinct word of the corpus
once and returns its ids; the block joins them back by position.  Decoding joins ids with the
vocabulary's pieces (bounded by the tokenizer's file, so it is broadcast) and concatenates them.

The tokenizer is a byte-level BPE file of the ``tokenizers`` library; its path is a parameter, and it
is read on the driver and broadcast.  Its added tokens are cut out of a text first, as that library does.

Defined cases: a null or empty text has no ids; a very long word is one word; repeated rows are
encoded each; an empty table gives an empty result.  Texts are valid UTF-8, as Spark's strings are.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from revlens.llm import blocks as B
from revlens.llm.arrays import P_BYTE, Texts, exact_names, gather, hash_spans, row_groups

SPACE, LETTER, NUMBER, OTHER, UNASSIGNED = 0, 1, 2, 3, 4
#: White space of Unicode.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
IDS = 1


#: Ids that are decoded together; a row with more is alone.
IDS_AT_ONCE = 1 << 18


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    name = map(unicodedata.category, map(chr, range(0x110000)))
    out = np.fromiter((UNASSIGNED if x == "Cn" else kind.get(x[0], OTHER) for x in name), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


@lru_cache(4096)
def class_of(c: int) -> int:
    """Class of a code point that this Python's tables lack: as the library splits it."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    return next((k for k, x in ((LETTER, "a"), (NUMBER, "1")) if len(split(x + chr(c))) == 1), OTHER)


def split_words(t: Texts, added: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all rows in order, and the index of each row's first word.

    A word is a run of letters, of numbers, of other signs (each with one space before it) or of
    white space; an apostrophe that begins a run of signs takes s, t, m, d, re, ve or ll after it.
    """
    raw = t.buf.tobytes()
    edges = set(t.off.tolist())
    for token in added:
        at = raw.find(token)
        while at >= 0:
            if np.searchsorted(t.off, at, "right") == np.searchsorted(t.off, at + len(token) - 1, "right"):
                edges.update((at, at + len(token)))
                at += len(token) - 1
            at = raw.find(token, at + 1)
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    lead = np.flatnonzero((t.buf & 0xC0) != 0x80)
    place = np.append(lead, len(t.buf))
    cuts = np.searchsorted(lead, np.array(sorted(edges), np.int64))
    c = classes()[cp]
    for x in np.unique(cp[c == UNASSIGNED]).tolist():
        c[cp == x] = class_of(x)
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    edge[n] = True
    head = edge.copy()
    head[1:n] |= c[1:] != c[:-1]
    begin = head[:n].copy()
    # white space before a word: its last sign is a word of its own, or a space that the next word takes
    i = np.flatnonzero(head[1:n] & ~edge[1:n] & (c[:-1] == SPACE)) + 1
    begin[i - 1] = True
    begin[i[cp[i - 1] == 0x20]] = False
    # apostrophes
    i = np.flatnonzero(begin & head[:n] & (cp == 0x27))
    i = i[~edge[i + 1]]
    one = np.isin(cp[i + 1], [ord(x) for x in "stmd"])
    j = i[~one]
    j = j[~edge[np.minimum(j + 2, n)]]
    pair = cp[j + 1].astype(np.int64) << 32 | cp[j + 2]
    j = j[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    for at, size in ((i[one], 1), (j, 2)):
        begin[at + 1] = False
        after = at + 1 + size
        begin[after[after < n]] = True
    if added:  # an added token is one word
        for a, b in zip(cuts[:-1], cuts[1:]):
            if raw[place[a] : place[b]] in added:
                begin[a + 1 : b] = False
    start = np.flatnonzero(begin)
    end = place[np.append(start[1:], n)] if len(start) else start
    start = place[start]
    return start, end, np.searchsorted(start, t.off)


def _words(t: Texts, added: list[bytes]):
    """Distinct words of a block (hash, starts, ends), the word at each place, and rows' first words.  Some rows are
    split at a time: every character has numbers of its own."""
    parts = [(t.off[a], split_words(t.rows(a, b), added)) for a, b in row_groups(t.off) or [(0, 0)]]
    start, end = (np.concatenate([x[k] + base for base, x in parts]) for k in (0, 1))
    first = np.append(0, np.cumsum(np.concatenate([np.diff(x[2]) for _, x in parts])))
    name = hash_spans(t.buf, start, end, P_BYTE)
    names, one, index = exact_names(t.buf, start, end, name)
    return names, start[one], end[one], index, first


class Codec:
    """A tokenizer file's text, and what workers make of it (once each)."""

    def __init__(self, text: str):
        self.text = text
        self.added = [x["content"].encode() for x in json.loads(text)["added_tokens"]]

    def __reduce__(self):
        return Codec, (self.text,)

    @lru_cache(1)
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.text)
        t.no_truncation()
        t.no_padding()
        return t

    @lru_cache(1)
    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces end to end, and the place of each id's."""
        data = json.loads(self.text)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        by_id = {i: bytes(of[c] for c in p) for p, i in data["model"]["vocab"].items()}
        by_id |= {x["id"]: x["content"].encode() for x in data["added_tokens"]}
        piece = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        return np.frombuffer(b"".join(piece), np.uint8), np.cumsum([0, *map(len, piece)])

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids end to end, and where each begins (one more than there are ids)."""
        data, off = self.pieces()
        begin, size = off[ids], np.diff(off)[ids]
        return data[gather(begin, size)], np.append(0, np.cumsum(size))


def read_codec(path: str | None = None) -> Codec:
    with open(path or default_path(), encoding="utf-8") as f:
        return Codec(f.read())


def encoded(blocks: DataFrame, held, finish, schema: str, text_col: str = "text") -> DataFrame:
    """``finish(rows, ids, off)`` for every block: all ids end to end, row i has ids[off[i]:off[i + 1]].
    ``held`` is a broadcast ``Codec``."""
    n = B.ranges(blocks.sparkSession)

    def send(block, t):
        texts = Texts.of(t[text_col])
        names, start, end, _, _ = _words(texts, held.value.added)
        off = np.append(0, np.cumsum(end - start))
        data = texts.buf[gather(start, end - start)]
        size = (end - start).astype(np.uint32)
        return B.table(B.SENT, [(i, block, a, B.dump(size[a:b], data[off[a] : off[b]], level=3)) for i, a, b in B.cut(names, n)])

    def encode(t: pa.Table) -> pa.Table:
        bodies = [B.load(x.as_py()) for x in t["body"]]
        size, data = (np.concatenate(x) for x in zip(*bodies))
        off = np.append(0, np.cumsum(size.astype(np.int64)))
        name = hash_spans(data, off[:-1], off[1:], P_BYTE)
        _, one, index = exact_names(data, off[:-1], off[1:], name)
        raw = data.tobytes()
        got = held.value.tokenizer().encode_batch_fast([raw[off[i] : off[i + 1]].decode("utf-8") for i in one], add_special_tokens=False)
        ids = [x.ids for x in got]
        count = np.array([len(x) for x in ids], np.uint32)
        flat = np.array([i for x in ids for i in x], np.uint32)
        begin = np.cumsum(count) - count
        rows, at = [], 0
        for block, start, x in zip(t["block"].to_pylist(), t["start"].to_pylist(), bodies):
            k = index[at : at + len(x[0])]
            at += len(x[0])
            rows.append((block, IDS, start, B.dump(count[k], flat[gather(begin[k].astype(np.int64), count[k].astype(np.int64))])))
        return B.table(B.ANSWER, rows)

    def apply(block, t, marks):
        texts = Texts.of(t[text_col])
        names, _, _, index, first = _words(texts, held.value.added)
        parts = sorted((s, x.as_py()) for s, x in zip(marks["start"].to_pylist(), marks["body"]))
        count, flat = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (zip(*(B.load(b) for _, b in parts)) if parts else ((), ())))
        count = count.astype(np.int64)
        begin = np.cumsum(count) - count
        ids = flat[gather(begin[index], count[index])]
        return finish(t, ids, np.append(0, np.cumsum(count[index]))[first])

    sent = B.each_block(blocks, send, B.SENT)
    back = sent.groupBy("bucket").applyInArrow(B.group_gives_back(encode), B.ANSWER).repartition(B.parts(blocks.sparkSession), "block")
    return B.with_answers(blocks, back, apply, schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    held = docs.sparkSession.sparkContext.broadcast(read_codec(path))

    def finish(t, ids, off):
        data, at = held.value.decode_bytes(ids)
        out = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            text = data[at[a] : at[b]].tobytes().decode("utf-8", "replace")
            out.append((hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "n_tokens": np.diff(off), "ids_sha256": pa.array([x[0] for x in out], pa.string()), "decoded_sha256": pa.array([x[1] for x in out], pa.string())})

    blocks = B.pack(B.chosen(docs, "doc_id", "text"))
    return encoded(blocks, held, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``docs``, all columns, and their ids as an array column (which replaces one of that name)."""
    held = docs.sparkSession.sparkContext.broadcast(read_codec(path))
    rest = [f for f in docs.schema.fields if f.name != to]

    def finish(t, ids, off):
        col = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
        return t.select([f.name for f in rest]).append_column(to, col)

    schema = StructType([*rest, StructField(to, ArrayType(IntegerType()))])
    return encoded(B.pack(docs, text_col), held, finish, schema, text_col)


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows``, all columns, and the text of their ids (null for null); bytes that are no UTF-8
    become the replacement character."""
    held = rows.sparkSession.sparkContext.broadcast(read_codec(path))
    rest = [f for f in rows.schema.fields if f.name != to]

    def texts(col):
        size = np.asarray(col.value_lengths().fill_null(0), np.int64)
        flat, null = np.asarray(col.flatten(), np.int64), np.asarray(col.is_null())
        data, at = held.value.decode_bytes(flat)
        ends = at[np.append(0, np.cumsum(size))].tolist()
        return [None if none else data[x:y].tobytes().decode("utf-8", "replace") for x, y, none in zip(ends[:-1], ends[1:], null.tolist())]

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(ids_col)
            ends = np.cumsum(np.asarray(b.column(at).value_lengths().fill_null(0), np.int64) + 1)
            first = 0
            while first < b.num_rows:  # some rows at a time: a byte of text is a number of eight bytes on the way
                upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + IDS_AT_ONCE, "right")))
                part = b.slice(first, upto - first)
                yield from pa.Table.from_batches([part]).select([f.name for f in rest]).append_column(to, pa.array(texts(part.column(at)), pa.string())).to_batches()
                first = upto

    return B.map_rows(rows, run, StructType([*rest, StructField(to, StringType())]))
