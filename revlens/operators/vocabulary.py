"""Matching texts against a vocabulary table of any size.

``extract_vocab`` of ``understand`` writes a vocabulary into one regular expression, which suits some hundred
entries.  Here the vocabulary is a table, and an entry is a sequence of words (letters and digits, lower-cased; signs
between words do not count).  The value of a text is that of its longest entry (characters of the words joined by
blanks), of those the earliest.  Two forms give the same rows:

* ``sent``: the entries become an automaton over words on each executor, and texts stay where they are.  Only for a
  vocabulary whose measured size is at most ``SENT_BYTES``.
* ``joined``: the texts' word sequences of the lengths that entries have are joined with the vocabulary; only hits
  are grouped.  Blocks of texts (``revlens.llm.blocks``; without these files a plain join) ask by short hashes which of
  their sequences may be entries; these travel as text, once for a block, and the text decides.

NULL and empty texts, and texts without a hit, have NULL as value and 0 hits.  Entries without a word are left out;
of rows of the same words the smallest value counts.  Very long texts are matched whole.  Repeated rows of the texts
are matched each when ``id_cols`` is unique, which the joined form needs.
"""

import importlib.util
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.text import words
from revlens.operators.joins import spread, with_group
from revlens.session import scratch_path, shuffles_dropped

SENT_BYTES = 4 << 20
# Bits of a hash by which blocks of texts ask: more cost every sequence, fewer let more pass that are no entries.
ASKED_BITS = 36
# Entries whose hashes a task holds at once.
ENTRIES_AT_ONCE = 1 << 20


def entries_of(vocab: DataFrame, surface_col: str, value_col: str) -> DataFrame:
    """``entry, n_words, value``: one row per sequence of words."""
    w = vocab.select(words(surface_col).alias("_w"), F.col(value_col).cast("string").alias("value")).where(F.size("_w") > 0)
    return w.groupBy(F.array_join("_w", " ").alias("entry"), F.size("_w").alias("n_words")).agg(F.min("value").alias("value"))


def sequences(text_col: str, sizes: Sequence[int]) -> Column:
    """Array of ``(entry, place)``: every n consecutive words of a text, for each n of ``sizes``.

    The words are bound by an outer ``transform``: as a column they would be split anew for every place.  They are
    read one by one, as ``slice`` copies the whole array for every place.
    """

    def of(tokens: Column, n: int) -> Column:
        places = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.concat_ws(" ", *[F.get(tokens, i + (j - 1)) for j in range(n)]).alias("entry"), i.alias("place")))

    return F.flatten(F.transform(F.array(words(text_col)), lambda w: F.concat(*[of(w, n) for n in sizes])))


def _met(rows: DataFrame, names: list[str], sizes: Sequence[int], entries: DataFrame) -> DataFrame:
    """``names``, ``entry, value, place, n``: the best entry of each of ``rows`` (``names``, ``line``: words joined by
    blanks, ``_several``) with the number of its entries; where ``_several``, every entry with n = 1.  Rows without an
    entry are left out.

    Blocks of rows ask twice: by short hashes, which of their sequences may be entries, then with the text of those,
    once for a block, which are.  What is asked and what is kept between the steps are scratch files.
    """
    from revlens.llm import arrays as A
    from revlens.llm import blocks as B

    spark = rows.sparkSession
    kind, seed, low = 1, A.P_BYTE2, np.uint64((1 << (64 - ASKED_BITS)) - 1)
    n_ranges = B.ranges(spark)
    fields = {c: rows.schema[c] for c in names}
    schema = T.StructType([*fields.values(), T.StructField("entry", T.StringType()), T.StructField("value", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("n", T.LongType())])

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        with shuffles_dropped(spark):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def spans(rows: pa.Table):
        """(texts, first byte, end, hash, row, place) of every sequence; of one length in the order of the text."""
        t = A.Texts.of(rows["line"])
        w = A.words_of(t, A.PLAIN)
        at = [np.flatnonzero(w.doc[: max(0, len(w.doc) - (n - 1))] == w.doc[n - 1 :]) for n in sizes]
        start = np.concatenate([w.start[i] for i in at])
        end = np.concatenate([w.end[i + (n - 1)] for i, n in zip(at, sizes)])
        first = np.concatenate(at)
        return t, start, end, A.hash_bytes(t.buf, start, end, seed), w.doc[first], first - w.first[w.doc[first]] + 1

    def text_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return buf[A.gather(start, end - start)]

    def column(size: np.ndarray, text: np.ndarray) -> pa.Array:
        return A.strings(text, np.append(0, np.cumsum(size, dtype=np.int64)))

    def ask(block: int, rows: pa.Table) -> pa.Table:
        asked = np.unique(spans(rows)[3] & ~low)
        return B.sends(block, n_ranges, asked, np.zeros(len(asked), np.uint8))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ENTRIES_AT_ONCE:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in some(batches):
            t = A.Texts.of(rows.column(0))
            have = np.unique(A.hash_bytes(t.buf, t.off[:-1], t.off[1:], seed) & ~low)
            yield from B.sends(-1, n_ranges, have, np.ones(len(have), np.uint8)).to_batches()

    def both(got: list[np.ndarray], _: np.ndarray) -> np.ndarray:
        hashes, entry = got
        order = np.argsort(hashes, kind="stable")
        heads = np.flatnonzero(A.run_starts(hashes[order]))
        has = np.logical_or.reduceat(entry[order] > 0, heads) if len(heads) else np.zeros(0, bool)
        out = np.zeros(len(hashes), bool)
        out[order] = np.repeat(has, np.diff(np.append(heads, len(hashes))))
        return out & (entry == 0)

    def proposed(rows: pa.Table, marks: pa.Table):
        """(spans, those that may be entries, the item that each of these is, one span of each item, the items' hashes):
        an item is a text of the block, in the order of the hashes."""
        all_spans = t, start, end, name, _, _ = spans(rows)
        asked, of = np.unique(name & ~low, return_inverse=True)
        at = np.flatnonzero(B.answers(marks, kind, len(asked))[of])
        _, one, item = A.exact_names(t.buf, start[at], end[at], name[at])  # by its bytes
        order = np.lexsort((start[at][one], name[at][one]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return all_spans, at, rank[item], at[one[order]], name[at[one[order]]]

    def propose(block: int, rows: pa.Table, marks: pa.Table) -> pa.Table:
        (t, start, end, *_), _, _, one, hashes = proposed(rows, marks)
        start, end = start[one], end[one]
        return B.table(B.SENT, [(i, block, a, B.dump((end - start)[a:b].astype(np.uint32), text_of(t.buf, start[a:b], end[a:b]), level=3)) for i, a, b in B.cut(hashes, n_ranges)])

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in some(batches):
            t, v = A.Texts.of(rows.column(0)), A.Texts.of(rows.column(1))
            hashes = A.hash_bytes(t.buf, t.off[:-1], t.off[1:], seed)
            none, order, out = np.asarray(rows.column(1).is_null()), np.argsort(hashes), []
            for i, a, b in B.cut(hashes[order], n_ranges):
                pick = order[a:b]
                texts = [x for y in (t, v) for x in (np.diff(y.off)[pick].astype(np.uint32), text_of(y.buf, y.off[:-1][pick], y.off[1:][pick]))]
                out.append((i, -1, 0, B.dump(*texts, none[pick].astype(np.uint8), level=3)))
            yield from B.table(B.SENT, out).to_batches()

    def decide(t: pa.Table) -> pa.Table:
        """For what a block proposed: the places of entries among it and their values."""
        have, values, none, out = [], [], [], []
        loaded = [(block, start, B.load(body.as_py())) for block, start, body in zip(t["block"].to_pylist(), t["start"].to_pylist(), t["body"])]
        for _, _, x in (x for x in loaded if x[0] < 0):
            have.append(column(*x[:2]))
            values.append(column(*x[2:4]))
            none.append(x[4])
        if have:
            have, values, none = pa.concat_arrays(have), A.Texts.of(pa.concat_arrays(values)), np.concatenate(none)
            asked = [(block, start, column(*x)) for block, start, x in loaded if block >= 0]
            texts = pa.concat_arrays([pa.array([], pa.large_string()), *(x for _, _, x in asked)])
            entry, to = np.asarray(pc.index_in(texts, have).fill_null(-1), np.int64), 0  # by the text; one table of the range
            for block, start, x in asked:
                at, to = entry[to : to + len(x)], to + len(x)
                hit = np.flatnonzero(at >= 0)
                at = at[hit]
                first, last = values.off[:-1][at], values.off[1:][at]
                out.append((block, kind + 1, start, B.dump(hit.astype(np.uint32), (last - first).astype(np.uint32), text_of(values.buf, first, last), none[at], level=3)))
        return B.table(B.ANSWER, out)

    def best(_: int, rows: pa.Table, marks: pa.Table) -> pa.Table:
        (t, start, end, _, row, place), at, item, one, _ = proposed(rows, marks)
        value_at, values, none = np.full(len(one), -1), [pa.array([], pa.large_string())], [np.zeros(0, np.uint8)]
        for k, first, body in zip(marks["kind"].to_pylist(), marks["start"].to_pylist(), marks["body"]):
            if k == kind + 1:
                hit, size, text, null = B.load(body.as_py())
                value_at[first + hit.astype(np.int64)] = sum(map(len, values)) + np.arange(len(hit))
                values.append(column(size, text))
                none.append(null)
        values, none = pa.concat_arrays(values), np.concatenate(none)
        is_entry = value_at[item] >= 0
        at, item = at[is_entry], item[is_entry]
        pick = np.unique(row[at] * max(1, len(one)) + item, return_index=True)[1]  # a text's first place in a row
        at, item = at[pick], item[pick]
        row, place = row[at], place[at]
        chars = np.asarray(pc.utf8_length(column((end - start)[one], text_of(t.buf, start[one], end[one]))), np.int64)
        order = np.lexsort((place, -chars[item], row))
        heads = A.run_starts(row[order])
        n = np.bincount(row, minlength=rows.num_rows)[row]
        several = np.asarray(rows["_several"].combine_chunks().cast(pa.uint8())).astype(bool)[row]
        out = order[heads | several[order]]
        at, item, row, place, n = at[out], item[out], row[out], place[out], np.where(several, 1, n)[out]
        texts = column(end[at] - start[at], text_of(t.buf, start[at], end[at])).cast(pa.string())
        value = values.take(pa.array(np.where(none[value_at[item]] > 0, -1, value_at[item]), mask=none[value_at[item]] > 0)).cast(pa.string())
        here = pa.array(row, pa.int64())
        return pa.table([*(rows[c].combine_chunks().take(here) for c in names), texts, value, pa.array(place, pa.int32()), pa.array(n, pa.int64())], schema.names)

    blocks = kept(B.pack(rows, "line", 2 * B.BLOCK_BYTES // max(2, len(sizes))), "blocks")
    sent = B.each_block(blocks, ask, B.SENT).unionByName(B.map_rows(entries.select("entry"), known, B.SENT))
    marks = kept(B.meet(sent, both, kind), "marks")
    sent = B.with_answers(blocks, marks, propose, B.SENT).unionByName(B.map_rows(entries.select("entry", "value"), worth, B.SENT))
    told = kept(sent.groupBy("bucket").applyInArrow(B.group_gives_back(decide), B.ANSWER), "told")
    return B.with_answers(blocks, marks.unionByName(told), best, schema)


def _joined(df: DataFrame, id_cols: Sequence[str], text_col: str, entries: DataFrame) -> DataFrame:
    sizes = sorted(r[0] for r in entries.select("n_words").distinct().collect())  # lengths, not entries
    if not sizes:
        return df.withColumns({"value": F.lit(None).cast("string"), "entry": F.lit(None).cast("string"), "n_found": F.lit(0).cast("bigint")})
    keys = [F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)]
    names = [f"_id{i}" for i in range(len(id_cols))]
    if importlib.util.find_spec("revlens.llm"):
        path = scratch_path(df.sparkSession, "repeated")  # an id's rows may stand in several blocks
        with shuffles_dropped(df.sparkSession):
            df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").write.parquet(path)
        repeated = df.sparkSession.read.parquet(path)
        lines = spread(df).select(*keys, F.array_join(words(text_col), " ").alias("line")).where(F.length("line") > 0)
        several = F.lit(False)
        if not repeated.isEmpty():
            lines = with_group(lines, repeated, names)
            several = F.col("_rows").isNotNull()
        found = _met(lines.select(*names, "line", several.alias("_several")), names, sizes, entries)
    else:
        found = spread(df).select(*keys, F.inline(sequences(text_col, sizes))).join(entries, "entry").withColumn("n", F.lit(1))
    found = found.groupBy(*names, "entry", "value").agg(F.min("place").alias("place"), F.max("n").alias("n"))
    best = F.max_by(F.struct("value", "entry"), F.struct(F.length("entry"), -F.col("place")))
    found = found.groupBy(*names).agg(best.alias("_b"), F.sum("n").alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(id_cols, names)]
    return df.join(found, same, "left").select(
        *df.columns, F.col("_b.value").alias("value"), F.col("_b.entry").alias("entry"), F.coalesce("_n", F.lit(0)).alias("n_found"))


def _sent(df: DataFrame, text_col: str, entries: DataFrame) -> DataFrame:
    table = entries.select("entry", "value").toArrow()  # at most SENT_BYTES, as measured
    sent = df.sparkSession.sparkContext.broadcast((table["entry"].to_pylist(), table["value"].to_pylist()))

    @F.pandas_udf("value string, entry string, n_found bigint")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for entry, value in zip(*sent.value):
            automaton.add_word(f" {entry} ", (entry, value))
        if len(automaton):
            automaton.make_automaton()
        for texts in batches:
            out = []
            for t in texts:
                hits = list(automaton.iter(t)) if t and len(automaton) else []
                end, (entry, value) = min(hits, key=lambda h: (-len(h[1][0]), h[0]), default=(0, (None, None)))
                out.append((value, entry, len({h[1][0] for h in hits})))
            yield pd.DataFrame(out, columns=["value", "entry", "n_found"])

    line = F.concat(F.lit(" "), F.array_join(words(text_col), " "), F.lit(" "))
    return spread(df).withColumn("_m", match(line)).select(*df.columns, "_m.value", "_m.entry", "_m.n_found")


def match_vocabulary(
    df: DataFrame, id_cols: str | Sequence[str], text_col: str, vocab: DataFrame, surface_col: str, value_col: str,
    strategy: str = "auto",
) -> DataFrame:
    """``df`` with ``value``, ``entry`` (the words that matched) and ``n_found`` (different entries in the text)."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    clash = {"value", "entry", "n_found"} & set(df.columns)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}: they are results")
    path = scratch_path(df.sparkSession, "entries")  # read several times: its size, its lengths, the join
    with shuffles_dropped(df.sparkSession):
        entries_of(vocab, surface_col, value_col).write.parquet(path)
    entries = df.sparkSession.read.parquet(path)
    if strategy == "auto":
        size = entries.agg(F.sum(F.octet_length("entry") + F.coalesce(F.octet_length("value"), F.lit(0)))).first()[0]
        strategy = "sent" if (size or 0) <= SENT_BYTES else "joined"
    return _sent(df, text_col, entries) if strategy == "sent" else _joined(df, ids, text_col, entries)
