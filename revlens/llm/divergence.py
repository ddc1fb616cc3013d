"""How the sources of a language differ in their terms, with late string materialization (dealt operator 12).

A term travels as a 64-bit digest; its text stays behind until something is reported.

1. Tasks tokenise whole texts and add up, for each (language, source, digest), the occurrences and the
   documents with the term, and write two things once: the counts, as packed columns of fixed width cut
   by ranges of digests, and beside them the texts of these digests.
2. A range adds up what tasks have counted; only these packed numbers are shuffled for it.  Terms in enough
   documents of their language are kept.
3. Kept digests meet their texts by range: a digest's texts have a minimum and a maximum, and where these
   differ, several terms share it.  Such digests are split: their terms are counted again, from the
   documents, under another digest, until no two terms share one.
4. Shares are integers, p = 1 + floor(10^9 (c + 1) / (N + V)), and so is everything made of them.  A pair
   of sources is compared over all kept terms, also those that neither has.  With b for the share of a
   term that a source does not have, the sum over all V terms is V f(b, b') plus corrections over the
   terms of one source (by how many terms have which count: a short table for each source) and over the
   terms that both have (the only part that goes through terms one by one, some at a time).
5. Of the terms by which a source stands out, a range passes on those from its 200th value up, the least
   value that can be reported is found, and only terms from there up are joined with their text; ties at
   the end are put in the order of the text.

Sums are 64-bit; those in SQL raise an error should one overflow (V beyond some 10^9 in one language).

Defined cases: a null text, language or source is the empty string; a group without terms is in all its
language's pairs, with value 0 if the language keeps no term; rows that share a number are documents of
their own; a text of any length is read whole, some MB at a time; an empty table gives an empty result.
Columns other than the three, whatever their names, are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm import blocks as B
from revlens.llm.arrays import U, Texts, byte_table, exact_names, gather, hash_bytes, mix, run_starts, words_of
from revlens.session import scratch_path

MIN_DOCS = 3
TOP = 200
ONE = 1_000_000_000
#: Counts that a task holds before it writes what it has added up.
HELD_ROWS = 1 << 20
#: Digests that several terms share: some n * n / 2**65 of n terms.  More of them than this is an error.
MAX_SHARED = 1 << 20
#: Pairs of sources that are compared at a time.
PAIRS_AT_ONCE = 1 << 20
LETTERS = byte_table(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A)  # after lower-casing A-Z
WRITTEN = "part int, groups string, counts binary, texts binary"
KEPT = "part int, lang string, sources array<string>, totals array<long>, body binary"
FOUND = "kind string, lang string, source string, item string, digest long, n long, value long"


def _strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.append(0, np.cumsum(size)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))


def _digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = hash_bytes(buf, start, end, mix(np.array([level + 1], U))[0])
    return h >> U(64 - bits) << U(64 - bits)


class _Sums:
    """What a task has counted: (group, digest) -> occurrences and documents; digest -> text."""

    def __init__(self, level: int, bits: int, shared: np.ndarray | None):
        self.level, self.bits, self.shared = level, bits, shared
        self.clear()

    def clear(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.held, self.texts, self.size = [], [], 0

    def add(self, lang: list[str], source: list[str], texts: pa.Array) -> None:
        group_of = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(lang, source)], np.int64)
        t = Texts.of(texts).lowered()
        w = words_of(t, LETTERS)
        h = hash_bytes(t.buf, w.start, w.end, mix(np.array([1], U))[0])
        _, one, term = exact_names(t.buf, w.start, w.end, h)  # a batch's distinct terms, told apart by their bytes
        digest = h[one] >> U(64 - self.bits) << U(64 - self.bits) if self.bits < 64 else h[one]
        row = w.doc
        if self.shared is not None:  # terms of shared digests only, under the next digest
            wanted = np.isin(digest, self.shared)
            digest = _digests(t.buf, w.start[one], w.end[one], self.level, 64)
            row, term = row[wanted[term]], term[wanted[term]]
        if not len(row):
            return
        # rows of a batch stand in order, so that a document's occurrences of a term are neighbours here
        order = np.argsort(term * t.n + row, kind="stable")
        k, r = term[order], row[order]
        heads = np.flatnonzero(run_starts(k, r))
        n, k, g = np.diff(np.append(heads, len(k))), k[heads], group_of[r[heads]]
        order = np.argsort(k * len(self.groups) + g, kind="stable")
        k, g, n = k[order], g[order], n[order]
        heads = np.flatnonzero(run_starts(k, g))
        self.held.append((digest[k[heads]], g[heads], np.add.reduceat(n, heads), np.diff(np.append(heads, len(k)))))
        used = np.unique(k)
        size = (w.end - w.start)[one[used]]
        self.texts.append(pa.table({"digest": digest[used], "term": _strings(t.buf[gather(w.start[one[used]], size)], size)}))
        self.size += len(heads)

    def fold(self) -> None:
        if len(self.held) > 1:
            d, g, n, docs = (np.concatenate(x) for x in zip(*self.held))
            order = np.lexsort((g, d))
            heads = np.flatnonzero(run_starts(d[order], g[order]))
            self.held = [(d[order][heads], g[order][heads], np.add.reduceat(n[order], heads), np.add.reduceat(docs[order], heads))]
            self.size = len(heads)
            self.texts = [pa.concat_tables(self.texts).group_by(["digest", "term"]).aggregate([])]

    def rows(self, parts: int) -> Iterator[pa.RecordBatch]:
        self.fold()
        names = list(self.groups)
        schema = pa.schema([("part", pa.int32()), ("groups", pa.string()), ("counts", pa.binary()), ("texts", pa.binary())])
        # every group, also one without terms, is named once
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([json.dumps(names)]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], schema=schema)
        if self.held:
            (d, g, n, docs), texts = self.held[0], self.texts[0].sort_by([("digest", "ascending"), ("term", "ascending")])
            order = np.lexsort((g, d))
            d, g, n, docs = d[order], g[order], n[order], docs[order]
            named = np.asarray(texts["digest"].combine_chunks(), U)
            t = Texts.of(texts["term"])
            at = {i: (a, b) for i, a, b in B.cut(named, parts)}
            for i, a, b in B.cut(d, parts):
                used, again = np.unique(g[a:b], return_inverse=True)
                x, y = at[i]
                body = B.dump(d[a:b], again.astype(np.uint32), n[a:b].astype(np.uint32 if n[a:b].max() < 1 << 32 else U), docs[a:b].astype(np.uint32))
                words = B.dump(named[x:y], np.diff(t.off[x : y + 1]).astype(np.uint32), t.buf[t.off[x] : t.off[y]])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([json.dumps([names[k] for k in used])]), pa.array([body], pa.binary()), pa.array([words], pa.binary())], schema=schema)
        self.clear()


def counted(docs: DataFrame, parts: int, level: int = 0, bits: int = 64, shared: np.ndarray | None = None) -> DataFrame:
    """What tasks have counted, written and read again (WRITTEN).  ``shared`` are digests whose terms alone are
    wanted, under a digest of their own (``level``)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(shared)

    def run(batches):
        sums = _Sums(level, bits, held.value)
        for b in B.slices(batches, "text"):
            lang, source = (b.column(i).fill_null("").to_pylist() for i in (1, 2))
            sums.add(lang, source, b.column(0))
            if sums.size > HELD_ROWS:
                sums.fold()
                if sums.size > HELD_ROWS // 2:
                    yield from sums.rows(parts)
        yield from sums.rows(parts)

    docs = B.chosen(docs, "text", "lang", "source")
    path = scratch_path(spark, "term-counts")
    docs.select(*(F.col(c).cast("string").alias(c) for c in docs.columns)).mapInArrow(run, WRITTEN).write.parquet(path)
    return spark.read.parquet(path)


def kept_terms(written: DataFrame, min_docs: int, shared: np.ndarray | None = None) -> DataFrame:
    """KEPT: kept terms by range and language, packed: digest, source (an index), count, and the language's count."""
    held = written.sparkSession.sparkContext.broadcast(shared if shared is not None else np.zeros(0, U))

    def run(t: pa.Table) -> pa.Table:
        groups: dict[tuple[str, str], int] = {}
        cols = []
        for names, body in zip(t["groups"].to_pylist(), t["counts"]):
            own = np.array([groups.setdefault(tuple(x), len(groups)) for x in json.loads(names)], np.int64)
            d, g, n, docs = B.load(body.as_py())
            cols.append((d, own[g], n.astype(np.int64), docs.astype(np.int64)))
        d, g, n, docs = (np.concatenate(x) for x in zip(*cols))
        names = list(groups)
        langs: dict[str, int] = {}
        lang_of = np.array([langs.setdefault(x, len(langs)) for x, _ in names], np.int64)
        order = np.lexsort((g, d, lang_of[g]))
        d, g, n, docs = d[order], g[order], n[order], docs[order]
        heads = np.flatnonzero(run_starts(d, g))
        d, g, n, docs = d[heads], g[heads], np.add.reduceat(n, heads), np.add.reduceat(docs, heads)
        lang = lang_of[g]
        heads = np.flatnonzero(run_starts(d, lang))
        term = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(d))))
        keep = (np.add.reduceat(docs, heads)[term] >= min_docs) & ~np.isin(d, held.value)
        of_lang = np.add.reduceat(n, heads)[term]
        d, g, n, of_lang, lang = d[keep], g[keep], n[keep], of_lang[keep], lang[keep]
        out = []
        for name, i in langs.items():
            own = np.flatnonzero(lang == i)
            if len(own):
                used, again = np.unique(g[own], return_inverse=True)
                totals = np.bincount(again, n[own]).astype(np.int64)
                out.append((t["part"][0].as_py(), name, [names[k][1] for k in used], totals.tolist(), B.dump(d[own], again.astype(np.uint32), n[own], of_lang[own])))
        part, name, sources, totals, body = zip(*out) if out else ((),) * 5
        return pa.table({"part": pa.array(part, pa.int32()), "lang": pa.array(name, pa.string()), "sources": pa.array(sources, pa.list_(pa.string())), "totals": pa.array(totals, pa.list_(pa.int64())), "body": pa.array(body, pa.binary())})

    kept = written.where("part >= 0").select("part", "groups", "counts").groupBy("part").applyInArrow(run, KEPT)
    path = scratch_path(written.sparkSession, "kept-terms")
    kept.write.parquet(path)
    return written.sparkSession.read.parquet(path)


def kept_texts(kept: DataFrame, written: DataFrame) -> DataFrame:
    """(digest, term, greatest): the least and the greatest text of every kept digest."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.unique(np.concatenate([np.zeros(0, U), *(B.load(x.as_py())[0] for x in left["body"])]))
        d, term = [np.zeros(0, U)], [pa.array([], pa.large_string())]
        for body in right["texts"] if len(wanted) else []:
            named, size, data = B.load(body.as_py())
            i = np.flatnonzero(np.isin(named, wanted))
            d.append(named[i])
            term.append(_strings(data, size.astype(np.int64)).take(pa.array(i)))
        got = pa.table({"digest": np.concatenate(d).view(np.int64), "term": pa.concat_arrays(term)}).group_by("digest").aggregate([("term", "min"), ("term", "max")])
        return pa.table({"digest": got["digest"], "term": got["term_min"].cast(pa.string()), "greatest": got["term_max"].cast(pa.string())})

    both = kept.select("part", "body").groupBy("part").cogroup(written.where("part >= 0").select("part", "texts").groupBy("part"))
    path = scratch_path(kept.sparkSession, "kept-texts")
    both.applyInArrow(run, "digest long, term string, greatest string").write.parquet(path)
    return kept.sparkSession.read.parquet(path)


def terms_of(docs: DataFrame, min_docs: int = MIN_DOCS, digest_bits: int = 64):
    """(groups: lang, source; KEPT; texts: digest, term), no two kept terms under one digest."""
    parts = B.parts(docs.sparkSession)
    written = counted(docs, parts, 0, digest_bits)
    groups = written.where("part = -1").select(F.explode(F.from_json("groups", "array<array<string>>")).alias("g"))
    groups = groups.select(F.col("g")[0].alias("lang"), F.col("g")[1].alias("source")).distinct()
    kept = kept_terms(written, min_docs)
    texts = kept_texts(kept, written)
    shared = texts.where("term <> greatest").select("digest").limit(MAX_SHARED + 1).collect()
    if len(shared) > MAX_SHARED:
        raise ValueError("digests are too short for this many terms")
    if shared:
        shared = np.sort(np.array([r.digest for r in shared], np.int64).view(U))
        kept, whole = kept_terms(written, min_docs, shared), texts.where("term = greatest")
        level = 1
        while True:
            again = counted(docs, parts, level, digest_bits, shared)
            more = kept_terms(again, min_docs)
            names = kept_texts(more, again)
            taken = names.join(whole, "digest", "left_semi").limit(1).count()
            if not taken and not names.where("term <> greatest").limit(1).count():
                break
            level += 1
        kept, texts = kept.unionByName(more), whole.unionByName(names)
    return groups, kept, texts.select("digest", "term")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), by long division so that no step leaves 64 bits."""
    a, d = n + 1, total + kept
    digits, rest = F.expr("0L"), None
    for scale in (1, 1000, 1000, 1000):
        a = a if rest is None else rest * scale
        digits = digits * scale + _div(a, d)
        rest = a % d
    return digits + 1


def shares(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """The same for arrays."""
    rest, d = n + 1, total + kept
    out = rest // d
    rest = rest % d
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // d, rest % d
    return out + 1


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that are not negative."""
    return F.call_function("div", a, b)


def value(p, q):
    square = (p - q) * (p - q)
    return square // q if isinstance(p, np.ndarray) else _div(square, q)


def _both(term: np.ndarray, source: np.ndarray, p: np.ndarray, base: np.ndarray, n_sources: int):
    """(source, other, correction) over the terms that both have; rows are sorted by term."""
    heads = np.flatnonzero(run_starts(term))
    size = np.diff(np.append(heads, len(term)))[np.cumsum(run_starts(term)) - 1]  # partners of a row, itself included
    first = np.repeat(heads, np.diff(np.append(heads, len(term))))
    ends, a = np.cumsum(size), 0
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while a < len(term):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
        i = np.repeat(np.arange(a, b), size[a:b])
        j = gather(first[a:b], size[a:b])
        i, j = i[source[i] != source[j]], j[source[i] != source[j]]
        b_i, b_j = base[source[i]], base[source[j]]
        v = value(p[i], p[j]) - value(p[i], b_j) - value(b_i, p[j]) + value(b_i, b_j)
        key = np.concatenate([keys, source[i] * n_sources + source[j]])
        v = np.concatenate([sums, v])
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(run_starts(key[order]))
        keys, sums = key[order][starts], np.add.reduceat(v[order], starts) if len(starts) else sums
        a = b
    return keys // max(n_sources, 1), keys % max(n_sources, 1), sums


def findings(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """FOUND, of every range: ``both`` (corrections of pairs over common terms), ``count`` (n: an occurrence count,
    value: the number of a source's terms with it) and ``term`` (digest, value: from the range's ``top``-th up)."""
    spark = kept.sparkSession
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    # a range's row gets the figures of its sources
    each = kept.select("part", "lang", F.posexplode("sources").alias("at", "source")).join(groups, ["lang", "source"])
    each = each.groupBy("part", "lang").agg(F.sort_array(F.collect_list(F.struct("at", "total", "base"))).alias("figures"), F.max("kept").alias("kept"))
    rows = kept.select("part", "lang", "sources", "body").join(each, ["part", "lang"]).join(of_lang, "lang")
    rows = rows.select("lang", "sources", "body", F.col("figures.total").alias("totals"), F.col("figures.base").alias("bases"), "kept", "lang_total")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                d, s, n, of_lang = B.load(r["body"])
                s, total, base, lang, names = s.astype(np.int64), np.array(r["totals"], np.int64), np.array(r["bases"], np.int64), r["lang"], r["sources"]
                p, q = shares(n, total[s], r["kept"]), shares(of_lang, np.full(len(n), r["lang_total"], np.int64), r["kept"])
                order = np.argsort(d, kind="stable")
                i, j, v = _both(d[order], s[order], p[order], base, len(names))
                yield _found("both", lang, names, i, j, None, None, v)
                order = np.lexsort((n, s))
                heads = np.flatnonzero(run_starts(s[order], n[order]))
                yield _found("count", lang, names, s[order][heads], None, None, n[order][heads], np.diff(np.append(heads, len(order))))
                f = value(p, q)
                above = np.flatnonzero(p > q)
                above = above[np.lexsort((-f[above], s[above]))]
                heads = np.flatnonzero(run_starts(s[above]))
                size = np.diff(np.append(heads, len(above)))
                least = f[above][heads + np.minimum(size, top) - 1]
                above = above[f[above] >= np.repeat(least, size)]
                yield _found("term", lang, names, s[above], None, d[above], None, f[above])

    path = scratch_path(spark, "findings")
    rows.mapInArrow(run, FOUND).write.partitionBy("kind").parquet(path)
    return spark.read.schema(FOUND).parquet(path)


def _found(kind, lang, names, source, item, digest, n, v) -> pa.RecordBatch:
    named, size = pa.array(names, pa.string()), len(v)
    cols = [pa.array([kind] * size, pa.string()), pa.array([lang] * size, pa.string()), named.take(pa.array(source)), named.take(pa.array(item)) if item is not None else pa.nulls(size, pa.string())]
    cols += [pa.array(digest.view(np.int64)) if digest is not None else pa.nulls(size, pa.int64()), pa.array(n) if n is not None else pa.nulls(size, pa.int64()), pa.array(v, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["kind", "lang", "source", "item", "digest", "n", "value"])


def pairs(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's sources."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other_total"), F.col("base").alias("other_base"))
    both = groups.join(other, "lang").where("source <> item")
    f = lambda a, b: value(F.col(a), F.col(b))
    base = both.select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("kept") * f("base", "other_base")).otherwise(0).alias("value"))
    # terms of one side: by how many of a source's terms have which count
    many = found.where("kind = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").alias("terms"))
    left = both.join(many, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    left = left.select("lang", "source", "item", (F.col("terms") * (f("p", "other_base") - f("base", "other_base"))).alias("value"))
    right = both.join(many.withColumnRenamed("source", "item"), ["lang", "item"]).withColumn("q", share(F.col("n"), F.col("other_total"), F.col("kept")))
    right = right.select("lang", "source", "item", (F.col("terms") * (f("base", "q") - f("base", "other_base"))).alias("value"))
    met = found.where("kind = 'both'").select("lang", "source", "item", "value")
    out = base
    for x in (left, right, met):
        out = out.unionByName(x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    return out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(found: DataFrame, texts: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): each source's terms above its language's share, the first ``top``."""
    t = found.where("kind = 'term'").select("lang", "source", "digest", "value")
    # the value from which a term may be reported: tasks pass on their first rows of a group only
    ranked = t.select("lang", "source", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"))).alias("rank"))
    least = ranked.where(F.col("rank") <= top).groupBy("lang", "source").agg(F.min("value").alias("least"))
    t = t.join(least, ["lang", "source"]).where("value >= least")
    t = t.join(texts, "digest").select("lang", "source", F.col("term").alias("item"), "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return t.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, digest_bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a source with every other one of its
    language, part ``term`` has the terms by which it stands out."""
    named, kept, texts = terms_of(docs, min_docs, digest_bits)
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
    size = texts_by_lang(kept)
    groups = named.join(totals, ["lang", "source"], "left").join(size, "lang", "left").na.fill(0, ["total", "kept"])
    groups = groups.withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))).checkpoint()
    found = findings(kept, groups, top)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    two = pairs(groups, found).withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))
    one = top_terms(found, texts, top).withColumn("part", F.lit("term"))
    return two.unionByName(one).select("lang", "source", "part", "item", "value", "rank")


def texts_by_lang(kept: DataFrame) -> DataFrame:
    """(lang, kept): the number of terms that a language keeps."""

    def run(batches):
        for b in batches:
            n = [len(np.unique(B.load(x.as_py())[0])) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["lang", "n"])

    return kept.select("lang", "body").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("kept"))
