"""License scans as an exact set-similarity join (dealt operator 5); DataFrame functions only.

A template is the set of words of a licence's notice.  A text block is the set of words of one line
or sentence, or, as notices are wrapped (and "v. 2.0" ends no sentence), that of any consecutive words
of the text, across lines and sentences, whose number is the notice's, plus as large a share as may be
missing.  A block matches a template when it holds at least ``containment`` of the template's words.
The template's words are ordered by how many documents of the corpus hold them (counted over all
documents, rarest first): a match must hold one of the first |T| - need + 1 of them (prefix filter),
must have at least ``need`` words (length filter), and from the rarest word of the prefix that it
holds only that word and those after it can agree (positional filter); the exact intersection
decides.  A text that holds fewer than ``need`` of a template's words anywhere has no block to compare.
The templates are constants, so the index of prefixes is an expression of a row: nothing but the words'
document counts is shuffled.

``matches`` gives every matching block with its place and containment; labels and score are taken from
these.  Of overlapping windows the best one counts, and a window that holds a line or sentence which matches as
well as it does is none.  Phrases are found apart from that, wherever their words stand consecutively, in whole texts.

Defined cases: a null or empty text has no words, no places (null first and last), empty labels and
score 0; overlapping places of different phrases all count; repeated rows are judged each; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices by label; their words are what is joined.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
CONTAINMENT = 0.9
FOUND = "array<struct<block:int,last_block:int,template:string,containment:double>>"
SPANS = "array<struct<place:int,end:int,block:int,last_block:int,containment:double>>"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_END = r"\n|[.!?;]\s"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.split(F.lit(" ".join(values)), " ")


def document_counts(docs: DataFrame, tokens: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each token stands; the result has as many rows as there are tokens."""
    w = words(lowered(F.col(f"`{text_col}`")))
    found = docs.select(F.explode(F.array_intersect(_strings(tokens), w)).alias("token")).groupBy("token").count()
    return {t: 0 for t in tokens} | {r["token"]: r["count"] for r in found.collect()}


def _index(notices: dict[str, str], count: dict[str, int], containment: float) -> Column:
    """The templates as one array of constants; words rarest first."""
    rows = []
    for label, notice in notices.items():
        t = sorted(set(notice.split()), key=lambda w: (count[w], w))
        need = -int(-containment * len(t) // 1)
        width = -int(-len(notice.split()) / containment // 1)
        values = {"label": F.lit(label), "words": _strings(t), "prefix": _strings(t[: len(t) - need + 1]), "n": F.lit(len(t)), "need": F.lit(need), "width": F.lit(width)}
        rows.append(F.struct(*(c.alias(k) for k, c in values.items())))
    return F.array(*rows)


def _pieces(blocks: Column, t: Column) -> Column:
    """The lines and sentences that hold enough of the template."""

    def share(b: Column) -> Column:
        both = F.array_intersect(t["words"], b)  # in the template's order
        first = F.array_position(t["words"], F.element_at(both, 1))
        able = F.arrays_overlap(b, t["prefix"]) & (F.size(b) >= t["need"])
        agrees = F.when((t["n"] - first + 1 >= t["need"]) & (F.size(both) >= t["need"]), F.size(both) / t["n"])
        return F.coalesce(F.when(able, agrees), F.lit(0.0))

    every = F.transform(blocks, lambda b, i: F.struct(i.alias("block"), i.alias("last_block"), t["label"].alias("template"), share(b).alias("containment")))
    return F.filter(every, lambda m: m["containment"] > 0).cast(FOUND)


def _windows(t: Column) -> Column:
    """The same for ``width`` consecutive words anywhere.  ``hits`` are the template's words in the text
    with their places; the words from a hit on are the best ones of those that hold it first; they end
    with the last that is new."""
    hits = t["hits"]

    def near(h: Column, k: Column) -> Column:
        x = F.filter(F.slice(hits, k + 1, t["width"]), lambda g: g["place"] < h["place"] + t["width"])
        return F.struct(x.alias("near"), F.array_distinct(x["word"]).alias("kinds"))

    def span(x: Column) -> Column:
        first = F.element_at(x["near"], 1)
        last = F.element_at(x["near"], F.array_position(x["near"]["word"], F.element_at(x["kinds"], -1)).cast("int"))
        return F.struct(first["place"].alias("place"), last["place"].alias("end"), first["block"].alias("block"), last["block"].alias("last_block"), (F.size(x["kinds"]) / t["n"]).alias("containment"))

    return F.transform(F.filter(F.transform(hits, near), lambda x: F.size(x["kinds"]) >= t["need"]), span).cast(SPANS)


def _wrapped(windows: Column, pieces: Column, label: Column) -> Column:
    """Windows that no line or sentence within them equals; of those that overlap the first of a run, the best."""
    best = lambda w: F.exists(pieces, lambda p: p["block"].between(w["block"], w["last_block"]) & (p["containment"] >= w["containment"]))

    def join(done: Column, w: Column) -> Column:
        x = F.element_at(done, -1)
        better = F.struct(x["place"].alias("place"), x["end"].alias("end"), *(w[c].alias(c) for c in ("block", "last_block", "containment")))
        more = F.when(w["containment"] > x["containment"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(better))).otherwise(done)
        return F.when(F.try_element_at(done, F.lit(-1))["end"] >= w["place"], more).otherwise(F.concat(done, F.array(w))).cast(SPANS)

    runs = F.aggregate(F.filter(windows, lambda w: ~best(w)), F.array().cast(SPANS), join)
    return F.transform(runs, lambda r: F.struct(r["block"], r["last_block"], label.alias("template"), r["containment"])).cast(FOUND)


def _places(spaced: Column, phrase: str, n_words: Column) -> tuple[Column, Column, Column]:
    """Number of a phrase's places, and its first and last start (in words).  Every word stands
    between spaces of its own, so that places share no sign."""
    parts = phrase.split()
    pieces = F.split(spaced, " " + "  ".join(parts) + " ")
    count = F.size(pieces) - 1
    length = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("long")
    first = F.when(count > 0, length(F.element_at(pieces, 1)))
    last = F.when(count > 0, n_words - length(F.element_at(pieces, -1)) - len(parts))
    return count.cast("long"), first, last


def _found(df: DataFrame, kept: list[str], text_col: str, templates: dict[str, str] | None, containment: float) -> DataFrame:
    """``kept`` with n_words, __spaced (where a phrase may stand) and __found, the matches of every template."""
    notices = templates or TEMPLATES
    vocabulary = sorted({t for v in notices.values() for t in v.split()})
    index = _index(notices, document_counts(df, vocabulary, text_col), containment)

    df = df.select(*kept, F.col(text_col).alias("__text"))
    df = df.withColumn("__low", lowered(F.col("__text"))).withColumn("__words", words(F.col("__low")))
    n_words = F.size("__words").cast("long")
    rarely = F.col("__low").rlike("license|cc[^0-9a-z]+by")
    spaced = F.when(rarely, F.concat(F.lit(" "), F.array_join("__words", "  "), F.lit(" "))).otherwise(F.lit(""))
    df = df.select(*kept, n_words.alias("n_words"), spaced.alias("__spaced"), "__low", "__words", F.array_intersect("__words", _strings(vocabulary)).alias("__held"))

    able = F.filter(index, lambda t: F.size(F.array_intersect("__held", t["words"])) >= t["need"])
    df = df.select(*kept, "n_words", "__spaced", "__low", able.alias("__able"))
    blocks = F.when(F.size("__able") > 0, F.transform(F.split("__low", BLOCK_END), words)).otherwise(F.array().cast("array<array<string>>"))
    df = df.select(*kept, "n_words", "__spaced", "__able", blocks.alias("__blocks"))
    every = F.flatten(F.transform("__blocks", lambda b, i: F.transform(b, lambda w: F.struct(i.alias("block"), w.alias("word")))))
    placed = F.transform(every, lambda x, i: F.struct(i.alias("place"), x["block"].alias("block"), x["word"].alias("word")))
    hits = lambda t: F.filter(placed, lambda h: F.array_contains(t["words"], h["word"]))
    each = lambda t: F.struct(*(t[c].alias(c) for c in ("label", "n", "need", "width")), hits(t).alias("hits"), _pieces(F.col("__blocks"), t).alias("pieces"))
    df = df.select(*kept, "n_words", "__spaced", F.transform("__able", each).alias("__each"))
    each = lambda t: F.struct(t["label"].alias("label"), t["pieces"].alias("pieces"), _windows(t).alias("windows"))
    df = df.select(*kept, "n_words", "__spaced", F.transform("__each", each).alias("__each"))
    found = F.flatten(F.transform("__each", lambda t: F.concat(t["pieces"], _wrapped(t["windows"], t["pieces"], t["label"]))))
    return df.select(*kept, "n_words", "__spaced", found.alias("__found"))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, block, last_block, template, containment) of every matching block.  Lines and sentences
    are numbered from 0; a notice over several of them has the number of the first and of the last."""
    at = [docs.columns.index(id_col), docs.columns.index(text_col)]
    df = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    df = _found(df, [f"c{at[0]}"], f"c{at[1]}", templates, containment)
    return df.select(F.col(f"c{at[0]}").alias(id_col), F.inline("__found"))


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score (which
    replace columns of these names)."""
    names_in, text_at = docs.columns, docs.columns.index(text_col)
    docs, text_col = docs.toDF(*(f"c{i}" for i in range(len(names_in)))), f"c{text_at}"  # names may differ in case only
    out = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [f"c{i}" for i, c in enumerate(names_in) if c not in out]
    df = _found(docs, kept, text_col, templates, containment)
    places = {label: _places(F.col("__spaced"), phrase, F.col("n_words")) for phrase, label in PHRASES.items()}
    names = list(places)
    df = df.select(
        *kept,
        "n_words",
        *(c.alias(f"__{what}{i}") for i, k in enumerate(names) for what, c in zip(("n", "f", "l"), places[k])),
        "__found",
    )
    col = lambda what: [F.col(f"__{what}{i}") for i in range(len(names))]
    base = F.array_compact(F.array(*(F.when(n > 0, F.lit(k)) for k, n in zip(names, col("n")))))
    more = F.array_distinct(F.col("__found")["template"])
    n_base = sum(col("n")[1:], col("n")[0])
    return df.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names_in) if c not in out),
        "n_words",
        n_base.alias("n_base"),
        F.least(*col("f")).alias("first_word"),
        F.greatest(*col("l")).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("__found")["containment"]), F.lit(0.0))).alias("score"),
    )
