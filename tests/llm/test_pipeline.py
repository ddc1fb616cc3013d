"""The pipeline's stages and run() against brute force."""

import hashlib

import corpus_pipeline
import test_decontaminate
import test_jaccard
import test_quality
from texts import corpus, last
from tokenizers import Tokenizer

from revlens.llm import bpe, quality


def cut(rows, width=50):
    """Texts without bytes of windows that start in a smaller document; characters go as a whole."""
    first = {}
    for i, t in rows:
        x = t.encode()
        for k in range(len(x) - width + 1):
            first[x[k : k + width]] = min(first.get(x[k : k + width], last(None)), last(i))
    out = []
    for i, t in rows:
        x, gone = t.encode(), set()
        for k in range(len(x) - width + 1):
            if first[x[k : k + width]] < last(i):
                gone.update(range(k, k + width))
        kept, at = "", 0
        for c in t:
            n = len(c.encode())
            kept += "" if gone.issuperset(range(at, at + n)) else c
            at += n
        out.append((i, kept))
    return out


def expected(rows, items):
    m = [test_quality.expected(t) for _, t in rows]
    counts = {c: [x[k] for x in m] for k, c in enumerate(quality.COUNTS)}
    import numpy as np

    _, kept = quality.verdict({c: np.array(v) for c, v in counts.items()})
    rows = [r for r, k in zip(rows, kept) if k]
    yield rows
    part = {i: c for i, _, c in test_jaccard.expected(rows)}
    rows = [r for r in rows if part[r[0]] == r[0]]
    yield rows
    rows = cut(rows)
    yield rows
    hit = {r[0] for r in test_decontaminate.expected(rows, items) if r[5]}
    rows = [r for r in rows if r[0] not in hit]
    yield rows


def test_stages(spark, tmp_path):
    seen, rows = set(), []
    for i, t in corpus(seed=6, n=60) + test_jaccard.family():
        if i is not None and i not in seen:
            rows.append((i, t))
            seen.add(i)
    items = [(1, " ".join(rows[3][1].split()[4:20])), (2, "no such passage anywhere in these documents at all, is there")]
    docs = spark.createDataFrame([(i, t, None, f"s{i % 3}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    at, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), [len(rows)]
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, expected(rows, items))):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        assert at.columns == docs.columns
        got = at.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in got)
        sizes.append(len(got))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 20

    tokenizer = Tokenizer.from_file(bpe.default_path())
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in want}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: (r.ids, r.n_tokens) for r in out.collect()} == {i: (x, len(x)) for i, x in ids.items()}
    assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want}


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
