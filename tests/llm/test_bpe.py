"""Encoding and decoding against the tokenizers library."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import corpus, frame, sha, slim
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from revlens.llm import bpe
from revlens.llm.arrays import Texts

ODD = ["it's we'll 'd ''s !'s '", "a<|endoftext|> b<|endoftext|>", "<|endoftext|", "  two  spaces\n\n\tx ", "日本語 ٣٤ ½ 　 \x85 \x1c", "\U000105c0Ᲊ new letters", "é 👩‍👧", "x" * 5000]


def words(texts, added):
    t = Texts.of(pa.array(texts, pa.string()))
    start, end, first = bpe.split_words(t, added)
    raw = t.buf.tobytes()
    return [[raw[start[j] : end[j]].decode() for j in range(first[i], first[i + 1])] for i in range(len(texts))]


def library_words(text):
    split, out = ByteLevel(add_prefix_space=False), []
    for i, part in enumerate((text or "").split("<|endoftext|>")):
        out += ["<|endoftext|>"] * (i > 0) + [part[a:b] for _, (a, b) in (split.pre_tokenize_str(part) if part else [])]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.lists(st.sampled_from(["'", "s", "t", "re", "ll", " ", "\n", "é", "1", "!", "<|endoftext|>"]), max_size=20).map("".join)), min_size=1, max_size=5))
def test_words(texts):
    assert words(texts, [b"<|endoftext|>"]) == [library_words(t) for t in texts]


def test_digest(spark):
    tokenizer = Tokenizer.from_file(bpe.default_path())
    rows = corpus() + [(500 + i, t) for i, t in enumerate(ODD)]
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.digest(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_round_trip(spark):
    rows = corpus(n=5) + [(600 + i, t) for i, t in enumerate(ODD)]
    out = bpe.decode(bpe.encode(slim(spark, rows)))
    assert out.columns == ["doc_id", "text", "block", "bucket", "ids", "decoded"]
    for r in out.collect():
        assert r.decoded == (r.text or "")
    assert bpe.encode(frame(spark, [])).collect() == []
    bad = spark.createDataFrame([([28053, 50256],), (None,), ([],), ([222],)], "ids array<int>")
    tokenizer = Tokenizer.from_file(bpe.default_path())
    got = [r.decoded for r in bpe.decode(bad).collect()]
    assert sorted(got, key=str) == sorted([tokenizer.decode([28053, 50256], skip_special_tokens=False), None, "", tokenizer.decode([222], skip_special_tokens=False)], key=str)
