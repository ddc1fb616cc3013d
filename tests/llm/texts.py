"""Small corpora with planted cases, and plain-Python words."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, block string, bucket int, TEXT string"
PLAIN = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def plain(text):
    return PLAIN.findall((text or "").encode())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def corpus(seed=3, n=40):
    """Texts with exact and near copies, a shared passage, a repeated line, odd signs and edge cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ日xyz") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["The", "don't", "x1", "#tag", "§"]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, texts = make(60), []
    for i in range(n):
        w = make(rng.randint(30, 160))
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 25) : rng.randint(40, 60)]
        if i % 5 == 1 and texts:
            w = texts[-1].split(" ")
            w[rng.randint(0, len(w) - 1)] = "changed"
        texts.append(" ".join(w))
    texts += [texts[2]] * 5  # copies
    texts += ["same line of text\n" * 30, "a a a a " * 40, " \t\n ", "", None, "one", "two words", "x" * 400, "日本語 " * 30, "a  b\x0bc d\n"]
    rows = [(i * 3 % 101 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[0], (rows[1][0], "another text under a number that is taken " + texts[5])]  # a repeated row, a shared number
    rows += [(None, texts[7]), (None, "no number")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "own", 7, "other") for i, t in rows], SCHEMA).repartition(3)


def slim(spark, rows):
    """Without the second column that Spark calls text."""
    return spark.createDataFrame([(i, t, "own", 7) for i, t in rows], "doc_id long, text string, block string, bucket int").repartition(3)


def last(i):
    return 2**63 - 1 if i is None else i
