"""Perspective rotation against plain Python."""

import re

from revlens.llm import rotate

TURNS = [
    (1, 0, "system", "be kind"),
    (1, 1, "anna", "hi"),
    (1, 2, "bo", "hello é"),
    (1, 3, "anna", None),
    (1, 3, "anna", None),
    (1, 600, "cy", "late"),
    (2, 0, "system", "nobody speaks"),
    (3, 1, None, "who"),
    (3, None, "dan", "no turn"),
    (3, 2, "", "empty name"),
    (None, 0, "eve", "no number"),
    (None, 1, "assistant", ""),
]


def expected(turns):
    out = []
    for conv in {t[0] for t in turns}:
        said = [(t[1], t[2] or "unknown", t[3] or "") for t in turns if t[0] == conv]
        said.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        for who in {s for _, s, _ in said} - {"system", "unknown"}:
            at = 0
            for turn, speaker, text in said:
                role = "assistant" if speaker == who else "system" if speaker == "system" else "user"
                head = f"<|im_start|>{role}" + (f" name={speaker}" if role == "user" else "") + "\n"
                piece = head + text + "<|im_end|>\n"
                mask = (at + len(head), at + len(piece) - 1) if role == "assistant" else (None, None)
                out.append((conv, who, turn, speaker, role, piece, at, at + len(piece), *mask))
                at += len(piece)
    return sorted(out, key=str)


def frame(spark, turns):
    return spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, perspective string, TEXT string")


def test_rotation(spark):
    got = rotate.rotate(frame(spark, TURNS), stretch=2)
    assert got.columns == rotate.COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(TURNS)


def test_long_conversation(spark):
    turns = [(7, i, f"s{i % 3}", "t" * (i % 5)) for i in range(1500)]
    assert sorted((tuple(r) for r in rotate.rotate(frame(spark, turns)).collect()), key=str) == expected(turns)


def test_dialogues(spark):
    rows = {(r.conv_id, r.perspective): r for r in rotate.dialogues(rotate.rotate(frame(spark, TURNS))).collect()}
    r = rows[1, "anna"]
    assert r.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bo\nhello é<|im_end|>\n")
    assert [r.text[a:b] for a, b in r.masks] == ["hi<|im_end|>", "<|im_end|>", "<|im_end|>"]


def test_native_and_empty(spark, capsys):
    rotate.rotate(frame(spark, TURNS)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
    assert rotate.rotate(frame(spark, [])).collect() == []
