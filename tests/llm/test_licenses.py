"""License scan against brute force."""

import re

from texts import ALNUM, corpus, frame, lower, slim

from revlens.llm import licenses

NOTICES = [
    "CC BY cc-by MIT License mit\nlicense GNU general public LICENSE",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under CC BY 4.0.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "redistribution and use in source and binary forms with modification",
    "ACC BY CC BYE cc by",
    "the Apache License, Version 2.0\nlicensed under",
    "x Licensed under the Apache License, Version 2.0 (the License)",
]


def expected(i, text):
    w = [x.decode() for x in ALNUM.findall(lower(text))]
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for k in range(len(w)):
            if w[k : k + len(p)] == p:
                places.append(k)
                base.add(label)
    labels, score = set(base), 1.0 if base else 0.0
    for label, notice in licenses.TEMPLATES.items():
        t = set(notice.split())
        for block in re.split(r"\n|[.!?;][ \t\n\x0b\f\r]", text or ""):
            share = len(t & {x.decode() for x in ALNUM.findall(lower(block))}) / len(t)
            if share >= 0.9 - 1e-9:
                labels.add(label)
                score = max(score, share)
    return i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_scan(spark):
    rows = corpus() + [(700 + i, t) for i, t in enumerate(NOTICES)] + [(699, "word " * 300 + " ; ".join(NOTICES))]
    df = licenses.scan(slim(spark, rows).withColumnRenamed("block", "score"))
    assert df.columns == ["doc_id", "text", "bucket", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = [tuple(r) for r in df.drop("text", "bucket").collect()]
    assert sorted(got, key=str) == sorted((expected(i, t) for i, t in rows), key=str)
    assert {r[6] for r in got} >= {"cc-by,cc-by-nc", "cc-by", "bsd", "apache"}


def test_native(spark, capsys):
    licenses.scan(frame(spark, [(1, "cc by")])).explain()
    assert not re.search("Python|Pandas|Arrow", re.sub("ExistingRDD", "", capsys.readouterr().out))


def test_empty(spark):
    assert licenses.scan(frame(spark, [])).collect() == []


#: The notices in their standard wording, wrapped as in sources; labels of phrases come on top.
WRAPPED = {
    "apache": "/* Licensed under the Apache\n * License, Version 2.0 (the \"License\");\n * you may not use this file */",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n",
    "cc-by-nc": "This work is licensed\nunder CC BY-NC\n4.0.",
    "cc-by-sa": "This work is licensed\nunder CC BY-SA\n4.0.",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public\r\n# License as published by\n# the Free Software Foundation, either version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy",
    "unlicense": "This is free and unencumbered software released into the\npublic domain.",
}
PHRASED = {"apache": "apache", "cc-by-nc": "cc-by,cc-by-nc", "cc-by-sa": "cc-by,cc-by-sa"}


def test_wrapped_notices(spark):
    assert WRAPPED.keys() == licenses.TEMPLATES.keys()
    rows = []
    for i, (label, notice) in enumerate(WRAPPED.items()):
        rows += [(10 * i, notice), (10 * i + 1, "The and of.\n" * 300 + notice + "\nof the" * 300)]
        loose = (" x" * 9 + " ").join(licenses.TEMPLATES[label].split())
        rows += [(10 * i + 2, loose.replace(" ", "\n"))]  # its words, but too far apart
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(slim(spark, rows)).collect()}
    for i, label in enumerate(WRAPPED):
        assert got[10 * i] == got[10 * i + 1] == (PHRASED.get(label, label), 1.0), label
        assert got[10 * i + 2] == ("", 0.0), label


def test_every_matching_block(spark):
    bsd, mpl = licenses.TEMPLATES["bsd"], licenses.TEMPLATES["mpl"]
    n = len(set(bsd.split()))
    part = " ".join(w for w in bsd.split() if w != "source")
    rows = [(1, f"x\n{bsd}\nx\n{part}\n" + "x " * 40 + f"\n{WRAPPED['bsd']}\n{mpl}. The end"), (2, WRAPPED["mpl"]), (3, "none"), (4, None)]
    got = [tuple(r) for r in licenses.matches(slim(spark, rows)).orderBy("doc_id", "block").collect()]
    assert [r[:4] for r in got if r[0] == 1] == [(1, 1, 1, "bsd"), (1, 3, 3, "bsd"), (1, 5, 7, "bsd"), (1, 9, 9, "mpl")]
    assert [r[4] for r in got] == [1.0, (n - 1) / n, 1.0, 1.0, 1.0]
    assert [r[:4] for r in got if r[0] != 1] == [(2, 0, 1, "mpl")]
