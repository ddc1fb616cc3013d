"""Freed memory of a worker returns to the system when a block is done."""

import re

import numpy as np
import pyarrow as pa
import pytest

from revlens.llm import blocks as B


def resident() -> float:
    return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024


def test_group_gives_back(monkeypatch):
    if not hasattr(__import__("ctypes").CDLL(None), "malloc_trim"):
        pytest.skip("not glibc")
    given = []
    monkeypatch.setattr(B, "give_back", lambda f=B.give_back: given.append((resident(), f(), resident())))
    made = {}
    held = type("Held", (), {"sparkSession": None, "groupBy": lambda self, _: self, "repartition": lambda self, *_: self, "applyInArrow": lambda self, run, _: made.setdefault("run", run) and self})()
    monkeypatch.setattr(B, "parts", lambda _: 2)
    small = [np.zeros(1000) for _ in range(60_000)]  # some 480 MB of pieces under the C library's limit for own mappings
    keep = small[::20_000]
    B.meet(held, lambda items, sender: items[0] > 0, 1)
    del small
    sent = pa.table({"block": [0], "start": [0], "body": [B.dump(np.arange(9))]})
    assert made["run"](sent).num_rows == 1
    assert len(given) == 1 and given[0][2] < given[0][0] - 50 and len(keep) == 3
