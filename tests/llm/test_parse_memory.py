import tracemalloc

import numpy as np

from revlens.llm.arrays import Texts
from revlens.llm.suffix_dedup import parse


def test_parse_holds_numbers_of_some_rows_only():
    r = np.random.default_rng(2)
    t = Texts(r.integers(97, 123, 4_000_000).astype(np.uint8), np.arange(0, 4_000_001, 4000))
    parse(t, 50, 24)  # the tables of powers stay
    tracemalloc.start()
    try:
        name, *_ = parse(t, 50, 24)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(name) and peak < 32 << 20
