"""A range of trigger hashes holds its share of the phrases."""

import numpy as np

from revlens.llm import blocks as B
from revlens.llm.arrays import Texts
from revlens.llm.suffix_dedup import parse


def test_ranges_are_even():
    r = np.random.default_rng(4)
    t = Texts(r.integers(97, 123, 400_000).astype(np.uint8), np.arange(0, 400_001, 4000))
    name = np.sort(parse(t, 50, 24)[0])
    sizes = [b - a for _, a, b in B.cut(name, 60)]
    assert len(sizes) == 60 and max(sizes) < 2 * len(name) / 60
