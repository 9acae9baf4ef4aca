"""The search of op9 by itself: what it fills, and what it needn't try."""

import itertools
import random

import pytest

np = pytest.importorskip("numpy")

from spanledger.llm import packing  # noqa: E402


def test_fullest_leaves_the_least_room():
    draw = random.Random(3)
    for _ in range(200):
        sizes = sorted((draw.randint(1, 30) for _ in range(draw.randint(1, 9))), reverse=True)
        places = packing.fullest([-x for x in sizes], 40)
        filled = sum(sizes[k] for k in places)
        sums = [sizes[0] + sum(c) for n in range(len(sizes)) for c in itertools.combinations(sizes[1:], n)]
        assert places[-1] == 0 and places == sorted(set(places), reverse=True) and filled == max(x for x in sums if x <= 40)


def test_bins_that_one_less_cannot_hold_are_not_filled_anew(monkeypatch):
    monkeypatch.setattr(packing, "fullest", lambda *_: pytest.fail("filled anew without any chance"))
    solution = [[0], [1]], [424, 424]
    assert packing.relieve([600, 600], solution, 1024, 1, np.random.default_rng(0)) == solution
