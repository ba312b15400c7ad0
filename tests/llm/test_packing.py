"""Order of neighbours and contents of the packing operator."""

from __future__ import annotations

import numpy as np

from cohorta.llm import packing


def test_neighbours_in_order_with_ties(monkeypatch):
    rng = np.random.default_rng(3)
    ids = [rng.integers(10, 60, rng.integers(1, 40)).astype(np.uint16) for _ in range(40)]
    ids = [ids[i] for i in rng.integers(0, 40, 300)]  # repeated documents tie
    index, used = packing.Index(ids), np.zeros(300, bool)
    used[[3, 50, 299]] = True
    monkeypatch.setattr(packing, "FIRST", 1000)
    whole = [index.near(seed, used).tolist() for seed in range(0, 300, 23)]
    for first in (1, 2, 64):
        monkeypatch.setattr(packing, "FIRST", first)
        assert [index.near(seed, used).tolist() for seed in range(0, 300, 23)] == whole
    assert max(map(len, whole)) > 64 and not {3, 50, 299} & set(whole[0])


def test_content_key_is_the_two_most_frequent_ids():
    for ids, want in [([], (-1, -1)), ([7], (7, -1)), ([7, 7, 3], (7, 3)), ([9, 4, 4, 9, 1], (4, 9)), ([0, 0], (0, -1)), ([5, 0], (0, 5))]:
        assert packing.content_key(np.array(ids, np.uint16)) == (want[0] + 1 << 32) + want[1] + 1, ids
