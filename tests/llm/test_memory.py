"""Memory of one worker on input that the tables don't hold: many different letters, a large benchmark."""

from __future__ import annotations

import subprocess
import sys

LANGUAGE = """
import numpy as np
from cohorta.llm.language import Profiles
rng = np.random.default_rng(1)
texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 10400))) for _ in range(128)]
Profiles().bundles(texts)
"""
WINDOWS = """
import numpy as np
from cohorta.llm.decontaminate import Windows
rng = np.random.default_rng(1)
words = [f"w{i}" for i in range(60000)]
items = [(i, " ".join(words[j] for j in rng.zipf(1.2, 230).clip(1, 59999))) for i in range(16000)]
assert 15e6 < sum(len(t) for _, t in items) < 17e6
print(__import__("resource").getrusage(0).ru_maxrss)
Windows(items, 13)
"""
PEAK = "print(__import__('resource').getrusage(0).ru_maxrss)"


def peak(code: str) -> list[float]:
    """Megabytes at what the code prints and at its end, of a process of its own."""
    out = subprocess.run([sys.executable, "-c", code + PEAK], capture_output=True, text=True, check=True, timeout=600)
    return [int(x) / 1024 for x in out.stdout.split()]


def test_texts_of_many_ngrams():
    """4 MB of text, hardly an n-gram twice."""
    assert peak(LANGUAGE)[-1] < 300


def test_a_full_block_of_the_benchmark():
    before, after = peak(WINDOWS)
    assert after - before < 330


def test_slices_do_not_change_bundles(monkeypatch):
    import numpy as np

    from cohorta.llm.language import Profiles

    texts = ["abc abd äöü", "x", "слово слова", "漢字かな" * 50, "the quick brown fox " * 20]
    whole = Profiles().bundles(texts)
    monkeypatch.setattr(Profiles, "SLICE", 3)
    monkeypatch.setattr(Profiles, "MOST", 5)
    monkeypatch.setattr(Profiles, "LETTERS", 4)
    assert (Profiles().bundles(texts) == whole).all() and np.allclose(np.linalg.norm(whole, axis=1), 1)


def test_windows_that_many_items_share():
    """Equal windows of many items, repeated within one, of other lengths, without an id."""
    from cohorta.llm.decontaminate import Windows, _scan

    shared = " ".join(f"s{i}" for i in range(13))
    items = [(i, f"{shared} own{i}") for i in range(50)] + [(None, shared), ("twice", f"{shared} {shared}"), ("short", "s1 s2"), ("none", "...")]
    w = Windows(items, 13)
    raw = f"s0 {shared} end s1 s2 s3".encode()
    import numpy as np

    n, first, hit, found = _scan(w, raw, np.array([0]), np.array([len(raw)]))
    assert n.tolist() == [18] and found[0] == {*(str(i) for i in range(50)), "twice", "short"}
    assert hit[:18].tolist() == [False] + [True] * 13 + [False, True, True, False]
