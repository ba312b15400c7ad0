"""Sets of word shingles and their MinHash signatures, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

from cohorta.llm.common import LOWER, WordNumbers, mix, text_bytes

WORDS, HASHES = 5, 125
_SEEDS = np.random.default_rng(1125).integers(1, 1 << 63, (3, 1024), np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return text.encode().translate(LOWER).split() if text else []


def exact_set(text: str | None, words: int = WORDS) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves; a text of fewer words is one shingle, none without words."""
    w = words_of(text)
    return set(zip(*(w[j:] for j in range(words)))) if len(w) >= words else {tuple(w)} if w else set()


class Shingles:
    """Of each row the sorted distinct 64-bit hashes of its ``words``-word shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.numbers = words, WordNumbers()
        self.place = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def sets(self, column) -> list[np.ndarray]:
        raw, start, end = text_bytes(column)
        raw = raw.tobytes().translate(LOWER)
        number, flat, sizes = self.numbers.__getitem__, [], []
        for a, b in zip(start.tolist(), end.tolist()):
            w = raw[a:b].split()
            flat += map(number, w)
            sizes.append(len(w))
        h = np.array(flat, np.int64).view(np.uint64)
        n = len(h) - self.words + 1
        five = np.zeros(max(n, 0), np.uint64)
        for j in range(self.words):
            five += h[j : j + n] * self.place[j] if n > 0 else np.uint64(0)
        five = mix(five)
        out, a = [], 0
        for size in sizes:
            if size >= self.words:
                x = np.sort(five[a : a + size - self.words + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            elif size:
                short = mix(np.array([size], np.uint64))
                for j in range(size):
                    short = mix(short + h[a + j : a + j + 1] * self.place[j])
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
            a += size
        return out


def signature(x: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """``hashes`` minima, 32 bits each, of independent hashes of a non-empty set."""
    out = np.full(hashes, 0xFFFFFFFF, np.uint32)
    up, plus = _SEEDS[0, :hashes, None] | np.uint64(1), _SEEDS[1, :hashes, None]
    for low in range(0, len(x), 1024):
        out = np.minimum(out, ((x[None, low : low + 1024] * up + plus) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return out


def set_key(x: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set: two sets have the same one only if they are equal."""
    a, b = mix(x ^ _SEEDS[2, 0]).sum(dtype=np.uint64), mix(x + _SEEDS[2, 1]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
