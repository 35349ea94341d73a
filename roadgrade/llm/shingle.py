"""Hashes of words and word n-grams for a batch of texts at once (numpy, inside tasks)."""

from __future__ import annotations

from itertools import chain

import numpy as np

_BASE = 0xC6A4A7935BD1E995 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Word hashes with a cache that lasts as long as the task."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """(hash of every word, where each text begins and the last ends, the words)."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        split = [(r.lower() if lower else r).split() for r in raw]
        return *self.of(split), split

    def of(self, split: list[list[bytes]], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, where each list of words begins and the last ends)."""
        import xxhash

        if lower:
            split = [[w.lower() for w in words] for words in split]
        if len(self.known) > 150_000:
            self.known.clear()
        known, h = self.known, xxhash.xxh64_intdigest
        for w in set().union(*split).difference(known):
            known[w] = h(w)
        edge = np.cumsum([0, *map(len, split)])
        return np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, int(edge[-1])), edge


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (of all texts in a row; the caller leaves out those across texts)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])
    return mix((total[k:] - total[:-k]) * back[: n - k + 1])


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the (leftmost) least hash of some window of one text's n-gram hashes."""
    if len(hashes) <= window:
        return np.array([hashes.argmin()]) if len(hashes) else np.zeros(0, np.int64)
    out = []
    for a in range(0, len(hashes) - window + 1, 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(hashes[a : a + (1 << 16) + window - 1], window)
        out.append(a + np.unique(view.argmin(axis=1) + np.arange(len(view))))
    return np.unique(np.concatenate(out))
