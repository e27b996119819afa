"""Word shingles of a text as sorted 64-bit hashes, and their minhash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words remembered by each worker; this changes the cost only.
MEMORY_WORDS = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct ``width``-word shingles. bytes.lower and bytes.split follow the ASCII rules of the contract exactly:
    A-Z fall to a-z, words end at space, tab, line feed, vertical tab, form feed and carriage return."""

    def __init__(self, width: int = 5) -> None:
        self.width = width
        self.memory: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self.memory) >= MEMORY_WORDS:
            self.memory.clear()
        h = self.memory[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def words(self, text: str | None) -> np.ndarray:
        """Hash of each word."""
        get, new = self.memory.get, self._hash
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.array([new(w) if (h := get(w)) is None else h for w in found], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; a text of fewer words is one shingle; one without words has none."""
        h = self.words(text)
        if not len(h):
            return h
        width = min(self.width, len(h))
        out = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            out = mixed(out * _ODD + h[k : len(h) - width + 1 + k] + np.uint64(k + 1))
        return np.unique(out + np.uint64(width))


class Signer:
    """Minhash signature: for each of ``size`` scrambles the smallest 32-bit value over the set."""

    def __init__(self, size: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.step = max(1, (1 << 18) // size)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(len(self.factor), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(shingles), self.step):
            part = shingles[at : at + self.step, None] * self.factor[None, :]
            np.minimum(best, part.min(axis=0), out=best)
        return (best >> np.uint64(32)).astype(np.uint32)
