"""Word shingles as 64-bit hashes, for operators that compare documents as sets."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_KNOWN_WORDS = 1 << 15


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Shingler:
    """Distinct shingles of a text: runs of ``width`` words; a shorter text is one shingle.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. Hashes of frequent
    words are remembered, within a bound.
    """

    def __init__(self, width: int = 5):
        self.width = width
        self._known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= _KNOWN_WORDS:
                self._known.clear()
            found = self._known[word] = xxhash.xxh64_intdigest(word)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self._word, words), np.uint64, len(words))
        width = min(self.width, len(words))
        total = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            total = mixed(total * np.uint64(_FACTORS[i % 4]) + hashes[i : len(hashes) - width + 1 + i])
        return np.unique(total)
