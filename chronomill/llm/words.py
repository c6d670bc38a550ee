"""Words of a text as runs of ASCII letters, digits and non-ASCII characters, and hashes of them."""

from __future__ import annotations

import numpy as np
import xxhash

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
GOLDEN = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8, A-Z in lower case. Bytes of one non-ASCII character always stay together."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, by the position of their first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(GOLDEN) + mixed(hashes[k : k + n] + np.uint64(k))
    return mixed(total)
