"""Words of whole texts as numbers, a batch at a time."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

#: Soft hyphen and zero-width characters, removed before words are taken.
INVISIBLE = dict.fromkeys([0x00AD, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
WORD = re.compile(r"[^\W_]+")
FIND = WORD.findall


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFKC, lower case and removal of invisible characters."""
    if text.isascii():
        return FIND(text.lower())
    return FIND(unicodedata.normalize("NFKC", text.translate(INVISIBLE)).lower().translate(INVISIBLE))


class Codes(dict):
    """Word to 64-bit hash, remembered up to ``most`` words (then forgotten and computed again)."""

    def __init__(self, most: int = 300_000, seed: int = 7) -> None:
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return h

    def array(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of ``n`` codes, by position of its first; empty if there are fewer."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    b = np.uint64(base)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * b + codes[k : k + m]
    return mixed(h)
