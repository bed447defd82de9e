"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker remembers.
REMEMBERED = 300_000
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


class Words(dict):
    """64-bit hash of each word (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[1]
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, words: Words, k: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of all words, if they are fewer; none without words.

    Words are what white space (space, tab to carriage return) parts, with A-Z in lower case.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if len(h) < k:
        out = np.uint64(len(h))
        for x in h:
            out = mixed((np.array([out], np.uint64) * _ODD[0]) ^ x)[0]
        return np.array([out], np.uint64)
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mixed((out * _ODD[0]) ^ h[i : i + n])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]
