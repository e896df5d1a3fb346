"""The perfect binary (23, 12) Golay code as a fuzzy hash of 23-bit words.

Any word has one codeword within distance 3. A word at distance 3 has five more
at distance 4. The key set of a word is the index of its nearest codeword and, at
distance 3, of those five: two words that differ in one bit always share a key,
and words that differ in two mostly do.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Tables of 2^12 remainders and, for each of the 2^11 syndromes, up to six error patterns."""

    def __init__(self) -> None:
        self.high = np.array([_remainder(x << 11) for x in range(1 << 12)], np.int32)
        one = [_remainder(1 << b) for b in range(23)]
        self.errors = np.full((1 << 11, 6), -1, np.int32)
        filled = np.zeros(1 << 11, np.int64)
        for weight in range(5):
            for bits in combinations(range(23), weight):
                s = 0
                for b in bits:
                    s ^= one[b]
                if weight < 4 or filled[s]:  # at distance 4 there are codewords for words at distance 3 alone
                    self.errors[s, filled[s]] = sum(1 << b for b in bits)
                    filled[s] += 1

    def indices(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) codeword indices of 12 bits; -1 where a word has but one."""
        w = words.astype(np.int32)
        e = self.errors[self.high[w >> 11] ^ (w & 0x7FF)]
        return np.where(e < 0, -1, (w[:, None] ^ e) >> 11)
