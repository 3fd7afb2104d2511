"""The perfect binary Golay code (23, 12, 7): nearby codewords of 23-bit words."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, CHECK = 23, 11


def _remainder(words: np.ndarray) -> np.ndarray:
    """Words modulo the generator: the 11-bit syndrome."""
    out = words.astype(np.int64).copy()
    for bit in range(BITS - 1, CHECK - 1, -1):
        out ^= ((out >> bit) & 1) * (GENERATOR << (bit - CHECK))
    return out


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word, and six error patterns per syndrome.

    The patterns lead from a word to every codeword within distance 3, or 4 if the nearest one
    is 3 away: exactly the codewords that the words within distance 1 decode to. That is one
    codeword for words at most 2 away from it (patterns repeat), else six.
    """
    low, high = _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12)
    patterns = np.full((1 << CHECK, 6), -1, np.int64)
    for weight in (0, 1, 2, 3, 4):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(BITS), weight)], np.int64)
        syndromes = _remainder(errors)
        if weight < 4:
            patterns[syndromes, 0] = errors
            near = syndromes if weight < 3 else syndromes[:0]
            patterns[near, 1:] = errors[: len(near), None]
        else:
            order = np.argsort(syndromes, kind="stable")
            s, e = syndromes[order], errors[order]
            rank = np.arange(len(s)) - np.searchsorted(s, s)
            patterns[s, 1 + rank] = e
    return low, high, patterns


def codeword_keys(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the codewords near each 23-bit word, six per word (repeated if there is one).

    Two words at distance 2 or less share an index: a word between them is within distance 1
    of both, and what it decodes to is among the indices of both. An index is the leading 12
    bits of its codeword, which determine it.
    """
    low, high, patterns = tables()
    words = words.astype(np.int64)
    syndromes = low[words & 0xFFF] ^ high[words >> 12]
    return (words[..., None] ^ patterns[syndromes]) >> CHECK
