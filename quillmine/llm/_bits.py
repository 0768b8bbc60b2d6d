"""Position bitmaps in bytes: of each word's bitmap only the bytes that aren't zero are kept, as entries (word, byte, mask).

The entries of many words are stored by byte, so that what may meet in an AND stands together; an entry's byte is told by
the step from the entry before. Steps are single bytes, of which 255 stands for a step of 255 or more that follows in a
list of its own.
"""

from __future__ import annotations

import numpy as np


def entries(word: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bitmaps of words at ascending positions, one word at each: word, byte and mask of every entry, by byte."""
    at = pos >> 3
    order = np.lexsort((word, at))
    w, k, bits = word[order], at[order], (1 << (pos[order] & 7)).astype(np.uint8)
    starts = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (k[1:] != k[:-1])][: len(w)])
    return w[starts], k[starts], np.add.reduceat(bits, starts).astype(np.uint8) if len(starts) else bits


def steps_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps between the bytes of entries as bytes, and the long ones."""
    step = np.diff(at, prepend=0)
    return np.minimum(step, 255).astype(np.uint8), step[step >= 255].astype("<i8")


def places(steps: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The bytes of entries, from their steps."""
    at = steps.astype(np.int64)
    at[steps == 255] = long
    return np.cumsum(at)


class Rows:
    """The entries of many words' bitmaps, by byte, so that what may meet stands together."""

    def __init__(self, word: np.ndarray, at: np.ndarray, mask: np.ndarray):
        self.word, self.at, self.mask = word, at, mask
        self.first = np.searchsorted(at, np.arange((int(at[-1]) if len(at) else 0) + 3))

    def follow(self, node: np.ndarray, at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shifts bitmaps (entries node, at, mask) by one position and ANDs them with those of all words.

        Returns the entries that have bits left: place of the node's entry, the word, the byte and the mask.
        """
        carried = np.flatnonzero(mask >> 7)
        source = np.concatenate([np.arange(len(node)), carried])
        byte = np.concatenate([at, at[carried] + 1])
        moved = np.concatenate([(mask << 1).astype(np.uint8), np.ones(len(carried), np.uint8)])
        live = moved != 0
        source, byte, moved = source[live], byte[live], moved[live]
        lo = self.first[byte]
        n = self.first[byte + 1] - lo
        each = np.repeat(np.arange(len(byte)), n)
        other = np.arange(len(each)) + np.repeat(lo - (np.cumsum(n) - n), n)
        both = moved[each] & self.mask[other]
        hit = np.flatnonzero(both)
        each = each[hit]
        return source[each], self.word[other[hit]], byte[each], both[hit]
