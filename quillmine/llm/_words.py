"""Words of whole text columns as 64-bit hashes, computed on the bytes of an Arrow column without Python strings.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its hash is a polynomial over the
64-bit integers, finished with a mixing step, so that equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time, about; the arrays of one step are some 30 times as large.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Kinds of bytes for word shapes: lower-case letters (with all bytes of other scripts), capitals, digits, others as they are.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("9")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin and the last ends; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def powers(n: int) -> np.ndarray:
    """FACTOR to the powers 0..n-1, kept for the next call."""
    have = getattr(powers, "kept", None)
    if have is None or len(have) < n:
        have = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, 1 << 12), FACTOR)])
        powers.kept = have
    return have


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each run data[start:end]; the runs are in order, don't overlap and aren't empty."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    at = np.arange(total) - np.repeat(firsts, lengths)
    values = data[at + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(values * powers(int(lengths.max()))[at], firsts) ^ (lengths.astype(np.uint64) << np.uint64(48)))


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words, between bytes that are blank; a word doesn't cross from one row into the next."""
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, inside[:-1]]
    after = np.r_[inside[1:], False]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def chunks(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray = BLANK) -> list[tuple[int, int]]:
    """Cuts the bytes into parts of about CHUNK that end at one of the bytes `ends` (blanks) or at a row's end; no word is cut."""
    cuts, at = [], 0
    row_ends = offsets[1:]
    while at < len(data):
        to = min(at + CHUNK, len(data))
        if to < len(data):
            nearest = row_ends[np.searchsorted(row_ends, to)]
            step = 1 << 16
            found = -1
            while found < 0 and to < nearest:
                blank = np.flatnonzero(ends[data[to : min(to + step, nearest)]])
                found = to + int(blank[0]) if len(blank) else -1
                to = min(to + step, nearest)
            to = found if found >= 0 else int(nearest)
        cuts.append((at, to))
        at = to
    return cuts


def words(column: pa.Array, shapes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes of all words in order, the number of words of each row and, if asked for, hashes of the words' shapes.

    A shape is the word's kinds of bytes with repeats removed: "Thing," is "Aa,".
    """
    data, offsets = text_bytes(column)
    found, counts, forms = [], np.zeros(len(column), np.int64), []
    for a, b in chunks(data, offsets):
        part = data[a:b]
        lo, hi = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        local = np.clip(offsets[lo : hi + 1] - a, 0, b - a)
        starts, ends = word_bounds(part, local)
        found.append(hash_runs(LOWER[part], starts, ends))
        counts[lo:hi] += np.diff(np.searchsorted(starts, local))
        if shapes and len(starts):
            kind = SHAPE[part]
            new = np.r_[True, kind[1:] != kind[:-1]]
            new[starts] = True
            new &= ~BLANK[part]
            upto = np.r_[0, np.cumsum(new)]
            forms.append(hash_runs(kind[new], upto[starts], upto[ends]))
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.uint64)
    return join(found), counts, join(forms) if shapes else None


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words in a row's words, and their number per row.

    A row with fewer words, but one at least, has its whole sequence as its one shingle.
    """
    seed = mix(np.uint64([size]))
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    firsts = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    length = np.repeat(np.minimum(counts, size), n)
    out = np.full(len(firsts), seed[0])
    for k in range(size):
        there = k < length
        nxt = mix(out * FACTOR + hashes[np.where(there, firsts + k, 0)]) if len(hashes) else out
        out = np.where(there, nxt, out)
    return out, n
