"""Rank-synchronous pair merging over ragged numpy arrays, for any byte-pair vocabulary."""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int64(1) << 40
#: Symbols above which a sequence is merged by a priority queue: rounds over it would each touch all of it.
LONG = 4096


class PairTable:
    """Which adjacent symbols join, into what, and with which rank: an open-addressing table in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, rank: np.ndarray, width: int):
        """rank is by id of what is made; width is above every id."""
        self.width = width
        keys, ids = np.asarray(left, np.int64) * width + np.asarray(right, np.int64), np.asarray(made, np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.made = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int64)
        slot, todo, self.probes = self.slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] < 0]
            mine = todo[first]
            self.keys[slot[mine]], self.made[slot[mine]], self.ranks[slot[mine]] = keys[mine], ids[mine], rank[ids[mine]]
            todo = np.delete(todo, first)
            slot[todo] = (slot[todo] + 1) & (size - 1)


    def scalar(self) -> dict[int, tuple[int, int]]:
        """The table as a dict from a pair's key to (rank, made); built when first asked for."""
        if not hasattr(self, "_scalar"):
            there = np.flatnonzero(self.keys >= 0)
            self._scalar = dict(zip(self.keys[there].tolist(), zip(self.ranks[there].tolist(), self.made[there].tolist(), strict=True), strict=True))
        return self._scalar

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair makes; NONE where it makes nothing."""
        key = left * self.width + right
        key[(left < 0) | (right < 0)] = -2
        at = self.slot(key)
        rank, made = self.ranks[at], self.made[at]
        off = np.flatnonzero(self.keys[at] != key)
        rank[off] = NONE
        for _ in range(self.probes - 1):  # only slots that another key holds are looked at again
            off = off[self.keys[at[off]] >= 0]
            if not len(off):
                break
            at[off] = (at[off] + 1) & (len(self.keys) - 1)
            hit = off[self.keys[at[off]] == key[off]]
            rank[hit], made[hit] = self.ranks[at[hit]], self.made[at[hit]]
            off = off[self.keys[at[off]] != key[off]]
        return rank, made


def merge_all(pairs: PairTable, symbols: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins every sequence's lowest-ranked pair at all its places, round after round.

    seq is sorted and numbers the sequence of each symbol; a symbol below 0 joins nothing. Returns the
    symbols left and their sequences, in order. Sequences above LONG go through a priority queue instead.
    """
    done = []
    starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]]) if len(seq) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(seq)]
    if ((ends - starts) > LONG).any():
        short = np.ones(len(seq), bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a > LONG:
                left = merge_long(pairs, symbols[a:b].tolist())
                done.append((np.array(left, np.int64), np.full(len(left), seq[a])))
                short[a:b] = False
        symbols, seq = symbols[short], seq[short]
    while len(symbols) > 1:
        inside = seq[1:] == seq[:-1]
        rank, made = pairs.join(symbols[:-1], symbols[1:])
        rank[~inside] = NONE
        starts = np.flatnonzero(np.r_[True, ~inside])
        best = np.minimum.reduceat(np.r_[rank, NONE], starts)
        wanted = np.repeat(best, np.diff(np.r_[starts, len(seq)]))
        over = wanted == NONE
        if over.any():  # sequences without a pair are ready
            done.append((symbols[over], seq[over]))
            going = np.flatnonzero(~over)
            if not len(going):
                break
            symbols, seq, wanted = symbols[going], seq[going], wanted[going]
            rank, made = np.r_[rank, NONE][going], np.r_[made, -1][going]
            rank, made = rank[:-1], made[:-1]
        hit = rank == wanted[:-1]
        # of overlapping places (a a a) the first, third, ... of a run are joined
        at = np.arange(len(hit))
        first = np.maximum.accumulate(np.where(hit & np.r_[True, ~hit[:-1]], at, 0))
        places = np.flatnonzero(hit & ((at - first) % 2 == 0))
        symbols = symbols.copy()
        symbols[places] = made[places]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        symbols, seq = symbols[keep], seq[keep]
    else:
        done.append((symbols, seq))
    symbols, seq = (np.concatenate(x) for x in zip(*done, strict=True)) if len(done) > 1 else done[0]
    order = np.argsort(seq, kind="stable")
    return symbols[order], seq[order]


def merge_long(pairs: PairTable, symbols: list[int]) -> list[int]:
    """One sequence's merges in order of rank, leftmost first, by a priority queue over a linked list."""
    table, width, n = pairs.scalar(), pairs.width, len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def found(i: int, j: int) -> tuple[int, int] | None:
        return table.get(symbols[i] * width + symbols[j]) if symbols[i] >= 0 and symbols[j] >= 0 else None

    queue = [(hit[0], i, hit[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (hit := found(i, i + 1))]
    heapq.heapify(queue)
    while queue:
        _, i, made, x, y = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or j >= n or symbols[i] != x or symbols[j] != y:
            continue  # one of the two was merged meanwhile
        symbols[i], alive[j], after[i] = made, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (hit := found(a, b)):
                heapq.heappush(queue, (hit[0], a, hit[1], symbols[a], symbols[b]))
    return [s for s, ok in zip(symbols, alive, strict=True) if ok]
