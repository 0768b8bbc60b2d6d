"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

A piece matters to best fit by its length alone, and there are at most `capacity` lengths. So the packing is
found over the histogram of lengths: lengths in decreasing order, each run of equal pieces placed into the
tightest open bins, which a segment tree over the remaining capacities finds in logarithmic time. The result
equals best-fit decreasing over all pieces of the corpus in one list, whatever their number, and what reaches
the driver depends on the capacity only. Every piece then looks up its place by its length and its number
among the pieces of that length, which salted groups count out, so that a hot length is no hot task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from ._shared import slices, tokenizer_path
from .bpe import Remembering, byte_alphabet

#: Pieces of one length that one task numbers, about.
GROUP_ROWS = 20_000


class Capacities:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the groups of open bins that have just that left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def push(self, left: int, first: int, n: int) -> None:
        """n bins from number `first` on now have `left` left."""
        if n and left:
            self.groups[left].append((first, n))
            self.add(left, 1)

    def pop(self, left: int) -> tuple[int, int]:
        self.add(left, -1)
        return self.groups[left].pop()

    def add(self, left: int, by: int) -> None:
        at = self.size + left
        while at:
            self.counts[at] += by
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity >= length that an open bin has left: up to a right sibling that has one, then down."""
        at = self.size + length
        if not self.counts[at]:
            while at > 1 and (at & 1 or not self.counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.counts[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places for every piece of every length, and the number of bins.

    Rows of (length, first number, count, first bin, offset): pieces of that length numbered from `first
    number` on go to `count` bins in a row, at that offset.
    """
    tree, rows, bins = Capacities(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        number, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, first = capacity, bins
                n = -(-todo // (capacity // length))
                bins += n
            else:
                first, n = tree.pop(left)
            each = left // length  # a bin stays the tightest until the length no longer fits
            full = min(n, todo // each)
            for k in range(each if full else 0):
                rows.append((length, number, full, first, capacity - left + k * length))
                number += full
            tree.push(left - each * length, first, full)
            todo -= full * each
            rest = min(todo, each - 1) if full < n else 0
            for k in range(rest):
                rows.append((length, number, 1, first + full, capacity - left + k * length))
                number += 1
            todo -= rest
            if full < n:
                tree.push(left - rest * length, first + full, 1)
                tree.push(left, first + full + 1, n - full - 1)
    return np.array(rows, np.int64).reshape(-1, 5), bins


class LibraryIds(Remembering):
    """Token ids by the tokenizers library, whose model is asked once for each word that a worker meets."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(file)
        self.model = library.model
        self.shown = {b: c for c, b in byte_alphabet().items()}  # as the model spells bytes
        super().__init__({t.content: i for i, t in library.get_added_tokens_decoder().items()})

    def learn(self, words: list[str]) -> None:
        ids, counts = [], []
        for w in words:
            plain = w.isascii() and w.isprintable()  # of these only the space is spelt otherwise
            found = self.model.tokenize(w.replace(" ", self.shown[ord(" ")]) if plain else w.encode().decode("latin-1").translate(self.shown))
            ids += [t.id for t in found]
            counts.append(len(found))
        self.remember(words, np.array(ids, np.int64), np.array(counts, np.int64))


@lru_cache(maxsize=1)
def library_ids(file: str) -> LibraryIds:
    """A worker's own, which its later tasks use again with the words that it has met."""
    return LibraryIds(file)


def cut_pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents above the capacity are cut, a shorter piece comes first."""
    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = library_ids(tokenizer_path(vocabulary)), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    at = 0
                    for k in range(-(-n // capacity)):
                        to = at + (n - at - 1) % capacity + 1
                        row.append(i), piece.append(k), start.append(at), length.append(to - at)
                        crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                        at = to
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return narrow.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    Null texts count as empty: one piece that holds the end id alone. A null doc_id stays null; repeated rows
    are packed each; an empty table gives an empty result; other columns of docs aren't read. Ties between
    pieces of equal length are broken by doc_id and piece.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(cut_pieces(docs, capacity, vocabulary, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    places, _ = best_fit(histogram, capacity)
    groups = max(16, -(-sum(histogram.values()) // GROUP_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    before = salted.groupBy("length", "salt").count().select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("number", F.col("before") + F.col("own") - 1)
    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    span = np.int64(1) << 47
    order = np.argsort(places[:, 0] * span + places[:, 1])
    keys, firsts, bins, offsets = (places[:, 0] * span + places[:, 1])[order], places[order, 1], places[order, 3], places[order, 4]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (np.asarray(b.column(i)) for i in (3, 5))
            at = np.searchsorted(keys, length * span + number, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bins[at] + number - firsts[at]), pa.array(offsets[at])], names=[*names, "sequence_id", "offset"])

    return numbered.select(*names, "number").mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
