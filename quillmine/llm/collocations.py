"""Phrase collocations by position bitmaps, as SPAM mines sequences: shift, AND, count bits, depth first.

Texts become shards of about SHARD words of one language; in each, every word has a compressed bitmap of its
positions, and a position is left free between pieces, so that no shift leads from one piece into the next. A shard goes
through its words a few at a time and extends each depth first: a phrase's bitmap, shifted by one and ANDed with a
word's, is that of the longer phrase, and its bits are the phrase's occurrences. Shards send back counts, which are
summed over all of them. A phrase can be frequent only if its parts are: they are looked up in bit filters of fixed size
made from the frequent words and shorter phrases. A filter lets some others through, whose sums then fail the threshold,
so it never changes a result; where it is full it passes everything. Bitmaps never leave their shard's row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import _bits, _words
from ._shared import slices

#: Words of a shard, about; entries that are extended together.
SHARD, TOGETHER = 1 << 20, 1 << 16
#: Bits of a filter of frequent phrases (16 MB), and of one of its pages.
FILTER, PAGE = 1 << 27, 1 << 19
#: Parts of a language's ranking that are cut to its first rows before they meet.
PARTS = 256

ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = ENDS.copy()
BLANK[[0x20, 0x09]] = True


#: What a shard's row holds: ids of its words, and its entries.
PARTS_OF_SHARD = ("ids", "words", "masks", "steps", "long")


class Shard:
    """Words and positions of one language, gathered until there are enough."""

    def __init__(self):
        self.bytes, self.lengths, self.at, self.words, self.next = [], [], [], 0, 0

    def add(self, column: pa.Array) -> None:
        data, offsets = _words.text_bytes(column)
        for a, b in _words.chunks(data, offsets, ENDS):
            part = _words.LOWER[data[a:b]]
            lo, hi = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
            local = np.clip(offsets[lo : hi + 1] - a, 0, b - a)
            starts, ends = _words.word_bounds(part, local, BLANK)
            if not len(starts):
                continue
            piece = np.cumsum(ENDS[part])[starts] + np.searchsorted(local, starts, "right")  # grows with every end of a piece or a row
            at = np.arange(len(starts)) + np.cumsum(np.r_[False, piece[1:] != piece[:-1]])
            self.bytes.append(part[~BLANK[part]])
            self.lengths.append(ends - starts)
            self.at.append(at + self.next)
            self.words += len(starts)
            self.next += int(at[-1]) + 2

    def rows(self, lang: str, seed: int) -> Iterator[pa.RecordBatch]:
        """A row for each word, with its occurrences, and one with the bitmaps of all of them."""
        lengths, data = np.concatenate(self.lengths), np.concatenate(self.bytes)
        offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        found = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        code, words = found.indices.to_numpy().astype(np.int64), found.dictionary
        raw, at = _words.text_bytes(words)
        own = _words.hash_runs(np.frombuffer(lang.encode() + b" ", np.uint8), np.array([0]), np.array([len(lang.encode()) + 1]))
        ids = _words.mix(_words.hash_runs(raw, at[:-1], at[1:]) ^ _words.mix(own + np.uint64(seed))).view(np.int64)
        n = np.bincount(code, minlength=len(words))
        none = pa.nulls(len(words), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(ids), words.cast(pa.string()), pa.array(n), *[none] * 5], names=["lang", "id", "word", "n", *PARTS_OF_SHARD])
        w, k, mask = _bits.entries(code, np.concatenate(self.at))
        held = [ids, w.astype("<i4"), mask, *_bits.steps_of(k)]
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in held)], names=["lang", "id", "word", "n", *PARTS_OF_SHARD])


def shards(docs: DataFrame, seed: int = 0) -> DataFrame:
    """lang, id, word, n of every shard's words, and a row without a word for each shard's bitmaps.

    id is a hash of language, word and seed.
    """
    narrow = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}
        for batch in batches:
            for part in slices(batch):
                for lang in pc.unique(part.column(0)).to_pylist():
                    held.setdefault(lang, Shard()).add(part.filter(pc.equal(part.column(0), lang)).column(1))
                full = [x for x, s in held.items() if s.words >= SHARD]
                if not full and sum(s.words for s in held.values()) >= 2 * SHARD:  # many languages: the fullest goes
                    full = [max(held, key=lambda x: held[x].words)]
                for lang in full:
                    yield from held.pop(lang).rows(lang, seed)
        for lang, one in held.items():
            if one.words:
                yield from one.rows(lang, seed)

    return narrow.mapInArrow(run, "lang string, id bigint, word string, n bigint, " + ", ".join(f"{x} binary" for x in PARTS_OF_SHARD))


def hashed(ids: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase, given as columns of its words' ids."""
    out = np.full(len(ids[0]), np.uint64(len(ids)) + np.uint64(0x51ED))
    for x in ids:
        out = _words.mix(out * _words.FACTOR + x.view(np.uint64))
    return out


def bits_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h % np.uint64(FILTER)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(FILTER)).astype(np.int64)


def filter_bits(phrases: DataFrame) -> bytes:
    """The filter of phrases(ids): FILTER bits whatever their number, made page by page."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            if len(ids):
                table = ids.flatten().to_numpy().reshape(len(ids), -1)
                bit = np.unique(np.concatenate(bits_of(hashed(list(table.T)))))
                yield pa.RecordBatch.from_arrays([pa.array(bit // PAGE), pa.array(bit % PAGE)], names=["page", "bit"])

    def page(t: pa.Table) -> pa.Table:
        on = np.zeros(PAGE, bool)
        on[t.column("bit").to_numpy()] = True
        return pa.table({"page": t.column("page").slice(0, 1), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    pages = phrases.select("ids").mapInArrow(marks, "page bigint, bit bigint").distinct().groupBy("page").applyInArrow(page, "page bigint, bits binary")
    out = bytearray(FILTER // 8)
    for r in pages.toLocalIterator():  # FILTER bits in all
        out[r["page"] * PAGE // 8 : (r["page"] + 1) * PAGE // 8] = r["bits"]
    return bytes(out)


def passes(bits: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    a, b = bits_of(hashed(ids))
    return ((bits[a >> 3] >> (7 - (a & 7))) & (bits[b >> 3] >> (7 - (b & 7))) & 1).astype(bool)


def extend(ids: np.ndarray, rows: _bits.Rows, size: int, filters: dict[int, np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Phrases of `size` words of a shard, as columns of ids, and their occurrences there; first words in order.

    filters has the frequent phrases of 1 to size - 1 words: a phrase goes on only if its last words pass.
    """
    by_word = np.argsort(rows.word, kind="stable")
    sorted_words = rows.word[by_word]
    edges = np.flatnonzero(np.r_[True, sorted_words[1:] != sorted_words[:-1]][: len(sorted_words)])
    cuts, start = [], 0
    for edge in [*edges[1:].tolist(), len(by_word)]:  # whole words, at least TOGETHER entries
        if edge - start >= TOGETHER or edge == len(by_word):
            cuts.append((start, edge))
            start = edge
    for lo, hi in cuts:
        for a in range(lo, hi, TOGETHER):  # a word with very many entries comes in parts; their counts add up later
            own = by_word[a : min(a + TOGETHER, hi)]
            nodes = [np.arange(rows.word[own].min(), rows.word[own].max() + 1)]
            node, at, mask = rows.word[own] - nodes[0][0], rows.at[own], rows.mask[own]
            for depth in range(2, size + 1):
                entry, word, at, mask = rows.follow(node, at, mask)
                key = node[entry].astype(np.int64) * len(ids) + word
                order = np.argsort(key, kind="stable")
                key, at, mask = key[order], at[order], mask[order]
                new = np.r_[True, key[1:] != key[:-1]][: len(key)]
                starts = np.flatnonzero(new)
                parents = [x[key[starts] // len(ids)] for x in nodes]
                nodes, node = [*parents, key[starts] % len(ids)], np.cumsum(new) - 1
                known = depth if depth < size else depth - 1
                if known > 1 and len(starts):
                    keep = passes(filters[known], [ids[x] for x in nodes[-known:]])
                    there = keep[node]
                    at, mask, node = at[there], mask[there], (np.cumsum(keep) - 1)[node[there]]
                    nodes = [x[keep] for x in nodes]
                if not len(node):
                    break
            else:
                n = np.bincount(node, np.bitwise_count(mask), len(nodes[0])).astype(np.int64)
                yield [ids[x] for x in nodes], n


def phrase_counts(bitmaps: DataFrame, size: int, filters: dict[int, bytes], least: int) -> DataFrame:
    """ids and f of phrases of `size` words that occur at least `least` times: counts of all shards, summed."""
    names = [f"w{i}" for i in range(size)]
    sent = bitmaps.sparkSession.sparkContext.broadcast(filters)  # FILTER bits each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: np.frombuffer(v, np.uint8) for k, v in sent.value.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, word, mask, steps, long = (np.frombuffer(batch.column(i)[row].as_buffer(), k) for i, k in enumerate(("<i8", "<i4", np.uint8, np.uint8, "<i8")))
                at, there = _bits.places(steps, long), passes(bits[1], [ids])[word]
                for phrase, n in extend(ids, _bits.Rows(word[there], at[there], mask[there]), size, bits):
                    for a in range(0, len(n), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (*phrase, n)], names=[*names, "n"])

    found = bitmaps.mapInArrow(run, ", ".join(f"{x} bigint" for x in (*names, "n")))
    return found.groupBy(*names).agg(F.sum("n").alias("f")).filter(F.col("f") >= least).select(F.array(*names).alias("ids"), "f")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, within: int = 50, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of 2 to `longest` words of each language.

    n counts a language's words, a, l and r are the occurrences of a phrase and of its two parts at the cut that scores
    least, score is floor(1000000 * a * a / (l * r)); ties of cuts go to the shortest first part. Phrases need `least`
    occurrences; those inside a longer such phrase with at least `within` percent of their occurrences are left out.
    Phrases rank by score, then by occurrences, then by their bytes. A null lang is "und", a null text is empty, rows
    that repeat count each, a text without words adds nothing, and an empty table (or a language without phrases) gives
    no rows; other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    for seed in itertools.count():
        cut = scratch.save(shards(docs, seed), "shards")
        words = scratch.save(cut.filter("word is not null").groupBy("lang", "id", "word").agg(F.sum("n").alias("f")), "words")
        # ids are hashes: two words may share one only if neither counts, or another seed tells them apart
        if not words.groupBy("id").agg(F.count("*").alias("k"), F.max("f").alias("f")).filter((F.col("k") > 1) & (F.col("f") >= least)).limit(1).count():
            break
    totals = scratch.save(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    numbered = scratch.save(words.filter(F.col("f") >= least), "frequent")
    bitmaps = cut.filter("word is null").select(*PARTS_OF_SHARD)
    known, filters = {1: numbered.select(F.array("id").alias("ids"), "f")}, {}
    for size in range(2, longest + 1):
        filters[size - 1] = filter_bits(known[size - 1])
        known[size] = scratch.save(phrase_counts(bitmaps, size, filters, least), f"phrases{size}")
    scratch.drop("shards")
    parts = known[1]
    for size in range(2, longest):
        parts = parts.unionByName(known[size])
    scored = []
    for size in range(2, longest + 1):
        phrases = known[size]
        if size < longest:  # the most frequent longer phrase around each
            around = None
            for more in range(size + 1, longest + 1):
                inner = known[more].select(F.explode(F.array(*(F.slice("ids", i, size) for i in range(1, more - size + 2)))).alias("ids"), "f")
                around = inner if around is None else around.unionByName(inner)
            phrases = phrases.join(around.groupBy("ids").agg(F.max("f").alias("longer")), "ids", "left").filter(f"longer is null or 100 * longer < {int(within)} * f").drop("longer")
        cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.array(*(F.lit(k) for k in range(1, size)))).alias("k"))
        halves = cuts.withColumn("left", F.expr("slice(ids, 1, k)")).withColumn("right", F.expr(f"slice(ids, k + 1, {size} - k)"))
        both = halves.join(parts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
        # exact below 10^16 occurrences
        score = F.expr("cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(32,0)) * cast(1000000 as decimal(7,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
        scored.append(both.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("ids", "a", "c.l", "c.r", "c.score"))
    candidates = scored[0]
    for more in scored[1:]:
        candidates = candidates.unionByName(more)
    candidates = scratch.save(candidates, "candidates")
    spelled = candidates.select("ids", F.posexplode("ids").alias("i", "id")).join(numbered.select("id", "lang", "word"), "id")
    texts = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = candidates.join(texts, "ids").withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(PARTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    kept = named.withColumn("rank", rank("lang", "part")).filter(F.col("rank") <= first)
    ranked = kept.withColumn("rank", rank("lang")).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
