"""Near-duplicates by b-bit MinHash over word shingles.

Every row's shingle set gives minima of some 120 hash functions. Bands of whole minima find candidates; of each
minimum the low bits are kept, packed into longs, and the similarity of candidates is estimated by counting equal
lanes, corrected for lanes that agree by chance. Candidates that may reach the threshold are confirmed on their full
sets. Rows with equal sets are one class from the start, so that copies never make pairs, and a band's bucket is
compared with one pivot instead of pair by pair. What the pivots leave undecided (members of a bucket that are in
different components) is gone through in blocks that hold texts and signatures and send back links, not pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, fewer_links
from ..scratch import Scratch
from . import _words
from ._shared import slices

#: Low bits kept of a minimum, and the chance, at most, that no band catches a pair at the threshold.
BITS, MISS = 2, 1e-6
LANES = 64 // BITS
#: Standard deviations that an estimate may lie under the threshold and still be confirmed on full sets.
SLACK = 6
#: Members of a family, and shingles of theirs, in one slot (about).
BLOCK, SHINGLES = 1024, 400_000
#: Buckets above LARGE get rounds of pivots, PIVOTS at most, before their pairs are gone through; results are the same.
LARGE, PIVOTS = 16_384, 3
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and minima in a band: enough bands to miss a pair at the threshold with probability MISS at most."""
    rows = 5 if percent >= 85 else 4
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))), rows


def row_hash() -> Column:
    """What tells rows that repeat a doc_id apart: a hash of the text as it is."""
    return F.xxhash64("text")


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row, n_shingles, set hash h1 and h2, band keys and packed low bits of the minima, for every row."""
    narrow = docs.select("doc_id", "text", row_hash().alias("row"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    rng = np.random.default_rng(1_997)
    count = bands * rows
    factors = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2)
    words = -(-count // LANES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, counts, _ = _words.words(part.column(1))
                found, n = _words.shingles(hashes, counts, size)
                ends = np.cumsum(n)
                there = np.flatnonzero(n)
                sets = [np.unique(found[e - k : e]) for e, k in zip(ends[there], n[there], strict=True)]
                sizes = np.zeros(len(n), np.int64)
                sizes[there] = [len(s) for s in sets]
                h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                keys, packed = np.zeros((len(there), bands), np.uint64), np.zeros((len(there), words), np.uint64)
                if len(there):
                    flat = np.concatenate(sets)
                    starts = np.cumsum(sizes[there]) - sizes[there]
                    h1[there] = np.add.reduceat(_words.mix(flat), starts)
                    h2[there] = np.add.reduceat(_words.mix(flat ^ _words.FACTOR), starts)
                    for k in range(count):
                        least = np.minimum.reduceat(flat * factors[k] + shifts[k], starts)
                        j = k // rows
                        keys[:, j] = _words.mix((keys[:, j] if k % rows else np.full(len(there), j, np.uint64)) * _words.FACTOR + least)
                        packed[:, k // LANES] |= (least & np.uint64((1 << BITS) - 1)) << np.uint64(BITS * (k % LANES))
                at = np.r_[0, np.cumsum(n > 0)]
                lists = [pa.ListArray.from_arrays(pa.array(at * x.shape[1], pa.int32()), pa.array(x.ravel().view(np.int64))) for x in (keys, packed)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *lists], names=["doc_id", "row", "n_shingles", "h1", "h2", "bands", "packed"])

    return narrow.mapInArrow(run, f"doc_id {kind}, row bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, packed array<bigint>")


def least_estimate(percent: int, lanes: int) -> float:
    chance, t = 2.0**-BITS, percent / 100
    p = t + (1 - t) * chance
    return t - SLACK * math.sqrt(p * (1 - p) / lanes) / (1 - chance)


def estimate(x: Column, y: Column, lanes: int) -> Column:
    """Similarity of two packed signatures: equal lanes by bit counts, less those that agree by chance."""
    low = F.lit(int("01" * LANES, 2))
    differ = F.lit(0)
    for i in range(-(-lanes // LANES)):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        differ = differ + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(low))
    chance = 2.0**-BITS
    return (1 - differ / F.lit(float(lanes)) - chance) / (1 - chance)


def shingle_set(text: str | None, size: int) -> set:
    words = WORD.findall((text or "").encode().translate(_words.LOWER.tobytes()))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, there = None, set()
        for batch in batches:
            hit = []
            for i, (b, x, y) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if b != last:
                    last, there = b, shingle_set(y.as_py(), size)
                own = shingle_set(x.as_py(), size)
                common = len(own & there)
                if own and 100 * common >= percent * (len(own) + len(there) - common):
                    hit.append(i)
            yield batch.select(["a", "b"]).take(pa.array(hit, pa.int64()))

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def set_bits(texts: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit sets of the texts over those shingles that two of them share at least, and the sizes of the full sets."""
    parts = [_words.words(c)[:2] for c in texts.chunks]
    found, n = _words.shingles(*(np.concatenate(x) for x in zip(*parts, strict=True)), size)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((row, found))
    found, row = found[order], row[order]
    once = np.r_[True, (found[1:] != found[:-1]) | (row[1:] != row[:-1])][: len(found)]
    found, row = found[once], row[once]
    sizes = np.bincount(row, minlength=len(n))
    _, place, times = np.unique(found, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[place] > 1
    row, bit = row[keep], shared[place[keep]]
    bits = np.zeros((len(n), int((times > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return bits, sizes


def links_in_block(t: pa.Table, size: int, percent: int, lanes: int, within: bool) -> tuple[list, list]:
    """Links between members of different components: estimates first, then full sets. At most one for each member.

    within: also pairs of the same slot; else only those of two slots.
    """
    ids, slot = t.column("id").to_pylist(), t.column("slot").to_numpy()
    _, root = np.unique(t.column("component").to_numpy(), return_inverse=True)
    sign = np.stack([np.array(x, np.int64) for x in t.column("packed").to_pylist()]).view(np.uint64)
    bits, sizes = set_bits(t.column("text"), size)
    low, chance, least = np.uint64(int("01" * LANES, 2)), 2.0**-BITS, least_estimate(percent, lanes)
    out: tuple[list, list] = ([], [])
    for x in range(len(ids) - 1):
        y = x + 1 + np.flatnonzero((root[x + 1 :] != root[x]) & (within | (slot[x + 1 :] != slot[x])))
        d = sign[y] ^ sign[x]
        equal = 1 - np.bitwise_count((d | (d >> np.uint64(1))) & low).sum(1, dtype=np.int64) / lanes
        y = y[(equal - chance) / (1 - chance) >= least]
        common = np.bitwise_count(bits[y] & bits[x]).sum(1, dtype=np.int64)
        for k in y[100 * common >= percent * (sizes[y] + sizes[x] - common)].tolist():
            if root[k] != root[x]:
                root[root == root[k]] = root[x]
                out[0].append(ids[x])
                out[1].append(ids[k])
    return out


class Search:
    """State of one run: classes with their signatures, members of buckets, and the links so far.

    A class is a set of shingles; its number is h1, the first half of its set hash, so that rows that repeat a doc_id
    stay apart.
    """

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        self.scratch = Scratch(docs.sparkSession, "minhash")
        bands, rows = bands_for(percent)
        self.lanes = bands * rows
        save = self.scratch.save
        self.rows = save(signatures(docs, size, bands, rows), "rows")
        full = self.rows.filter("n_shingles > 0 and doc_id is not null")
        same = [F.first(c).alias(c) for c in ("n_shingles", "bands", "packed")]  # alike in all rows of a class
        reps = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row")).alias("one"), *same)
        self.reps = save(reps.select(F.col("h1").alias("id"), "h2", F.col("one.doc_id").alias("least"), F.col("one.row").alias("row"), "n_shingles", "bands", "packed"), "reps")
        members = self.reps.select("id", F.explode("bands").alias("key"))
        buckets = save(members.groupBy("key").agg(F.min_by("id", F.xxhash64("id")).alias("pivot"), F.count("*").alias("n")).filter("n > 1"), "buckets")
        self.near = save(members.join(buckets, "key"), "near")
        shared = self.near.select("id").distinct().join(self.reps.select("id", F.col("least").alias("doc_id"), "row"), "id")
        texts = docs.select("doc_id", "text", row_hash().alias("row")).join(shared, ["doc_id", "row"]).select("id", "text")
        self.texts = save(texts.dropDuplicates(["id"]) if self.repeats() else texts, "texts")
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def repeats(self) -> bool:
        """Whether rows repeat doc_id and text, so that a class may have several rows with its text."""
        twice = self.rows.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id", "row").count().filter("count > 1")
        return twice.limit(1).count() > 0

    def add(self, links: DataFrame, name: str) -> None:
        """Takes confirmed links (a, b) and finds the components of all links so far."""
        links = self.scratch.save(fewer_links(links.select("a", "b")), f"{name}-links")
        self.links = links if self.labels is None else links.union(self.labels.toDF("a", "b"))
        self.labels = connected_components(self.links, self.scratch, f"{name}-components")

    def check(self, pairs: DataFrame, name: str) -> None:
        """Estimates pairs (a, b), each once, and confirms those that may reach the threshold."""
        ordered = pairs.filter("a != b").distinct()
        p, q = (self.reps.select(F.col("id").alias(i), F.col("n_shingles").alias(n), F.col("packed").alias(s)) for i, n, s in (("a", "na", "sa"), ("b", "nb", "sb")))
        close = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent) & (estimate(F.col("sa"), F.col("sb"), self.lanes) >= least_estimate(self.percent, self.lanes))
        likely = self.scratch.save(ordered.join(p, "a").join(q, "b").filter(close).select("a", "b"), f"{name}-likely")
        self.add(confirm(likely, self.texts, self.size, self.percent), name)

    def undecided(self, name: str) -> tuple[DataFrame, int]:
        """key, id, component, n of the members of buckets that hold several components and pairs not yet looked at."""
        labelled = self.near.filter("n > 2").join(self.labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
        labelled = self.scratch.save(labelled, f"{name}-labelled")
        open_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("first")).filter("lo < hi").select("key", "first")
        left = self.scratch.save(labelled.join(self.scratch.save(open_keys, f"{name}-open"), "key"), f"{name}-undecided")
        return left, left.agg(F.max("n")).first()[0] or 0

    def pivot_round(self, left: DataFrame, k: int) -> DataFrame:
        """Pairs of each member with another pivot of its bucket, where their components differ."""
        pivots = self.scratch.save(left.groupBy("key").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(k))).alias("p")), f"pivots-{k}")
        return left.join(pivots, "key").filter("component != p.component").select(F.col("id").alias("a"), F.col("p.id").alias("b"))

    def block_links(self, left: DataFrame) -> DataFrame:
        """Links between members of undecided buckets that are in different components.

        Buckets with a common member are one family, so that a text is moved once and not for each band. A family
        above BLOCK members or SHINGLES shingles is cut into slots; each pair of its slots is a group of its own, so
        that no group is larger than two slots. Groups send back links only.
        """
        own = fewer_links(left.select(F.col("id").alias("a"), F.col("first").alias("b")))
        family = connected_components(own, self.scratch, "families").withColumnRenamed("component", "family")
        members = left.select("id", "component").distinct().join(self.reps.select("id", "n_shingles", "packed"), "id").join(family, "id")
        members = self.scratch.save(members, "members")
        slots = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / SHINGLES)).cast("int")
        sizes = self.scratch.save(members.groupBy("family").agg(slots.alias("slots")), "sizes")
        dealt = members.join(sizes, "family").withColumn("slot", F.pmod(F.xxhash64("id", F.lit(17)), F.col("slots")).cast("int"))
        whole = dealt.join(self.texts, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        spread = whole.select("family", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "id", "component", "packed", "text")
        size, percent, lanes = self.size, self.percent, self.lanes

        def run(t: pa.Table) -> pa.Table:
            a, b = links_in_block(t, size, percent, lanes, t.column("i")[0] == t.column("j")[0])
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return confirm(self.scratch.save(spread.groupBy("family", "i", "j").applyInArrow(run, "a bigint, b bigint"), "found"), self.texts, size, percent)

    def run(self) -> DataFrame:
        """The rows with h1, row (a hash of the text) and component: the smallest doc_id that can be reached."""
        self.check(self.near.select(F.col("id").alias("a"), F.col("pivot").alias("b")), "first")
        left, most = self.undecided("first")
        for k in range(1, PIVOTS + 1):
            if most <= LARGE:
                break
            self.check(self.pivot_round(left, k), f"pivot{k}")
            left, most = self.undecided(f"pivot{k}")
        if most:
            self.add(self.block_links(left), "blocks")
        for name in ("texts", "near", "buckets"):  # the result needs none of these
            self.scratch.drop(name)
        linked = self.scratch.save(self.reps.select("id", "h2", "least").join(self.labels, "id"), "linked")
        low = linked.groupBy("component").agg(F.min("least").alias("low"))
        heads = self.reps.select("id", "h2", "least").join(linked.join(low, "component").select("id", "h2", "low"), ["id", "h2"], "left")
        heads = heads.select(F.col("id").alias("h1"), "h2", F.coalesce("low", "least").alias("head"))
        whole = self.rows.join(heads, ["h1", "h2"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("head")).otherwise(F.col("doc_id")))
        return whole.select("doc_id", "n_shingles", "row", component.alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: sets of `size` words, linked at `percent` similarity.

    Texts that are null or have no words have an empty set and link with nothing. A row with a null doc_id links
    with nothing, has a null component and is kept. doc_id is expected to be unique: rows that repeat one are
    compared like other rows, each by its own text, and a row is kept if its doc_id is its component's smallest. An
    empty table gives an empty result; other columns aren't read. Sets are compared on whole texts; the links that
    pivots and blocks find are confirmed word by word, while sets are taken as equal by a hash of 128 bits.
    """
    found = Search(docs, size, percent).run().drop("row")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs, with their columns, less all rows of each component of near-duplicates but one.

    That one has the component's smallest doc_id and, of rows that repeat it with different texts, the text with the
    smallest hash. Rows that repeat both doc_id and text are one document: the one whose columns come first as
    JSON stays. Rows without words stay (one of those that repeat doc_id and text), and all rows with a null doc_id.
    """
    scratch = Scratch(docs.sparkSession, "dropped")
    found = scratch.save(Search(docs, size, percent).run().filter("doc_id is not null"), "found")
    worded = found.filter("n_shingles > 0")
    stays = worded.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("stays"))
    others = worded.join(stays, "component_id").filter((F.col("doc_id") != F.col("stays.doc_id")) | (F.col("row") != F.col("stays.row")))
    dropped = scratch.save(others.select("doc_id", "row").distinct(), "ids")
    repeated = found.groupBy("doc_id", "row").count().filter("count > 1").select("doc_id", "row")
    repeated = scratch.save(repeated.join(dropped, ["doc_id", "row"], "left_anti"), "repeated")
    # docs' columns, whatever their names, go along in a struct
    keyed, on = docs.select(F.col("doc_id").alias("of"), row_hash().alias("row"), F.struct(*docs.columns).alias("whole")), ["of", "row"]
    left = keyed.join(dropped.toDF(*on), on, "left_anti")
    if not repeated.limit(1).count():
        return left.select("whole.*")
    again = left.join(repeated.toDF(*on), on, "left_semi")
    least = again.groupBy(*on).agg(F.min_by("whole", F.to_json("whole")).alias("one")).select("one.*")
    return left.join(repeated.toDF(*on), on, "left_anti").select("whole.*").unionByName(least)
