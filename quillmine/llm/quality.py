"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Words and word shapes hash into a fixed number of slots. A slot's index vector is a sparse random one; its
context vector sums the index vectors of what stands beside it in all documents. A document is pooled from the
context vectors of its words and the index vectors of its shapes. The network is trained with numpy on the
driver, over at most `sample` pooled rows of fixed width; a temperature, fitted on rows that training left out,
calibrates its probabilities. Every row of the table is then scored from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import _words
from ._shared import slices

#: Slots for words and shapes, width of a vector, entries of an index vector that aren't zero.
SLOTS, WIDTH, SPARSE = 1 << 14, 32, 4
FEATURES = 2 * WIDTH + 3
#: Rows with labels that the classifier is fitted on at most; the bound of what reaches the driver.
SAMPLE = 20_000


def held_out() -> Column:
    """Whether a row is in the fifth that labels aren't learnt from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(20_011)
    out = np.zeros((SLOTS, WIDTH), np.float32)
    for k in range(SPARSE):
        out[np.arange(SLOTS), rng.integers(0, WIDTH, SLOTS)] += np.where(rng.random(SLOTS) < 0.5, 1, -1) / np.sqrt(SPARSE)
    return out


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the words, slots of their shapes, whether a word repeats the one before it, and words per row."""
    hashes, counts, forms = _words.words(column, shapes=True)
    row = np.repeat(np.arange(len(counts)), counts)
    repeats = np.r_[False, (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])][: len(hashes)]
    shape = _words.mix(forms + np.where(repeats, np.uint64(7), np.uint64(3)))
    return (hashes % np.uint64(SLOTS)).astype(np.int64), (shape % np.uint64(SLOTS)).astype(np.int64), repeats, counts


def sum_rows(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), values.shape[1]), np.float32)
    there = np.flatnonzero(counts)
    if len(there):
        out[there] = np.add.reduceat(values, (np.cumsum(counts) - counts)[there])
    return out


def add_contexts(total: np.ndarray, index: np.ndarray, column: pa.Array) -> None:
    """Adds to each word's slot the index vectors of its own shape and of the shapes and words on either side."""
    word, shape, _, counts = tokens(column)
    row = np.repeat(np.arange(len(counts)), counts)
    near = index[shape].copy()
    same = np.flatnonzero(row[1:] == row[:-1])
    near[same] += index[shape[same + 1]] + index[word[same + 1]]
    near[same + 1] += index[shape[same]] + index[word[same]]
    order = np.argsort(word, kind="stable")
    starts = np.flatnonzero(np.r_[True, word[order][1:] != word[order][:-1]][: len(word)])
    if len(starts):
        total[word[order][starts]] += np.add.reduceat(near[order], starts)


def pool(column: pa.Array, index: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Features of each row: mean context vector, mean index vector of its shapes, share of repeats, and its length."""
    word, shape, repeats, counts = tokens(column)
    out = np.zeros((len(counts), FEATURES), np.float32)
    n = np.maximum(counts, 1)[:, None]
    step = 1 << 16
    ends = np.cumsum(counts)
    for a in range(0, len(counts), 128):  # rows at a time, so that the gathered vectors stay small
        part = slice(a, a + 128)
        lo, hi = int(ends[a] - counts[a]), int(ends[min(a + 128, len(counts)) - 1])
        if hi - lo <= step * 4:
            out[part, :WIDTH] = sum_rows(context[word[lo:hi]], counts[part])
            out[part, WIDTH : 2 * WIDTH] = sum_rows(index[shape[lo:hi]], counts[part])
            continue
        for i in range(a, min(a + 128, len(counts))):  # very long rows: in pieces
            for x in range(int(ends[i] - counts[i]), int(ends[i]), step):
                y = min(x + step, int(ends[i]))
                out[i, :WIDTH] += context[word[x:y]].sum(0)
                out[i, WIDTH : 2 * WIDTH] += index[shape[x:y]].sum(0)
    out[:, : 2 * WIDTH] /= n
    out[:, 2 * WIDTH] = sum_rows(repeats.astype(np.float32)[:, None], counts)[:, 0] / n[:, 0]
    out[:, 2 * WIDTH + 1] = np.log1p(counts) / 10
    out[:, 2 * WIDTH + 2] = counts == 0
    return out


@dataclass
class Model:
    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; the prior where there was nothing to learn from."""
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -30, 30)))


def train(context: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7) -> Model:
    """Adam on the cross entropy; every fifth row is left out and fits the temperature."""
    prior = float(y.mean()) if len(y) else 0.5
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    if len(y) < 10 or prior in (0.0, 1.0):
        return Model(context, mean, scale, None, 1.0, prior)
    rng = np.random.default_rng(seed)
    fold = np.arange(len(y)) % 5 == 0
    z, t = ((x - mean) / scale)[~fold], y[~fold].astype(np.float32)
    p = [rng.normal(0, np.sqrt(2 / FEATURES), (FEATURES, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, np.sqrt(1 / hidden), hidden).astype(np.float32), np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for a in range(0, len(t), 256):
            i = order[a : a + 256]
            h = z[i] @ p[0] + p[1]
            r = np.maximum(h, 0)
            d = (1 / (1 + np.exp(-np.clip(r @ p[2] + p[3], -30, 30))) - t[i]) / len(i)
            back = np.outer(d, p[2]) * (h > 0)
            grads = [z[i].T @ back + 1e-4 * p[0], back.sum(0), r.T @ d + 1e-4 * p[2], np.array([d.sum()], np.float32)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(context, mean, scale, (p[0], p[1], p[2], float(p[3][0])), 1.0, prior)
    logits, truth = model.logits(x[fold]).astype(np.float64), y[fold]
    loss = lambda s: np.logaddexp(0, np.where(truth == 1, -logits, logits) / s).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the network on at most `sample` labelled rows outside the held-out fifth, chosen by a hash of doc_id.

    The word vectors are those of all documents. Labels that are null or have no document are left out; of several
    labels for a doc_id the mean decides.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = scratch.save(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text").repartition(8), "sample")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, index = np.zeros((SLOTS, WIDTH)), index_vectors()
        for batch in batches:
            for part in slices(batch, rows=100):
                add_contexts(total, index, part.column(0))
        yield sent(total)

    def sent(total: np.ndarray) -> pa.RecordBatch:
        halves = np.rint(total * np.sqrt(SPARSE)).astype("<i8")  # whole numbers: sums don't depend on their order
        small = halves.astype("<i4")
        return pa.RecordBatch.from_arrays([pa.array([(small if (small == halves).all() else halves).tobytes()], pa.binary())], names=["total"])

    def read(total: bytes) -> np.ndarray:
        return np.frombuffer(total, "<i4" if len(total) == 4 * SLOTS * WIDTH else "<i8").reshape(SLOTS, WIDTH) / np.sqrt(SPARSE)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, WIDTH))
        for batch in batches:
            for one in batch.column(0):
                total += read(one.as_py())
        yield sent(total)

    totals = scratch.save(docs.select("text").mapInArrow(contexts, "total binary"), "totals")  # a row of some 2 MB for each task
    total = np.zeros((SLOTS, WIDTH))
    for r in totals.repartition(8).mapInArrow(summed, "total binary").collect():
        total += read(r["total"])
    context = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for batch in batches:
            for part in slices(batch, rows=500):
                x = pool(part.column(1), index, context)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    got = rows.mapInArrow(features, "y int, x binary").toArrow()  # `sample` rows of fixed width
    ordered = sorted(zip(got.column("x").to_pylist(), got.column("y").to_pylist(), strict=True))  # the same however rows arrive
    x = np.frombuffer(b"".join(a for a, _ in ordered), np.float32).reshape(-1, FEATURES)
    y = np.array([b for _, b in ordered], np.int64)
    shuffle = np.random.default_rng(1).permutation(len(y))
    scratch.drop()
    return train(context, x[shuffle], y[shuffle])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep: bool = False, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; with keep, all columns of docs and, last, quality_score.

    Null and empty texts are scored like any other, from features that say so. held_out is null if doc_id is.
    Repeated rows are scored each; an empty table gives an empty result; without labels (or with labels of one
    kind) the score is their mean, or 0.5. Only text is an input of a score.
    """
    model = fit(docs, labels, sample)
    columns = docs.columns if keep else ["doc_id", "text"]
    given = docs.select(*columns)
    at = columns.index("text")
    kept = [i for i in range(len(columns)) if keep or i != at]
    own = "quality_score"
    while own in {c.lower() for c in columns}:  # a column of that name, in any case, stays as it is
        own += "_"
    schema = ", ".join([*(f"`{columns[i]}` {given.schema[i].dataType.simpleString()}" for i in kept), f"{own} double"])
    names = [*(columns[i] for i in kept), own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for batch in batches:
            for part in slices(batch, batch.schema.names[at], rows=500):
                made = model.score(pool(part.column(at), index, model.context))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(made, pa.float64())], names=names)

    out = given.mapInArrow(run, schema)
    if keep:
        return out
    return out.select("doc_id", held_out().alias("held_out"), F.col(own).alias("score"), (F.col(own) >= threshold).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns."""
    scored = score(docs, labels, threshold, keep=True)
    return scored.filter(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)
