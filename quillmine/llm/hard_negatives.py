"""Hard negatives by a pivot table over vectors whose inner products have become distances.

Components are whole numbers, so scores are exact. A row x gets one more component, sqrt(M - <x, x>), where M is the
largest <x, x> of its length; an anchor q gets a 0. Then |q - x|^2 = M + <q, q> - 2 <q, x>: high scores are short distances.
The table stores each row's distances to a few pivots. By the triangle inequality these bracket the distance of any
anchor and row, and so the score; rows whose bracket can't matter are left out, and the survivors' scores are exact
integer products. Rows lie in blocks of one nearest pivot, whose ranges of distances rule out whole blocks for an
anchor. Anchors, a stated query set, meet all rows block by block, and a block sends back a few rows for each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Pivots of a length; rows that they are chosen from at most, those first by a hash of vec_id.
PIVOTS, CHOSEN_FROM = 12, 2048
#: Rows of a block on average, anchors of a block on average, anchors that are gone through together.
ROWS, ANCHORS, TOGETHER = 2048, 4096, 128
#: Whole numbers below this are exact in doubles.
EXACT = 2**53


def whole(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(256 x) of vectors of one length, as doubles."""
    return np.floor(np.stack(vectors).astype(np.float64) * 256.0)


def unpacked(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Whole components of packed vectors of one length."""
    values = column.to_pylist()
    return np.floor(np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64) * 256.0)


def readable(embeddings: DataFrame, kind: str, relabel: Column) -> DataFrame:
    """row, vec_id, label, vec, dim, norm of the rows that take part."""
    element = "float" if kind == "<f4" else "double"
    narrow = embeddings.filter("vec_id is not null and label is not null and embedding is not null").select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), relabel.cast("long").alias("label"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vec, dim, norm = [], [], [], []
            for i, value in enumerate(batch.column(3)):
                x = None if value.values.null_count else value.values.to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    if x is None or not np.isfinite(big := x.astype(np.float64) * 256.0).all():
                        continue
                    n = float((np.floor(big) ** 2).sum())
                keep.append(i)
                vec.append(x.astype(kind).tobytes())
                dim.append(len(x))
                norm.append(n)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(vec, pa.binary()), pa.array(dim, pa.int32()), pa.array(norm, pa.float64())], names=["row", "vec_id", "label", "vec", "dim", "norm"])

    return narrow.mapInArrow(run, "row bigint, vec_id bigint, label bigint, vec binary, dim int, norm double")


class Pivots:
    """The pivots of one length in the space with the added component, and distances to them."""

    def __init__(self, sample: np.ndarray, most: float):
        self.most = most
        points = self.added(sample)
        chosen = [0] if len(points) else []
        far = np.full(len(points), np.inf)
        while chosen and len(chosen) < PIVOTS:  # each next one is the farthest from those before
            far = np.minimum(far, self.apart(points, points[chosen[-1:]])[:, 0])
            if not far.max() > 0:
                break
            chosen.append(int(far.argmax()))
        self.points = points[chosen]

    def added(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.c_[x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self.apart(self.added(x), self.points)

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return self.apart(np.c_[x, np.zeros(len(x))], self.points)

    def scores(self, norm: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores of anchors with these norms to rows at these least and greatest distances.

        The slack covers the rounding of distances; where they overflow the bracket is open.
        """
        with np.errstate(all="ignore"):
            base = self.most + norm[:, None]
            slack = 1 + 1e-6 * base
            low, high = (base - far**2) / 2 - slack, (base - near**2) / 2 + slack
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def brackets(pivots: Pivots, norm: np.ndarray, anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of anchors and rows by their distances to the pivots."""
    near, far = np.zeros((len(anchors), len(rows))), np.full((len(anchors), len(rows)), np.inf)
    for k in range(anchors.shape[1]):
        a, r = anchors[:, k, None], rows[:, k]
        np.maximum(near, np.abs(a - r), out=near)
        np.minimum(far, a + r, out=far)
    return pivots.scores(norm, near, far)


def exact(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: doubles where these hold them, else Python's integers."""
    if not len(rows) or not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)))
    if np.abs(anchors).max() * np.abs(rows).max() * anchors.shape[1] < EXACT:
        return anchors @ rows.T
    as_ints = lambda x: np.array([[int(v) for v in r] for r in x], object)
    return as_ints(anchors) @ as_ints(rows).T


def top(scores: np.ndarray, count: int) -> list[list[int]]:
    """Places of the `count` highest scores of each line above -inf, the first of equal ones first."""
    out: list[list[int]] = [[] for _ in scores]
    s, lines = scores.copy(), np.arange(len(scores))
    for _ in range(min(count, scores.shape[1])):
        at = s.argmax(1)
        for i in np.flatnonzero(s[lines, at] > -np.inf):
            out[i].append(int(at[i]))
        s[lines, at] = -np.inf
    return out


def long(value: float) -> int:
    """A score as a 64-bit integer; what lies beyond stays at the end."""
    return max(-(2**63), min(2**63 - 1, int(value)))


def window(positive: int) -> tuple[int, int]:
    """Least and greatest score of a negative for this positive's: 50 p <= 100 s <= 95 p in whole numbers."""
    return -(-50 * positive // 100), 95 * positive // 100


def positives_in(rows: dict, anchors: dict, pivots: Pivots, count: int) -> Iterator[tuple[int, int, int, int]]:
    """anchor's row, positive's row, vec_id and score: the best `count` of the block's rows with an anchor's label."""
    for label in np.unique(anchors["label"]):
        r = np.flatnonzero(rows["label"] == label)
        if not len(r):
            continue
        every = np.flatnonzero(anchors["label"] == label)
        for a in (every[i : i + TOGETHER] for i in range(0, len(every), TOGETHER)):
            low, high = brackets(pivots, anchors["norm"][a], anchors["to"][a], rows["to"][r])
            self_ = anchors["row"][a][:, None] == rows["row"][r]
            low[self_] = -np.inf
            enough = np.partition(low, len(r) - count, axis=1)[:, len(r) - count, None] if len(r) > count else -np.inf
            survive = (high >= enough) & ~self_
            some = np.flatnonzero(survive.any(0))
            found = exact(anchors["x"][a], rows["x"][r[some]])
            found = np.where(survive[:, some], found, -np.inf)
            for i, best in enumerate(top(found, count)):
                for j in best:
                    at = r[some[j]]
                    yield int(anchors["row"][a[i]]), int(rows["row"][at]), int(rows["vec_id"][at]), long(found[i, j])


def negatives_in(rows: dict, anchors: dict, pivots: Pivots, count: int) -> Iterator[tuple[int, int, int, int]]:
    """anchor's row, positive's row, negative's vec_id and score: the best `count` of the block in each positive's window."""
    for i in range(0, len(anchors["row"]), TOGETHER):
        a = np.arange(i, min(i + TOGETHER, len(anchors["row"])))
        least, most = anchors["least"][a], anchors["most"][a]  # of all the anchor's windows
        near = np.maximum(rows["to"].min(0) - anchors["to"][a], anchors["to"][a] - rows["to"].max(0)).clip(0).max(1, keepdims=True)
        far = (rows["to"].max(0) + anchors["to"][a]).min(1, keepdims=True)
        low, high = pivots.scores(anchors["norm"][a], near, far)
        a = a[((high[:, 0] >= least) & (low[:, 0] <= most))]  # the block's ranges alone rule out the others
        if not len(a):
            continue
        low, high = brackets(pivots, anchors["norm"][a], anchors["to"][a], rows["to"])
        survive = (high >= anchors["least"][a, None]) & (low <= anchors["most"][a, None]) & (anchors["label"][a, None] != rows["label"])
        some = np.flatnonzero(survive.any(0))
        if not len(some):
            continue
        found = np.where(survive[:, some], exact(anchors["x"][a], rows["x"][some]), -np.inf)
        for k in range(max(len(anchors["windows"][x]) for x in a)):
            there = [n for n, x in enumerate(a) if k < len(anchors["windows"][x])]
            bounds = [anchors["windows"][a[n]][k] for n in there]
            lo, hi = (np.array([w[x] for w in bounds], found.dtype)[:, None] for x in (1, 2))
            part = found[there]
            inside = np.where((part >= lo) & (part <= hi), part, -np.inf)
            for n, (w, best) in enumerate(zip(bounds, top(inside, count), strict=True)):
                for j in best:
                    yield int(anchors["row"][a[there[n]]]), w[0], int(rows["vec_id"][some[j]]), long(inside[n, j])


def mine(embeddings: DataFrame, relabel: Column | None = None, anchors: Column | None = None, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each anchor's positives are its first other rows of its label by score, ties by vec_id; for each come the first rows
    of other labels whose score is 50 to 95 percent of the positive's. relabel gives the label a row takes part with
    (label itself if not given), anchors says which rows are anchors (all whose vec_id 50 divides).

    Rows with a null vec_id, label or vector, or with null or non-finite components (or such that 256 times them isn't
    finite), take no part; vectors of different lengths have no score. Rows that repeat a vec_id are rows each, and an
    anchor that is repeated is one of its own other rows' positives; equal rows tie by vec_id and then by place. Scores are
    exact at any size, but those beyond 64 bits are returned as the nearest long. An empty table, an anchor without other
    rows of its label, and a positive without rows in its window give no rows; other columns aren't read.
    """
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession, "negatives")
    kind = "<f4" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = scratch.save(readable(embeddings, kind, F.col("label") if relabel is None else relabel), "rows")
    most = {r["dim"]: r["most"] for r in rows.groupBy("dim").agg(F.max("norm").alias("most")).toLocalIterator()}  # a number for each length
    tables = {}
    for dim, m in most.items():
        sample = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "row").select("vec").limit(CHOSEN_FROM).toArrow()
        tables[dim] = Pivots(unpacked(sample.column(0), kind), m)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(4).to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                to = tables[dim].of_rows(unpacked(part.column(3), kind))
                cell = np.where(np.isnan(to), np.inf, to).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t.tobytes() for t in to], pa.binary()), pa.array(cell)], names=[*part.schema.names, "to", "cell"])

    table = scratch.save(rows.mapInArrow(placed, "row bigint, vec_id bigint, label bigint, vec binary, dim int, norm double, to binary, cell int"), "table")
    cells = table.groupBy("dim", "cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("slots"))
    is_anchor = (F.col("vec_id") % 50 == 0) if anchors is None else anchors
    asked = scratch.save(table.filter(is_anchor).select("row", "vec_id", "label", "vec", "dim", "norm"), "anchors")
    groups = asked.groupBy("dim").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("groups"))
    deal = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
    # every row meets every group of anchors, and every anchor every block of rows
    blocks = scratch.save(table.join(cells, ["dim", "cell"]).join(groups, "dim").withColumn("slot", deal("slots")).drop("slots"), "blocks")
    spread = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups", "norm")
    key = ["dim", "group", "cell", "slot"]

    def asking(these: DataFrame) -> DataFrame:
        places = cells.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
        return these.join(groups, "dim").withColumn("group", deal("groups")).drop("groups").join(places, "dim")

    def unblocked(t: pa.Table, dim: int, by_id: bool) -> dict:
        got = {c: t.column(c).to_numpy() for c in ("row", "vec_id", "label")}
        order = np.lexsort((got["row"], got["vec_id"])) if by_id else np.arange(len(got["row"]))
        return {c: v[order] for c, v in got.items()} | {"x": unpacked(t.column("vec"), kind)[order], "order": order}

    def both(left: pa.Table, right: pa.Table) -> tuple[dict, dict, Pivots] | None:
        if not left.num_rows or not right.num_rows:
            return None
        dim = left.column("dim")[0].as_py()
        r, a, pivots = unblocked(left, dim, True), unblocked(right, dim, False), tables[dim]
        r["to"] = np.frombuffer(b"".join(left.column("to").to_pylist()), np.float64).reshape(len(r["row"]), -1)[r["order"]]
        a |= {"to": pivots.of_anchors(a["x"]), "norm": right.column("norm").to_numpy()}
        return r, a, pivots

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        got = both(left, right)
        found = list(positives_in(*got, positives)) if got else []
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["anchor", "positive", "positive_id", "score"])

    def hardest(left: pa.Table, right: pa.Table) -> pa.Table:
        got, found = both(left, right), []
        if got:
            got[1]["windows"] = [[(w["positive"], *window(w["score"])) for w in ws] for ws in right.column("positives").to_pylist()]
            got[1]["least"] = np.array([min(float(w[1]) for w in ws) for ws in got[1]["windows"]])
            got[1]["most"] = np.array([max(float(w[2]) for w in ws) for ws in got[1]["windows"]])
            found = list(negatives_in(*got, negatives))
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["anchor", "positive", "negative_id", "score"])

    first = lambda n, by, *ties: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *ties)) <= n
    near = spread.groupBy(*key).cogroup(asking(asked).groupBy(*key)).applyInArrow(nearest, "anchor bigint, positive bigint, positive_id bigint, score bigint")
    best = scratch.save(near.withColumn("in", first(positives, ["anchor"], "positive_id", "positive")).filter("in").drop("in"), "positives")
    windows = best.groupBy("anchor").agg(F.collect_list(F.struct("positive", "score")).alias("positives"))
    with_windows = scratch.save(asked.join(windows.withColumnRenamed("anchor", "row"), "row"), "windows")
    hard = spread.groupBy(*key).cogroup(asking(with_windows).groupBy(*key)).applyInArrow(hardest, "anchor bigint, positive bigint, negative_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "negative_id"))
    ranked = hard.withColumn("rank", rank).filter(F.col("rank") <= negatives).withColumnRenamed("score", "negative_score")
    named = best.withColumnRenamed("score", "positive_score").join(asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return ranked.join(named, ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
