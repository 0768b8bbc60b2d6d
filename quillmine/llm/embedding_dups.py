"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

Equal vectors are one class from the start. Each class's vector is rotated at random and keeps the signs as its code,
with the inner product of code and vector as its correction factor: <rotated query, code> / factor is an unbiased
estimate of a cosine, and the factor bounds its error. Hyperplane tables give the candidates. They hold the rotated
vectors in steps of a byte, whose signs are the codes: in a bucket all pairs are estimated at once, and only rows with a
pair whose upper confidence bound reaches the threshold fetch their vectors, to be recomputed exactly in doubles. A
pair that meets in several tables counts in the first one. Buckets send back rows, counts and a link to a root for each
vector, never pairs, and a bucket above BLOCK vectors is cut into pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..scratch import Scratch

#: Vectors that a bucket holds on average, at most, and that one block of a large bucket holds.
BUCKET, BLOCK = 1024, 2048
#: Chance, at most, that a pair at the threshold meets in no table; standard errors that the confidence bound allows.
MISS, SIGMAS = 1e-5, 5.0
#: Candidate pairs of a block that are recomputed at once.
PAIRS = 100_000


def tables_for(vectors: int, threshold: float) -> tuple[int, int]:
    """Tables and bits of a table's key: keys grow with the logarithm of the vectors, tables with a small power."""
    bits = max(0, math.ceil(math.log2(max(vectors, 1) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return (max(1, math.ceil(math.log(MISS) / math.log1p(-agree))) if agree < 1 else 1), bits


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(4_099 + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def hyperplanes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(7_919 + dim).normal(size=(dim, count))


def stored_as(embeddings: DataFrame) -> str:
    """How a component is stored: single precision if it comes so, which loses nothing and halves what is moved."""
    return "<f4" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def readable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vec: the components as bytes; null where the vector links with nothing."""
    single = stored_as(embeddings)
    narrow = embeddings.select("vec_id", F.col("embedding").cast("array<float>" if single == "<f4" else "array<double>").alias("embedding"))
    kind = narrow.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                x = None if value.as_py() is None or value.values.null_count else value.values.to_numpy(zero_copy_only=False) + np.float32(0)
                ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
                out.append(x.astype(single).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return narrow.mapInArrow(run, f"vec_id {kind}, vec binary")


def unit(vectors: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in doubles."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(classes: DataFrame, tables: int, bits: int, kind: str) -> DataFrame:
    """A row for each class: id, n, vec, dim, its key in every table, and what its cosines are estimated by.

    levels is the rotated vector in 256 steps of size step, whose signs are its binary code; gap is the length of what
    the steps leave out, factor the correction factor of the code.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2).to_pylist()
            size = np.dtype(kind).itemsize
            for dim in sorted({len(v) // size for v in vecs}):
                at = [i for i, v in enumerate(vecs) if len(v) == size * dim]
                for part in (at[k : k + 256] for k in range(0, len(at), 256)):
                    x = unit([vecs[i] for i in part], kind)
                    y = x @ rotation(dim).T
                    step = np.abs(y).max(1) / 127.5
                    levels = np.clip(np.floor(y / step[:, None]), -128, 127)
                    gap = np.linalg.norm(y - (levels + 0.5) * step[:, None], axis=1)
                    sides = (x @ hyperplanes(dim, max(1, tables * bits)) > 0)[:, : tables * bits].reshape(len(part), tables, bits)
                    keys = (sides @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
                    made = [pa.array([r.tobytes() for r in levels.astype(np.int8)], pa.binary()), pa.array(step), pa.array(gap), pa.array(np.abs(y).sum(1) / math.sqrt(dim))]
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(part)) for c in batch.columns), pa.array(np.full(len(part), dim, np.int32)), lists, *made], names=["id", "n", "vec", "dim", "keys", "levels", "step", "gap", "factor"])

    return classes.select("id", "n", "vec").mapInArrow(run, "id bigint, n bigint, vec binary, dim int, keys array<int>, levels binary, step double, gap double, factor double")


def error(factor: np.ndarray, dim: int) -> np.ndarray:
    """How far an estimate by a code with this factor may lie under the cosine."""
    return SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1)) + 1e-5


def near_in_block(t: pa.Table, threshold: float) -> np.ndarray:
    """Places of those rows of a group that have a pair in it whose bounds reach the threshold: that of the estimate by
    either's binary code, and that of the steps."""
    dim, i, j = (t.column(c)[0].as_py() for c in ("dim", "i", "j"))
    slot, step, gap, factor = (t.column(c).to_numpy() for c in ("slot", "step", "gap", "factor"))
    levels = np.frombuffer(b"".join(t.column("levels").to_pylist()), np.int8).reshape(len(slot), -1)
    y = ((levels + np.float32(0.5)) * step[:, None].astype(np.float32)).astype(np.float32)
    sign = np.where(levels >= 0, np.float32(1), np.float32(-1))
    there = np.zeros(len(slot), bool)
    for a in range(0, len(slot), 512):
        part = slice(a, a + 512)
        upper = (y[part] @ sign.T) / (math.sqrt(dim) * factor) + error(factor, dim) + gap[part, None] / factor
        other = (sign[part] @ y.T) / (math.sqrt(dim) * factor[part, None]) + error(factor, dim)[part, None] + gap / factor[part, None]
        close = y[part] @ y.T + gap[part, None] + gap * (1 + gap[part, None]) + 1e-4
        fit = (slot[part, None] != slot) if i != j else (np.arange(a, min(a + 512, len(slot)))[:, None] != np.arange(len(slot)))
        hit = fit & (np.maximum(upper, other) >= threshold) & (close >= threshold)
        there[part] |= hit.any(1)
        there |= hit.any(0)
    return np.flatnonzero(there)


def links_in_block(t: pa.Table, threshold: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a group's rows: ids, how many vectors each links with here, and the smallest id it is linked to through others."""
    dim, place, i, j = (t.column(c)[0].as_py() for c in ("dim", "place", "i", "j"))
    slot, ids, n = (t.column(c).to_numpy() for c in ("slot", "id", "n"))
    x = unit(t.column("vec").to_pylist(), kind)
    keys = np.array(t.column("keys").to_pylist(), np.int32).reshape(len(ids), -1)
    y = x @ rotation(dim).T
    sign, factor = np.where(y > 0, np.float32(1), np.float32(-1)), np.abs(y).sum(1) / math.sqrt(dim)
    y, off = y.astype(np.float32), error(factor, dim)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    pairs = []
    for a in range(0, len(ids), 512):
        upper = (y[a : a + 512] @ sign.T) / (math.sqrt(dim) * factor) + off
        p, q = np.nonzero(upper >= threshold)
        p = p + a
        fit = (slot[p] != slot[q]) if i != j else (p != q)
        p, q = p[fit], q[fit]
        p, q = np.minimum(p, q), np.maximum(p, q)
        pairs.append(p * np.int64(len(ids)) + q)
    both = np.unique(np.concatenate(pairs))  # either direction's bound lets a pair through
    p, q = both // len(ids), both % len(ids)
    for a in range(0, len(p), PAIRS):
        u, v = p[a : a + PAIRS], q[a : a + PAIRS]
        hit = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
        u, v = u[hit], v[hit]
        hit = (keys[u] == keys[v]).argmax(1) == place
        u, v = u[hit], v[hit]
        np.add.at(links, u, n[v])
        np.add.at(links, v, n[u])
        moved = np.flatnonzero(root != np.arange(len(ids)))  # earlier pairs' links: a root that moves takes them along
        u, v = np.concatenate([u, moved]), np.concatenate([v, root[moved]])
        while True:  # the least rank among linked vectors, until nothing changes
            before = root.copy()
            low = np.where(rank[root[u]] < rank[root[v]], root[u], root[v])
            for w in (u, v, root[u], root[v]):
                order = np.argsort(-rank[low], kind="stable")
                better = rank[low[order]] < rank[root[w[order]]]
                root[w[order][better]] = low[order][better]
            root = root[root]
            if (root == before).all():
                break
    return ids, links, ids[root]


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, linked where the cosine of two vectors reaches the threshold.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
    different lengths; a row with a null vec_id links with nothing, has a null component and is kept. vec_id is
    expected to be unique: rows that repeat one count as vectors each. An empty table gives an empty result;
    other columns (labels too) aren't read.
    """
    scratch, single = Scratch(embeddings.sparkSession, "embeddings"), stored_as(embeddings)
    rows = scratch.save(readable(embeddings), "rows")
    classes = scratch.save(rows.filter("vec is not null and vec_id is not null").groupBy("vec").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("n")), "classes")
    total = classes.count()
    tables, bits = tables_for(total, threshold)
    coded = scratch.save(codes(classes.repartition(max(1, -(-total // 4096))), tables, bits, single), "codes")
    placed = coded.select("dim", "id", "levels", "step", "gap", "factor", F.posexplode("keys").alias("place", "key"))
    group = ["dim", "place", "key"]
    sizes = placed.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("size")).filter("size > 1").drop("size")
    sized = placed.join(scratch.save(sizes, "sizes"), group)
    slotted = sized.withColumn("slot", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = [*group, "i", "j"]
    spread = slotted.withColumn("i", F.least("slot", "other")).withColumn("j", F.greatest("slot", "other")).drop("blocks", "other")

    def near(t: pa.Table) -> pa.Table:
        return t.select([*group, "slot", "id"]).take(pa.array(near_in_block(t, threshold), pa.int64()))

    def run(t: pa.Table) -> pa.Table:
        ids, links, root = links_in_block(t, threshold, single)
        there = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[there], pa.int64()), "links": pa.array(links[there], pa.int64()), "root": pa.array(root[there], pa.int64())})

    kept = scratch.save(spread.groupBy(*group).applyInArrow(near, "dim int, place int, key int, i int, j int, slot int, id bigint"), "near")
    whole = kept.join(coded.select("id", "n", "vec", "keys"), "id")
    found = scratch.save(whole.groupBy(*group).applyInArrow(run, "id bigint, links bigint, root bigint"), "found")
    scratch.drop("codes")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), scratch, "components")
    known = scratch.save(classes.join(counts, "id", "left").join(labels, "id", "left").select("vec", F.coalesce("component", "id").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "known")
    kind = rows.schema["vec_id"].dataType
    out = rows.join(known.withColumnRenamed("vec", "v"), F.when(F.col("vec_id").isNotNull(), F.col("vec")) == F.col("v"), "left")
    component = F.coalesce(F.col("component").cast(kind), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
