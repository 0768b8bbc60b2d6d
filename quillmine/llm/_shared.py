"""Helpers that the operators of this subpackage share: tables, slices of Arrow batches, columns made from texts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of one slice inside a Python worker; bounds the memory of a vectorised step on usual texts.
SLICE_ROWS = 1_000
#: Bytes of text of one slice; a single text above it makes a slice of its own.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path goes to Spark's reader only, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where its rows or the bytes of a text column reach the limits. Rows stay whole and in order."""
    texts = batch.column(batch.schema.get_field_index(column))
    start, held = 0, 0
    lengths = pc.binary_length(texts).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_text(df: DataFrame, make: Callable[[], Callable[[list], list]], schema: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds columns computed from the whole texts, keeping the key columns as they are.

    make() runs once in each task and returns a function from a list of texts (null is "") to a list of
    columns. Only the key columns and text leave the JVM.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    narrow = df.select(*keys, "text")
    out = narrow.select(*keys).limit(0).schema
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in out), schema])
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow
        step = make()
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                made = step(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(x if isinstance(x, pa.Array) else pa.array(x) for x in made)], names=[*keys, *names])

    return narrow.mapInArrow(run, ddl)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies, on whichever machine asks."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
