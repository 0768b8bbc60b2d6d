"""Canonical record schema and the registry of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source labels in arrival order, publication categories, accepted publication types.
SOURCES = ("arXiv", "PubMed", "IEEE", "Scopus", "medRxiv", "bioRxiv")
CATEGORIES = ("Journal", "Conference Proceedings", "Book")
PUBLICATION_TYPES = ("journal", "conference proceedings", "book", "other")

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "date": T.DateType(), "strings": T.ArrayType(T.StringType()), "counts": T.MapType(T.StringType(), T.IntegerType())}


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k] if isinstance(k, str) else k) for n, k in fields.items()])


PUBLICATION = _struct(title="string", isbn="string", issn="string", publisher="string", category="string", cite_score="double", sjr="double", snip="double", subject_areas="strings", is_potentially_predatory="boolean")
PAPER = _struct(
    title="string", abstract="string", authors="strings", publication=PUBLICATION, publication_date="date", urls="strings", doi="string", citations="int",
    keywords="strings", comments="string", number_of_pages="int", pages="string", databases="strings",
)
#: A saved search: the query's parameters, counts, and its papers.
SEARCH = _struct(
    query="string", since="string", until="string", limit="int", limit_per_database="int", processed_at="string", databases="strings", publication_types="strings",
    number_of_papers="int", number_of_papers_by_database="counts", papers=T.ArrayType(PAPER),
)


def source_rank(column: str = "source"):
    """Position of a source in arrival order, from 1; 0 for unknown ones. Case doesn't count."""
    return F.array_position(F.array(*(F.lit(s.lower()) for s in SOURCES)), F.lower(column))


def with_arrival(df: DataFrame, source: str, page: str = "page", position: str = "position") -> DataFrame:
    """Adds source and seq, the arrival order over all sources: source, then page, then place in the page.

    seq is a struct, so that it is exact for any number of pages and independent of partitioning.
    """
    rank = SOURCES.index(source) + 1
    return df.withColumn("source", F.lit(source)).withColumn("seq", F.struct(F.lit(rank).alias("source"), F.col(page).cast("long").alias("page"), F.col(position).cast("long").alias("position"))).drop(page, position)


def conform(df: DataFrame) -> DataFrame:
    """Canonical columns in order, with nulls (or empty arrays) for those that a source doesn't set, and all others after them."""
    columns = []
    for f in PAPER:
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType) and f.name != "authors":
            value = F.coalesce(value, F.array().cast(f.dataType))
        columns.append(value.alias(f.name))
    return df.select(*columns, *(c for c in df.columns if c not in PAPER.names))


def to_records(papers: DataFrame) -> DataFrame:
    """One JSON string for each paper, all canonical fields in it."""
    return papers.select(F.to_json(F.struct(*PAPER.names), {"ignoreNullFields": "false"}).alias("record"))


def from_records(records: DataFrame) -> DataFrame:
    """Papers of JSON strings; a string that is no record gives nulls."""
    return conform(records.select(F.from_json("record", PAPER).alias("paper")).select("paper.*"))
