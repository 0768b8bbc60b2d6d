"""Counts and series over consolidated papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_database(papers: DataFrame) -> DataFrame:
    """database, n; a paper counts for each database that has it."""
    return papers.select(F.explode("databases").alias("database")).groupBy("database").agg(F.count("*").alias("n"))


def regions(papers: DataFrame, databases: tuple[str, str, str]) -> DataFrame:
    """region, n: how many papers are in just these of three databases; in none of them is "none"."""
    inside = F.array_join(F.filter(F.array(*(F.when(F.array_contains("databases", d), F.lit(d)) for d in databases)), lambda d: d.isNotNull()), "+")
    return papers.groupBy(F.when(inside == "", "none").otherwise(inside).alias("region")).agg(F.count("*").alias("n"))


def citation_series(papers: DataFrame) -> DataFrame:
    """publication_date, citations of papers with citations."""
    return papers.filter("citations is not null").select("publication_date", "citations")


def newest_first(papers: DataFrame) -> DataFrame:
    """By date, newest first; ties by title and key, so that the order is one."""
    return papers.orderBy(F.desc("publication_date"), "title", *(["paper_key"] if "paper_key" in papers.columns else []))
