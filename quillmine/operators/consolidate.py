"""Exact deduplication with survivorship, limits on distinct papers, and filters. All order is by seq, the arrival order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import paper_key, publication_key, union_sorted
from ..schema import PAPER, PUBLICATION, SOURCES


def with_keys(papers: DataFrame) -> DataFrame:
    """Adds paper_key and publication_key (null without a publication)."""
    p = F.col("publication")
    return papers.withColumn("paper_key", paper_key(F.col("title"), F.col("doi"), F.col("publication_date"))).withColumn("publication_key", F.when(p.isNotNull(), publication_key(p["title"], p["issn"], p["isbn"])))


def in_dates(date: Column, since: dt.date | None, until: dt.date | None) -> Column:
    """Both ends count; a bound that is None doesn't bind."""
    out = F.lit(True)
    if since is not None:
        out = out & (date >= F.lit(since))
    return out & (date <= F.lit(until)) if until is not None else out


def of_types(publication: Column, types: tuple[str, ...] | None) -> Column:
    """No publication counts as other; a publication without a category passes any types."""
    if types is None:
        return F.lit(True)
    kind = publication["category"]
    return F.when(publication.isNull(), F.lit("other" in types)).otherwise(kind.isNull() | F.lower(kind).isin(*types) | (~kind.isin("Journal", "Conference Proceedings", "Book") & F.lit("other" in types)))


def usable(papers: DataFrame) -> DataFrame:
    """Rows with a title and a date."""
    return papers.filter((F.length("title") > 0) & F.col("publication_date").isNotNull())


def first_known(value: Column, seq: Column) -> Column:
    """The earliest value that isn't null."""
    return F.min_by(value, F.when(value.isNotNull(), seq))


def longest_first(value: Column, size: Column, seq: Column) -> Column:
    """The largest by size; of equals the earliest. An ordering that grows as seq shrinks isn't there for
    structs, so the choice is the least of (-size, seq)."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(-size, seq)))


def merge_papers(papers: DataFrame, key: str) -> DataFrame:
    """One row for each value of key: seq, the canonical columns by the rules of survivorship, and n_merged.

    Title: the first. Date, DOI: the first known. Abstract, comments, pages: the longest. Authors, keywords:
    the largest. Citations, pages: the most. URLs and databases: all. The publication: merged in turn.
    """
    seq = F.col("seq")
    text = lambda c: longest_first(F.col(c), F.length(c), seq).alias(c)
    many = lambda c: longest_first(F.col(c), F.size(c), seq).alias(c)
    every = lambda c: union_sorted(F.collect_set(c)).alias(c)
    rules = {
        "title": F.min_by("title", seq).alias("title"), "abstract": text("abstract"), "authors": many("authors"), "publication": merged_publication(F.col("publication"), seq).alias("publication"),
        "publication_date": first_known(F.col("publication_date"), seq).alias("publication_date"), "urls": every("urls"), "doi": first_known(F.col("doi"), seq).alias("doi"),
        "citations": F.max("citations").alias("citations"), "keywords": many("keywords"), "comments": text("comments"), "number_of_pages": F.max("number_of_pages").alias("number_of_pages"),
        "pages": text("pages"), "databases": every("databases"),
    }
    return papers.groupBy(key).agg(F.min("seq").alias("seq"), *(rules[f.name] for f in PAPER), F.count("*").alias("n_merged"))


def publication_rules(p: Column, seq: Column) -> list[Column]:
    """Aggregates for each field of a publication, in the schema's order."""
    subjects = F.filter(F.transform(p["subject_areas"], lambda x: F.trim(x)), lambda s: s != "")
    rules = {
        "title": longest_first(p["title"], F.length(p["title"]), seq),
        "subject_areas": F.when(F.count(p["title"]) > 0, union_sorted(F.collect_set(subjects))),
        "is_potentially_predatory": F.bool_or(F.coalesce(p["is_potentially_predatory"], F.lit(False))),
    }
    return [rules.get(f.name, first_known(p[f.name], seq)).alias(f.name) for f in PUBLICATION]


def merged_publication(p: Column, seq: Column) -> Column:
    """One publication of several, null if all are."""
    return F.when(F.count(p) > 0, F.struct(*publication_rules(p, seq)))


def merge_publications(papers: DataFrame) -> DataFrame:
    """papers whose publication is the merged one of all papers with the same publication_key."""
    p = F.col("publication")
    merged = papers.filter("publication_key is not null").groupBy("publication_key").agg(F.struct(*publication_rules(p, F.col("seq"))).alias("merged"))
    return papers.join(merged, "publication_key", "left").withColumn("publication", F.coalesce("merged", "publication")).drop("merged")


def limit_per_source(papers: DataFrame, limit: int | None) -> DataFrame:
    """Arrivals up to the one that completes `limit` distinct papers of a source; later ones, copies too, don't count.

    The numbering runs over distinct keys of each source and keeps the first `limit` in partial windows already.
    """
    if limit is None:
        return papers
    firsts = papers.groupBy("source", "paper_key").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("source").orderBy("seq")
    cut = firsts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).groupBy("source").agg(F.max("seq").alias("last"), F.max("n").alias("n"))
    bound = F.broadcast(cut)  # a row for each source
    return papers.join(bound, "source").filter((F.col("n") < limit) | (F.col("seq") <= F.col("last"))).drop("last", "n")


def limit_total(papers: DataFrame, limit: int | None) -> DataFrame:
    """Arrivals up to the one that completes `limit` distinct papers over all sources. Only the top keys are sorted."""
    if limit is None:
        return papers
    firsts = papers.groupBy("paper_key").agg(F.min("seq").alias("seq")).orderBy("seq").limit(limit)
    last = firsts.agg(F.when(F.count("*") >= limit, F.max("seq")).alias("last")).scalar()  # null: the limit isn't reached
    return papers.filter(F.coalesce(F.col("seq") <= last, F.lit(True)))


def deduplicate(papers: DataFrame) -> DataFrame:
    """One row for each paper_key, publications merged by their own key first."""
    return merge_papers(merge_publications(with_keys(papers)), "paper_key")


def lookup(papers: DataFrame, key: str) -> DataFrame:
    """The paper with a key, if there is one."""
    return papers.filter(F.col("paper_key") == key)


def without(papers: DataFrame, keys: DataFrame) -> DataFrame:
    """papers less those whose paper_key is among keys(paper_key)."""
    return papers.join(keys.select("paper_key").distinct(), "paper_key", "left_anti")


def tagged(papers: DataFrame, source: str) -> DataFrame:
    """papers that a source has, too. An unknown source raises ValueError."""
    known = {s.lower(): s for s in SOURCES}
    if source.lower() not in known:
        raise ValueError(f"unknown database: {source}")
    return papers.withColumn("databases", union_sorted(F.array("databases", F.array(F.lit(known[source.lower()])))))


def with_url(papers: DataFrame, url: Column) -> DataFrame:
    """papers with one more address; a null adds none."""
    return papers.withColumn("urls", union_sorted(F.array("urls", F.array(url))))
