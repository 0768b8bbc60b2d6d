"""The three things a user does: search, download, generate_bibtex."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import consolidate, enrich, fuzzy
from .operators.normalize import NORMALIZERS
from .operators.token_index import TokenIndex
from .plans.predicates import for_source
from .plans.query import QueryError
from .schema import SOURCES, source_rank
from .scratch import Scratch
from .sinks import documents
from .sources import captures, live
from .spec import SearchSpec

log = logging.getLogger(__name__)
READERS = {"arXiv": captures.read_arxiv, "PubMed": captures.read_pubmed, "IEEE": captures.read_ieee, "Scopus": captures.read_scopus, "medRxiv": captures.read_rxiv, "bioRxiv": captures.read_rxiv}


def load_sources(spark: SparkSession, spec: SearchSpec, paths: dict[str, str], matching: bool = False, dead_letters: str | None = None) -> DataFrame | None:
    """Normalised papers of all captured sources that the search asks for and that have a path ("Scopus details" is one
    for its detail documents); with matching, only those
    that select() takes, so that dates and terms are applied before anything is written.

    Each source is read to the end and its papers written to the shared folder, so that one that can't be read, or whose
    files turn out to be broken on the way, is left out and doesn't end the search. Records that can't be read are left
    out of the papers; with dead_letters, a folder, they are added there as Parquet: source, file, record.
    """
    out, scratch = None, Scratch(spark, "sources")
    for source in spec.databases:
        if source not in paths or (source == "PubMed" and spec.publication_types is not None and "journal" not in spec.publication_types):
            log.info("skipping %s", source)
            continue
        try:
            raw = READERS[source](spark, paths[source])
            details = paths.get(f"{source} details")  # a folder of captured detail documents
            read = NORMALIZERS[source](raw, captures.read_scopus_details(spark, details)) if source == "Scopus" and details else NORMALIZERS[source](raw)
            papers = scratch.save(select(read, spec) if matching else read, source)
            if dead_letters:
                captures.read_broken(spark, source, paths[source]).select(F.lit(source).alias("source"), "file", "record").write.mode("append").parquet(dead_letters)
        except Exception:  # noqa: BLE001  one source that fails doesn't end the search
            log.warning("%s can't be read", source, exc_info=True)
            continue
        out = papers if out is None else out.unionByName(papers)
    return out


def capture(spark: SparkSession, spec: SearchSpec, source: str, folder: str, token: str = "", **options) -> str:
    """Captures what a live source has for the search, page by page, until the search's limits are reached or it ends; a
    walk that broke goes on where it broke. Returns the folder, which search() reads."""

    def accepted(session: SparkSession, path: str) -> DataFrame:
        found = select(NORMALIZERS[source](READERS[source](session, path)), spec)
        return consolidate.with_keys(found).select(F.col("paper_key").alias("key")).distinct()

    return live.capture(spark, spec, source, folder, token, enough=accepted, **options)


def select(papers: DataFrame, spec: SearchSpec) -> DataFrame:
    """Usable papers of the asked sources that match the query in its sources' field scopes, within the dates."""
    chosen = consolidate.usable(papers).filter(F.col("source").isin(*spec.databases))
    match = F.lit(False)
    for source in spec.databases:
        try:
            match = F.when(F.col("source") == source, for_source(source, spec.tree, F.col("title"), F.col("abstract"), F.array_join("keywords", " "))).otherwise(match)
        except QueryError as e:
            log.warning("%s is left out: %s", source, e)
    return chosen.filter(consolidate.in_dates(F.col("publication_date"), spec.since, spec.until)).filter(match)


def run(papers: DataFrame, spec: SearchSpec, pages: DataFrame | None = None, metrics: DataFrame | None = None, journals: DataFrame | None = None, publishers: DataFrame | None = None, resolved: DataFrame | None = None, threshold: float = 0.95, index: TokenIndex | None = None) -> DataFrame:
    """Consolidated papers: select, limit, deduplicate, enrich, filter by type, merge similar titles, flag.

    papers: canonical columns, source and seq (any orderable type). Columns of the result: the canonical ones,
    seq, paper_key and publication_key. lookups.tables() makes pages, metrics and resolved from live sources;
    an index of the papers narrows them before the query's predicate decides.
    """
    found = consolidate.with_keys(select(index.narrow(papers, spec.tree) if index else papers, spec))
    found = consolidate.limit_total(consolidate.limit_per_source(found, spec.limit_per_database), spec.limit)
    merged = consolidate.merge_papers(consolidate.merge_publications(found), "paper_key")
    if metrics is not None:
        merged = enrich.enrich_from_metrics(merged, metrics)
    if pages is not None:
        merged = enrich.enrich_from_pages(merged, pages)
    typed = merged.filter(consolidate.of_types(F.col("publication"), spec.publication_types))
    similar = fuzzy.merge_similar(with_long_seq(typed), threshold)
    keyed = consolidate.with_keys(similar.drop("n_merged"))
    if journals is not None and publishers is not None:
        keyed = enrich.flag_predatory(keyed, journals, publishers, resolved)
    return keyed


def with_long_seq(papers: DataFrame) -> DataFrame:
    """seq as one long: struct arrivals are packed as source, page and position (20 bits and 28 bits for the last two)."""
    if papers.schema["seq"].dataType.typeName() != "struct":
        return papers
    s = F.col("seq")
    return papers.withColumn("seq", F.shiftleft(s["source"].cast("long"), 58) + F.shiftleft(s["page"], 28) + s["position"])


def search(spark: SparkSession, outputpath: str | None, spec: SearchSpec, paths: dict[str, str], one_file: bool = False, dead_letters: str | None = None, **tables: DataFrame) -> DataFrame:
    """Searches captured sources and, with an output path, saves the result: a folder with the papers and the envelope, or
    with one_file one JSON document. What is returned is the saved result, so nothing is computed twice."""
    papers = load_sources(spark, spec, paths, matching=True, dead_letters=dead_letters)
    if papers is None:
        raise ValueError("none of the asked sources can be read")
    result = run(papers, spec, **tables)
    if not outputpath:
        return result
    if one_file:
        result = Scratch(spark, "search").save(result, "result")
        documents.write_search_json(result, spec, outputpath)
        return result
    documents.write_search(result, spec, outputpath)
    return spark.read.parquet(f"{outputpath}/papers")


def generate_bibtex(spark: SparkSession, search_path: str, outputpath: str, credit_tool: bool = False) -> None:
    documents.write_bibtex(captures.read_saved(spark, search_path), outputpath, credit_tool)


def download(spark: SparkSession, search_path: str, output_directory: str | None = None, get: Callable | None = None) -> DataFrame:
    """The download plan of a saved search; with a directory and a fetching function, what became of it."""
    plan = documents.download_plan(consolidate.with_keys(captures.read_saved(spark, search_path)))
    return documents.fetch(plan, output_directory, get) if output_directory and get else plan


__all__ = ["SOURCES", "SearchSpec", "capture", "download", "generate_bibtex", "load_sources", "run", "search", "select", "source_rank"]
