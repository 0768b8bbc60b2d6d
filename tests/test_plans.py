"""What the physical plans must and must not hold, whatever the data."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from quillmine import queries, source_queries
from quillmine.operators import consolidate
from quillmine.queries import papers

#: Queries whose work is a job of its own before the plan is there (files written and read, merges): their plans are the last step's.
ALL = {**queries.QUERIES, **source_queries.QUERIES}
#: Those that run Python by design: BibTeX and JSON aren't among them, addresses, replayed merges and per-row parsers are.
PYTHON = {"q_fetch_addresses", "q_query_language", "q_dialects"}
SF = "/root/testdata/sf0.001"


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        ALL[name](spark, SF).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(ALL))
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert name in PYTHON or not any(x in text for x in ("PythonUDF", "MapInArrow", "MapInPandas", "FlatMapGroups", "BatchEvalPython"))
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name, pushed, read",
    [
        ("q_date_range", "GreaterThanOrEqual(o_orderdate,", "struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>"), ("q_host", "", "struct<page_id:bigint,url:string>"), ("q_paper_key", "", "struct<doc_id:bigint,text:string>"),
        ("q_lookup", "", "struct<doc_id:bigint,text:string>"),
    ],
)
def test_pushdown_and_pruning(spark, name, pushed, read):
    text = plan(spark, name)
    assert f"ReadSchema: {read}" in text
    assert pushed in "".join(x for x in text.splitlines() if x.startswith("PushedFilters"))


def test_a_search_in_saved_papers_pushes_dates_and_sources(spark, tmp_path):
    """Canonical papers in Parquet: source and dates reach the scan, and only the columns that are asked for."""
    import datetime as dt

    papers(spark, SF).write.parquet(str(tmp_path / "p"))
    chosen = spark.read.parquet(str(tmp_path / "p")).filter(consolidate.in_dates(F.col("publication_date"), dt.date(2010, 1, 1), None)).filter(F.col("source").isin("IEEE", "PubMed"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        chosen.select("title").explain("formatted")
    pushed = next(x for x in out.getvalue().splitlines() if x.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(publication_date,2010-01-01)" in pushed and "In(source, [IEEE,PubMed])" in pushed
    assert "ReadSchema: struct<title:string,publication_date:date,source:string>" in out.getvalue()


def test_limits_are_taken_before_the_shuffle(spark):
    assert plan(spark, "q_limit_per_source").count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan(spark, "q_limit_global")
