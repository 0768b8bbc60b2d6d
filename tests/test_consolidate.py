import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillmine.operators import consolidate as c
from quillmine.operators import reports
from quillmine.schema import PAPER, conform, from_records, to_records, with_arrival

D = dt.date(2020, 1, 1)


def paper(title="T", abstract=None, authors=(), publication=None, publication_date=D, urls=(), doi=None, citations=None, keywords=(), comments=None, number_of_pages=None, pages=None, databases=("arXiv",)):
    return (title, abstract, list(authors), publication, publication_date, list(urls), doi, citations, list(keywords), comments, number_of_pages, pages, list(databases))


def venue(title, isbn=None, issn=None, publisher=None, category=None, subjects=(), flag=False):
    return (title, isbn, issn, publisher, category, None, None, None, list(subjects), flag)


def frame(spark, rows, sources=None):
    return spark.createDataFrame([(*r, (sources or ["arXiv"] * len(rows))[i], i) for i, r in enumerate(rows)], _schema())


def _schema():
    from pyspark.sql import types as T

    return T.StructType([*PAPER.fields, T.StructField("source", T.StringType()), T.StructField("seq", T.LongType())])


def test_survivorship(spark):
    rows = [
        paper("First", "short", ["a"], venue("V", issn="1"), urls=["u2"], doi="10/x", citations=3, keywords=["k"], databases=["arXiv"]),
        paper("Second longer", "longer text", ["b", "c"], venue("Venue", issn="1", publisher="P", category="Journal", subjects=[" s ", ""], flag=True), dt.date(2021, 1, 1), ["u1"], "10/x", 2, ["x"], "note", 4, "1-4", ["IEEE"]),
        paper("Third", "same length", ["d", "e"], None, urls=["u1"], doi="10/x", databases=["arXiv"]),
    ]
    got = c.deduplicate(frame(spark, rows)).collect()
    assert len(got) == 1
    g = got[0]
    assert (g.title, g.publication_date, g.abstract, g.authors, g.citations, g.keywords) == ("First", D, "longer text", ["b", "c"], 3, ["k"])
    assert (g.urls, g.databases, g.comments, g.number_of_pages, g.pages, g.n_merged) == (["u1", "u2"], ["IEEE", "arXiv"], "note", 4, "1-4", 3)
    p = g.publication
    assert (p.title, p.publisher, p.category, p.subject_areas, p.is_potentially_predatory) == ("Venue", "P", "Journal", ["s"], True)


def fold(rows):
    """The specification: papers one by one, in order."""
    out = {}
    for seq, r in enumerate(rows):
        key = f"DOI-{r[6]}" if r[6] else f"{r[0].lower()}|{r[4].year}"
        if key not in out:
            out[key] = [seq, *r]
            continue
        o = out[key]
        for i in (1, 9, 11):
            if r[i] is not None and (o[i + 1] is None or len(r[i]) > len(o[i + 1])):
                o[i + 1] = r[i]
        for i in (2, 8):
            if len(r[i]) > len(o[i + 1]):
                o[i + 1] = r[i]
        o[8] = max((x for x in (o[8], r[7]) if x is not None), default=None)
        for i in (5, 12):
            o[i + 1] = sorted({*o[i + 1], *r[i]})
    return {k: [v[0], v[1], v[2], v[3], v[6], v[8], v[9], v[10], v[12], v[13]] for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_ordered_fold_whatever_the_partitioning(spark, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "x", "yy", "zz", "abc"])
    rows = [paper(rng.choice("ABC"), text(), rng.sample("pqr", rng.randint(0, 3)), None, dt.date(rng.choice([2000, 2001]), 1, 1), rng.sample(["u", "v"], 1), rng.choice([None, None, "d1", "d2"]), rng.choice([None, 1, 5]), rng.sample("kl", rng.randint(0, 2)), text(), None, text(), [rng.choice(["arXiv", "IEEE"])]) for _ in range(60)]
    df = c.with_keys(frame(spark, rows))
    want = fold(rows)
    for n in (1, 5):
        got = {r.paper_key: [r.seq, r.title, r.abstract, r.authors, r.urls, r.citations, r.keywords, r.comments, r.pages, r.databases] for r in c.merge_papers(df.repartition(n), "paper_key").collect()}
        assert got == want
    again = c.merge_papers(c.merge_papers(df, "paper_key").withColumn("k", F.col("paper_key")), "k")
    assert again.count() == len(want)


def test_limits(spark):
    rows = [paper("A"), paper("a"), paper("B"), paper("C"), paper("A"), paper("D")]
    df = c.with_keys(frame(spark, rows, ["arXiv", "arXiv", "arXiv", "IEEE", "IEEE", "IEEE"]))
    seqs = lambda x: [r.seq for r in x.orderBy("seq").collect()]
    assert seqs(c.limit_total(df, 2)) == [0, 1, 2]
    assert seqs(c.limit_total(df, 9)) == seqs(c.limit_total(df, None)) == list(range(6))
    assert seqs(c.limit_per_source(df, 1)) == [0, 3]
    assert seqs(c.limit_per_source(df, 2)) == [0, 1, 2, 3, 4]
    assert seqs(c.limit_per_source(df, None)) == list(range(6))


def test_filters(spark):
    rows = [paper(publication=None), paper(publication=venue("V", category="Journal")), paper(publication=venue("V")), paper(publication=venue("V", category="Book")), paper(""), paper(publication_date=None)]
    df = frame(spark, rows)
    seqs = lambda x: [r.seq for r in x.orderBy("seq").collect()]
    assert seqs(df.filter(c.of_types(F.col("publication"), ("journal",)))) == [1, 2]
    assert seqs(df.filter(c.of_types(F.col("publication"), ("other", "book")))) == [0, 2, 3, 4, 5]
    assert seqs(c.usable(df)) == [0, 1, 2, 3]
    assert seqs(df.filter(c.in_dates(F.col("publication_date"), D, D))) == [0, 1, 2, 3, 4]
    assert seqs(df.filter(c.in_dates(F.col("publication_date"), None, dt.date(2019, 12, 31)))) == []


def test_reports(spark):
    df = frame(spark, [paper(databases=["arXiv", "IEEE"]), paper("B", databases=["IEEE"], citations=2), paper("C", databases=["Scopus"], publication_date=dt.date(2022, 1, 1))])
    assert {r.database: r.n for r in reports.counts_by_database(df).collect()} == {"arXiv": 1, "IEEE": 2, "Scopus": 1}
    assert {r.region: r.n for r in reports.regions(df, ("arXiv", "IEEE", "PubMed")).collect()} == {"arXiv+IEEE": 1, "IEEE": 1, "none": 1}
    assert [r.citations for r in reports.citation_series(df).collect()] == [2]
    assert [r.title for r in reports.newest_first(df).collect()] == ["C", "B", "T"]


def test_arrival_and_conform(spark):
    df = spark.createDataFrame([("x", 2, 3)], "title string, page int, position int")
    row = conform(with_arrival(df, "IEEE")).first()
    assert (row.seq.source, row.seq.page, row.seq.position, row.source, row.urls, row.doi) == (3, 2, 3, "IEEE", [], None)


def test_records_lookup_and_tags(spark):
    df = c.with_keys(frame(spark, [paper("A", urls=["u"], publication=venue("V")), paper("B")]))
    back = from_records(to_records(df)).collect()
    assert sorted(r.title for r in back) == ["A", "B"] and back[0].publication_date == D
    assert c.lookup(df, "a|2020").count() == 1 and c.lookup(df, "none").count() == 0
    assert [r.title for r in c.without(df, c.lookup(df, "a|2020")).collect()] == ["B"]
    one = c.with_url(c.tagged(df, "ieee"), F.lit("a")).filter("title = 'A'").first()
    assert (one.databases, one.urls) == (["IEEE", "arXiv"], ["a", "u"])
    with pytest.raises(ValueError):
        c.tagged(df, "nowhere")
