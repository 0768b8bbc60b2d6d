import pytest
from pyspark.sql import functions as F

from quillmine.operators import consolidate as c
from quillmine.operators import enrich
from quillmine.schema import conform
from quillmine.sinks import documents
from quillmine.spec import SearchSpec
from quillmine.streaming.incremental import Consolidated, follow

from .test_consolidate import frame, paper, venue

PAGE = """<META CONTENT='Short' NAME='citation_title'><meta name="citation_title" content="A longer title"><meta content="10.9/x" name="citation_doi"><meta name="keywords" content="a; b">
<meta name="citation_author" content="Lee"><meta name="citation_author" content="Bo"><meta name="citation_journal_title" content="Sea Journal"><meta name="citation_issn" content="7-7"><meta name="citation_pdf_url" content="http://x/p.pdf">"""


def test_metadata(spark):
    pages = spark.createDataFrame([("u", PAGE), ("none", "<p>"), ("pre", '<meta name="citation_title" content="T"><meta name="citation_journal_title" content="bioRxiv">')], "url string, html string")
    got = {r.url: r for r in enrich.page_metadata(pages).collect()}
    assert set(got) == {"u", "pre"} and got["pre"].venue is None
    u = got["u"]
    assert (u.title, u.doi, u.keywords, u.authors, u.venue.category, u.issn) == ("A longer title", "10.9/x", ["a", "b"], ["Lee", "Bo"], "Journal", "7-7")


def test_enrichment(spark):
    rows = [paper("Old", urls=["u", "http://x/some.pdf"]), paper("Kept", doi="10.1/k", urls=["u"]), paper("Has venue", urls=["u"], publication=venue("V"))]
    pages = spark.createDataFrame([("u", PAGE), ("http://x/some.pdf", PAGE.replace("longer", "wrong"))], "url string, html string")
    a, b, d = enrich.enrich_from_pages(c.with_keys(frame(spark, rows)), pages).orderBy("seq").collect()
    assert (a.title, a.doi, a.authors, a.publication.title, a.publication.category) == ("A longer title", "10.9/x", ["Lee", "Bo"], "Sea Journal", "Journal")
    assert a.urls == ["http://x/p.pdf", "http://x/some.pdf", "u"]
    assert (b.title, b.publication) == ("Kept", None)
    assert (d.publication.title, d.publication.category, d.publication.issn) == ("V", "Journal", "7-7")


def test_flags(spark):
    rows = [paper("A", publication=venue("Bad Journal")), paper("B", publication=venue("Fine", publisher=" shady press")), paper("C", publication=venue("Host"), doi="10.1/h"), paper("D", publication=venue("Good")), paper("E"), paper("F", publication=venue("good"))]
    journals = spark.createDataFrame([("bad journal ".replace(" ", " "),), (None,)], "name string")
    publishers = spark.createDataFrame([("Shady Press", None), ("Other", "http://www.evil.org/x")], "name string, url string")
    resolved = spark.createDataFrame([("10.1/h", "https://evil.org/article")], "doi string, final_url string")
    got = {r.title: r.publication and r.publication.is_potentially_predatory for r in enrich.flag_predatory(c.with_keys(frame(spark, rows)), journals, publishers, resolved).collect()}
    assert got == {"A": True, "B": True, "C": True, "D": False, "E": None, "F": False}


def test_sinks(spark, tmp_path):
    df = c.with_keys(frame(spark, [paper("Same", urls=["u"]), paper("Same!", doi="10.1/x"), paper("Same?")]))
    plan = {r.paper_key: r for r in documents.download_plan(df).collect()}
    assert [plan[k].collision for k in ("same|2020", "DOI-10.1/x", "same?|2020")] == [False, False, True]
    assert plan["DOI-10.1/x"].urls == ["http://doi.org/10.1/x"]
    documents.write_search(df, SearchSpec("[a]"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/papers")).count() == 3 and '"number_of_papers": 3' in spark.read.text(str(tmp_path / "s/envelope")).first().value


def test_stream_equals_batch(spark, tmp_path):
    rows = [paper("The sea", "short", urls=["u1"]), paper("the sea", "a longer abstract", urls=["u2"], citations=3), paper("Other", "nothing")]
    whole = frame(spark, rows)
    for i in range(3):
        whole.filter(F.col("seq") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    spec, table = SearchSpec("[sea]"), Consolidated(spark, str(tmp_path / "table"))
    for _ in range(2):  # a second start finds nothing new
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landing"))
        q = follow(stream, spec, table, str(tmp_path / "cp"))
        q.awaitTermination(60)
    got = table.read().collect()
    assert len(got) == 1 and (got[0].abstract, got[0].urls, got[0].citations) == ("a longer abstract", ["u1", "u2"], 3)
    table.merge(whole.filter("seq = 2"), 0)  # a batch number that was merged before
    assert table.read().count() == 1


def test_a_batch_that_fails_between_its_writes_loses_nothing(spark, tmp_path, monkeypatch):
    first, more, again = frame(spark, [paper("The sea", "short"), paper("Other", "x")]), frame(spark, [paper("Third", "y")]), frame(spark, [paper("the sea", "a longer abstract")])
    table = Consolidated(spark, str(tmp_path / "table"))
    assert table.read() is None
    table.merge(first, 0)
    publish = Consolidated.publish
    monkeypatch.setattr(Consolidated, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.merge(more, 1)  # the data is written, the version isn't
    assert sorted(r.title for r in Consolidated(spark, str(tmp_path / "table")).read().collect()) == ["Other", "The sea"]
    monkeypatch.setattr(Consolidated, "publish", publish)
    before = table.runs_of(0)
    table.merge(more, 1)
    table.merge(more, 1)  # the same batch again
    assert sorted(r.title for r in table.read().collect()) == ["Other", "The sea", "Third"]
    held = table.runs_of(1)
    assert held[0] == before[0] and held[1][1] == 1  # what was there isn't written again
    table.merge(again, 2)
    assert {r.title: r.abstract for r in table.read().collect()}["The sea"] == "a longer abstract"
    named = {name for v in table.versions() for name, _ in table.runs_of(v)}
    assert table.versions() == [1, 2] and set(table.listed("data")) == named  # what the failed batch left is gone


def test_batches_write_in_proportion_to_their_keys(spark, tmp_path, monkeypatch):
    """20 batches of 100 keys, half of them known: runs stay few, what is written grows as n log n, and all equals one merge."""
    written, write = [], Consolidated.write
    monkeypatch.setattr(Consolidated, "write", lambda self, df, number: written.append(write(self, df, number)) or written[-1])
    batch = lambda i: conform(spark.range(i * 50, i * 50 + 100, numPartitions=1).select(F.concat(F.lit("t"), F.col("id")).alias("title"), F.lit("2020-01-01").cast("date").alias("publication_date"), F.array(F.lit(f"u{i}")).alias("urls"), (F.col("id") + 10_000 * i).alias("seq")))
    table = Consolidated(spark, str(tmp_path / "table"))
    for i in range(20):
        table.merge(batch(i), i)
        table = Consolidated(spark, str(tmp_path / "table"))  # a restart
    runs = [rows for _, rows in table.runs_of(19)]
    assert len(runs) <= 7 and runs == sorted(runs, reverse=True)
    assert sum(rows for _, rows in written) <= 20 * 100 * 3  # not 20 * 1050 / 2 * ... as whole tables would be
    everything = batch(0)
    for i in range(1, 20):
        everything = everything.unionByName(batch(i))
    rows = lambda df: sorted((r.paper_key, r.seq, tuple(r.urls)) for r in df.collect())
    assert rows(table.read()) == rows(c.merge_papers(c.with_keys(everything), "paper_key"))
