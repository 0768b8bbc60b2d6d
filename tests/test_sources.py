import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillmine import api
from quillmine.operators import normalize as n
from quillmine.sources import captures, live
from quillmine.spec import SearchSpec

ARXIV = """<feed xmlns:arxiv="x"><entry><title>A  title
 on ships</title><published>2020-02-27T13:35:26Z</published><summary>All about ships</summary><arxiv:journal_ref>Journal of Boats</arxiv:journal_ref><arxiv:doi>10.1/a</arxiv:doi>
<arxiv:comment>3 pages</arxiv:comment><category term="cs.DB"/><category term="zz"/><link href="http://b"/><link href="http://a"/><author><name>Ann Lee</name></author></entry>
<entry><title>Single</title><published>2021-01-01T00:00:00Z</published><summary>s</summary><category term="stat.ML"/><link href="http://c"/><author><name>Bo</name></author><author><name>Cy</name></author></entry>
<entry><title>No date</title><summary>s</summary></entry></feed>"""
PUBMED = """<Set><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><Journal><ISSN>1-2</ISSN><Title>Sea Letters</Title><JournalIssue><PubDate><Year>2020</Year><Month>Feb</Month></PubDate></JournalIssue></Journal>
<ArticleTitle>On ships</ArticleTitle><Pagination><MedlinePgn>10-14</MedlinePgn></Pagination><Abstract><AbstractText>One.</AbstractText><AbstractText>Two.</AbstractText></Abstract>
<AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author><Author><LastName>Crew</LastName></Author></AuthorList></Article>
<KeywordList><Keyword MajorTopicYN="N">boats</Keyword><Keyword MajorTopicYN="N">sails</Keyword></KeywordList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId><ArticleId IdType="doi">10.1/p</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><Journal><Title>J</Title></Journal><ArticleTitle>No abstract</ArticleTitle><ArticleDate><Year>2020</Year><Month>1</Month><Day>5</Day></ArticleDate></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>3</PMID><Article><Journal><Title>J</Title></Journal><ArticleTitle>Exact day</ArticleTitle><Abstract><AbstractText>x</AbstractText></Abstract><ArticleDate><Year>2020</Year><Month>1</Month><Day>5</Day></ArticleDate></Article></MedlineCitation></PubmedArticle></Set>"""


def put(tmp_path, name, text):
    f = tmp_path / name
    f.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(f)


def test_arxiv(spark, tmp_path):
    rows = n.arxiv(captures.read_arxiv(spark, put(tmp_path, "a.xml", ARXIV))).orderBy("seq").collect()
    a, b = rows
    assert (a.title, a.publication_date, a.doi, a.comments, a.urls, a.authors) == ("A title on ships", dt.date(2020, 2, 27), "10.1/a", "3 pages", ["http://a", "http://b"], ["Ann Lee"])
    assert (a.publication.title, a.publication.category, a.publication.subject_areas, a.databases, a.source) == ("Journal of Boats", "Journal", ["Databases"], ["arXiv"], "arXiv")
    assert (b.publication, b.authors, b.seq.position) == (None, ["Bo", "Cy"], 2)


def test_pubmed(spark, tmp_path):
    a, b = n.pubmed(captures.read_pubmed(spark, put(tmp_path, "p.xml", PUBMED))).orderBy("seq").collect()
    assert (a.title, a.abstract, a.authors, a.doi, a.publication_date) == ("On ships", "One.\nTwo.", ["Ann Lee", "Crew"], "10.1/p", dt.date(2020, 2, 1))
    assert (a.keywords, a.pages, a.number_of_pages, a.publication.issn, a.publication.category) == (["boats", "sails"], "10-14", 5, "1-2", "Journal")
    assert (b.title, b.publication_date, b.doi) == ("Exact day", dt.date(2020, 1, 5), None)


def test_pubmed_markup_is_plain_text(spark, tmp_path):
    """Text nodes in the order of the document: inline tags, comments, instructions, CDATA and references."""
    title = "A <i>Bold</i> case of H<sub>2</sub>O &amp;lt; &#38;lt; <!-- no > yes --><![CDATA[p < 0.05 & <b>]]><?x y>z?>"
    record = PUBMED.replace("On ships", title).replace("<AbstractText>One.", '<AbstractText Label="A > B">See <![CDATA[x]]>\r\n<b a=\'>\'>One</b>.').replace('N">boats', 'N">granular <i>c</i>')
    record = record.replace("</Abstract>", "</Abstract><OtherAbstract><AbstractText>not this</AbstractText></OtherAbstract>", 1)
    a, _ = n.pubmed(captures.read_pubmed(spark, put(tmp_path, "p.xml", record))).orderBy("seq").collect()
    assert a.title == "A Bold case of H2O &lt; &lt; p < 0.05 & <b>"
    assert a.abstract == "See x\nOne.\nTwo." and a.keywords == ["granular c", "sails"]
    got = spark.createDataFrame([("a<x/>b<x>1</x><x y='<>'>2</x ><xy>3</xy>",)], "t string").select(captures.inside(captures.markup(F.col("t")), "x").alias("x")).first().x
    assert got == ["1", "2"]


def test_pubmed_records_of_a_split_file_keep_their_order(spark, tmp_path):
    one = PUBMED[PUBMED.index("<PubmedArticle>") : PUBMED.index("</PubmedArticle>") + 16]
    path = put(tmp_path, "many.xml", "<Set>" + "".join(one.replace("On ships", f"Ship {i}") for i in range(300)) + "</Set>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = n.pubmed(captures.read_pubmed(spark, path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.title for r in rows] == [f"Ship {i}" for i in range(300)]


def test_ieee(spark, tmp_path):
    full = {"title": "T", "publication_date": "1-3 Mar 2020", "publication_year": 2020, "doi": "10.1/i", "citing_paper_count": 7, "abstract": "x", "publication_title": "Conf", "isbn": "9", "publisher": "P", "content_type": "Conferences", "pdf_url": "http://pdf", "index_terms": {"author_terms": {"terms": ["b", "a"]}}, "authors": {"authors": [{"full_name": "A B"}]}, "start_page": "7", "end_page": "3"}
    path = put(tmp_path, "i.json", {"total_records": 2, "articles": [full, {"title": "Bare", "publication_date": "Spring", "publication_year": 2018}]})
    a, b = n.ieee(captures.read_ieee(spark, path)).orderBy("seq").collect()
    assert (a.publication_date, a.citations, a.keywords, a.number_of_pages, a.pages, a.publication.category) == (dt.date(2020, 3, 1), 7, ["a", "b"], 5, "7-3", "Conference Proceedings")
    assert (b.publication_date, b.authors, b.urls, b.publication, b.pages) == (dt.date(2018, 1, 1), [], [], None, None)


def test_scopus(spark, tmp_path):
    entries = [
        {"dc:title": "T", "dc:creator": "X", "prism:publicationName": "A Book", "prism:coverDate": "2020-05-06", "prism:doi": "10.1/s", "citedby-count": "4", "prism:aggregationType": "Book", "prism:url": "d1", "prism:isbn": [{"$": "978"}, {"$": "979"}], "prism:issn": "1234", "prism:pageRange": "1-2", "link": [{"@ref": "scopus", "@href": "http://s"}]},
        {"dc:title": "U", "prism:coverDate": "2020-05-07", "prism:url": "d2", "citedby-count": "many"},
    ]
    raw = captures.read_scopus(spark, put(tmp_path, "s.json", {"search-results": {"opensearch:totalResults": "2", "entry": entries}}))
    (tmp_path / "details").mkdir()
    put(tmp_path / "details", "d1.xml", "<a><ce:para>Full <i>abstract</i> &amp; more</ce:para><ce:indexed-name>Lee A.</ce:indexed-name><ce:indexed-name>Lee A.</ce:indexed-name><author-keyword>k</author-keyword><prism:startingPage>10</prism:startingPage><prism:endingPage>14</prism:endingPage></a>")
    a, b = n.scopus(raw, captures.read_scopus_details(spark, str(tmp_path / "details"))).orderBy("seq").collect()
    assert (a.abstract, a.authors, a.keywords, a.number_of_pages, a.pages, a.publication.isbn, a.publication.issn, a.urls) == ("Full abstract & more", ["Lee A."], ["k"], 5, "1-2", "978", "1234", ["http://s"])
    assert (b.citations, b.publication, b.authors) == (None, None, [])
    assert n.scopus(raw).count() == 2


def test_details_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    one = '<?xml version="1.0"?><a><prism:url>d{0}</prism:url>\n<ce:para>Text <?x y?>{0}</ce:para></a>'
    put(tmp_path, "many.xml", "\n".join(one.format(i) for i in range(300)) + "\n")
    (tmp_path / "alone").mkdir()
    put(tmp_path / "alone", "d7.xml", "<a><ce:para>No declaration,\nno address</ce:para></a>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = captures.read_scopus_details(spark, str(tmp_path / "many.xml"))
        assert read.rdd.getNumPartitions() > 5  # a whole file was one row
        assert sorted((r.url, *r.abstracts) for r in read.collect()) == sorted((f"d{i}", f"Text {i}") for i in range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.url, *r.abstracts) for r in captures.read_scopus_details(spark, str(tmp_path / "alone")).collect()] == [("d7", "No declaration,\nno address")]


def test_rxiv(spark, tmp_path):
    path = put(tmp_path, "r.json", {"collection": [{"title": "T", "abstract": "x", "authors": "Lee, A.; Bo, C.;", "date": "2020-01-02", "doi": "10.1101/1", "published": "10.1\\/pub"}, {"title": "U", "authors": "", "date": "2020-01-03", "doi": "10.1101/2", "published": "NA"}]})
    a, b = n.rxiv(captures.read_rxiv(spark, path), "bioRxiv").orderBy("seq").collect()
    assert (a.authors, a.doi, a.urls, a.publication, a.databases) == (["Lee, A.", "Bo, C."], "10.1/pub", ["https://doi.org/10.1/pub"], None, ["bioRxiv"])
    assert (b.doi, b.authors) == ("10.1101/2", [])
    html = '<h1 id="page-title">\n 1,234 Results</h1><span class="highwire-cite-metadata-doi highwire-cite-metadata"><span>doi:</span> https://doi.org/10.1101/9 </span></span><a href="/next?page=1" class="link-icon link-icon-after">Next</a>'
    got = spark.createDataFrame([(html,), ("<p>",)], "h string").select(captures.rxiv_total(F.col("h")), captures.rxiv_dois(F.col("h")), captures.rxiv_next(F.col("h"))).collect()
    assert [tuple(x) for x in got] == [(1234, ["10.1101/9"], "/next?page=1"), (0, [], None)]


def test_serial_metrics(spark, tmp_path):
    entry = {"dc:publisher": "P", "prism:issn": "1-2", "prism:aggregationType": "Journal", "subject-area": [{"$": "B"}, {"$": " A "}], "SNIPList": {"SNIP": [{"@year": "2020", "$": "1.5"}]}, "citeScoreYearInfoList": {"citeScoreCurrentMetric": "2.5"}}
    m = n.serial_metrics(captures.read_serials(spark, put(tmp_path, "m.json", {"serial-metadata-response": {"entry": [entry]}}))).first()
    assert (m.issn, m.category, m.subject_areas, m.cite_score, m.sjr, m.snip) == ("1-2", "Journal", ["A", "B"], 2.5, None, 1.5)


def answer(url):
    if "bad" in url:
        raise OSError("down")
    return 200, f"body of {url}"


def test_live_pages(spark):
    spark.dataSource.register(live.HttpPages)
    urls = ["http://a/1", "http://b/bad", "http://a/2"]
    got = spark.read.format("quillmine_http").option("urls", "\n".join(urls)).option("delay", "0").option("pause", "0").option("fetch", "tests.test_sources.answer").load()
    assert {r.url: (r.status, r.attempts) for r in got.collect()} == {"http://a/1": (200, 1), "http://a/2": (200, 1), "http://b/bad": (None, 2)}


def test_search_over_captures(spark, tmp_path):
    paths = {"arXiv": put(tmp_path, "a.xml", ARXIV), "PubMed": put(tmp_path, "p.xml", PUBMED), "IEEE": str(tmp_path / "missing.json")}
    spec = SearchSpec("[ships]", databases=("arXiv", "PubMed", "IEEE"))
    out = api.search(spark, str(tmp_path / "out"), spec, paths)
    assert sorted(r.title for r in out.collect()) == ["A title on ships", "On ships"]
    saved = captures.read_saved(spark, str(tmp_path / "out"))
    assert [r.title for r in saved.orderBy("seq").collect()] == ["A title on ships", "On ships"]
    assert captures.read_saved_envelope(spark, str(tmp_path / "out")).first().number_of_papers == 2
    api.generate_bibtex(spark, str(tmp_path / "out"), str(tmp_path / "bib"), credit_tool=True)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "bib")).collect())
    assert text.count("@article{") == 2 and "@misc{quillmine," in text
    plan = api.download(spark, str(tmp_path / "out"))
    assert sorted(r.file_name for r in plan.collect()) == ["2020-A_title_on_ships.pdf", "2020-On_ships.pdf"]
    got = api.download(spark, str(tmp_path / "out"), f"file://{tmp_path}/pdf", lambda url: ("application/pdf", b"%PDF") if "10.1/a" in url else None)
    assert sorted(r.status for r in got.collect()) == ["[DOWNLOADED]", "[FAILED]"]
    assert sorted(r.status for r in api.download(spark, str(tmp_path / "out"), f"file://{tmp_path}/pdf", lambda url: None).collect()) == ["[COLLECTED]", "[FAILED]"]


def test_a_source_that_breaks_on_the_way_is_left_out(spark, tmp_path, monkeypatch):
    broken = F.udf(lambda _: 1 // 0, "int")
    monkeypatch.setitem(api.NORMALIZERS, "IEEE", lambda raw: n.arxiv(raw).withColumn("title", broken("title").cast("string")))
    monkeypatch.setitem(api.READERS, "IEEE", captures.read_arxiv)
    paths = {"arXiv": put(tmp_path, "a.xml", ARXIV), "IEEE": put(tmp_path, "i.xml", ARXIV)}
    got = api.load_sources(spark, SearchSpec("[ships]", databases=("IEEE", "arXiv")), paths)
    assert {r.source for r in got.collect()} == {"arXiv"}


def test_saved_searches_in_one_file(spark, tmp_path):
    paths = {"arXiv": put(tmp_path, "a.xml", ARXIV)}
    for query, count in (("[ships]", 1), ("[ships] OR [s]", 2), ("[nothing]", 0)):
        path = str(tmp_path / f"out{count}")
        api.search(spark, path, SearchSpec(query, databases=("arXiv",)), paths, one_file=True)
        text = "\n".join(r.value for r in spark.read.text(path).collect())
        whole = json.loads(text)
        assert whole["number_of_papers"] == len(whole["papers"]) == count == captures.read_saved(spark, path).count()
        assert json.dumps(whole, indent=2, sort_keys=True, ensure_ascii=False) == text or count == 0


def test_a_document_in_parts(spark, tmp_path):
    """Many parts are one document; braces, line feeds and brackets inside of texts cut nothing; a failed job leaves none."""
    from quillmine.schema import conform
    from quillmine.sinks import documents

    odd = "a\n    }\n  ],\n    {"
    papers = conform(spark.range(0, 500, numPartitions=7).select(F.concat(F.lit(odd), F.col("id")).alias("title"), F.array(F.lit("x")).alias("databases"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("publication_date"), F.lit("{}").alias("abstract")))
    spec, path = SearchSpec("[ships]"), str(tmp_path / "doc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few papers would make one part
    try:
        documents.write_search_json(papers, spec, path, dt.datetime(2024, 1, 1))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(tmp_path.glob("doc/part-*"))
    whole = json.loads("".join(f.read_text() for f in files))
    assert len(files) > 1 and whole["number_of_papers"] == len(whole["papers"]) == 500
    assert json.dumps(whole, indent=2, sort_keys=True, ensure_ascii=False) + "\n" == "".join(f.read_text() for f in files)
    assert [r.title for r in captures.read_saved(spark, path).orderBy("seq").collect()] == [x["title"] for x in whole["papers"]]
    e = captures.read_saved_envelope(spark, path).first()
    assert (e.query, e.number_of_papers, e.processed_at) == ("[ships]", 500, "2024-01-01 00:00:00")
    with pytest.raises(Exception, match="(?i)exists"):
        documents.write_search_json(papers, spec, path, dt.datetime(2024, 1, 1))  # nothing is overwritten
    fails = F.udf(lambda i: 1 // (400 - i), "int")
    with pytest.raises(Exception):
        spark.range(500).select(fails("id").cast("string").alias("value")).write.text(str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("part-*")) and not (tmp_path / "none" / "_SUCCESS").exists()


def test_downloads_go_on_after_errors(spark, tmp_path):
    plan = spark.createDataFrame([("a", "a.pdf", ["http://bad", "http://good"], ["http://raises"], False), ("b", "b.pdf", ["http://raises"], [], False), ("c", "c.pdf", None, None, False), ("d", "a.pdf", ["http://good"], [], True)], "paper_key string, file_name string, urls array<string>, pdf_urls array<string>, collision boolean")

    def get(url):
        if "raises" in url:
            raise OSError("refused")
        return ("application/pdf", b"%PDF") if "good" in url else ("text/html", b"")

    from quillmine.sinks import documents

    folder = f"file://{tmp_path}/pdf"
    got = {r.paper_key: (r.status, r.url, r.error) for r in documents.fetch(plan, folder, get).collect()}
    assert got == {"a": ("[DOWNLOADED]", "http://good", None), "b": ("[FAILED]", "http://raises", "OSError: refused"), "c": ("[FAILED]", None, None), "d": ("[COLLECTED]", None, None)}
    documents.fetch(plan, folder, get)
    assert sorted(p.name for p in (tmp_path / "pdf").iterdir() if not p.name.startswith(".")) == ["a.pdf", "download.log"]
    assert spark.read.json(f"{folder}/download.log").count() == 8


def test_numeric_references(spark):
    rows = [("a&#233;b &#x1F389;<i>c</i> &amp;lt; &#65;",), ("&#9999999;x",), ("plain",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(captures.plain_text(F.col("x"))).collect()]
    assert got[0] == "aéb 🎉c &lt; A" and got[2:] == ["plain", None]


def test_reference_lists(spark, tmp_path):
    a = put(tmp_path, "list.csv", "name,url\nBad Journal,\nPress,https://www.press.example\nPress,https://www.press.example\n")
    b = put(tmp_path, "list.json", '{"name": "Bad Journal"}\n{"name": "Press", "url": "https://www.press.example"}\n')
    want = {("Bad Journal", None), ("Press", "https://www.press.example")}
    assert {tuple(r) for r in captures.read_listed(spark, a).collect()} == {tuple(r) for r in captures.read_listed(spark, b).collect()} == want


def test_details_are_fetched_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(live, "CHUNK", 3)
    urls = spark.createDataFrame([(f"http://a/{i}",) for i in range(10)] + [("http://a/bad",)], "url string")
    got = live.fetch_all(urls, fetch="tests.test_sources.answer", delay="0", pause="0")
    assert got.rdd.getNumPartitions() == 4
    assert {r.url: r.attempts for r in got.collect() if r.body is None} == {"http://a/bad": 2} and got.count() == 11


FEED = '<feed><opensearch:totalResults xmlns:opensearch="o">401</opensearch:totalResults>{}</feed>'


def paged(url):
    """A made-up arXiv (three pages), PubMed (ids, then records) and Scopus (a cursor)."""
    if "arxiv" in url:
        n = url.split("start=")[1].split("&")[0]
        return 200, FEED.format(f"<entry><title>Ships {n}</title><published>2020-02-27T13:35:26Z</published><summary>ships</summary></entry>")
    if "esearch" in url:
        return 200, "<r><Count>51</Count><IdList><Id>1</Id><Id>3</Id></IdList></r>" if "retstart=0" in url else "<r><Count>51</Count><IdList><Id>3</Id></IdList></r>"
    if "efetch" in url:
        return 200, PUBMED if url.endswith("=1") else "<none/>"
    nxt = [] if "cursor=2" in url else [{"@ref": "next", "@href": "https://api.elsevier.com/x?cursor=2"}]
    return 200, json.dumps({"search-results": {"link": nxt, "entry": [{"dc:title": f"S{len(nxt)}", "prism:coverDate": "2020-05-07"}]}})


def test_captures_of_live_walks(spark, tmp_path):
    spec, options = SearchSpec("[ships]"), {"delay": "0", "pause": "0", "fetch": "tests.test_sources.paged"}
    go = lambda source, token="": live.capture(spark, spec, source, str(tmp_path / source), token, dt.date(2024, 1, 1), **options)
    assert [r.title for r in n.arxiv(captures.read_arxiv(spark, go("arXiv"))).orderBy("seq").collect()] == ["Ships 0", "Ships 200", "Ships 400"]
    assert sorted(r.title for r in n.pubmed(captures.read_pubmed(spark, go("PubMed"))).collect()) == ["Exact day", "On ships"]
    assert [r.title for r in n.scopus(captures.read_scopus(spark, go("Scopus", "t"))).orderBy("seq").collect()] == ["S1", "S0"]
    with pytest.raises(ValueError):
        live.first_urls(spec, "IEEE")
    assert live.NEXT["IEEE"]("http://x?start_record=1", '{"total_records": 201}') == "http://x?start_record=201"
    assert live.NEXT["IEEE"]("http://x?start_record=201", '{"total_records": 201}') is None
    assert live.rxiv_next("https://h/a/b", '<a href="/c?page=1" class="link-icon link-icon-after">') == "https://h/c?page=1"
    assert len(live.first_urls(spec, "bioRxiv", today=dt.date(2024, 1, 1))) == 1


#: Workers and tests share it; one test runs at a time.
ASKED = "/tmp/quillmine-test-asked"


def noted(url):
    """The made-up sources, noting each address in a file; one page gives no answer while a file says so."""
    import os

    with open(ASKED, "a") as f:
        f.write(url + "\n")
    if os.path.exists(ASKED + ".down") and "start=400" in url:
        raise OSError("down")
    if "arxiv" in url:
        k = int(url.split("start=")[1].split("&")[0])
        entry = "".join(f"<entry><title>Ships {k + j}</title><published>2020-02-27T13:35:26Z</published><summary>ships</summary></entry>" for j in range(3))
        return 200, FEED.replace("401", "1900").format(entry)
    if "ieee" in url:
        at = int(url.split("start_record=")[1].split("&")[0])
        assert "apikey=s3cret" in url
        return 200, json.dumps({"total_records": 401, "articles": [{"title": f"I{at}", "abstract": "ships", "publication_year": 2020}]})
    return paged(url)


@pytest.fixture
def asked():
    """The addresses asked so far."""
    import os

    for path in (ASKED, ASKED + ".down"):
        if os.path.exists(path):
            os.unlink(path)
    return lambda: open(ASKED).read().split("\n")[:-1] if os.path.exists(ASKED) else []


WALK = {"delay": "0", "pause": "0", "pages": "2", "fetch": "tests.test_sources.noted", "today": dt.date(2024, 1, 1)}


def test_a_walk_ends_at_the_limit(spark, tmp_path, asked):
    """Ten pages of three papers: a limit of 10 needs four pages, in rounds of two, and gives what the whole walk gives."""
    spec = SearchSpec("[ships]", limit_per_database=10, databases=("arXiv",))
    few = api.capture(spark, spec, "arXiv", str(tmp_path / "few"), **WALK)
    assert len(asked()) == 4
    whole = live.capture(spark, spec, "arXiv", str(tmp_path / "whole"), **WALK)
    assert len(asked()) == 4 + 10
    got = [sorted((r.title, r.seq) for r in api.search(spark, None, spec, {"arXiv": path}).collect()) for path in (few, whole)]
    assert got[0] == got[1] and len(got[0]) == 10


def test_a_broken_walk_goes_on_where_it_broke(spark, tmp_path, asked):
    open(ASKED + ".down", "w").close()
    spec, folder = SearchSpec("[ships]", databases=("arXiv",)), str(tmp_path / "arxiv")
    with pytest.raises(live.WalkBroken):
        live.capture(spark, spec, "arXiv", folder, **WALK)
    starts = lambda: [int(u.split("start=")[1].split("&")[0]) for u in asked()]
    assert starts() == [0, 200, 400, 400]
    assert [r.title for r in n.arxiv(captures.read_arxiv(spark, folder)).orderBy("seq").collect()] == [f"Ships {k + j}" for k in (0, 200) for j in range(3)]
    import os

    os.unlink(ASKED + ".down")
    live.capture(spark, spec, "arXiv", folder, **WALK)
    assert starts()[4:] == list(range(400, 1900, 200))
    live.capture(spark, spec, "arXiv", folder, **WALK)  # nothing is left to ask
    assert len(starts()) == 4 + 8
    assert [r.title for r in n.arxiv(captures.read_arxiv(spark, folder)).orderBy("seq").collect()] == [f"Ships {k + j}" for k in range(0, 1900, 200) for j in range(3)]


def test_tokens_are_not_written(spark, tmp_path, asked):
    folder = live.capture(spark, SearchSpec("[ships]", databases=("IEEE",)), "IEEE", str(tmp_path / "ieee"), "s3cret", **WALK)
    assert [r.title for r in n.ieee(captures.read_ieee(spark, folder)).orderBy("seq").collect()] == ["I1", "I201", "I401"]
    for r in spark.read.parquet(f"{folder}/_walk/pages-000-000000").collect():
        assert "s3cret" not in str(r) and live.TOKEN in r.url


def test_broken_records_are_kept_apart(spark, tmp_path):
    broken = PUBMED.replace("</Article></MedlineCitation></PubmedArticle></Set>", "</Artcle></MedlineCitation></PubmedArticle></Set>")
    (tmp_path / "ieee").mkdir()
    put(tmp_path / "ieee", "a.json", {"total_records": 1, "articles": [{"title": "Ships", "abstract": "ships", "publication_year": 2020}]})
    put(tmp_path / "ieee", "b.json", '{"articles": [{"title": "Cut off')
    paths = {"PubMed": put(tmp_path, "p.xml", broken), "IEEE": str(tmp_path / "ieee")}
    spec = SearchSpec("[ships]", databases=("PubMed", "IEEE"))
    out = api.search(spark, None, spec, paths, dead_letters=str(tmp_path / "dead"))
    assert sorted(r.title for r in out.collect()) == ["On ships", "Ships"]
    dead = {r.source: (r.file.rpartition("/")[2], r.record) for r in spark.read.parquet(str(tmp_path / "dead")).collect()}
    assert dead["PubMed"][0] == "p.xml" and "<PMID>3</PMID>" in dead["PubMed"][1] and dead["IEEE"][0] == "b.json" and len(dead) == 2
