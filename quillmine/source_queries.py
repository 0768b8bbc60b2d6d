"""Queries end to end: captured responses made of the tables, written as files, and read as a source's are; saved
searches, downloads, live addresses and streams. Each has its DuckDB equivalent over the same tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import api
from .operators import consolidate as c
from .operators import enrich, fuzzy, normalize
from .operators.token_index import TokenIndex
from .plans import dialects
from .plans import query as language
from .queries import _MERGE, PAPERS, _flat, _has, flagship, papers, table
from .schema import from_records, to_records
from .scratch import Scratch
from .sinks import documents
from .sources import captures, live, lookups
from .spec import SearchSpec
from .streaming.incremental import Consolidated, follow

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Entries of one captured result page.
PAGE = 100


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def written(df: DataFrame, label: str, one: bool = False) -> str:
    """Writes a one-column table as text files, with one each row is a file, and returns the folder."""
    path = Scratch(df.sparkSession, label).path("captured")
    (df.write.option("maxRecordsPerFile", 1) if one else df.write).text(path)
    return path


def xml(text: Column) -> Column:
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
        text = F.replace(text, F.lit(char), F.lit(f"&{name};"))
    return text


def tag(name: str, *values) -> Column:
    return F.concat(F.lit(f"<{name}>"), *(v if isinstance(v, Column) else F.lit(v) for v in values), F.lit(f"</{name}>"))


def pages_of(df: DataFrame, entry: Column, whole) -> DataFrame:
    """JSON documents of PAGE entries each; whole makes a document of the entries' array."""
    pages = df.select(F.floor(F.col("seq") / PAGE).alias("page"), "seq", entry.alias("entry")).groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "entry"))), lambda x: x["entry"]).alias("entries"))
    return pages.select(F.to_json(whole(F.col("entries"))).alias("value"))


def xml_pages(df: DataFrame, entry: Column, root: str) -> DataFrame:
    """XML documents of PAGE entries each."""
    pages = df.select(F.floor(F.col("seq") / PAGE).alias("page"), "seq", entry.alias("entry")).groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "entry"))), lambda x: x["entry"]), "\n").alias("entries"))
    return pages.select(F.concat(F.lit(f'<{root} xmlns:arxiv="x">'), "entries", F.lit(f"</{root}>")).alias("value"))


def arxiv_capture(p: DataFrame) -> str:
    code = F.when(F.col("keywords")[0] == "en", "cs.DB").when(F.col("keywords")[0] == "fr", "physics.optics").otherwise("none")
    entry = tag(
        "entry", tag("title", xml(F.col("title"))), tag("published", F.date_format("publication_date", "yyyy-MM-dd"), "T01:02:03Z"), tag("summary", xml(F.col("abstract"))), tag("arxiv:journal_ref", F.col("publication.title"), " journal"),
        tag("arxiv:comment", F.col("seq").cast("string")), F.concat(F.lit('<category term="'), code, F.lit('"/><link href="'), F.col("urls")[0], F.lit('"/>')), tag("author", tag("name", F.col("authors")[0])), tag("author", tag("name", "Second Author")),
    )
    return written(xml_pages(p, entry, "feed"), "arxiv", one=True)


_TITLE = "trim(regexp_replace(title, ' +', ' ', 'g'))"
_SUMMARY = "trim(regexp_replace(replace(trim(abstract, ' ' || chr(9) || chr(10)), chr(10), ''), ' +', ' ', 'g'))"


@query(f"""WITH {PAPERS} SELECT CAST(seq AS VARCHAR) AS comments, {_TITLE} AS title, {_SUMMARY} AS abstract, venue || ' journal' AS venue, 'Journal' AS category, CASE lang WHEN 'en' THEN 'Databases' WHEN 'fr' THEN 'Optics' ELSE '' END AS subjects,
  author || '|Second Author' AS authors, url AS urls, publication_date FROM papers WHERE trim(title) <> ''""")
def q_capture_arxiv(spark, d):
    q = F.col("publication")
    out = normalize.arxiv(captures.read_arxiv(spark, arxiv_capture(papers(spark, d))))
    return out.select("comments", "title", "abstract", q["title"].alias("venue"), q["category"].alias("category"), F.array_join(q["subject_areas"], ",").alias("subjects"), F.array_join("authors", "|").alias("authors"), F.array_join("urls", "|").alias("urls"), "publication_date")


def cdata(text: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def pubmed_capture(p: DataFrame) -> str:
    """Records as the source gives them: inline markup, comments, CDATA and references in titles, abstracts and keywords."""
    q, day, title = F.col("publication"), F.col("publication_date"), F.col("title")
    head, tail = F.substr(title, F.lit(1), F.lit(9)), F.substr(title, F.lit(10))
    marked = F.concat(F.lit("A&#233;<i class='x>y'>&lt;"), xml(head), F.lit("</i><!-- no > yes --><sub/>"), cdata(tail), F.lit(" &#x41;&amp;lt;"))
    part = lambda name, pattern: tag(name, F.date_format(day, pattern))
    abstract = F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(tag("Abstract", F.lit('<AbstractText Label="A > B">'), xml(F.col("abstract")), F.lit("</AbstractText>"), tag("AbstractText", cdata(q["title"]))))
    article = tag(
        "Article", tag("Journal", F.coalesce(tag("ISSN", q["issn"]), F.lit("")), tag("Title", q["title"]), tag("JournalIssue", tag("PubDate", part("Year", "yyyy"), part("Month", "MMM")))), tag("ArticleTitle", marked),
        tag("Pagination", tag("MedlinePgn", F.col("seq").cast("string"), "-", (F.col("seq") + 9).cast("string"))), abstract, tag("AuthorList", tag("Author", tag("LastName", F.col("authors")[0])), tag("Author", tag("LastName", "Author"), tag("ForeName", "Second"))),
    )
    ids = F.concat(F.lit('<ArticleId IdType="pubmed">'), F.col("seq").cast("string"), F.lit("</ArticleId>"), F.coalesce(F.concat(F.lit('<ArticleId IdType="doi">'), F.col("doi"), F.lit("</ArticleId>")), F.lit("")))
    record = tag("PubmedArticle", tag("MedlineCitation", tag("PMID", F.col("seq").cast("string")), article, tag("KeywordList", F.lit('<Keyword MajorTopicYN="N">granular <i>'), F.col("keywords")[0], F.lit("</i></Keyword>"))), tag("PubmedData", tag("ArticleIdList", ids)))
    return written(xml_pages(p, record, "PubmedArticleSet"), "pubmed", one=True)


@query(f"""WITH {PAPERS} SELECT seq || '-' || (seq + 9) AS pages, 'Aé<' || title || ' A&lt;' AS title, trim(replace(replace(abstract, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10)) || chr(10) || venue AS abstract, author || '|Second Author' AS authors, venue, issn, 'Journal' AS category, CAST(date_trunc('month', publication_date) AS DATE) AS publication_date, doi, 10 AS number_of_pages, 'granular ' || lang AS keywords
FROM papers WHERE seq % 3 <> 0""")
def q_capture_pubmed(spark, d):
    """A third of the records has no abstract; these are dropped."""
    q = F.col("publication")
    out = normalize.pubmed(captures.read_pubmed(spark, pubmed_capture(papers(spark, d))))
    return out.select("pages", "title", "abstract", F.array_join("authors", "|").alias("authors"), q["title"].alias("venue"), q["issn"].alias("issn"), q["category"].alias("category"), "publication_date", "doi", "number_of_pages", F.array_join("keywords", "|").alias("keywords"))


def ieee_capture(p: DataFrame) -> str:
    q = F.col("publication")
    entry = F.struct(
        "title", "abstract", F.date_format("publication_date", "dd MMM yyyy").alias("publication_date"), F.year("publication_date").alias("publication_year"), "doi", F.col("citations").alias("citing_paper_count"), q["title"].alias("publication_title"), q["issn"].alias("issn"), q["publisher"].alias("publisher"),
        q["category"].alias("content_type"), F.col("urls")[0].alias("pdf_url"), F.struct(F.struct(F.col("keywords").alias("terms")).alias("author_terms")).alias("index_terms"), F.struct(F.transform("authors", lambda a: F.struct(a.alias("full_name"))).alias("authors")).alias("authors"), F.col("seq").cast("string").alias("start_page"), (F.col("seq") + 9).cast("string").alias("end_page"),
    )
    return written(pages_of(p, entry, lambda e: F.struct(F.size(e).alias("total_records"), e.alias("articles"))), "ieee", one=True)


@query(f"""WITH {PAPERS} SELECT seq || '-' || (seq + 9) AS pages, title, abstract, author || '|Second Author' AS authors, venue, category, issn, publisher, publication_date, doi, citations, lang AS keywords, url AS urls, 10 AS number_of_pages FROM papers WHERE title <> ''""")
def q_capture_ieee(spark, d):
    q = F.col("publication")
    out = normalize.ieee(captures.read_ieee(spark, ieee_capture(papers(spark, d))))
    return out.select("pages", "title", "abstract", F.array_join("authors", "|").alias("authors"), q["title"].alias("venue"), q["category"].alias("category"), q["issn"].alias("issn"), q["publisher"].alias("publisher"), "publication_date", "doi", "citations", F.array_join("keywords", "|").alias("keywords"), F.array_join("urls", "|").alias("urls"), "number_of_pages")


def scopus_capture(p: DataFrame) -> tuple[str, str]:
    """Result pages, and a detail record for each entry; markup, named and numeric references in its abstract."""
    q, s = F.col("publication"), F.col("seq").cast("string")
    entry = F.struct(
        F.col("title").alias("dc:title"), F.col("authors")[0].alias("dc:creator"), q["title"].alias("prism:publicationName"), F.date_format("publication_date", "yyyy-MM-dd").alias("prism:coverDate"), F.col("doi").alias("prism:doi"), F.col("citations").cast("string").alias("citedby-count"),
        q["category"].alias("prism:aggregationType"), F.concat(F.lit("https://example.org/abstract/"), s).alias("prism:url"), q["issn"].alias("prism:issn"), q["publisher"].alias("dc:publisher"), F.array(F.struct(F.lit("scopus").alias("@ref"), F.col("urls")[0].alias("@href"))).alias("link"),
    )
    results = written(pages_of(p, entry, lambda e: F.struct(F.struct(F.size(e).cast("string").alias("opensearch:totalResults"), e.alias("entry")).alias("search-results"))), "scopus", one=True)
    record = F.concat(
        F.lit('<?xml version="1.0"?><abstracts-retrieval-response>'), tag("prism:url", F.lit("https://example.org/abstract/"), s), tag("ce:para", "\n Caf&#233; <i>no.</i> ", s, " &lt;&#x41;&gt;", xml(F.col("abstract")), F.lit("<!-- end -->.")), tag("ce:indexed-name", "B"), tag("ce:indexed-name", "A"), tag("ce:indexed-name", "B"),
        tag("author-keyword", "k"), tag("prism:startingPage", s), tag("prism:endingPage", (F.col("seq") + 6).cast("string")), F.lit("</abstracts-retrieval-response>"),
    )
    return results, written(p.select(record.alias("value")), "details")


@query(f"""WITH {PAPERS} SELECT url AS urls, title, 'Café no. ' || seq || ' <A>' || replace(replace(abstract, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || '.' AS abstract, 'B|A' AS authors, venue, category, issn, publisher, publication_date, doi, citations, 'k' AS keywords, 7 AS number_of_pages FROM papers WHERE title <> ''""")
def q_capture_scopus(spark, d):
    q = F.col("publication")
    results, details = scopus_capture(papers(spark, d))
    out = normalize.scopus(captures.read_scopus(spark, results), captures.read_scopus_details(spark, details))
    return out.select(F.array_join("urls", "|").alias("urls"), "title", "abstract", F.array_join("authors", "|").alias("authors"), q["title"].alias("venue"), q["category"].alias("category"), q["issn"].alias("issn"), q["publisher"].alias("publisher"), "publication_date", "doi", "citations", F.array_join("keywords", "|").alias("keywords"), "number_of_pages")


def rxiv_capture(p: DataFrame) -> str:
    entry = F.struct("title", "abstract", F.concat(F.col("authors")[0], F.lit("; Second Author;")).alias("authors"), F.date_format("publication_date", "yyyy-MM-dd").alias("date"), F.concat(F.lit("10.1101/"), "seq").alias("doi"), F.coalesce(F.replace("doi", F.lit("/"), F.lit("\\/")), F.lit("NA")).alias("published"))
    return written(pages_of(p, entry, lambda e: F.struct(e.alias("collection"))), "rxiv", one=True)


_RXIV = "title, abstract, author || '|Second Author' AS authors, publication_date, coalesce(doi, '10.1101/' || seq) AS doi, 'https://doi.org/' || coalesce(doi, '10.1101/' || seq) AS urls FROM papers WHERE title <> ''"


@query(f"WITH {PAPERS} SELECT 'medRxiv' AS source, {_RXIV} AND seq % 6 = 4 UNION ALL SELECT 'bioRxiv', {_RXIV} AND seq % 6 = 5")
def q_capture_rxiv(spark, d):
    """Both preprint servers, each with the documents that are its own, through the sources' dispatch."""
    p = papers(spark, d)
    paths = {s: rxiv_capture(p.filter(F.col("source") == s)) for s in ("medRxiv", "bioRxiv")}
    out = api.load_sources(spark, SearchSpec("[the]", databases=("medRxiv", "bioRxiv")), paths)
    return out.select("source", "title", "abstract", F.array_join("authors", "|").alias("authors"), "publication_date", "doi", F.array_join("urls", "|").alias("urls"))


@query(f"SELECT CAST(floor(doc_id / {PAGE}) AS BIGINT) AS page, 1000 + CAST(floor(doc_id / {PAGE}) AS INT) AS total, string_agg('10.1101/' || doc_id, ',' ORDER BY doc_id) AS dois, CASE WHEN floor(doc_id / {PAGE}) % 2 = 0 THEN '/search?page=' || CAST(floor(doc_id / {PAGE}) AS BIGINT) END AS next FROM documents GROUP BY floor(doc_id / {PAGE})")
def q_rxiv_results(spark, d):
    """Result pages of a preprint server: totals with thousands commas, DOIs in order, the next page's address."""
    found = F.concat(F.lit('<span class="highwire-cite-metadata-doi highwire-cite-metadata"><span>doi:</span> https://doi.org/10.1101/'), "doc_id", F.lit(" </span></span>"))
    page = F.floor(F.col("doc_id") / PAGE)
    html = table(spark, d, "documents").groupBy(page.alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", found.alias("x")))), lambda x: x["x"]), "").alias("body"))
    head = F.concat(F.lit('<h1 id="page-title">\n '), F.regexp_replace((F.col("page") + 1000).cast("string"), r"(\d)(\d{3})$", "$1,$2"), F.lit(" Results</h1>"))
    foot = F.when(F.col("page") % 2 == 0, F.concat(F.lit('<a href="/search?page='), "page", F.lit('" class="link-icon link-icon-after">Next</a>'))).otherwise("")
    path = written(html.select(F.concat(F.lit("<!-- "), "page", F.lit(" -->"), head, "body", foot).alias("value")), "results", one=True)
    out = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", "<!-- ([0-9]+) -->", 1).try_cast("long").alias("page"), captures.rxiv_total(F.col("value")).alias("total"), captures.rxiv_dois(F.col("value")).alias("dois"), captures.rxiv_next(F.col("value")).alias("next"))
    return out.select("page", "total", F.array_join("dois", ",").alias("dois"), "next")


@query(f"""WITH {PAPERS}, o AS (SELECT source, row_number() OVER (ORDER BY list_position(['arXiv', 'PubMed', 'IEEE', 'Scopus', 'medRxiv', 'bioRxiv'], source)) AS k FROM papers WHERE trim(title) <> '' AND source NOT IN ('Scopus', 'bioRxiv') AND (source <> 'PubMed' OR seq % 3 <> 0))
SELECT source, count(*) AS n, min(k) AS first, max(k) AS last FROM o GROUP BY source""")
def q_union_sources(spark, d):
    """Captured sources in the order of arrival; one has no readable files and is left out, one isn't asked for."""
    p = papers(spark, d).filter(F.trim("title") != "")
    of = lambda s: p.filter(F.col("source") == s)
    paths = {"arXiv": arxiv_capture(of("arXiv")), "PubMed": pubmed_capture(of("PubMed")), "IEEE": ieee_capture(of("IEEE")), "Scopus": "file:///nowhere/at/all", "medRxiv": rxiv_capture(of("medRxiv")), "bioRxiv": "file:///nowhere/at/all"}
    out = api.with_long_seq(api.load_sources(spark, SearchSpec("[the]", databases=("bioRxiv", "medRxiv", "Scopus", "IEEE", "PubMed", "arXiv")), paths))
    before = out.groupBy("source").agg(F.count("*").alias("n"), F.min("seq").alias("lo"))
    upto = F.sum("n").over(Window.orderBy("lo"))  # a row for each source
    return before.select("source", "n", (upto - F.col("n") + 1).alias("first"), upto.alias("last"))


@query(f"""WITH {PAPERS}, o AS (SELECT source, seq, trim(title) <> '' OR source = 'PubMed' AS titled, seq % 7 = 3 AS cut FROM papers WHERE source IN ('arXiv', 'PubMed', 'IEEE')),
  p AS (SELECT source, CASE WHEN source = 'IEEE' THEN floor(seq / {PAGE}) ELSE seq END AS record, titled, source = 'PubMed' AND seq % 3 = 0 AS bare, CASE WHEN source = 'IEEE' THEN floor(seq / {PAGE}) % 3 = 1 ELSE cut END AS broken FROM o)
SELECT source, count(*) FILTER (WHERE NOT broken AND titled AND NOT bare) AS good, count(DISTINCT record) FILTER (WHERE broken) AS broken FROM p GROUP BY source""")
def q_dead_letters(spark, d):
    """Captures with broken records (a tag that isn't closed, a JSON document cut off): good ones are read, broken ones kept."""
    p, scratch = papers(spark, d), Scratch(spark, "broken")
    arxiv, pubmed, ieee = (spark.read.text(f(p.filter(F.col("source") == s)), wholetext=True) for s, f in (("arXiv", arxiv_capture), ("PubMed", pubmed_capture), ("IEEE", ieee_capture)))
    cut = lambda df, tag: df.select(F.array_join(F.transform(F.split("value", f"<{tag}>"), lambda x: F.when(F.regexp_extract(x, "^([0-9]+)<", 1).try_cast("long") % 7 == 3, F.regexp_replace(x, f"</{tag}>", f"</{tag}x>")).otherwise(x)), f"<{tag}>").alias("value"))
    page = F.floor(F.regexp_extract("value", '"start_page":"([0-9]+)"', 1).try_cast("long") / PAGE)
    paths = {"arXiv": written(cut(arxiv, "arxiv:comment"), "arxiv", one=True), "PubMed": written(cut(pubmed, "PMID"), "pubmed", one=True), "IEEE": written(ieee.select(F.when(page % 3 == 1, F.substr("value", F.lit(1), F.length("value") - 9)).otherwise(F.col("value")).alias("value")), "ieee", one=True)}
    dead = scratch.path("dead")
    good = api.load_sources(spark, SearchSpec("[the]", databases=tuple(paths)), paths, dead_letters=dead).groupBy("source").agg(F.count("*").alias("good"))
    broken = spark.read.parquet(dead).groupBy("source").agg(F.count("*").alias("broken"))
    return good.join(broken, "source", "full").select("source", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("broken", F.lit(0)).alias("broken"))


@query(f"WITH {PAPERS}, m AS (SELECT paper_key, {_MERGE} FROM keyed GROUP BY paper_key) SELECT title, doi, publication_date, citations, databases, urls, abstract, comments, pages, CAST((SELECT count(*) FROM m) AS INT) AS number_of_papers FROM m")
def q_saved_search(spark, d):
    """A consolidated search saved as one JSON document and read again, with the count that its envelope states."""
    path = Scratch(spark, "saved").path("search")
    spec = SearchSpec("[the]")
    documents.write_search_json(c.merge_papers(c.with_keys(papers(spark, d)), "paper_key"), spec, path, dt.datetime(2024, 1, 1))
    n = captures.read_saved_envelope(spark, path).select("number_of_papers").scalar()
    return captures.read_saved(spark, path).select("title", "doi", "publication_date", "citations", F.array_join("databases", ",").alias("databases"), F.array_join("urls", ",").alias("urls"), "abstract", "comments", "pages", n.alias("number_of_papers"))


@query(f"WITH {PAPERS} SELECT title, abstract, author || '|Second Author' AS authors, venue, issn, publisher, category, publication_date, url AS urls, doi, citations, lang AS keywords, comments, pages, source AS databases FROM papers")
def q_record_dicts(spark, d):
    """Papers as JSON records and back."""
    q = F.col("publication")
    out = from_records(to_records(papers(spark, d)))
    flat = lambda x: F.array_join(x, "|").alias(x)
    return out.select("title", "abstract", flat("authors"), q["title"].alias("venue"), q["issn"].alias("issn"), q["publisher"].alias("publisher"), q["category"].alias("category"), "publication_date", flat("urls"), "doi", "citations", flat("keywords"), "comments", "pages", flat("databases"))


@query(f"""WITH {PAPERS}, one AS (SELECT *, lower(trim(venue)) IN (SELECT DISTINCT lower(trim(venue)) FROM papers WHERE seq < 3) OR coalesce(publisher = 'Press de', false) OR coalesce(doi IS NOT NULL AND CAST(split_part(doi, '/', 2) AS BIGINT) % 7 = 3, false) AS hit FROM keyed)
SELECT seq, bool_or(hit) OVER (PARTITION BY publication_key) AS flagged FROM one""")
def q_flag_hosts(spark, d):
    """Reference lists read from files; a DOI's resolved address counts by its host."""
    p = papers(spark, d)
    names = p.filter("seq < 3").select(F.concat(F.lit(" "), F.upper("publication.title")).alias("name"))
    journals = captures.read_listed(spark, _json_lines(names, "journals"))
    publishers = captures.read_listed(spark, _json_lines(spark.sql("SELECT 'press DE ' AS name, 'http://www.h3.example.org/about' AS url"), "publishers"))
    resolved = p.filter("doi is not null").select("doi", F.concat(F.lit("https://H"), (F.split("doi", "/")[1].cast("long") % 7).cast("string"), F.lit(".example.org/x?y")).alias("final_url"))
    return enrich.flag_predatory(c.with_keys(p), journals, publishers, resolved).select("seq", F.col("publication.is_potentially_predatory").alias("flagged"))


def _json_lines(df: DataFrame, label: str) -> str:
    path = Scratch(df.sparkSession, label).path("list")
    df.write.json(path)
    return path


_PAGE_TAGS = """concat('<meta name="citation_title" content="T', page_id, '"><meta content="Title ', page_id, ' long" name="citation_title"><meta name="citation_author" content="A"><meta name="citation_author" content="B">',
 '<meta name="dc.description" content="About ', page_id, '"><meta name="keywords" content="x; y">',
 CASE page_id % 4 WHEN 0 THEN '<meta name="citation_journal_title" content="bioRxiv">' WHEN 1 THEN '<meta name="citation_journal_title" content="J1">' WHEN 2 THEN '<meta name="citation_conference_title" content="C2">' ELSE '<meta name="citation_book_title" content="B3">' END,
 '<meta name="citation_issn" content="55-', page_id, '"><meta name="citation_isbn" content="978', page_id, '"><meta name="citation_publisher" content="House"><meta name="citation_pdf_url" content="https://pdf/', page_id, '">')"""


@query(f"""WITH {PAPERS}, m AS (SELECT page_id, page_id % 4 <> 0 AS v FROM pages)
SELECT seq, CASE WHEN page_id IS NULL THEN title ELSE 'Title ' || page_id || ' long' END AS title, CASE WHEN page_id IS NULL THEN abstract ELSE 'About ' || page_id END AS abstract, CASE WHEN page_id IS NULL THEN author || '|Second Author' ELSE 'A|B' END AS authors,
  CASE WHEN page_id IS NULL THEN lang ELSE 'x|y' END AS keywords, venue, category, coalesce(issn, CASE WHEN v THEN '55-' || page_id END) AS issn, CASE WHEN v THEN '978' || page_id END AS isbn, coalesce(publisher, CASE WHEN v THEN 'House' END) AS publisher,
  CASE WHEN page_id IS NULL THEN url ELSE url || '|https://pdf/' || page_id END AS urls
FROM papers LEFT JOIN m ON page_id = seq AND papers.doi IS NULL""")
def q_page_enrich(spark, d):
    """All fields that pages give: the longest of repeated tags, venues by kind but preprint servers, PDF addresses."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("https://example.org/"), F.col("page_id")).alias("url"), F.expr(_PAGE_TAGS).alias("html"))
    q, flat = F.col("publication"), lambda x: F.array_join(x, "|").alias(x)
    return enrich.enrich_from_pages(papers(spark, d), pages, "seq").select("seq", "title", "abstract", flat("authors"), flat("keywords"), q["title"].alias("venue"), q["category"].alias("category"), q["issn"].alias("issn"), q["isbn"].alias("isbn"), q["publisher"].alias("publisher"), flat("urls"))


@query("SELECT page_id, 'Title ' || page_id || ' long' AS title, CASE page_id % 4 WHEN 1 THEN 'J1' WHEN 2 THEN 'C2' WHEN 3 THEN 'B3' END AS venue, CASE page_id % 4 WHEN 1 THEN 'Journal' WHEN 2 THEN 'Conference Proceedings' WHEN 3 THEN 'Book' END AS category, 'https://pdf/' || page_id AS pdf_url FROM pages")
def q_page_venues(spark, d):
    """Venues named by pages, read from captured pages in files."""
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), F.expr(_PAGE_TAGS).alias("html"))
    read = enrich.page_metadata(captures.read_pages(spark, _json_lines(pages, "pages")))
    return read.select(F.col("url").cast("long").alias("page_id"), "title", F.col("venue.title").alias("venue"), F.col("venue.category").alias("category"), "pdf_url")


@query(f"WITH {PAPERS} SELECT seq, title FROM keyed WHERE paper_key = (SELECT paper_key FROM keyed WHERE seq = 20)")
def q_lookup(spark, d):
    keyed = c.with_keys(papers(spark, d))
    return c.lookup(keyed, keyed.filter("seq = 20").first()["paper_key"]).select("seq", "title")


@query(f"WITH {PAPERS} SELECT seq, paper_key FROM keyed WHERE paper_key NOT IN (SELECT paper_key FROM keyed WHERE lang = 'de')")
def q_removed(spark, d):
    keyed = c.with_keys(papers(spark, d))
    return c.without(keyed, keyed.filter("keywords[0] = 'de'")).select("seq", "paper_key")


@query(f"WITH {PAPERS} SELECT seq, CASE WHEN source = 'IEEE' THEN 'IEEE' WHEN source < 'IEEE' THEN source || ',IEEE' ELSE 'IEEE,' || source END AS databases, CASE WHEN doi IS NULL THEN url ELSE 'https://doi.org/' || doi || ',' || url END AS urls FROM papers")
def q_tagged(spark, d):
    out = c.with_url(c.tagged(papers(spark, d), "ieee"), F.concat(F.lit("https://doi.org/"), F.col("doi")))
    return out.select("seq", F.array_join("databases", ",").alias("databases"), F.array_join("urls", ",").alias("urls"))


@query(f"""WITH {PAPERS}, k AS (SELECT CASE category WHEN 'Journal' THEN '@article' WHEN 'Book' THEN '@book' ELSE '@inproceedings' END || '{{' ||
  regexp_replace(translate(lower(author), ' ,', '') || year(publication_date) || lower(split_part(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' ', 1)), '[^\\p{{L}}\\p{{N}}_]', '', 'g') || ',' AS head FROM papers)
SELECT head, count(*) AS n FROM (SELECT head FROM k UNION ALL SELECT '@misc{{quillmine,') GROUP BY head""")
def q_bibtex_file(spark, d):
    """Entries of a written file by their heads, the tool's own among them."""
    path = Scratch(spark, "bibtex").path("file")
    documents.write_bibtex(papers(spark, d), path, credit_tool=True)
    heads = spark.read.text(path).filter(F.col("value").rlike(r"^@[a-z]+\{.*,$"))
    return heads.groupBy(F.col("value").alias("head")).agg(F.count("*").alias("n"))


#: Two words of each document's text, and a query made of them in one of eight ways.
_WORDS = "coalesce(nullif(regexp_extract_all(lower(text), '[a-z]{4,}')[1], ''), 'none') AS v, coalesce(nullif(regexp_extract_all(lower(text), '[a-z]{4,}')[2], ''), 'none') AS w"


def asked_of(spark, d) -> DataFrame:
    """doc_id, v, w (two words) and query (one of eight forms) of every document."""
    word = lambda k: F.coalesce(F.get(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0), F.lit(k)), F.lit("none"))
    words = table(spark, d, "documents").select("doc_id", word(0).alias("v"), word(1).alias("w"))
    forms = ["[{v}]", "[{v}] AND [{w}]", "[{v}] OR ([{w}] AND NOT [{v} {w}])", "([{v}*] OR [{w}])", "[{v}] or [{w}]", "([{v}] OR [{w}]", "  [{v}]\n  AND   ([{w}] OR ([{v} {w}]))", "[?{v}]"]
    made = F.element_at(F.array(*(F.lit(f) for f in forms)), (F.col("doc_id") % len(forms) + 1).cast("int"))
    return words.withColumn("query", F.replace(F.replace(made, F.lit("{v}"), F.col("v")), F.lit("{w}"), F.col("w")))


@query(f"""WITH q AS (SELECT doc_id, doc_id % 8 AS k, {_WORDS} FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN '[' || v || ']' WHEN 1 THEN '[' || v || '] AND [' || w || ']' WHEN 2 THEN '[' || v || '] OR ([' || w || '] AND NOT [' || v || ' ' || w || '])' WHEN 3 THEN '([' || v || '*] OR [' || w || '])'
    WHEN 4 THEN '[' || v || '] or [' || w || ']' WHEN 5 THEN '([' || v || '] OR [' || w || ']' WHEN 6 THEN '[' || v || '] AND ([' || w || '] OR ([' || v || ' ' || w || ']))' ELSE '[?' || v || ']' END AS query,
  k IN (0, 1, 2, 3, 6) AS valid, k NOT IN (4, 5) AS valid_free, CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 0 END AS depth,
  upper(CASE k WHEN 0 THEN '[' || v || ']' WHEN 1 THEN '[' || v || '] AND [' || w || ']' WHEN 2 THEN '[' || v || '] OR ([' || w || '] AND NOT [' || v || ' ' || w || '])' WHEN 3 THEN '([' || v || '*] OR [' || w || '])' WHEN 6 THEN '[' || v || '] AND ([' || w || '] OR ([' || v || ' ' || w || ']))' WHEN 7 THEN '[?' || v || ']' END) AS rewritten,
  CASE k WHEN 0 THEN v WHEN 1 THEN v || ',' || w WHEN 2 THEN v || ',' || w || ',' || v || ' ' || w WHEN 3 THEN v || '*,' || w WHEN 6 THEN v || ',' || w || ',' || v || ' ' || w WHEN 7 THEN '?' || v END AS terms,
  CASE k WHEN 0 THEN 'root(' || v || ')' WHEN 1 THEN 'root(' || v || ' AND ' || w || ')' WHEN 2 THEN 'root(' || v || ' OR group(' || w || ' AND NOT ' || v || ' ' || w || '))' WHEN 3 THEN 'root(group(' || v || '* OR ' || w || '))' WHEN 6 THEN 'root(' || v || ' AND group(' || w || ' OR group(' || v || ' ' || w || ')))' WHEN 7 THEN 'root(?' || v || ')' END AS tree
FROM q""")
def q_query_language(spark, d):
    """Queries made of every document's words: cleaning, validation with and without the rules for wildcards, nesting, terms,
    the tree, and rewriting."""

    def shown(node):
        return node["value"] if node["node_type"] in ("term", "connector") else f"{node['node_type']}({' '.join(map(shown, node['children']))})"

    def read(text):
        clean = language.sanitize(text)
        if not language.is_valid(clean, strict=False):
            return clean, False, False, None, None, None, None
        node = language.parse(clean, strict=False)
        return clean, language.is_valid(clean), True, language.depth(node), language.render(language.map_terms(node, str.upper)), ",".join(t.text for t in language.terms(node)), shown(language.tree(node))

    return _by_row(asked_of(spark, d).select("doc_id", "query"), read, "query string, valid boolean, valid_free boolean, depth int, rewritten string, terms string, tree string")


def _by_row(df: DataFrame, make, schema: str) -> DataFrame:
    """doc_id and what make gives for the other columns of each row."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [make(*x) for x in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True))], names=["doc_id", *(n for n, _ in fields)])

    return df.mapInArrow(run, f"doc_id bigint, {schema}")


@query(f"""WITH q AS (SELECT doc_id, {_WORDS} FROM documents)
SELECT doc_id, '(ti:"' || v || '" AND (ti:' || w || '* OR ti:"' || v || ' ' || w || '") ANDNOT ti:"' || w || '") OR (abs:"' || v || '" AND (abs:' || w || '* OR abs:"' || v || ' ' || w || '") ANDNOT abs:"' || w || '")' AS arxiv,
  '"' || v || '"[TIAB] AND ("' || w || '*"[TIAB] OR "' || v || ' ' || w || '"[TIAB]) NOT "' || w || '"[TIAB] AND has abstract [FILT] AND "journal article"[Publication Type] AND 2019/01/02:2020/03/04[Date - Publication]' AS pubmed,
  '"Abstract":"' || v || '" AND ("Abstract":"' || w || '*" OR "Abstract":"' || v || ' ' || w || '") NOT "Abstract":"' || w || '"' AS ieee,
  '=2019&end_year=2020&content_type=Conferences&content_type=Journals&content_type=Books&content_type=Courses&content_type=Early+Access&content_type=Magazines&content_type=Standards' AS ieee_types,
  'TITLE-ABS-KEY({{' || v || '}} AND ("' || w || '*" OR {{' || v || ' ' || w || '}}) AND NOT {{' || w || '}}) AND PUBYEAR > 2018 AND PUBYEAR < 2021 AND SRCTYPE(p OR j OR b OR k OR r OR d)' AS scopus,
  'match-any:' || v || ',' || v || ' ' || w || '; match-all:' || w || ',' || v AS rxiv, 'refused' AS rxiv_wildcard, 'refused' AS rxiv_and_not, 'refused' AS rxiv_depth, 'refused' AS rxiv_mixed, 'submittedDate descending, coverDate, pub+date' AS orders FROM q""")
def q_dialects(spark, d):
    """What each remote source is asked for queries made of every document's words, with its codes of types and its order, and
    what a source refuses."""
    from urllib.parse import parse_qs, urlsplit

    since, until, types = dt.date(2019, 1, 2), dt.date(2020, 3, 4), ["conference proceedings", "journal", "book", "other"]
    query_of = lambda url: parse_qs(urlsplit(url).query)

    def groups(text):
        try:
            return "; ".join(f"{kind}:{','.join(words)}" for kind, words in dialects.rxiv_groups(language.parse(text)))
        except language.QueryError:
            return "refused"

    def made(v, w):
        node, one = language.parse(f"[{v}] AND ([{w}*] OR [{v} {w}]) AND NOT [{w}]"), language.parse(f"[{v}]")
        arxiv = query_of(dialects.arxiv_url(one))
        orders = f"{arxiv['sortBy'][0]} {arxiv['sortOrder'][0]}, {query_of(dialects.scopus_url(one, 't', None, None, None))['sort'][0]}, {dialects.pubmed_url(one, None, None, until).rpartition('sort=')[2]}"
        refused = [groups(f"[{w}*]"), groups(f"[{v}] AND NOT [{w}]"), groups(f"[{v}] OR (([{w}] OR [{v}]) AND [{w}])"), groups(f"[{v}] OR [{w}] AND [{v}]")]
        return (
            dialects.arxiv_query(node), dialects.pubmed_query(node, since, until, until), dialects.ieee_query(node), dialects.ieee_url(one, "t", since, until, types).partition("&start_year")[2],
            dialects.scopus_query(node, since, until, types), groups(f"([{v}] OR [{v} {w}]) OR ([{w}] AND [{v}])"), *refused, orders,
        )

    names = ("arxiv", "pubmed", "ieee", "ieee_types", "scopus", "rxiv", "rxiv_wildcard", "rxiv_and_not", "rxiv_depth", "rxiv_mixed", "orders")
    return _by_row(asked_of(spark, d).select("doc_id", "v", "w"), made, ", ".join(f"{n} string" for n in names))


def offline(url: str) -> tuple[int, str]:
    """Stands for a network: hosts of .net never answer."""
    if ".example.net" in url:
        raise OSError("no answer")
    return 200, f"body of {url}"


@query("SELECT page_id, CASE WHEN contains(url, '.example.net') THEN NULL ELSE 200 END AS status, CASE WHEN contains(url, '.example.net') THEN NULL ELSE length('body of ' || url) END AS size, CASE WHEN contains(url, '.example.net') THEN 2 ELSE 1 END AS attempts FROM pages")
def q_fetch_addresses(spark, d):
    """Every page's address asked through the live source's fetcher: retries, and faults that end one address only."""
    pages = table(spark, d, "pages").select("page_id", "url")
    got = live.fetch_all(pages.select("url").distinct(), fetch="quillmine.source_queries.offline", delay="0", pause="0")
    return pages.join(got, "url").select("page_id", "status", F.length("body").cast("long").alias("size"), "attempts")


def offline_once(url: str) -> tuple[int, str]:
    """Stands for a network that has changed since: it answers what was not asked before, and nothing else."""
    status, body = offline(url)
    return status, f"later {body}"


@query("""SELECT page_id, CASE WHEN contains(url, '.example.net') THEN NULL WHEN first THEN 'body of ' || url ELSE 'later body of ' || url END AS body
FROM (SELECT page_id, url, bool_or(page_id % 2 = 0) OVER (PARTITION BY url) AS first FROM pages)""")
def q_lookup_join(spark, d):
    """Addresses looked up through a cache: every second page's first, then all; what the cache has isn't asked again, and
    hosts that don't answer leave nothing in it."""
    pages, cache = table(spark, d, "pages").select("page_id", "url"), Scratch(spark, "lookups").path("cache")
    ask = {"delay": 0.0, "pause": "0"}
    lookups.looked_up(pages.filter("page_id % 2 = 0"), cache, round_size=50, fetch="quillmine.source_queries.offline", **ask)
    got = lookups.looked_up(pages, cache, fetch="quillmine.source_queries.offline_once", **ask)
    return pages.join(got, "url", "left").select("page_id", "body")


def offline_pdf(url: str) -> tuple[str, bytes] | None:
    if url.endswith("1"):
        raise OSError("no answer")
    return ("application/pdf", b"%PDF") if "doi.org" in url else ("text/html", b"")


@query(f"""WITH {PAPERS}, m AS (SELECT paper_key, min(seq) AS seq, any_value(doi) AS doi, arg_min(title, seq) AS title, arg_min(publication_date, seq) AS day FROM keyed GROUP BY paper_key),
  w AS (SELECT *, regexp_replace(year(day) || '-' || title, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') || '.pdf' AS whole FROM m),
  o AS (SELECT *, CASE WHEN strlen(whole) <= 200 THEN whole ELSE substring(whole, 1, 32) || '-' || sha256(whole) || '.pdf' END AS file_name FROM w),
  f AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY seq) > 1 AS collision FROM o)
SELECT paper_key, file_name, CASE WHEN collision THEN '[COLLECTED]' WHEN doi IS NOT NULL AND doi NOT LIKE '%1' THEN '[DOWNLOADED]' ELSE '[FAILED]' END AS status FROM f""")
def q_download(spark, d):
    """A download over all papers, under their own names: some addresses raise, most have no PDF, names collide."""
    named = c.merge_papers(c.with_keys(papers(spark, d)), "paper_key")
    folder = Scratch(spark, "pdf").path("files")
    return documents.fetch(documents.download_plan(named), folder, offline_pdf).select("paper_key", "file_name", "status")


@query(f"WITH {PAPERS}, hit AS (SELECT * FROM keyed WHERE title <> '' AND {_has('abstract', 'the')} AND source IN ('PubMed', 'IEEE')) SELECT paper_key, min(seq) AS seq, arg_min(title, seq) AS title, max(citations) AS citations, string_agg(DISTINCT source, ',' ORDER BY source) AS databases, count(*) AS n FROM hit GROUP BY paper_key")
def q_incremental(spark, d):
    """A stream of papers that land in four files, merged batch by batch into a table."""
    p, scratch = papers(spark, d), Scratch(spark, "stream")
    landing = scratch.path("landing")
    p.filter("source IN ('PubMed', 'IEEE')").repartitionByRange(4, F.xxhash64("seq")).write.parquet(landing)
    stream = spark.readStream.schema(spark.read.parquet(landing).schema).option("maxFilesPerTrigger", 1).parquet(landing)
    merged = Consolidated(spark, scratch.path("table"), fan=2)
    follow(stream.withColumn("urls", F.array(F.col("seq").cast("string"))), SearchSpec("[the]", databases=("PubMed", "IEEE")), merged, scratch.path("checkpoint")).awaitTermination()
    return merged.read().select("paper_key", "seq", "title", "citations", F.array_join("databases", ",").alias("databases"), F.size("urls").cast("long").alias("n"))


def _leaders(rows: str, threshold: float) -> str:
    """CTEs up to led(id, leader) over a table or CTE `rows` of (id, year, doi, title): papers are gone through in order of
    arrival, one a step. A leader takes later papers of its year that are alike or have its DOI, if DOIs don't differ; the
    first DOI that it takes becomes its own."""
    alike = f"levenshtein(a.t, b.t) <= CAST(floor(greatest(length(a.t), length(b.t)) * (1.0::DOUBLE - {threshold}::DOUBLE)) AS INT)"
    return f"""n AS MATERIALIZED (SELECT id, year AS y, doi, lower(title) AS t, row_number() OVER (ORDER BY id) AS i FROM {rows}),
  near AS (SELECT a.i, list(b.i ORDER BY b.i) AS js FROM n a JOIN n b ON a.y = b.y AND a.i < b.i AND {alike} GROUP BY a.i),
  same AS (SELECT a.i, list(b.i ORDER BY b.i) AS js FROM n a JOIN n b ON a.y = b.y AND a.i < b.i AND a.doi = b.doi GROUP BY a.i),
  ns AS MATERIALIZED (SELECT n.i, n.y, n.doi, coalesce(near.js, []) AS near, coalesce(same.js, []) AS same FROM n LEFT JOIN near USING (i) LEFT JOIN same USING (i)),
  facts AS MATERIALIZED (SELECT list(doi ORDER BY i) AS doi, list(y ORDER BY i) AS y FROM ns),
  step AS (
    SELECT 0::BIGINT AS i, (SELECT list(0::BIGINT) FROM n) AS led
    UNION ALL
    SELECT s.i + 1, CASE WHEN s.led[s.i + 1] <> 0 OR (len(ns.near) = 0 AND len(ns.same) = 0) THEN s.led ELSE list_transform(s.led, lambda l, j:
        CASE WHEN l <> 0 OR j <= s.i + 1 THEN l
          WHEN x.own IS NOT NULL THEN CASE WHEN (list_contains(ns.near, j) AND coalesce(facts.doi[j], x.own) = x.own) OR list_contains(ns.same, j) THEN s.i + 1 ELSE l END
          WHEN x.k IS NULL THEN CASE WHEN list_contains(ns.near, j) THEN s.i + 1 ELSE l END
          WHEN (list_contains(ns.near, j) AND (j <= x.k AND (facts.doi[j] IS NULL OR j = x.k) OR j > x.k AND coalesce(facts.doi[j], facts.doi[x.k]) = facts.doi[x.k])) OR (j > x.k AND facts.doi[j] = facts.doi[x.k] AND facts.y[j] = ns.y) THEN s.i + 1 ELSE l END) END
    FROM step s JOIN ns ON ns.i = s.i + 1, facts, LATERAL (SELECT ns.doi AS own, list_filter(ns.near, lambda j: s.led[j] = 0 AND facts.doi[j] IS NOT NULL)[1] AS k) x
  ),
  led AS (SELECT n.id, m.id AS leader FROM n, (SELECT led FROM step ORDER BY i DESC LIMIT 1) f, n m WHERE m.i = CASE WHEN f.led[n.i] = 0 THEN n.i ELSE f.led[n.i] END)"""


@query(f"WITH RECURSIVE {PAPERS}, {_leaders('(SELECT seq AS id, year(publication_date) AS year, doi, title FROM papers)', 0.9)} SELECT leader, {_MERGE} FROM led JOIN papers ON papers.seq = led.id GROUP BY leader")
def q_fuzzy_merge(spark, d):
    merged = fuzzy.merge_similar(papers(spark, d), 0.9)
    return _flat(merged.withColumn("leader", F.col("seq")), "leader")


def _terms(column: str) -> str:
    return f"({_has(column, 'with')} AND ({_has(column, 'pour')} OR {_has(column, 'the')}) AND NOT {_has(column, 'sch[\\p{L}\\p{N}_]*')})"


def _per_term(columns: tuple[str, ...]) -> str:
    has = lambda w: "(" + " OR ".join(_has(x, w) for x in columns) + ")"
    return f"({has('with')} AND ({has('pour')} OR {has('the')}) AND NOT {has('sch[\\p{L}\\p{N}_]*')})"


@query(f"""WITH RECURSIVE {PAPERS}, hit AS (SELECT * FROM keyed WHERE title <> '' AND publication_date >= date '2000-01-01' AND CASE source WHEN 'PubMed' THEN {_per_term(('title', 'abstract'))} WHEN 'IEEE' THEN {_terms('abstract')} WHEN 'Scopus' THEN {_per_term(('title', 'abstract', 'lang'))} ELSE false END),
  f AS (SELECT source, paper_key, min(seq) AS first FROM hit GROUP BY 1, 2), nn AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first) AS k FROM f),
  cut AS (SELECT source, max(first) AS last, max(k) AS k FROM nn WHERE k <= 2000 GROUP BY 1), few AS (SELECT hit.* FROM hit JOIN cut ON hit.source = cut.source WHERE k < 2000 OR seq <= last),
  g AS (SELECT paper_key, min(seq) AS first FROM few GROUP BY 1 ORDER BY 2 LIMIT 5000), kept AS (SELECT * FROM few WHERE seq <= (SELECT max(first) FROM g) OR (SELECT count(*) FROM g) < 5000),
  m AS MATERIALIZED (SELECT paper_key, min(seq) AS seq, arg_min(title, seq) AS title, arg_min(doi, seq) FILTER (WHERE doi IS NOT NULL) AS doi, arg_min(publication_date, seq) AS day, max(citations) AS citations, list(DISTINCT source) AS databases FROM kept GROUP BY 1),
  {_leaders('(SELECT seq AS id, year(day) AS year, doi, title FROM m)', 0.95)},
  w AS (SELECT leader AS seq, arg_min(title, m.seq) AS title, arg_min(doi, m.seq) FILTER (WHERE doi IS NOT NULL) AS doi, arg_min(day, m.seq) AS publication_date, max(citations) AS citations, array_to_string(list_sort(list_distinct(flatten(list(databases)))), ',') AS databases FROM led JOIN m ON m.seq = led.id GROUP BY leader)
SELECT coalesce('DOI-' || doi, lower(title) || '|' || year(publication_date)) AS paper_key, title, doi, publication_date, citations, databases, seq FROM w""")
def q_search(spark, d):
    """The flagship search."""
    return flagship(spark, d)


@query(ORACLES["q_search"])
def q_search_indexed(spark, d):
    """The flagship search through an index of all papers' tokens."""
    return flagship(spark, d, TokenIndex.build(papers(spark, d), Scratch(spark, "index").path("tokens")))


@query(f"""WITH {PAPERS} SELECT seq, source FROM papers WHERE title <> '' AND CASE source
  WHEN 'PubMed' THEN ({_has('title', 'of the')} OR {_has('abstract', 'of the')} OR {_has('title', 'que la')} OR {_has('abstract', 'que la')} OR {_has('title', 'haer[\\p{L}\\p{N}_]*')} OR {_has('abstract', 'haer[\\p{L}\\p{N}_]*')}) AND NOT ({_has('title', 'd[\\p{L}\\p{N}_]s')} OR {_has('abstract', 'd[\\p{L}\\p{N}_]s')})
  WHEN 'IEEE' THEN ({_has('abstract', 'of the')} OR {_has('abstract', 'que la')} OR {_has('abstract', 'haer[\\p{L}\\p{N}_]*')}) AND NOT {_has('abstract', 'd[\\p{L}\\p{N}_]s')} ELSE false END""")
def q_token_index(spark, d):
    """Phrases and wildcards by the index: the papers that it leaves are those that the predicates match."""
    p, spec = papers(spark, d), SearchSpec("([of the] OR [que la] OR [haer*]) AND NOT [d?s]", databases=("PubMed", "IEEE"))
    index = TokenIndex.build(p, Scratch(spark, "index").path("tokens"), buckets=16)
    return api.select(index.narrow(p, spec.tree), spec).select("seq", "source")


@query(f"""WITH RECURSIVE {PAPERS}, hit AS (SELECT * FROM keyed WHERE title <> '' AND ({_has('abstract', 'the')} OR {_has('abstract', 'de')}) AND source IN ('IEEE')),
  m AS MATERIALIZED (SELECT paper_key, min(seq) AS seq, arg_min(title, seq) AS title, arg_min(doi, seq) FILTER (WHERE doi IS NOT NULL) AS doi, arg_min(publication_date, seq) AS day, max(citations) AS citations FROM hit GROUP BY 1),
  {_leaders('(SELECT seq AS id, year(day) AS year, doi, title FROM m)', 0.9)}
SELECT leader AS seq, arg_min(title, m.seq) AS title, max(citations) AS citations, count(*) AS n FROM led JOIN m ON m.seq = led.id GROUP BY leader""")
def q_search_without_limits(spark, d):
    """A search in one source without limits, so that the merge of similar titles meets all that the query finds."""
    spec = SearchSpec("[the] OR [de]", databases=("IEEE",))
    found = c.merge_papers(c.merge_publications(c.with_keys(api.select(papers(spark, d), spec))), "paper_key")
    return fuzzy.merge_similar(found, 0.9).select("seq", "title", "citations", F.col("n_merged").alias("n"))
