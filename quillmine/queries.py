"""Queries over the driver's tables, each with its DuckDB equivalent.

The tables hold no bibliography, so papers() reads documents as papers by fixed formulas; PAPERS is the same in SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import records as r
from .operators import consolidate as c
from .operators import enrich, fuzzy, normalize, reports
from .operators.token_index import TokenIndex
from .plans.predicates import for_source, per_term, whole_query
from .plans.query import parse
from .schema import SOURCES
from .spec import SearchSpec

PDF_HOSTS = (
    "dl.acm.org/doi/10.1/", "ieeexplore.ieee.org/document/", "www.sciencedirect.com/science/", "pubs.rsc.org/articlelanding/", "www.tandfonline.com/full/", "pubs.acs.org/doi/", "link.springer.com/article/10%2F",
    "www.isca-speech.org/abstracts/x.html?", "onlinelibrary.wiley.com/abs/", "www.mdpi.com/", "www.pnas.org/content/", "www.jneurosci.org/content/", "www.ijcai.org/p/", "asmp-eurasipjournals.springeropen.com/articles/", "other.example.org/",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as canonical papers with source and seq."""
    d = F.col("doc_id")
    source = F.element_at(F.array(*(F.lit(s) for s in SOURCES)), (d % 6 + 1).cast("int"))
    title = F.regexp_extract("text", r"^([^.\n]*)", 1)
    return table(spark, sf_dir, "documents").select(
        title.alias("title"), F.col("text").alias("abstract"), F.array(F.concat(F.col("lang"), F.lit(" "), F.col("source")), F.lit("Second Author")).alias("authors"),
        normalize.publication(title=F.col("source"), issn=F.when(d % 4 == 0, F.concat(F.lit("12-"), d % 9)), publisher=F.when(d % 3 == 0, F.concat(F.lit("Press "), F.col("lang"))), category=F.element_at(F.array(*(F.lit(x) for x in ("Journal", "Conference Proceedings", "Book"))), (d % 3 + 1).cast("int")), subject_areas=F.array("lang")).alias("publication"),
        F.date_add(F.lit("2000-01-01").cast("date"), (d % 8000).cast("int")).alias("publication_date"), F.array(F.concat(F.lit("https://example.org/"), d)).alias("urls"), F.when(d % 10 == 0, F.concat(F.lit("10.1000/"), F.floor(d / 50))).alias("doi"),
        F.col("n_chars").cast("int").alias("citations"), F.array("lang").alias("keywords"), F.when(d % 7 == 0, F.concat(F.lit("note "), d)).alias("comments"), F.lit(None).cast("int").alias("number_of_pages"), F.when(d % 5 == 0, F.concat(d, F.lit("-"), d + 9)).alias("pages"),
        F.array(source).alias("databases"), source.alias("source"), d.alias("seq"),
    )


_SOURCE = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "][doc_id % 6 + 1]"
PAPERS = f"""papers AS (
  SELECT doc_id AS seq, regexp_extract(text, '^([^.\\n]*)', 1) AS title, text AS abstract, lang || ' ' || source AS author, source AS venue,
    CASE WHEN doc_id % 4 = 0 THEN '12-' || (doc_id % 9) END AS issn, CASE WHEN doc_id % 3 = 0 THEN 'Press ' || lang END AS publisher,
    ['Journal', 'Conference Proceedings', 'Book'][doc_id % 3 + 1] AS category, lang, date '2000-01-01' + CAST(doc_id % 8000 AS INT) AS publication_date,
    'https://example.org/' || doc_id AS url, CASE WHEN doc_id % 10 = 0 THEN '10.1000/' || CAST(floor(doc_id / 50) AS BIGINT) END AS doi, CAST(n_chars AS INT) AS citations,
    CASE WHEN doc_id % 7 = 0 THEN 'note ' || doc_id END AS comments, CASE WHEN doc_id % 5 = 0 THEN doc_id || '-' || (doc_id + 9) END AS pages, {_SOURCE} AS source
  FROM documents
), keyed AS (
  SELECT *, coalesce('DOI-' || doi, lower(title) || '|' || year(publication_date)) AS paper_key, coalesce('ISSN-' || lower(issn), 'TITLE-' || lower(venue)) AS publication_key FROM papers
)"""


def _has(column: str, word: str) -> str:
    """SQL for a term; word is written as a regular expression already."""
    return f"regexp_matches(lower({column}), '(^|[^\\p{{L}}\\p{{N}}_]){word}([^\\p{{L}}\\p{{N}}_]|$)')"


W = "[\\p{L}\\p{N}_]"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


BOOLEAN = "[with] AND ([pour] OR [the]) AND NOT [sch*]"


@query(f"WITH {PAPERS} SELECT seq, publication_date FROM papers WHERE {_has('abstract', 'with')} AND ({_has('abstract', 'pour')} OR {_has('abstract', 'the')}) AND NOT {_has('abstract', f'sch{W}*')}")
def q_bool_and_or_not(spark, d):
    return papers(spark, d).filter(per_term(parse(BOOLEAN), [F.col("abstract")])).select("seq", "publication_date")


@query(f"WITH {PAPERS} SELECT seq FROM papers WHERE {_has('abstract', 'pour')} OR ({_has('abstract', 'the')} AND {_has('abstract', 'rest')})")
def q_precedence(spark, d):
    return papers(spark, d).filter(per_term(parse("[pour] OR [the] AND [rest]"), [F.col("abstract")])).select("seq")


@query(f"WITH {PAPERS} SELECT seq FROM papers WHERE {_has('abstract', f'th{W}')}")
def q_wildcard_question(spark, d):
    return papers(spark, d).filter(per_term(parse("[th?]"), [F.col("abstract")])).select("seq")


@query(f"WITH {PAPERS} SELECT seq FROM papers WHERE {_has('abstract', f'haer{W}*')}")
def q_wildcard_star(spark, d):
    return papers(spark, d).filter(per_term(parse("[haer*]"), [F.col("abstract")])).select("seq")


def _scoped(spark, d, source, text):
    return papers(spark, d).filter(for_source(source, parse(text), F.col("title"), F.col("abstract"), F.array_join("keywords", " "))).select("seq", F.lit(source).alias("scope"))


@query(f"WITH {PAPERS} SELECT seq, 'arXiv' AS scope FROM papers WHERE ({_has('title', 'the')} AND NOT {_has('title', 'and')}) OR ({_has('abstract', 'the')} AND NOT {_has('abstract', 'and')})")
def q_scope_whole_query(spark, d):
    return papers(spark, d).filter(whole_query(parse("[the] AND NOT [and]"), [F.col("title"), F.col("abstract")])).select("seq", F.lit("arXiv").alias("scope"))


@query(f"WITH {PAPERS} SELECT seq, 'PubMed' AS scope FROM papers WHERE ({_has('title', 'the')} OR {_has('abstract', 'the')}) AND NOT ({_has('title', 'and')} OR {_has('abstract', 'and')})")
def q_scope_per_term(spark, d):
    return _scoped(spark, d, "PubMed", "[the] AND NOT [and]")


@query(f"WITH {PAPERS} SELECT seq, 'IEEE' AS scope FROM papers WHERE {_has('abstract', 'the')} AND NOT {_has('abstract', 'and')}")
def q_scope_abstract(spark, d):
    return _scoped(spark, d, "IEEE", "[the] AND NOT [and]")


@query(f"WITH {PAPERS} SELECT seq, 'Scopus' AS scope FROM papers WHERE {_has('title', 'de')} OR {_has('abstract', 'de')} OR {_has('lang', 'de')}")
def q_scope_tiabkey(spark, d):
    return _scoped(spark, d, "Scopus", "[de]")


@query(f"""WITH {PAPERS}, t AS (SELECT seq, concat_ws(' ', title, abstract) AS x FROM papers)
SELECT seq, 'medRxiv' AS scope FROM t WHERE ({_has('x', 'the')} AND {_has('x', 'rest')}) OR ({_has('x', 'pour')} OR {_has('x', 'und')})""")
def q_scope_any_or_all(spark, d):
    return _scoped(spark, d, "medRxiv", "([the] AND [rest]) OR ([pour] OR [und])")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1996-03-02'")
def q_date_range(spark, d):
    return table(spark, d, "orders").filter(c.in_dates(F.col("o_orderdate").cast("date"), dt.date(1995, 3, 1), dt.date(1996, 3, 1))).select("o_orderkey", "o_orderdate")


@query(f"WITH {PAPERS} SELECT seq, publication_date FROM papers WHERE publication_date BETWEEN date '2000-01-01' AND date '2000-12-31'")
def q_year_range(spark, d):
    return papers(spark, d).filter(c.in_dates(F.col("publication_date"), dt.date(2000, 1, 1), dt.date(2000, 12, 31))).select("seq", "publication_date")


@query(f"WITH {PAPERS} SELECT seq, category FROM papers WHERE category IN ('Journal', 'Book')")
def q_type_filter(spark, d):
    return papers(spark, d).filter(c.of_types(F.col("publication"), ("journal", "book"))).select("seq", F.col("publication.category").alias("category"))


@query("SELECT doc_id, CASE WHEN contains(lower(t), 'journal') THEN 'Journal' WHEN contains(lower(t), 'conference') OR contains(lower(t), 'proceeding') THEN 'Conference Proceedings' WHEN contains(lower(t), 'book') THEN 'Book' END AS category FROM (SELECT doc_id, ['Journal of X', 'Proceedings of Y', 'A Book Series', 'journal book', 'magazine'][doc_id % 5 + 1] AS t FROM documents)")
def q_category(spark, d):
    kinds = F.array(*(F.lit(x) for x in ("Journal of X", "Proceedings of Y", "A Book Series", "journal book", "magazine")))
    return table(spark, d, "documents").select("doc_id", r.category(F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int"))).alias("category"))


@query(f"WITH {PAPERS} SELECT seq, paper_key FROM keyed")
def q_paper_key(spark, d):
    return c.with_keys(papers(spark, d)).select("seq", "paper_key")


@query(f"WITH {PAPERS} SELECT seq, publication_key FROM keyed")
def q_publication_key(spark, d):
    return c.with_keys(papers(spark, d)).select("seq", "publication_key")


_MERGE = """min(seq) AS seq, arg_min(title, seq) AS title, arg_min(doi, seq) FILTER (WHERE doi IS NOT NULL) AS doi, arg_min(publication_date, seq) AS publication_date, max(citations) AS citations,
  string_agg(DISTINCT source, ',' ORDER BY source) AS databases, string_agg(DISTINCT url, ',' ORDER BY url) AS urls, arg_max(abstract, (length(abstract), -seq)) AS abstract,
  arg_max(comments, (length(comments), -seq)) FILTER (WHERE comments IS NOT NULL) AS comments, arg_max(pages, (length(pages), -seq)) FILTER (WHERE pages IS NOT NULL) AS pages, count(*) AS n_merged"""


def _flat(merged: DataFrame, key: str) -> DataFrame:
    return merged.select(key, "seq", "title", "doi", "publication_date", "citations", F.array_join("databases", ",").alias("databases"), F.array_join("urls", ",").alias("urls"), "abstract", "comments", "pages", "n_merged")


@query(f"WITH {PAPERS} SELECT paper_key, {_MERGE} FROM keyed GROUP BY paper_key")
def q_exact_dedup(spark, d):
    return _flat(c.merge_papers(c.with_keys(papers(spark, d)), "paper_key"), "paper_key")


@query(f"WITH {PAPERS} SELECT publication_key, {_MERGE} FROM keyed GROUP BY publication_key")
def q_survivorship(spark, d):
    return _flat(c.merge_papers(c.with_keys(papers(spark, d)), "publication_key"), "publication_key")


@query(f"""WITH {PAPERS} SELECT publication_key, arg_max(venue, (length(venue), -seq)) AS title, arg_min(issn, seq) FILTER (WHERE issn IS NOT NULL) AS issn, arg_min(publisher, seq) FILTER (WHERE publisher IS NOT NULL) AS publisher,
  arg_min(category, seq) AS category, string_agg(DISTINCT lang, ',' ORDER BY lang) AS subject_areas FROM keyed GROUP BY publication_key""")
def q_publication_merge(spark, d):
    p = F.col("p")
    merged = c.with_keys(papers(spark, d)).groupBy("publication_key").agg(c.merged_publication(F.col("publication"), F.col("seq")).alias("p"))
    return merged.select("publication_key", p["title"].alias("title"), p["issn"].alias("issn"), p["publisher"].alias("publisher"), p["category"].alias("category"), F.array_join(p["subject_areas"], ",").alias("subject_areas"))


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(DISTINCT lang) AS n FROM documents GROUP BY source")
def q_set_union(spark, d):
    langs = r.union_sorted(F.collect_set(F.array("lang")))
    return table(spark, d, "documents").groupBy("source").agg(langs.alias("langs")).select("source", F.array_join("langs", ",").alias("langs"), F.size("langs").cast("long").alias("n"))


@query(f"WITH {PAPERS}, f AS (SELECT paper_key, min(seq) AS first FROM keyed GROUP BY 1 ORDER BY 2 LIMIT 100) SELECT seq, paper_key FROM keyed WHERE seq <= (SELECT max(first) FROM f) OR (SELECT count(*) FROM f) < 100")
def q_limit_global(spark, d):
    return c.limit_total(c.with_keys(papers(spark, d)), 100).select("seq", "paper_key")


@query(f"""WITH {PAPERS}, f AS (SELECT source, paper_key, min(seq) AS first FROM keyed GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first) AS k FROM f),
  cut AS (SELECT source, max(first) AS last, max(k) AS k FROM n WHERE k <= 10 GROUP BY 1) SELECT seq, keyed.source, paper_key FROM keyed JOIN cut ON keyed.source = cut.source WHERE k < 10 OR seq <= last""")
def q_limit_per_source(spark, d):
    return c.limit_per_source(c.with_keys(papers(spark, d)), 10).select("seq", "source", "paper_key")


@query(f"""WITH {PAPERS}, t AS (SELECT seq, year(publication_date) AS y, lower(title) AS t, doi FROM papers)
SELECT a.seq AS a, b.seq AS b, levenshtein(a.t, b.t) <= CAST(floor(greatest(length(a.t), length(b.t)) * (1.0::DOUBLE - 0.9::DOUBLE)) AS INT) AS titled FROM t a JOIN t b ON a.y = b.y AND a.seq < b.seq
WHERE (a.doi IS NULL OR b.doi IS NULL OR a.doi = b.doi) AND (a.doi = b.doi OR levenshtein(a.t, b.t) <= CAST(floor(greatest(length(a.t), length(b.t)) * (1.0::DOUBLE - 0.9::DOUBLE)) AS INT))""")
def q_fuzzy_pairs(spark, d):
    narrow = papers(spark, d).select(F.col("seq").alias("id"), F.year("publication_date").alias("year"), "doi", "title")
    return fuzzy.title_pairs(narrow, 0.9)


@query(f"""WITH {PAPERS}, j AS (SELECT DISTINCT venue FROM papers WHERE seq % 97 = 0), b AS (SELECT DISTINCT publisher FROM papers WHERE seq % 101 = 0 AND publisher IS NOT NULL),
  one AS (SELECT *, lower(trim(venue)) IN (SELECT lower(trim(venue)) FROM j) OR coalesce(lower(trim(publisher)) IN (SELECT lower(trim(publisher)) FROM b), false) AS hit FROM keyed)
SELECT seq, bool_or(hit) OVER (PARTITION BY publication_key) AS flagged FROM one""")
def q_flag_predatory(spark, d):
    p = papers(spark, d)
    journals = p.filter("seq % 97 = 0").select(F.concat(F.lit(" "), F.upper("publication.title")).alias("name"))
    publishers = p.filter("seq % 101 = 0").select(F.col("publication.publisher").alias("name"), F.lit(None).cast("string").alias("url"))
    return enrich.flag_predatory(c.with_keys(p), journals, publishers).select("seq", F.col("publication.is_potentially_predatory").alias("flagged"))


@query("SELECT page_id, replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), 'www.', '') AS host FROM pages")
def q_host(spark, d):
    return table(spark, d, "pages").select("page_id", r.host(F.col("url")).alias("host"))


_META = "concat('<meta content=\"', regexp_extract(html, '<title>([^<\"]*)', 1), '\" name=\"citation_title\"><meta name=\"keywords\" content=\"a', page_id % 3, ', b;c\"><meta name=\"citation_doi\" content=\"10.5/', page_id, '\">')"


def _tagged(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.expr(_META).alias("html"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<\"]*)', 1)) AS title, '10.5/' || page_id AS doi, 'a' || (page_id % 3) || ',b;c' AS keywords FROM pages WHERE regexp_extract(html, '<title>([^<\"]*)', 1) <> ''")
def q_meta_tags(spark, d):
    pages = _tagged(spark, d).withColumn("url", F.col("page_id").cast("string"))
    return enrich.page_metadata(pages).select(F.col("url").cast("long").alias("page_id"), "title", "doi", F.array_join("keywords", ",").alias("keywords"))


@query(f"""WITH {PAPERS}, m AS (SELECT page_id, trim(regexp_extract(html, '<title>([^<"]*)', 1)) AS title, '10.5/' || page_id AS doi FROM pages WHERE regexp_extract(html, '<title>([^<"]*)', 1) <> '')
SELECT seq, coalesce(m.title, papers.title) AS title, coalesce(m.doi, papers.doi) AS doi FROM papers LEFT JOIN m ON page_id = seq AND papers.doi IS NULL""")
def q_meta_enrich(spark, d):
    pages = _tagged(spark, d).withColumn("url", F.concat(F.lit("https://example.org/"), F.col("page_id")))
    return enrich.enrich_from_pages(papers(spark, d), pages, "seq").select("seq", "title", "doi")


@query(f"""WITH {PAPERS}, m AS (SELECT '12-' || i AS issn, i / 4.0::DOUBLE AS sjr, 'Metrics ' || i AS publisher FROM range(0, 9, 2) t(i))
SELECT seq, m.sjr AS sjr, coalesce(m.publisher, papers.publisher) AS publisher FROM papers LEFT JOIN m ON papers.issn = m.issn""")
def q_metrics_join(spark, d):
    i = F.col("id")
    metrics = spark.range(0, 9, 2).select(F.concat(F.lit("12-"), i).alias("issn"), F.lit(None).cast("string").alias("category"), F.concat(F.lit("Metrics "), i).alias("publisher"), F.array().cast("array<string>").alias("subject_areas"), F.lit(None).cast("double").alias("cite_score"), (i / 4.0).alias("sjr"), F.lit(None).cast("double").alias("snip"))
    p = F.col("publication")
    return enrich.enrich_from_metrics(papers(spark, d), metrics).select("seq", p["sjr"].alias("sjr"), p["publisher"].alias("publisher"))


_MONTHS = ("January", "feb", "MARCH", "4", "12", "13", "sept", "Oktober", "nothing", "06")


@query(f"""WITH m AS (SELECT o_orderkey, {list(_MONTHS)}[o_orderkey % 10 + 1] AS m FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(m, '^[0-9]+$') THEN CASE WHEN CAST(m AS INT) BETWEEN 1 AND 12 THEN lpad(CAST(CAST(m AS INT) AS VARCHAR), 2, '0') ELSE '01' END
  ELSE coalesce(lpad(CAST(nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(left(m, 3))), 0) AS VARCHAR), 2, '0'), '01') END AS month FROM m""")
def q_month_parse(spark, d):
    names = F.array(*(F.lit(m) for m in _MONTHS))
    return table(spark, d, "orders").select("o_orderkey", r.month(F.element_at(names, (F.col("o_orderkey") % 10 + 1).cast("int"))).alias("month"))


@query("SELECT o_orderkey, abs(TRY_CAST(a AS INT) - TRY_CAST(b AS INT)) + 1 AS n_pages FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'e' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS b FROM orders)")
def q_page_count(spark, d):
    last = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("e"), "o_custkey")).otherwise(F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", r.page_count(F.col("o_orderkey").cast("string"), last).alias("n_pages"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN make_date(year(o_orderdate), 1, 1) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def q_date_fallback(spark, d):
    text = F.when(F.col("o_orderkey") % 4 == 0, "2001-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", r.date_or_new_year(text, "yyyy-MM-dd", F.year("o_orderdate").cast("string")).alias("day"))


@query(f"WITH {PAPERS} SELECT seq, regexp_replace(translate(lower(author), ' ,', '') || year(publication_date) || lower(split_part(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' ', 1)), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS citation_key FROM papers")
def q_citation_key(spark, d):
    return papers(spark, d).select("seq", r.citation_key(F.col("authors"), F.col("publication_date"), F.col("title")).alias("citation_key"))


@query(f"WITH {PAPERS} SELECT seq, regexp_replace(year(publication_date) || '-' || title, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') || '.pdf' AS file_name FROM papers")
def q_filename(spark, d):
    return papers(spark, d).select("seq", r.file_name(F.col("publication_date"), F.col("title")).alias("file_name"))


@query(f"""WITH u AS (SELECT page_id, 'https://' || {list(PDF_HOSTS)}[page_id % {len(PDF_HOSTS)} + 1] || page_id AS u FROM pages)
SELECT page_id, CASE page_id % {len(PDF_HOSTS)} WHEN 0 THEN replace(u, '/doi/', '/doi/pdf/') WHEN 1 THEN 'https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=' || page_id
  WHEN 2 THEN 'https://www.sciencedirect.com/science/article/pii/' || page_id || '/pdfft?isDTMRedir=true&download=true' WHEN 3 THEN replace(u, '/articlelanding/', '/articlepdf/') WHEN 4 THEN replace(u, '/full', '/pdf')
  WHEN 5 THEN replace(u, '/doi', '/doi/pdf') WHEN 6 THEN 'https://link.springer.com/content/pdf/10/' || page_id || '.pdf' WHEN 7 THEN 'https://www.isca-speech.org/pdfs/x.pdf?' || page_id WHEN 8 THEN replace(u, '/abs/', '/pdfdirect/')
  WHEN 9 THEN u || '/pdf' WHEN 10 THEN 'https://www.pnas.org/content/pnas/' || page_id || '.full.pdf' WHEN 11 THEN 'https://www.jneurosci.org/content/jneuro/' || page_id || '.full.pdf'
  WHEN 12 THEN 'https://www.ijcai.org/p/' || CASE WHEN page_id < 1000 THEN lpad(CAST(page_id AS VARCHAR), 4, '0') ELSE CAST(page_id AS VARCHAR) END || '.pdf' WHEN 13 THEN replace(u, '/articles/', '/track/pdf/') END AS pdf_url FROM u""")
def q_pdf_url(spark, d):
    hosts = F.array(*(F.lit(h) for h in PDF_HOSTS))
    url = F.concat(F.lit("https://"), F.element_at(hosts, (F.col("page_id") % len(PDF_HOSTS) + 1).cast("int")), F.col("page_id"))
    return table(spark, d, "pages").select("page_id", r.pdf_url(url, F.lit(None).cast("string")).alias("pdf_url"))


@query(f"""WITH {PAPERS} SELECT seq, CASE category WHEN 'Journal' THEN '@article' WHEN 'Book' THEN '@book' ELSE '@inproceedings' END || '{{' ||
  regexp_replace(translate(lower(author), ' ,', '') || year(publication_date) || lower(split_part(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' ', 1)), '[^\\p{{L}}\\p{{N}}_]', '', 'g') || ',' || chr(10) ||
  concat_ws(',' || chr(10), '    title = {{' || title || '}}', '    author = {{' || author || ' and Second Author}}', CASE category WHEN 'Journal' THEN '    journal = {{' || venue || '}}' WHEN 'Conference Proceedings' THEN '    booktitle = {{' || venue || '}}' END,
  '    publisher = {{' || publisher || '}}', '    year = {{' || year(publication_date) || '}}', '    pages = {{' || pages || '}}') || chr(10) || '}}' || chr(10) AS entry FROM papers""")
def q_bibtex(spark, d):
    from .sinks.documents import bibtex_entries

    return bibtex_entries(papers(spark, d)).select("seq", "entry")


@query(f"WITH {PAPERS} SELECT source AS database, count(DISTINCT paper_key) AS n FROM keyed GROUP BY source")
def q_counts_by_source(spark, d):
    return reports.counts_by_database(c.merge_papers(c.with_keys(papers(spark, d)), "paper_key"))


@query(f"""WITH {PAPERS}, m AS (SELECT paper_key, bool_or(source = 'arXiv') AS a, bool_or(source = 'PubMed') AS b, bool_or(source = 'IEEE') AS c FROM keyed GROUP BY paper_key)
SELECT coalesce(nullif(concat_ws('+', CASE WHEN a THEN 'arXiv' END, CASE WHEN b THEN 'PubMed' END, CASE WHEN c THEN 'IEEE' END), ''), 'none') AS region, count(*) AS n FROM m GROUP BY 1""")
def q_venn(spark, d):
    return reports.regions(c.merge_papers(c.with_keys(papers(spark, d)), "paper_key"), ("arXiv", "PubMed", "IEEE"))


@query(f"WITH {PAPERS} SELECT publication_date, citations FROM papers WHERE citations IS NOT NULL")
def q_citation_series(spark, d):
    return reports.citation_series(papers(spark, d))


@query(f"WITH {PAPERS} SELECT seq, title, publication_date FROM keyed ORDER BY publication_date DESC, title, paper_key")
def q_sorted_output(spark, d):
    return reports.newest_first(c.with_keys(papers(spark, d))).select("seq", "title", "publication_date")


@query(f"WITH {PAPERS} SELECT seq, title, doi, publication_date, '[' || author || ']' AS authors FROM papers WHERE title <> ''")
def q_normalize_rxiv(spark, d):
    """Detail records of a preprint server made of documents, and back to papers."""
    p = papers(spark, d)
    raw = p.select(F.lit(1).alias("page"), F.col("seq").alias("position"), "title", "abstract", F.concat(F.col("authors")[0], F.lit("; ")).alias("authors"), F.date_format("publication_date", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("doi"), F.coalesce("doi", F.lit("NA")).alias("published"))
    out = normalize.rxiv(raw)
    return out.select(F.col("seq.position").alias("seq"), "title", "doi", "publication_date", F.concat(F.lit("["), F.array_join("authors", "|"), F.lit("]")).alias("authors"))


@query(f"""WITH {PAPERS} SELECT seq, trim(regexp_replace(title, ' +', ' ', 'g')) AS title, venue || ' journal' AS venue, 'Journal' AS category, CASE lang WHEN 'en' THEN 'Databases' WHEN 'fr' THEN 'Optics' ELSE '' END AS subjects, publication_date FROM papers WHERE trim(title) <> ''""")
def q_normalize_arxiv(spark, d):
    p = papers(spark, d)
    code = F.when(F.col("keywords")[0] == "en", "cs.DB").when(F.col("keywords")[0] == "fr", "physics.optics").otherwise("none")
    raw = p.select(
        F.lit(1).alias("page"), F.col("seq").alias("position"), "title", F.col("abstract").alias("summary"), F.concat(F.date_format("publication_date", "yyyy-MM-dd"), F.lit("T01:02:03Z")).alias("published"), F.concat(F.col("publication.title"), F.lit(" journal")).alias("arxiv:journal_ref"),
        F.col("doi").alias("arxiv:doi"), F.col("comments").alias("arxiv:comment"), F.array(F.struct(code.alias("@term"))).alias("category"), F.transform("urls", lambda u: F.struct(u.alias("@href"))).alias("link"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("author"),
    )
    q = F.col("publication")
    return normalize.arxiv(raw).select(F.col("seq.position").alias("seq"), "title", q["title"].alias("venue"), q["category"].alias("category"), F.array_join(q["subject_areas"], ",").alias("subjects"), "publication_date")


@query(f"""WITH {PAPERS} SELECT seq, title, abstract, author || '|Second Author' AS authors, venue, category, publication_date, doi, citations, lang AS keywords, 10 AS number_of_pages, seq || '-' || (seq + 9) AS pages FROM papers WHERE title <> ''""")
def q_normalize_ieee(spark, d):
    p, q = papers(spark, d), F.col("publication")
    raw = p.select(
        F.lit(1).alias("page"), F.col("seq").alias("position"), "title", "abstract", F.date_format("publication_date", "dd MMM yyyy").alias("publication_date"), F.year("publication_date").cast("string").alias("publication_year"), "doi", F.col("citations").cast("string").alias("citing_paper_count"),
        q["title"].alias("publication_title"), F.lit(None).cast("string").alias("isbn"), q["issn"].alias("issn"), q["publisher"].alias("publisher"), q["category"].alias("content_type"), F.lit(None).cast("string").alias("pdf_url"), F.struct(F.struct(F.col("keywords").alias("terms")).alias("author_terms")).alias("index_terms"),
        F.struct(F.transform("authors", lambda a: F.struct(a.alias("full_name"))).alias("authors")).alias("authors"), F.col("seq").cast("string").alias("start_page"), (F.col("seq") + 9).cast("string").alias("end_page"),
    )
    out = normalize.ieee(raw)
    return out.select(F.col("seq.position").alias("seq"), "title", "abstract", F.array_join("authors", "|").alias("authors"), F.col("publication.title").alias("venue"), F.col("publication.category").alias("category"), "publication_date", "doi", "citations", F.array_join("keywords", "|").alias("keywords"), "number_of_pages", "pages")


@query(f"""WITH {PAPERS} SELECT seq, trim(title) AS title, abstract || chr(10) || venue AS abstract, author || '|Author' AS authors, 'Journal' AS category, issn, CAST(date_trunc('month', publication_date) AS DATE) AS publication_date, doi, 10 AS number_of_pages
FROM papers WHERE trim(title) <> ''""")
def q_normalize_pubmed(spark, d):
    p, q, day = papers(spark, d), F.col("publication"), F.col("publication_date")
    part = lambda pattern: F.date_format(day, pattern)
    article = F.struct(
        F.struct(q["issn"].alias("ISSN"), q["title"].alias("Title"), F.struct(F.struct(part("yyyy").alias("Year"), part("MMM").alias("Month"), F.lit(None).cast("string").alias("Day")).alias("PubDate")).alias("JournalIssue")).alias("Journal"),
        F.struct(F.concat(F.col("seq"), F.lit("-"), F.col("seq") + 9).alias("MedlinePgn")).alias("Pagination"),
        F.struct(F.array(F.struct(F.col("authors")[0].alias("LastName"), F.lit(None).cast("string").alias("ForeName")), F.struct(F.lit("Author").alias("LastName"), F.lit(None).cast("string").alias("ForeName"))).alias("Author")).alias("AuthorList"),
        F.lit(None).cast("struct<Year:string,Month:string,Day:string>").alias("ArticleDate"),
    )
    ids = F.struct(F.struct(F.array(F.struct(F.lit("pubmed").alias("@IdType"), F.lit("1").alias("#text")), F.struct(F.lit("doi").alias("@IdType"), F.col("doi").alias("#text"))).alias("ArticleId")).alias("ArticleIdList"))
    raw = p.select(F.lit(1).alias("page"), F.col("seq").alias("position"), F.struct(F.lit("1").alias("PMID"), article.alias("Article")).alias("MedlineCitation"), ids.alias("PubmedData"), F.trim("title").alias("title_text"), F.array("abstract", q["title"]).alias("abstract_texts"), F.col("keywords").alias("keyword_texts"))
    out = normalize.pubmed(raw)
    return out.select(F.col("seq.position").alias("seq"), "title", "abstract", F.array_join("authors", "|").alias("authors"), F.col("publication.category").alias("category"), F.col("publication.issn").alias("issn"), "publication_date", "doi", "number_of_pages")


@query(f"""WITH {PAPERS} SELECT seq, title, CASE WHEN seq % 2 = 0 THEN 'Detail ' || seq END AS abstract, CASE WHEN seq % 2 = 0 THEN 'B|A' ELSE author END AS authors, issn, 'isbn' || seq AS isbn, publication_date, citations, CASE WHEN seq % 2 = 0 THEN 7 END AS number_of_pages FROM papers WHERE title <> ''""")
def q_normalize_scopus(spark, d):
    """Entries with ISBNs as text or as lists, and detail records for every other one."""
    p, q, s = papers(spark, d), F.col("publication"), F.col("seq")
    null = F.lit(None).cast("string")
    listed = F.concat(F.lit('[{"$":"isbn'), s, F.lit('"},{"$":"x"}]'))
    raw = p.select(
        F.lit(1).alias("page"), s.alias("position"), F.col("title").alias("dc:title"), F.col("authors")[0].alias("dc:creator"), q["title"].alias("prism:publicationName"), F.date_format("publication_date", "yyyy-MM-dd").alias("prism:coverDate"), F.col("doi").alias("prism:doi"), F.col("citations").cast("string").alias("citedby-count"),
        q["category"].alias("prism:aggregationType"), s.cast("string").alias("prism:url"), null.alias("prism:pageRange"), F.when(s % 3 == 0, listed).otherwise(F.concat(F.lit("isbn"), s)).alias("prism:isbn"), q["issn"].alias("prism:issn"), q["publisher"].alias("dc:publisher"), F.array(F.struct(F.lit("scopus").alias("@ref"), F.col("urls")[0].alias("@href"))).alias("link"),
    )
    details = p.filter("seq % 2 = 0").select(s.cast("string").alias("url"), F.array(F.concat(F.lit("Detail "), s)).alias("abstracts"), F.array(F.lit("B"), F.lit("A"), F.lit("B")).alias("authors"), F.array(F.lit("k")).alias("keywords"), null.alias("page_range"), F.lit("3").alias("first_page"), F.lit("9").alias("last_page"))
    out = normalize.scopus(raw, details)
    return out.select(F.col("seq.position").alias("seq"), "title", "abstract", F.array_join("authors", "|").alias("authors"), F.col("publication.issn").alias("issn"), F.col("publication.isbn").alias("isbn"), "publication_date", "citations", "number_of_pages")


@query(f"""WITH {PAPERS}, w AS (SELECT *, regexp_replace(year(publication_date) || '-' || title, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') || '.pdf' AS whole FROM papers),
  f AS (SELECT seq, CASE WHEN strlen(whole) <= 200 THEN whole ELSE substring(whole, 1, 32) || '-' || sha256(whole) || '.pdf' END AS file_name, url, doi, coalesce('DOI-' || doi, lower(title) || '|' || year(publication_date)) AS paper_key FROM w)
SELECT paper_key, file_name, concat_ws(' ', url, 'http://doi.org/' || doi) AS urls, row_number() OVER (PARTITION BY file_name ORDER BY seq) > 1 AS collision FROM f""")
def q_download_plan(spark, d):
    """Names are bounded in bytes: what is longer is cut and ends in a hash."""
    from .sinks.documents import download_plan

    return download_plan(c.with_keys(papers(spark, d))).select("paper_key", "file_name", F.array_join("urls", " ").alias("urls"), "collision")


@query("SELECT page_id, 'https://doi.org/10.5/' || page_id AS url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, url FROM pages WHERE page_id % 2 <> 0 AND NOT contains(lower(url), 'pdf')")
def q_visited_urls(spark, d):
    doi = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("10.5/"), F.col("page_id")))
    return table(spark, d, "pages").select("page_id", F.explode(enrich.visited(doi, F.array("url"))).alias("url"))


_SPEC = {"since": dt.date(2000, 1, 1), "until": dt.date(2021, 6, 30), "limit": 150, "limit_per_database": 60, "publication_types": ("journal", "book"), "databases": ("PubMed", "IEEE", "Scopus")}


@query(f"""WITH {PAPERS}, hit AS (SELECT * FROM keyed WHERE source IN ('PubMed', 'IEEE', 'Scopus') AND title <> '' AND publication_date BETWEEN date '2000-01-01' AND date '2021-06-30'
    AND ({_has('abstract', 'the')} OR {_has('abstract', 'de')} OR (source <> 'IEEE' AND ({_has('title', 'the')} OR {_has('title', 'de')})) OR (source = 'Scopus' AND ({_has('lang', 'the')} OR {_has('lang', 'de')})))),
  f AS (SELECT source, paper_key, min(seq) AS first FROM hit GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first) AS k FROM f),
  cut AS (SELECT source, max(first) AS last, max(k) AS k FROM n WHERE k <= 60 GROUP BY 1), few AS (SELECT hit.* FROM hit JOIN cut ON hit.source = cut.source WHERE k < 60 OR seq <= last),
  g AS (SELECT paper_key, min(seq) AS first FROM few GROUP BY 1 ORDER BY 2 LIMIT 150), kept AS (SELECT * FROM few WHERE seq <= (SELECT max(first) FROM g) OR (SELECT count(*) FROM g) < 150),
  pub AS (SELECT publication_key, arg_min(category, seq) AS category FROM kept GROUP BY 1),
  m AS (SELECT kept.paper_key, min(seq) AS seq, arg_min(title, seq) AS title, max(citations) AS citations, string_agg(DISTINCT source, ',' ORDER BY source) AS databases, arg_min(pub.category, seq) AS category FROM kept JOIN pub USING (publication_key) GROUP BY 1)
SELECT paper_key, seq, title, citations, databases, category FROM m WHERE category IN ('Journal', 'Book')""")
def q_search_exact(spark, d):
    """A search up to the type filter: everything that comes before similar titles are merged."""
    spec = SearchSpec("[the] OR [de]", **_SPEC)
    found = c.with_keys(api.select(papers(spark, d), spec))
    found = c.limit_total(c.limit_per_source(found, spec.limit_per_database), spec.limit)
    merged = c.merge_papers(c.merge_publications(found), "paper_key")
    return merged.filter(c.of_types(F.col("publication"), spec.publication_types)).select("paper_key", "seq", "title", "citations", F.array_join("databases", ",").alias("databases"), F.col("publication.category").alias("category"))


def flagship(spark: SparkSession, d: str, index: TokenIndex | None = None) -> DataFrame:
    """A whole search over documents: query, dates, limits, deduplication, type filter, similar titles, newest first."""
    spec = SearchSpec(BOOLEAN, since=dt.date(2000, 1, 1), limit=5_000, limit_per_database=2_000, publication_types=("journal", "conference proceedings", "book"), databases=("PubMed", "IEEE", "Scopus"))
    out = api.run(papers(spark, d), spec, index=index)
    return reports.newest_first(out.select("paper_key", "title", "doi", "publication_date", "citations", F.array_join("databases", ",").alias("databases"), "seq"))
