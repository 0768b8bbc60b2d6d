"""Readers of captured responses of the six sources, and of saved searches. Schemas are explicit.

The XML parser gives an array even for a single child, so that shapes don't vary. Records that can't be read are
dropped or null (PERMISSIVE), never an error; read_broken() gives them. Every reader adds page and position, the place in the arrival order:
the page is the file by name, the position the record's place in it. Files are numbered from a table with a row for each
of them (a captured page holds hundreds of records), joined as Catalyst sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PAPER, SEARCH, conform

ARXIV = "title string, published string, summary string, `arxiv:journal_ref` string, `arxiv:doi` string, `arxiv:comment` string, category array<struct<`@term`: string>>, link array<struct<`@href`: string>>, author array<struct<name: string>>"
PUBMED = """MedlineCitation struct<PMID: string, Article: struct<Journal: struct<ISSN: string, Title: string, JournalIssue: struct<PubDate: struct<Year: string, Month: string, Day: string>>>,
  Pagination: struct<MedlinePgn: string>, AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>, ArticleDate: struct<Year: string, Month: string, Day: string>>>,
  PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<`@IdType`: string, `#text`: string>>>>"""
IEEE = """total_records int, articles array<struct<title: string, publication_date: string, publication_year: string, doi: string, citing_paper_count: string, abstract: string, publication_title: string, isbn: string, issn: string,
  publisher: string, content_type: string, pdf_url: string, index_terms: struct<author_terms: struct<terms: array<string>>>, authors: struct<authors: array<struct<full_name: string>>>, start_page: string, end_page: string>>"""
SCOPUS = """`search-results` struct<`opensearch:totalResults`: string, entry: array<struct<`dc:title`: string, `dc:creator`: string, `prism:publicationName`: string, `prism:coverDate`: string, `prism:doi`: string, `citedby-count`: string,
  `prism:aggregationType`: string, `prism:url`: string, `prism:pageRange`: string, `prism:isbn`: string, `prism:issn`: string, `dc:publisher`: string, link: array<struct<`@ref`: string, `@href`: string>>>>>"""
SCOPUS_DETAIL = "url string, abstracts array<string>, authors array<string>, keywords array<string>, page_range string, first_page string, last_page string"
RXIV = "collection array<struct<title: string, abstract: string, authors: string, date: string, doi: string, published: string>>"
SERIALS = """`serial-metadata-response` struct<entry: array<struct<`dc:title`: string, `dc:publisher`: string, `prism:issn`: string, `prism:aggregationType`: string, `subject-area`: array<struct<`@code`: string, `@abbrev`: string, `$`: string>>,
  SNIPList: struct<SNIP: array<struct<`@year`: string, `$`: string>>>, SJRList: struct<SJR: array<struct<`@year`: string, `$`: string>>>, citeScoreYearInfoList: struct<citeScoreCurrentMetric: string, citeScoreCurrentMetricYear: string>>>>"""


def _paged(df: DataFrame) -> DataFrame:
    """Adds page, the number of the row's file by name."""
    pages = df.select("file").distinct().withColumn("page", F.dense_rank().over(Window.orderBy("file")))
    return df.join(pages, "file")


def _ordered(df: DataFrame) -> DataFrame:
    """page and position for records of files(file, start, place)."""
    return _paged(df).withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("start", "place")))


XML_OPTIONS = {"attributePrefix": "@", "valueTag": "#text", "mode": "PERMISSIVE"}


def _json(spark: SparkSession, path: str, schema: str, entries: str) -> DataFrame:
    """A row for each entry of whole JSON documents, with its file's and its own place."""
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())
    return _paged(read).select("page", F.posexplode(entries).alias("position", "entry")).select("page", "position", "entry.*")


#: A tag's attributes: values may hold what looks like the tag's end.
_ATTRIBUTES = r"""(?:\s(?:[^<>"']|"[^"]*+"|'[^']*+')*+)?"""
_TAG = r"""</?[A-Za-z_:](?:[^<>"']|"[^"]*+"|'[^']*+')*+>"""


def markup(xml: Column) -> Column:
    """XML in which only tags, references and text are left: comments and instructions are gone, CDATA is escaped text."""
    tokens = lambda x: F.regexp_extract_all(x, F.lit(r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|[^<]++|<"), 0)

    def plain(t: Column) -> Column:
        inner = F.substr(t, F.lit(10), F.length(t) - 12)
        for char, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
            inner = F.replace(inner, F.lit(char), F.lit(f"&{name};"))
        return F.when(t.startswith("<![CDATA["), inner).when(t.startswith("<!--") | t.startswith("<?"), F.lit("")).otherwise(t)

    xml = F.replace(F.replace(xml, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))  # line ends, as XML reads them
    special = xml.contains("<!") | xml.contains("<?")
    return F.when(special, F.array_join(F.transform(tokens(xml), plain), "")).otherwise(xml)


def inside(xml: Column, tag: str) -> Column:
    """What each element of this name holds, in order, of XML as markup() leaves it; elements of a name don't nest."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}{_ATTRIBUTES}(?<!/)>(.*?)</{tag}\s*>"), 1)


def first_inside(xml: Column, tag: str) -> Column:
    return F.get(inside(xml, tag), F.lit(0))


def _records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """file, start, place and xml of each element of this name. Files are cut at the element's end, so that large ones are
    read by many tasks; what stands before and after the elements is no record."""
    end = f"</{tag}>"
    raw = spark.read.option("lineSep", end).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    record = F.regexp_extract("value", rf"(?s)<{tag}(?:\s[^>]*)?>.*", 0)
    return raw.select("file", "start", "place", record.alias("xml")).filter("xml <> ''").withColumn("xml", F.concat("xml", F.lit(end)))


def read_arxiv(spark: SparkSession, path: str) -> DataFrame:
    """Entries are parsed one by one, so that a broken one costs none of those that follow in its file."""
    return _ordered(_records(spark, path, "entry").select("file", "start", "place", F.from_xml("xml", ARXIV, XML_OPTIONS).alias("x"))).select("page", "position", "x.*")


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Fields of fixed shape by the XML parser; title, abstract and keywords, whose text has inline markup, as plain text in
    the order of the document."""
    records = _records(spark, path, "PubmedArticle").withColumn("clean", markup(F.col("xml")))
    article = first_inside(F.col("clean"), "Article")
    flat = lambda part, tag: F.transform(inside(part, tag), plain_text)
    read = records.select(
        "file", "start", "place", F.from_xml("xml", PUBMED, XML_OPTIONS).alias("x"), F.get(flat(article, "ArticleTitle"), F.lit(0)).alias("title_text"),
        flat(first_inside(article, "Abstract"), "AbstractText").alias("abstract_texts"), flat(F.array_join(inside(F.col("clean"), "KeywordList"), ""), "Keyword").alias("keyword_texts"),
    )
    return _ordered(read).select("page", "position", "x.*", "title_text", "abstract_texts", "keyword_texts")


def read_ieee(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, IEEE, "articles")


def read_scopus(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, SCOPUS, "`search-results`.entry")


def read_rxiv(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, RXIV, "collection")


def read_serials(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, SERIALS, "`serial-metadata-response`.entry")


def read_scopus_details(spark: SparkSession, path: str) -> DataFrame:
    """Detail documents. A file holds one or more, each of which begins with an XML declaration if there are more; a document
    is keyed by the address in it, or by its file's name without its ending. Files are cut at the declarations, so that large
    ones are read by many tasks and no row is more than a document."""
    files = spark.read.option("lineSep", "<?xml ").text(path).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", r"([^/]*?)(\.[a-z]+)?$", 1)
    return parse_details(files.select(name.alias("url"), "value").filter(F.trim("value") != ""))


def parse_details(documents: DataFrame) -> DataFrame:
    """What normalize.scopus takes of detail documents(url, value); the address in a document counts before the one given."""
    whole = documents.withColumn("clean", markup(F.col("value")))
    many = lambda tag: F.transform(inside(F.col("clean"), tag), plain_text)
    one = lambda tag: F.get(many(tag), F.lit(0))
    return whole.select(
        F.coalesce(one("prism:url"), "url").alias("url"), many("ce:para").alias("abstracts"), many("ce:indexed-name").alias("authors"), many("author-keyword").alias("keywords"),
        one("prism:pageRange").alias("page_range"), one("prism:startingPage").alias("first_page"), one("prism:endingPage").alias("last_page"),
    )


def plain_text(xml: Column) -> Column:
    """Text nodes in document order of XML as markup() leaves it: tags removed, numeric references and the five named
    entities decoded, each once."""
    out = F.regexp_replace(xml, _TAG, "")
    # pieces between numeric references, and the references themselves by turns
    pieces = F.split(out, "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", -1)
    numbers = F.regexp_extract_all(out, F.lit("&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), 1)
    point = lambda x: F.when(F.lower(x).startswith("x"), F.conv(F.substr(x, F.lit(2)), 16, 10)).otherwise(x).cast("int")
    known = lambda p: ((p >= 0) & (p < 0xD800)) | ((p > 0xDFFF) & (p <= 0x10FFFF))
    utf8 = lambda p: F.decode(F.unhex(F.lpad(F.hex(F.when(known(p), p).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    def named(text: Column) -> Column:
        for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
            text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
        return text

    joined = F.array_join(F.zip_with(F.transform(pieces, named), F.transform(numbers, lambda x: utf8(point(x))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.btrim(F.when(F.size(numbers) > 0, joined).otherwise(named(out)), F.lit(" \n\r\t"))


def read_rxiv_results(spark: SparkSession, path: str) -> DataFrame:
    """Result pages: the total of the page's title, the DOIs in order, and the address of the next page."""
    html = spark.read.text(path, wholetext=True)
    return html.select(rxiv_total(F.col("value")).alias("total"), rxiv_dois(F.col("value")).alias("dois"), rxiv_next(F.col("value")).alias("next"))


def rxiv_total(html: Column) -> Column:
    """The number in the page's title, thousands commas removed; 0 if it has none."""
    title = F.regexp_extract(html, r'(?s)id="page-title"[^>]*>\s*([0-9,]*)', 1)
    return F.coalesce(F.replace(title, F.lit(","), F.lit("")).try_cast("int"), F.lit(0))


def rxiv_dois(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r'(?s)class="highwire-cite-metadata-doi highwire-cite-metadata"[^>]*>(.*?)</span>\s*(?:</span>|<)'), 1)
    return F.filter(F.transform(found, lambda d: F.regexp_extract(d, r"https?://(?:dx\.)?doi\.org/([^\s<]+)", 1)), lambda d: d != "")


def rxiv_next(html: Column) -> Column:
    tag = F.regexp_extract(html, r'(<a[^>]*class="link-icon link-icon-after"[^>]*>)', 1)
    return F.nullif(F.regexp_extract(tag, 'href="([^"]*)"', 1), F.lit(""))


#: A column of records that can't be read, as they stand.
CORRUPT = "_corrupt_record"


def read_broken(spark: SparkSession, source: str, path: str) -> DataFrame:
    """file and record of a source's captures that can't be read: records of XML, whole documents of JSON.

    The readers leave them out; records that can be read but lack what a paper needs aren't broken.
    """
    if source in ("PubMed", "arXiv"):
        tag, schema = ("PubmedArticle", PUBMED) if source == "PubMed" else ("entry", ARXIV)
        # a record alone lacks the namespaces that its document declares; the parser doesn't ask for them
        found = _records(spark, path, tag).select("file", "xml", F.from_xml("xml", f"{schema}, {CORRUPT} string", XML_OPTIONS).alias("x"))
    else:
        schema = {"IEEE": IEEE, "Scopus": SCOPUS}.get(source, RXIV)
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml"))
        found = whole.withColumn("x", F.from_json("xml", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE"}))
    return found.filter(f"x is null or x.{CORRUPT} is not null").select("file", F.col("xml").alias("record"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """A document written in parts, cut after each paper: file, start, place, value. Line feeds inside of strings are
    escaped in JSON, so a brace at a paper's depth ends a paper."""
    read = spark.read.option("lineSep", "\n    }").text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """Papers of saved searches, in their order: folders of Parquet, JSON documents written in parts, or others' JSON
    documents (each of which is one task's)."""
    if _exists(spark, f"{path}/papers"):
        return conform(spark.read.parquet(f"{path}/papers"))
    if _exists(spark, f"{path}/_SUCCESS"):
        paper = F.concat(F.regexp_extract("value", r"(?s)(?:^|\n)(    \{\n.*)", 1), F.lit("}"))
        cut = _pieces(spark, path).withColumn("paper", paper).filter("paper != '}'").select("file", "start", "place", F.from_json("paper", PAPER).alias("paper"))
        seq = F.shiftleft(F.col("page").cast("long"), 32) + F.col("position")
        return conform(_ordered(cut).select("paper.*", seq.alias("seq")))
    saved = spark.read.schema(SEARCH).option("multiLine", True).json(path)
    return conform(saved.select(F.posexplode("papers").alias("seq", "paper")).select("paper.*", F.col("seq").cast("long").alias("seq")))


def read_saved_envelope(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/papers") and _exists(spark, f"{path}/_SUCCESS"):
        # the document without its papers: one piece begins it, one ends it
        head, foot = F.regexp_extract("value", r'(?s)^(\{\n.*?"papers": \[)', 1), F.regexp_extract("value", r"(?s)(?:^|\n)  \](,?\n.*)$", 1)
        whole = _pieces(spark, path).agg(F.concat(F.max(head), F.lit("]"), F.max(foot)).alias("value"))
        return whole.select(F.from_json("value", SEARCH).alias("s")).select("s.*").drop("papers")
    at = f"{path}/envelope" if _exists(spark, f"{path}/papers") else path
    return spark.read.schema(SEARCH).option("multiLine", True).json(at).drop("papers")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """url and html of captured pages, JSON lines."""
    return spark.read.schema("url string, html string").json(path)


def read_listed(spark: SparkSession, path: str) -> DataFrame:
    """name and url of a reference list (journals or publishers), JSON lines or CSV with a header, by the path's ending."""
    reader = spark.read.schema("name string, url string")
    read = reader.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else reader.json(path)
    return read.filter("name is not null or url is not null").distinct()
