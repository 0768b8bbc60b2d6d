"""Raw records of each source to canonical papers. Pure projections, but for the joins with detail records.

A record without a title or a date is dropped, as is one that its source requires more of; what can't be parsed is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import category, date_or_new_year, month, page_count, page_range_count
from ..functions.subject_areas import SUBJECT_AREAS
from ..schema import PUBLICATION, conform, with_arrival


def publication(**fields: Column) -> Column:
    """A publication of the given fields, null without a title."""
    given = {"subject_areas": F.array().cast("array<string>"), "is_potentially_predatory": F.lit(False)} | fields
    made = F.struct(*((given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in PUBLICATION))
    return F.when(F.length(fields["title"]) > 0, made)


def _finish(df: DataFrame, source: str) -> DataFrame:
    placed = with_arrival(df, source).withColumn("databases", F.array(F.lit(source)))
    return conform(placed.filter((F.length("title") > 0) & F.col("publication_date").isNotNull()))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\n"), F.lit("")), " +", " "))


def subject_names(codes: Column) -> Column:
    """Names of known codes, distinct, in order."""
    names = F.create_map(*(F.lit(x) for pair in SUBJECT_AREAS.items() for x in pair))
    return F.array_distinct(F.filter(F.transform(codes, lambda c: F.try_element_at(names, c)), lambda n: n.isNotNull()))


def arxiv(raw: DataFrame) -> DataFrame:
    venue = F.col("`arxiv:journal_ref`")
    return _finish(
        raw.select(
            "page", "position", squeeze(F.col("title")).alias("title"), squeeze(F.col("summary")).alias("abstract"), F.transform("author", lambda a: a["name"]).alias("authors"),
            publication(title=venue, category=category(venue), subject_areas=subject_names(F.transform("category", lambda c: c["@term"]))).alias("publication"),
            F.try_to_date(F.substring("published", 1, 10), "yyyy-MM-dd").alias("publication_date"), F.sort_array(F.array_distinct(F.transform("link", lambda x: x["@href"]))).alias("urls"),
            F.col("`arxiv:doi`").alias("doi"), F.col("`arxiv:comment`").alias("comments"),
        ),
        "arXiv",
    )


def pubmed(raw: DataFrame) -> DataFrame:
    """Records need an abstract; a day that isn't given is the first."""
    a, issue = F.col("MedlineCitation.Article"), F.col("MedlineCitation.Article.Journal.JournalIssue.PubDate")
    written, year = a["ArticleDate"], F.coalesce(a["ArticleDate"]["Year"], issue["Year"])
    exact = F.try_to_date(F.concat_ws("-", written["Year"], F.lpad(written["Month"], 2, "0"), F.lpad(written["Day"], 2, "0")), "yyyy-MM-dd")
    printed = F.try_to_date(F.concat_ws("-", issue["Year"], month(F.coalesce(issue["Month"], F.lit(""))), F.lit("01")), "yyyy-MM-dd")
    ids = F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda i: i["@IdType"] == "doi")
    pages = a["Pagination"]["MedlinePgn"]
    journal = a["Journal"]
    out = raw.select(
        "page", "position", F.col("title_text").alias("title"), F.nullif(F.array_join("abstract_texts", "\n"), F.lit("")).alias("abstract"),
        F.transform(a["AuthorList"]["Author"], lambda x: F.concat_ws(" ", x["ForeName"], x["LastName"])).alias("authors"),
        publication(title=journal["Title"], issn=journal["ISSN"], category=F.lit("Journal")).alias("publication"),
        F.coalesce(exact, printed, F.make_date(year.try_cast("int"), F.lit(1), F.lit(1))).alias("publication_date"), F.get(ids, F.lit(0))["#text"].alias("doi"),
        F.sort_array(F.array_distinct(F.filter("keyword_texts", lambda x: x != ""))).alias("keywords"), page_range_count(pages).alias("number_of_pages"), pages.alias("pages"),
    )
    return _finish(out.filter("abstract is not null"), "PubMed")


def ieee(raw: DataFrame) -> DataFrame:
    day = F.regexp_replace(F.trim("publication_date"), r"^(\d{1,2})-\d{1,2} ", "$1 ")
    return _finish(
        raw.select(
            "page", "position", "title", "abstract", F.coalesce(F.transform(F.col("authors.authors"), lambda a: a["full_name"]), F.array().cast("array<string>")).alias("authors"),
            publication(title=F.col("publication_title"), isbn=F.col("isbn"), issn=F.col("issn"), publisher=F.col("publisher"), category=category(F.col("content_type"))).alias("publication"),
            date_or_new_year(day, "d MMM yyyy", F.col("publication_year")).alias("publication_date"), F.filter(F.array("pdf_url"), lambda u: u.isNotNull()).alias("urls"), "doi",
            F.col("citing_paper_count").try_cast("int").alias("citations"), F.sort_array(F.array_distinct(F.col("index_terms.author_terms.terms"))).alias("keywords"),
            page_count(F.col("start_page"), F.col("end_page")).alias("number_of_pages"), F.when(F.col("start_page").isNotNull() & F.col("end_page").isNotNull(), F.concat_ws("-", "start_page", "end_page")).alias("pages"),
        ),
        "IEEE",
    )


def text_or_first(value: Column) -> Column:
    """A JSON value that is a string or a list of {"$": string}: the string, or the first of the list."""
    return F.coalesce(F.get_json_object(value, "$[0].$"), F.when(~value.startswith("["), value))


def scopus(raw: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Details, of details(url, ...), replace authors, abstract, keywords and pages of the entry with that url."""
    link = F.get(F.filter("link", lambda x: x["@ref"] == "scopus"), F.lit(0))["@href"]
    flat = raw.select(
        "page", "position", F.col("`prism:url`").alias("url"), F.col("`dc:title`").alias("title"), F.filter(F.array(F.col("`dc:creator`")), lambda c: c.isNotNull()).alias("authors"),
        publication(title=F.col("`prism:publicationName`"), isbn=text_or_first(F.col("`prism:isbn`")), issn=text_or_first(F.col("`prism:issn`")), publisher=F.col("`dc:publisher`"), category=category(F.col("`prism:aggregationType`"))).alias("publication"),
        F.try_to_date(F.col("`prism:coverDate`"), "yyyy-MM-dd").alias("publication_date"), F.filter(F.array(link), lambda u: u.isNotNull()).alias("urls"), F.col("`prism:doi`").alias("doi"),
        F.col("`citedby-count`").try_cast("int").alias("citations"), F.col("`prism:pageRange`").alias("pages"),
    )
    if details is None:
        return _finish(flat.drop("url"), "Scopus")
    d = details.dropDuplicates(["url"]).select("url", *(F.col(c).alias(f"d_{c}") for c in details.columns if c != "url"))
    joined = flat.join(d, "url", "left").withColumns(
        {
            "authors": F.when(F.size("d_authors") > 0, F.array_distinct("d_authors")).otherwise(F.col("authors")), "abstract": F.get("d_abstracts", F.lit(0)),
            "keywords": F.sort_array(F.array_distinct(F.filter("d_keywords", lambda k: k.isNotNull()))), "pages": F.coalesce("d_page_range", "pages"),
            "number_of_pages": page_count(F.col("d_first_page"), F.col("d_last_page"), signed=True),
        }
    )
    return _finish(joined.drop("url", *(c for c in d.columns if c.startswith("d_"))), "Scopus")


def rxiv(raw: DataFrame, database: str = "medRxiv") -> DataFrame:
    """Preprints have no publication; a published DOI replaces the preprint's."""
    published = F.when(F.lower("published") != "na", F.replace("published", F.lit("\\"), F.lit("")))
    doi = F.coalesce(published, F.col("doi"))
    return _finish(
        raw.select(
            "page", "position", "title", "abstract", F.filter(F.transform(F.split("authors", ";"), lambda x: F.trim(x)), lambda a: a != "").alias("authors"), F.try_to_date("date", "yyyy-MM-dd").alias("publication_date"),
            F.array(F.concat(F.lit("https://doi.org/"), doi)).alias("urls"), doi.alias("doi"),
        ),
        database,
    )


def serial_metrics(raw: DataFrame) -> DataFrame:
    """issn, category, publisher, subject_areas, cite_score, sjr, snip of journal metadata; scores that aren't there are null."""
    first = lambda path: F.get(F.col(path), F.lit(0))["$"].try_cast("double")
    return raw.select(
        F.col("`prism:issn`").alias("issn"), category(F.col("`prism:aggregationType`")).alias("category"), F.col("`dc:publisher`").alias("publisher"), F.sort_array(F.array_distinct(F.transform(F.col("`subject-area`"), lambda s: F.trim(s["$"])))).alias("subject_areas"),
        F.col("citeScoreYearInfoList.citeScoreCurrentMetric").try_cast("double").alias("cite_score"), first("SJRList.SJR").alias("sjr"), first("SNIPList.SNIP").alias("snip"),
    )


NORMALIZERS = {"arXiv": arxiv, "PubMed": pubmed, "IEEE": ieee, "Scopus": scopus, "medRxiv": rxiv, "bioRxiv": lambda raw: rxiv(raw, "bioRxiv")}
