"""Enrichment from page metadata and journal metrics, and flags against reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import host, longest, split_keywords, union_sorted

# Names of meta tags, in the order in which they are tried.
TITLE_TAGS = ("citation_title", "DC.Title", "DC.title", "dc.Title", "dc.title")
ABSTRACT_TAGS = ("citation_abstract", "DC.Description", "DC.description", "dc.Description", "dc.description", "description")
AUTHOR_TAGS = ("citation_author", "citation_authors")
KEYWORD_TAGS = ("citation_keywords", "keywords")
VENUE_TAGS = {"Journal": "citation_journal_title", "Conference Proceedings": "citation_conference_title", "Book": "citation_book_title"}
PREPRINT_VENUES = ("biorxiv", "medrxiv", "arxiv")


def meta_tags(html: Column) -> Column:
    """A map from the name of each meta tag to all its contents, in page order; the attributes' order doesn't matter."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\s[^>]*>)"), 1)
    attribute = lambda t, a: F.coalesce(F.nullif(F.regexp_extract(t, rf'(?is)\s{a}\s*=\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(t, rf"(?is)\s{a}\s*=\s*'([^']*)'", 1), F.lit("")))
    pairs = F.filter(F.transform(tags, lambda t: F.struct(attribute(t, "name").alias("name"), attribute(t, "content").alias("content"))), lambda p: p["name"].isNotNull() & p["content"].isNotNull())
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: F.trim(p["content"]))))


def first_tag(tags: Column, names: tuple[str, ...]) -> Column:
    """The longest content of the first of these tags that is there."""
    return F.coalesce(*(longest(F.try_element_at(tags, F.lit(n))) for n in names))


def page_metadata(pages: DataFrame) -> DataFrame:
    """url and the fields that a page's meta tags give, of pages(url, html); pages without a title give nothing."""
    t = F.col("tags")
    venue = F.coalesce(*(F.when(F.try_element_at(t, F.lit(n)).isNotNull(), F.struct(longest(F.try_element_at(t, F.lit(n))).alias("title"), F.lit(kind).alias("category"))) for kind, n in VENUE_TAGS.items()))
    one = lambda name: longest(F.try_element_at(t, F.lit(name)))
    read = pages.select("url", meta_tags(F.col("html")).alias("tags")).select(
        "url", first_tag(t, TITLE_TAGS).alias("title"), one("citation_doi").alias("doi"), first_tag(t, ABSTRACT_TAGS).alias("abstract"),
        F.coalesce(*(F.try_element_at(t, F.lit(n)) for n in AUTHOR_TAGS)).alias("authors"), split_keywords(first_tag(t, KEYWORD_TAGS)).alias("keywords"), venue.alias("venue"),
        one("citation_issn").alias("issn"), one("citation_isbn").alias("isbn"), one("citation_publisher").alias("publisher"), one("citation_pdf_url").alias("pdf_url"),
    )
    kept = F.when(~F.lower(F.col("venue.title")).isin(*PREPRINT_VENUES), F.col("venue"))
    return read.filter("title is not null").withColumn("venue", kept)


def visited(doi: Column, urls: Column) -> Column:
    """The addresses that are looked up: the DOI's alone if there is one, else all that don't lead to a PDF."""
    return F.when(doi.isNotNull(), F.array(F.concat(F.lit("https://doi.org/"), doi))).otherwise(F.filter(urls, lambda u: ~F.lower(u).contains("pdf")))


def enrich_from_pages(papers: DataFrame, pages: DataFrame, key: str = "paper_key") -> DataFrame:
    """papers with what their pages say: each field takes the last page (by address) that has it, else stays.

    A page with a venue names the publication if there is none; a page's PDF address joins the urls.
    """
    meta = page_metadata(pages)
    hits = papers.select(key, F.explode(visited(F.col("doi"), F.col("urls"))).alias("url")).join(meta, "url")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() if c not in ("authors", "keywords") else F.size(c) > 0, F.col("url"))).alias(f"m_{c}")
    found = hits.groupBy(key).agg(*(last(c) for c in ("title", "doi", "abstract", "authors", "keywords", "venue", "issn", "isbn", "publisher")), F.collect_set("pdf_url").alias("m_urls"))
    joined = papers.join(found, key, "left")
    for c in ("title", "doi", "abstract", "authors", "keywords"):
        joined = joined.withColumn(c, F.coalesce(f"m_{c}", c))
    p, v = F.col("publication"), F.col("m_venue")
    made = F.struct(
        v["title"].alias("title"), F.col("m_isbn").alias("isbn"), F.col("m_issn").alias("issn"), F.col("m_publisher").alias("publisher"), v["category"].alias("category"),
        *(F.lit(None).cast("double").alias(x) for x in ("cite_score", "sjr", "snip")), F.array().cast("array<string>").alias("subject_areas"), F.lit(False).alias("is_potentially_predatory"),
    )
    filled = p
    for c in ("isbn", "issn", "publisher"):
        filled = filled.withField(c, F.coalesce(p[c], F.when(v.isNotNull(), F.col(f"m_{c}"))))
    filled = filled.withField("category", F.coalesce(p["category"], v["category"]))
    joined = joined.withColumn("publication", F.when(p.isNotNull(), filled).when(v.isNotNull(), made))
    joined = joined.withColumn("urls", union_sorted(F.array("urls", "m_urls")))
    return joined.select(*papers.columns)


def enrich_from_metrics(papers: DataFrame, metrics: DataFrame) -> DataFrame:
    """papers with journal metrics by ISSN, of metrics(issn, category, publisher, subject_areas, cite_score, sjr, snip).

    A category fills a missing one; publisher and scores replace what is there; subject areas are joined. Of
    several rows for an ISSN the first by its values counts.
    """
    m = metrics.filter("issn is not null").groupBy(F.col("issn").alias("m_issn")).agg(F.min(F.struct("category", "publisher", "subject_areas", "cite_score", "sjr", "snip")).alias("m"))
    p, q = F.col("publication"), F.col("m")
    new = p.withField("category", F.coalesce(p["category"], q["category"])).withField("subject_areas", union_sorted(F.array(p["subject_areas"], q["subject_areas"])))
    for c in ("publisher", "cite_score", "sjr", "snip"):
        new = new.withField(c, F.coalesce(q[c], p[c]))
    return papers.join(m, p["issn"] == F.col("m_issn"), "left").withColumn("publication", F.when(q.isNotNull(), new).otherwise(p)).select(*papers.columns)


def flag_predatory(papers: DataFrame, journals: DataFrame, publishers: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """papers whose publication is flagged if its title is among journals(name), its publisher among publishers(name,
    url), or the host of its resolved DOI, of resolved(doi, final_url), among the hosts of publishers.

    Names are trimmed and lower-cased on both sides. Three equi joins with distinct keys, so none multiplies rows.
    A flag holds for all papers of a publication_key, if papers have that column.
    """
    name = lambda c: F.lower(F.trim(c))
    listed = lambda df, value, flag: df.select(value.alias(f"k_{flag}")).filter(F.col(f"k_{flag}").isNotNull()).distinct().withColumn(flag, F.lit(True))
    out = papers
    sides = [("by_title", journals, name(F.col("name")), name(F.col("publication.title"))), ("by_publisher", publishers, name(F.col("name")), name(F.col("publication.publisher")))]
    if resolved is not None:
        out = out.join(resolved.groupBy("doi").agg(F.min("final_url").alias("final_url")), "doi", "left")
        sides.append(("by_host", publishers, host(F.col("url")), host(F.col("final_url"))))
    for flag, df, value, own in sides:
        out = out.withColumn("own", own)
        out = out.join(listed(df, value, flag), F.col("own") == F.col(f"k_{flag}"), "left").drop("own", f"k_{flag}")
    hit = F.coalesce(*(F.col(s[0]) for s in sides), F.lit(False))
    if "publication_key" in papers.columns:  # flagged keys are few; a window over all papers of a venue would be one task
        keys = out.filter(hit).select(F.col("publication_key").alias("k_hit")).distinct().withColumn("by_key", F.lit(True))
        out = out.join(keys, F.col("publication_key") == F.col("k_hit"), "left")
        hit = hit | F.coalesce("by_key", F.lit(False))
    p = F.col("publication")
    flagged = p.withField("is_potentially_predatory", F.coalesce(p["is_potentially_predatory"], F.lit(False)) | hit)
    return out.withColumn("publication", F.when(p.isNotNull(), flagged)).select(*papers.columns)
