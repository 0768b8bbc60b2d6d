"""Column functions on bibliographic records: keys, dates, pages, names, addresses, BibTeX. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.predicates import WORD

# Month names by their first three letters, BibTeX entry types by category.
MONTHS = {"jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12"}
ENTRY_TYPES = {"Journal": "@article", "Conference Proceedings": "@inproceedings", "Book": "@book"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def paper_key(title: Column, doi: Column, date: Column) -> Column:
    """DOI-<doi>, or the lower-cased title and the year."""
    return F.coalesce(F.concat(F.lit("DOI-"), doi), F.concat(F.lower(title), F.lit("|"), F.coalesce(F.year(date).cast("string"), F.lit(""))))


def publication_key(title: Column, issn: Column, isbn: Column) -> Column:
    return F.coalesce(F.concat(F.lit("ISSN-"), F.lower(issn)), F.concat(F.lit("ISBN-"), F.lower(isbn)), F.concat(F.lit("TITLE-"), F.lower(title)))


def category(text: Column) -> Column:
    """Journal, Conference Proceedings or Book, by the words in a venue's kind or title; else null."""
    t = F.lower(text)
    return F.when(t.contains("journal"), "Journal").when(t.contains("conference") | t.contains("proceeding"), "Conference Proceedings").when(t.contains("book"), "Book")


def month(text: Column) -> Column:
    """Two digits for a month's number or English name; 01 if it is neither."""
    number = F.when(text.rlike("^[0-9]{1,2}$"), text.cast("int"))
    return F.when(number.between(1, 12), F.lpad(number.cast("string"), 2, "0")).otherwise(F.coalesce(F.try_element_at(_map(MONTHS), F.lower(F.substring(text, 1, 3))), F.lit("01")))


def date_or_new_year(text: Column, pattern: str, year: Column) -> Column:
    """The parsed date, or the first of January of the year; null without either."""
    return F.coalesce(F.try_to_date(text, pattern), F.make_date(_int(year), F.lit(1), F.lit(1)))


def _int(text: Column) -> Column:
    return text.try_cast("int")


def page_count(first: Column, last: Column, signed: bool = False) -> Column:
    """Pages from first to last, both counted; null if either is no number. signed keeps the order of the two."""
    span = _int(last) - _int(first)
    return (span if signed else F.abs(span)) + 1


def page_range_count(pages: Column) -> Column:
    """Pages of a range "a-b"."""
    parts = F.split(pages, "-")
    return F.when(F.size(parts) == 2, page_count(F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))))


def citation_key(authors: Column, date: Column, title: Column) -> Column:
    """First author, year and first word of the title, of which letters, digits and underscores are kept."""
    author = F.when(F.size(authors) > 0, F.translate(F.lower(F.get(authors, F.lit(0))), " ,", ""))
    word = F.lower(F.get(F.split(F.trim(title), r"\s+"), F.lit(0)))
    return F.regexp_replace(F.concat(F.coalesce(author, F.lit("unknown")), F.coalesce(F.year(date).cast("string"), F.lit("XXXX")), F.coalesce(word, F.lit(""))), f"[^{WORD}]", "")


def file_name(date: Column, title: Column) -> Column:
    """<year>-<title>.pdf with all but letters, digits, underscores and hyphens replaced."""
    return F.concat(F.regexp_replace(F.concat(F.year(date).cast("string"), F.lit("-"), title), f"[^{WORD}-]", "_"), F.lit(".pdf"))


def host(url: Column) -> Column:
    """A web address's host without www., lower-cased; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", F.replace(found, F.lit("www."), F.lit("")))


def split_keywords(text: Column) -> Column:
    """Keywords between commas, or else semicolons: trimmed, distinct, without blanks; one keyword stays one."""
    parts = F.split(text, F.when(text.contains(","), F.lit(",")).otherwise(F.lit(";")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda k: k != ""))


def longest(values: Column) -> Column:
    """The longest of an array of strings, the first of these; null for none."""
    ranked = F.transform(values, lambda v, i: F.struct(-F.length(v), i, v.alias("v")))
    return F.array_min(F.filter(ranked, lambda r: r["v"].isNotNull()))["v"]


def union_sorted(arrays: Column) -> Column:
    """All values of an array of arrays, distinct and sorted, without nulls."""
    return F.sort_array(F.array_distinct(F.filter(F.flatten(F.filter(arrays, lambda a: a.isNotNull())), lambda v: v.isNotNull())))


def pdf_url(url: Column, doi: Column) -> Column:
    """Where a publisher's landing page has its PDF, by rules on the host; null where no rule fits."""
    bare = F.regexp_replace(F.regexp_extract(url, r"^https://[^/?#]+([^?#]*)", 1), "/$", "")
    last = F.element_at(F.split(bare, "/"), -1)
    change = lambda *pairs: _replaced(url, pairs)
    number = F.regexp_extract(url, r"[?&]arnumber=([^&#]+)", 1)
    document = F.when(bare.startswith("/document/"), F.substr(bare, F.lit(11))).otherwise(F.when(number != "", number))
    acm = F.coalesce(doi, F.when(bare.startswith("/doi/") & ~bare.contains("/doi/pdf/"), F.substr(bare, F.lit(6))))
    final = F.element_at(F.split(url, "/"), -1)
    padded = F.when(F.length(final) < 4, F.lpad(final, 4, "0")).otherwise(final)
    # Hosts and the places of their PDF files.
    rules = [
        (("dl.acm.org",), F.concat(F.lit("https://dl.acm.org/doi/pdf/"), acm)),
        (("ieeexplore.ieee.org",), F.concat(F.lit("https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber="), document)),
        (("www.sciencedirect.com", "linkinghub.elsevier.com"), F.concat(F.lit("https://www.sciencedirect.com/science/article/pii/"), last, F.lit("/pdfft?isDTMRedir=true&download=true"))),
        (("pubs.rsc.org",), change(("/articlelanding/", "/articlepdf/"))),
        (("www.tandfonline.com", "www.frontiersin.org"), change(("/full", "/pdf"))),
        (("pubs.acs.org", "journals.sagepub.com", "royalsocietypublishing.org"), change(("/doi", "/doi/pdf"))),
        (("link.springer.com",), F.concat(change(("/article/", "/content/pdf/"), ("%2F", "/")), F.lit(".pdf"))),
        (("www.isca-speech.org",), change(("/abstracts/", "/pdfs/"), (".html", ".pdf"))),
        (("onlinelibrary.wiley.com",), change(("/full/", "/pdfdirect/"), ("/abs/", "/pdfdirect/"))),
        (("www.jmir.org", "www.mdpi.com"), F.concat(url, F.lit("/pdf"))),
        (("www.pnas.org",), F.concat(change(("/content/", "/content/pnas/")), F.lit(".full.pdf"))),
        (("www.jneurosci.org",), F.concat(change(("/content/", "/content/jneuro/")), F.lit(".full.pdf"))),
        (("www.ijcai.org",), F.concat(F.regexp_extract(url, "^(.*/)", 1), padded, F.lit(".pdf"))),
        (("asmp-eurasipjournals.springeropen.com",), change(("/articles/", "/track/pdf/"))),
    ]
    site = F.lower(F.regexp_extract(url, r"^https://([^/:?#]+)", 1))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for hosts, target in rules:
        out = out.when(site.isin(*hosts), target)
    return out


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def bibtex(paper: dict[str, Column]) -> Column:
    """One BibTeX entry. paper: title, authors, publication_title (null: unpublished), category, publisher, publication_date, urls, comments, pages, has_publication."""
    p, date = paper, F.date_format(paper["publication_date"], "yyyy/MM/dd")
    kind = F.when(~p["has_publication"], "@unpublished").otherwise(F.coalesce(F.try_element_at(_map(ENTRY_TYPES), p["category"]), F.lit("@misc")))
    url = F.when(F.size(p["urls"]) > 0, F.get(F.sort_array(p["urls"]), F.lit(0)))
    known = F.concat(F.coalesce(F.concat(F.lit("Available at "), url), F.lit("")), F.coalesce(F.concat(F.lit(" ("), date, F.lit(")")), F.lit("")))
    note = F.concat(known, F.when(p["comments"].isNull(), "").when(known == "", p["comments"]).otherwise(F.concat(F.lit(" | "), p["comments"])))
    line = lambda name, value: F.concat(F.lit(f"    {name} = {{"), value, F.lit("}"))
    fields = [
        line("title", p["title"]),
        F.when(F.size(p["authors"]) > 0, line("author", F.array_join(p["authors"], " and "))),
        F.when(kind == "@unpublished", line("note", note)).when(kind == "@article", line("journal", p["publication_title"])).when(kind == "@inproceedings", line("booktitle", p["publication_title"])).when((kind == "@misc") & url.isNotNull(), line("howpublished", F.concat(F.lit("Available at "), url, F.lit(" ("), date, F.lit(")")))),
        F.when(p["has_publication"], line("publisher", p["publisher"])),
        line("year", F.year(p["publication_date"]).cast("string")),
        line("pages", p["pages"]),
    ]
    head = F.concat(kind, F.lit("{"), citation_key(p["authors"], p["publication_date"], p["title"]), F.lit(",\n"))
    return F.concat(head, F.concat_ws(",\n", *fields), F.lit("\n}\n"))
