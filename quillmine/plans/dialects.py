"""Queries as the text that each remote source takes. Pure functions of the query tree and the search's bounds."""

from __future__ import annotations

import datetime as dt
from urllib.parse import quote_plus, urlencode

from .query import Group, QueryError, Term, depth, render, terms

# The remote interfaces' addresses, page sizes and codes of publication types.
ARXIV_URL, ARXIV_PAGE = "http://export.arxiv.org/api/query", 200
PUBMED_URL, PUBMED_PAGE = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils", 50
IEEE_URL, IEEE_PAGE = "http://ieeexploreapi.ieee.org/api/v1/search/articles", 200
SCOPUS_URL = "https://api.elsevier.com/content/search/scopus"
RXIV_URL, RXIV_PAGE = "https://www.medrxiv.org/search", 75
IEEE_TYPES = {"conference proceedings": ["Conferences"], "journal": ["Journals"], "book": ["Books"], "other": ["Courses", "Early Access", "Magazines", "Standards"]}
SCOPUS_TYPES = {"conference proceedings": ["p"], "journal": ["j"], "book": ["b", "k"], "other": ["r", "d"]}


def arxiv_query(node: Group) -> str:
    """All of the query over titles, or all of it over abstracts; hyphens become spaces, wildcard terms aren't quoted."""
    def one(field: str) -> str:
        term = lambda t: f"{field}:{t.text}" if t.wildcard else f'{field}:"{t.text}"'
        return render(node, term, {"AND NOT": "ANDNOT"}).replace("-", " ")

    return f"({one('ti')}) OR ({one('abs')})"


def arxiv_url(node: Group, start: int = 0) -> str:
    return f"{ARXIV_URL}?" + urlencode({"search_query": arxiv_query(node), "start": start, "sortBy": "submittedDate", "sortOrder": "descending", "max_results": ARXIV_PAGE})


def pubmed_query(node: Group, since: dt.date | None, until: dt.date | None, today: dt.date) -> str:
    """Titles or abstracts for each term; journal articles with an abstract, between two days."""
    asked = render(node, lambda t: f'"{t.text}"[TIAB]', {"AND NOT": "NOT"})
    lo, hi = (since or dt.date(1, 1, 1)).strftime("%Y/%m/%d").rjust(10, "0"), (until or today).strftime("%Y/%m/%d")
    return f'{asked} AND has abstract [FILT] AND "journal article"[Publication Type] AND {lo}:{hi}[Date - Publication]'


def pubmed_url(node: Group, since: dt.date | None, until: dt.date | None, today: dt.date, start: int = 0) -> str:
    return f"{PUBMED_URL}/esearch.fcgi?" + urlencode({"db": "pubmed", "term": pubmed_query(node, since, until, today), "retstart": start, "retmax": PUBMED_PAGE, "sort": "pub+date"}, safe="+")


def ieee_query(node: Group) -> str:
    return render(node, lambda t: f'"Abstract":"{t.text}"', {"AND NOT": "NOT"})


def ieee_url(node: Group, token: str, since: dt.date | None, until: dt.date | None, types: list[str] | None, start: int = 1) -> str:
    """Years bound the dates; each type stands for one or more content types."""
    asked = {"querytext": f"({ieee_query(node)})", "format": "json", "apikey": token, "max_records": IEEE_PAGE, "start_record": start}
    asked |= {"start_year": since.year} if since else {}
    asked |= {"end_year": until.year} if until else {}
    kinds = [k for t in types or [] for k in IEEE_TYPES.get(t, [])]
    return f"{IEEE_URL}?" + urlencode(asked) + "".join("&content_type=" + quote_plus(k) for k in kinds)


def scopus_query(node: Group, since: dt.date | None, until: dt.date | None, types: list[str] | None) -> str:
    """Exact terms in braces, wildcard terms in quotes; years and source types bound the result."""
    out = f"TITLE-ABS-KEY({render(node, lambda t: f'{chr(34)}{t.text}{chr(34)}' if t.wildcard else f'{{{t.text}}}')})"
    out += f" AND PUBYEAR > {since.year - 1}" if since else ""
    out += f" AND PUBYEAR < {until.year + 1}" if until else ""
    kinds = [k for t in types or [] for k in SCOPUS_TYPES.get(t, [])]
    return out + (f" AND SRCTYPE({' OR '.join(kinds)})" if kinds else "")


def scopus_url(node: Group, token: str, since: dt.date | None, until: dt.date | None, types: list[str] | None) -> str:
    return f"{SCOPUS_URL}?" + urlencode({"query": scopus_query(node, since, until, types), "sort": "coverDate", "apiKey": token})


def rxiv_groups(node: Group) -> list[tuple[str, list[str]]]:
    """(match-any or match-all, terms) for each alternative; raises QueryError for what the source can't answer."""
    if any(t.wildcard for t in terms(node)):
        raise QueryError("this source takes no wildcards")
    if depth(node) > 1:
        raise QueryError("this source takes one level of parentheses")
    groups = [m for m in node.members if isinstance(m, Group)]
    if groups and (len(groups) != len(node.members) or set(node.connectors) - {"OR"}):
        raise QueryError("this source takes only OR between parentheses, and no terms beside them")
    out = []
    for g in groups or [node]:
        kinds = set(g.connectors)
        if "AND NOT" in kinds or len(kinds) > 1:
            raise QueryError("this source takes one kind of connector in a group, AND or OR")
        out.append(("match-any" if kinds == {"OR"} else "match-all", [m.text for m in g.members if isinstance(m, Term)]))
    return out


def rxiv_urls(node: Group, database: str, since: dt.date | None, until: dt.date | None, today: dt.date) -> list[str]:
    """One address for each alternative; both databases share a host."""
    out = []
    for kind, words in rxiv_groups(node):
        title = quote_plus(" ".join(words) if len(words) == 1 else " ".join(f'"{w}"' for w in words))
        parts = [f"abstract_title%3A{title}", f"abstract_title_flags%3A{kind}", f"jcode%3A{database.lower()}", f"limit_from%3A{since or dt.date(1970, 1, 1)}", f"limit_to%3A{until or today}", f"numresults%3A{RXIV_PAGE}", "sort%3Apublication-date%20direction%3Adescending", "format_result%3Acondensed"]
        out.append(f"{RXIV_URL}/" + "%20".join(parts))
    return out
