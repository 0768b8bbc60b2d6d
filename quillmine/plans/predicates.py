"""Queries as Catalyst predicates. AND and AND NOT bind tighter than OR; null text matches nothing."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .query import Group, Term, alternatives, map_terms

#: What belongs to a word; the same in Java's regular expressions and in RE2.
WORD = r"\p{L}\p{N}_"


def term_pattern(text: str) -> str:
    """A regular expression over lower-cased text: the phrase between word borders, ? one word character, * any number."""
    body = "".join(f"[{WORD}]" if c == "?" else f"[{WORD}]*" if c == "*" else c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in text.lower())
    return f"(^|[^{WORD}]){re.sub(' +', ' ', body.strip())}([^{WORD}]|$)"


def term_predicate(term: Term, field: Column) -> Column:
    return F.coalesce(F.lower(field).rlike(term_pattern(term.text)), F.lit(False))


def per_term(node: Term | Group, fields: list[Column]) -> Column:
    """Each term may stand in any of the fields."""
    return _fold(node, lambda t: reduce(or_, (term_predicate(t, f) for f in fields)))


def whole_query(node: Term | Group, fields: list[Column]) -> Column:
    """One of the fields satisfies the whole query."""
    return reduce(or_, (_fold(node, lambda t, f=f: term_predicate(t, f)) for f in fields))


def _fold(node: Term | Group, leaf: Callable[[Term], Column]) -> Column:
    if isinstance(node, Term):
        return leaf(node)
    parts = [[~_fold(m, leaf) if negated else _fold(m, leaf) for negated, m in both] for both in alternatives(node)]
    return reduce(or_, (reduce(and_, p) for p in parts))


def any_or_all(groups: list[tuple[str, list[str]]], fields: list[Column]) -> Column:
    """Groups of terms, each matched as any or all of its terms; a row needs one group."""
    match = lambda text: reduce(or_, (term_predicate(Term(text), f) for f in fields))
    return reduce(or_, (reduce(and_ if kind == "match-all" else or_, map(match, words)) for kind, words in groups))


def for_source(source: str, node: Group, title: Column, abstract: Column, keywords: Column | None = None) -> Column:
    """The query with the field scope that a source gives it."""
    if source == "arXiv":  # a hyphen is a space there, in terms and in texts
        spaced = lambda c: F.translate(c, "-", " ")
        return whole_query(map_terms(node, lambda t: t.replace("-", " ")), [spaced(title), spaced(abstract)])
    if source == "IEEE":
        return per_term(node, [abstract])
    if source == "Scopus":
        return per_term(node, [title, abstract, *([keywords] if keywords is not None else [])])
    if source in ("medRxiv", "bioRxiv"):
        from .dialects import rxiv_groups

        return any_or_all(rxiv_groups(node), [F.concat_ws(" ", title, abstract)])
    return per_term(node, [title, abstract])
