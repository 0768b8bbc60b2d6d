import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmine.plans import dialects as dia
from quillmine.plans.predicates import for_source, per_term, whole_query
from quillmine.plans.query import Group, QueryError, Term, depth, is_valid, map_terms, parse, render, sanitize, terms, tree
from quillmine.spec import SearchSpec, from_environment

ACCEPTED = ["([red] OR [blue])", "[red] OR [blue]", "[red] AND [blue]", "[red] AND NOT ([blue] OR [green])", "[red] OR ([blue] AND ([green] OR [grey]))", "[red]", "[red] OR ([blue] AND ([gree*] OR [r?d]))"]
REJECTED = ["[a] OR ([b] AND ([c] OR [d])", "[a] or [b]", "[a] and [b]", "[a] and not [b]", "([a] OR [b]", "a OR [b]", "[a] [b]", "[a] XOR [b]", "[a] OR NOT [b]", "[] AND [b]", "[ ] AND [b]", "[ ]", "[", "[a]OR[b]", "[a][b]", "( AND [a])", "[a]) AND ([b]", "", "()", "[a] AND", "a"]
WILDCARDS = ["[some term*]", "[?erm]", "[te*]", "[ter*s]", "[t?rm?]", "[*]"]


@pytest.mark.parametrize("q", ACCEPTED)
def test_accepted(q):
    assert is_valid(q)


@pytest.mark.parametrize("q", REJECTED)
def test_rejected(q):
    assert not is_valid(q) and not is_valid(q, strict=False)


@pytest.mark.parametrize("q", WILDCARDS)
def test_wildcard_rules_are_strict_only(q):
    assert not is_valid(q) and is_valid(q, strict=False)


def test_sanitize():
    assert sanitize("  ([a]\n\nOR\t [b])  AND [c*]") == "([a] OR [b]) AND [c*]"


def test_tree_and_depth():
    q = parse("[a] AND NOT [b] OR ([c] AND ([d] OR [e]))")
    t = tree(q)
    assert [c["node_type"] for c in t["children"]] == ["term", "connector", "term", "connector", "group"]
    assert t["children"][1]["value"] == "AND NOT" and t["children"][4]["children"][2]["node_type"] == "group"
    assert [depth(parse(x)) for x in ("[a]", "([a])", "([a] OR ([b]))", "([a] OR ([b] AND ([c])))")] == [0, 1, 2, 3]
    assert [x.text for x in terms(map_terms(q, str.upper))] == list("ABCDE")


nodes = st.recursive(st.text("abc xyz", min_size=1, max_size=5).filter(lambda s: s.strip() and s == sanitize(s)).map(Term), lambda inner: st.lists(inner, min_size=1, max_size=3).flatmap(lambda m: st.lists(st.sampled_from(["AND", "OR", "AND NOT"]), min_size=len(m) - 1, max_size=len(m) - 1).map(lambda c: Group(tuple(m), tuple(c)))), max_leaves=8)


@given(nodes)
def test_round_trip(node):
    node = node if isinstance(node, Group) else Group((node,))
    assert parse(render(node)) == node


def test_dialects():
    q = parse("[deep-sea] AND ([fish*] OR [whale]) AND NOT [boat]")
    one = lambda f: f'{f}:"deep sea" AND ({f}:fish* OR {f}:"whale") ANDNOT {f}:"boat"'
    assert dia.arxiv_query(q) == f"({one('ti')}) OR ({one('abs')})"
    text = dia.pubmed_query(q, None, None, dt.date(2024, 5, 6))
    assert text.startswith('"deep-sea"[TIAB] AND ("fish*"[TIAB] OR "whale"[TIAB]) NOT "boat"[TIAB]') and "0001/01/01:2024/05/06" in text and "has abstract" in text
    assert dia.ieee_query(q) == '"Abstract":"deep-sea" AND ("Abstract":"fish*" OR "Abstract":"whale") NOT "Abstract":"boat"'
    assert dia.scopus_query(q, dt.date(2019, 1, 1), None, ["book"]) == 'TITLE-ABS-KEY({deep-sea} AND ("fish*" OR {whale}) AND NOT {boat}) AND PUBYEAR > 2018 AND SRCTYPE(b OR k)'
    assert "start_year=2019" in dia.ieee_url(q, "t", dt.date(2019, 1, 1), None, ["other"]) and "content_type=Early+Access" in dia.ieee_url(q, "t", None, None, ["other"])
    assert "start=200" in dia.arxiv_url(q, 200) and "retstart=50" in dia.pubmed_url(q, None, None, dt.date(2024, 1, 1), 50)


def test_preprint_dialect():
    assert dia.rxiv_groups(parse("([a] OR [b c]) OR ([d] AND [e])")) == [("match-any", ["a", "b c"]), ("match-all", ["d", "e"])]
    assert len(dia.rxiv_urls(parse("([a] OR [b]) OR ([c])"), "bioRxiv", None, None, dt.date(2024, 1, 1))) == 2
    for bad in ("[term*]", "[a] AND NOT [b]", "[a] OR (([b] OR [c]) AND [d])", "([a] OR [b]) AND ([c] OR [d])", "[a] OR [b] AND [c]"):
        with pytest.raises(QueryError):
            dia.rxiv_groups(parse(bad))


def test_predicates(spark):
    rows = [(1, "son", "x"), (2, "song of", "joy"), (3, "Songs", None), (4, None, "the son-in law"), (5, "per_son", "sonic"), (6, "Größe song", "")]
    df = spark.createDataFrame(rows, "id int, title string, abstract string")
    ids = lambda q, f=per_term, cols=("title", "abstract"): [r.id for r in df.filter(f(parse(q), [F.col(c) for c in cols])).orderBy("id").collect()]
    assert ids("[son]") == [1, 4]
    assert ids("[son?]") == [2, 6]
    assert ids("[son*]") == [1, 2, 3, 4, 5, 6]
    assert ids("[größe] OR [joy] AND [song]") == [2, 6]  # AND binds tighter
    assert ids("[song] AND NOT [joy]") == [6]
    assert ids("[song] AND [joy]", whole_query) == []
    arxiv = df.filter(for_source("arXiv", parse("[son in law]"), F.col("title"), F.col("abstract")))
    assert [r.id for r in arxiv.collect()] == [4]
    assert [r.id for r in df.filter(for_source("IEEE", parse("[son]"), F.col("title"), F.col("abstract"))).collect()] == [4]


def test_spec():
    s = SearchSpec(" [a]  OR [b] ", databases=("ARXIV", "arxiv"), publication_types=("Journal",))
    assert s.query == "[a] OR [b]" and s.databases == ("arXiv",) and s.publication_types == ("journal",)
    for bad in ({"databases": ("nowhere",)}, {"publication_types": ("poster",)}, {"limit": 0}, {"since": dt.date(2020, 1, 2), "until": dt.date(2020, 1, 1)}, {"query": "a"}):
        with pytest.raises(ValueError):
            SearchSpec(**({"query": "[a]"} | bad))


def test_query_of_the_environment(monkeypatch):
    monkeypatch.setenv("QUILLMINE_QUERY", "[x]  AND [y]")
    assert from_environment(limit=3).query == "[x] AND [y]" and from_environment(query="[z]").query == "[z]"
    monkeypatch.delenv("QUILLMINE_QUERY")
    with pytest.raises(ValueError):
        from_environment()
