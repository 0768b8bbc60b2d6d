import re

import pytest
from pyspark.sql import functions as F

from quillmine import api
from quillmine.operators.token_index import TokenIndex, postings_of, term_tokens
from quillmine.schema import SOURCES, conform
from quillmine.spec import SearchSpec

TEXTS = [
    ("Deep sea", "The peace of mind."), ("deep-sea", "peace  of mind; of the peace"), ("Sea deep", "mind of peace"), ("Joy", "joyful_1 JOY, enjoy"), ("Être", "l'être et le néant"),
    ("peace", "of mind"), ("x", None), ("y", ""), ("C++", "c plus c++ code"), ("tail peace of", "mind the gap"),
]
QUERIES = [
    "[peace of mind]", "[deep sea]", "[deep-sea]", "[joy*]", "[jo?]", "[enjo?] OR [être]", "[mind] AND NOT [sea]", "[of] AND ([gap] OR [code])", "[c++]", "[peace of] AND [mind]", "[nowhere]", "[nowhere] OR [sea]", "([mind] AND [of]) OR ([joy] AND NOT [x])", "[+]",
]


@pytest.fixture(scope="module")
def papers(spark):
    rows = [(k * len(SOURCES) + i, t, a, s) for k, (t, a) in enumerate(TEXTS) for i, s in enumerate(SOURCES)]
    raw = spark.createDataFrame(rows, "seq bigint, title string, abstract string, source string")
    return conform(raw.withColumn("publication_date", F.lit("2020-01-01").cast("date")).withColumn("keywords", F.array(F.lit("key word"))))


@pytest.fixture(scope="module")
def index(papers, tmp_path_factory):
    return TokenIndex.build(papers, str(tmp_path_factory.mktemp("index") / "tokens"), 8)


@pytest.mark.parametrize("query", QUERIES)
def test_results_equal_a_scan(papers, index, query):
    spec = SearchSpec(query)
    rows = lambda df: sorted(r.seq for r in api.select(df, spec).select("seq").collect())
    assert rows(index.narrow(papers, spec.tree)) == rows(papers)


def test_only_the_tokens_of_the_query_are_read(spark, index):
    plan = index.with_term("peace of mind")._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[[^]]*\]", plan)
    assert len(scans) == 3 and all(re.search(r"bucket#\d+ = \d+", s) for s in scans) and plan.count("EqualTo(token,") >= 3
    assert "StringStartsWith(token,jo)" in index.of_token("jo?")._jdf.queryExecution().executedPlan().toString()
    assert index.candidates(SearchSpec("[peace of mind]").tree).count() < 30
    assert index.candidates(SearchSpec("[+]").tree) is None


def test_tokens_of_terms():
    assert term_tokens("Deep-sea fish*") == ["deep", "sea", "fish*"] and term_tokens("c++") == ["c"] and term_tokens("+") == []


def test_postings_are_made_without_moving_words(spark, tmp_path):
    texts = {1: ["a", "b", "a"], 2: [], 3: None, 4: ["é"] * 3, 5: [str(i % 700) for i in range(600_000)], 6: ["b"]}
    made = postings_of(spark.createDataFrame(list(texts.items()), "seq bigint, tokens array<string>"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = {(t, s): [i for i, x in enumerate(xs) if x == t] for s, xs in texts.items() if s != 5 for t in set(xs or ())} | {(str(k), 5): list(range(k, 600_000, 700)) for k in range(700)}
    assert {(r.token, r.seq): list(r.places) for r in made.collect()} == want
