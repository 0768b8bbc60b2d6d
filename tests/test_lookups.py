import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillmine import api
from quillmine.operators import enrich
from quillmine.operators import normalize as n
from quillmine.schema import conform
from quillmine.sources import captures, lookups
from quillmine.spec import SearchSpec

#: Workers and tests share it; one test runs at a time.
ASKED = "/tmp/quillmine-test-lookups"


def noted(url):
    """Made-up details, metrics, pages and DOIs; each address is noted with its time."""
    with open(ASKED, "a") as f:
        f.write(f"{time.time()} {url}\n")
    if "down" in url:
        raise OSError("down")
    if "abstract/" in url:
        assert "apiKey=s3cret" in url
        return 200, f"<a><ce:para>Abstract <i>of</i> {url.split('?')[0][-1]}</ce:para><ce:indexed-name>Lee A.</ce:indexed-name></a>"
    if "/serial/" in url:
        assert "apiKey=s3cret" in url
        return 200, json.dumps({"serial-metadata-response": {"entry": [{"dc:publisher": "House", "prism:issn": "other", "SJRList": {"SJR": [{"$": "1.5"}]}}]}})
    if "doi.org" in url:
        return 200, "https://evil.example.org/x"
    return 200, f'<meta name="citation_title" content="A longer title of {url[-1]}">'


@pytest.fixture
def asked():
    if os.path.exists(ASKED):
        os.unlink(ASKED)
    return lambda: [(float(x.split()[0]), x.split()[1]) for x in open(ASKED)] if os.path.exists(ASKED) else []


ASK = {"delay": 0.0, "pause": "0", "fetch": "tests.test_lookups.noted"}


def test_a_second_run_asks_nothing(spark, tmp_path, asked):
    urls = spark.createDataFrame([(f"http://h{i % 3}/{i}",) for i in range(20)] + [("http://h1/1",), ("http://down/1",), (None,)], "url string")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = lookups.looked_up(urls, cache, round_size=6, **ASK)
        assert sorted(r.url for r in got.collect()) == sorted(f"http://h{i % 3}/{i}" for i in range(20))
    found = [u for _, u in asked()]
    assert len([u for u in found if "down" not in u]) == len({u for u in found if "down" not in u}) == 20
    assert found.count("http://down/1") == 4  # twice each run: it has no answer to keep
    more = lookups.looked_up(urls.unionByName(spark.createDataFrame([("http://h9/new",)], "url string")), cache, **ASK)
    assert more.count() == 21 and len([u for _, u in asked() if "down" not in u]) == 21


def test_no_host_is_asked_faster_than_its_pace(spark, tmp_path, asked):
    urls = spark.createDataFrame([(f"http://h{i % 3}/{i}",) for i in range(12)], "url string").repartition(6)
    lookups.looked_up(urls, str(tmp_path / "cache"), **(ASK | {"delay": 0.3})).count()
    for name in ("h0", "h1", "h2"):
        times = sorted(t for t, u in asked() if f"//{name}/" in u)
        assert len(times) == 4 and min(b - a for a, b in zip(times, times[1:], strict=False)) >= 0.29


def test_a_round_that_fails_keeps_those_before(spark, tmp_path, asked, monkeypatch):
    urls, cache = spark.createDataFrame([(f"http://h/{i}",) for i in range(20)], "url string"), str(tmp_path / "cache")
    add, calls = lookups.Cache.add, []
    monkeypatch.setattr(lookups.Cache, "add", lambda self, df: add(self, df) if not calls.append(1) and len(calls) < 3 else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        lookups.looked_up(urls, cache, round_size=5, **ASK)
    before = len(asked())
    assert 0 < before < 20
    monkeypatch.setattr(lookups.Cache, "add", add)
    assert lookups.looked_up(urls, cache, round_size=5, **ASK).count() == 20
    assert len(asked()) == 20


def test_rounds_are_few(spark, tmp_path, asked, monkeypatch):
    assert lookups.round_ends(0, 5) == [] and lookups.round_ends(12, 5) == [5, 10, 12] and lookups.round_ends(20, 100) == [20]
    ends = lookups.round_ends(375_000, 50)
    assert len(ends) < 20 and ends[:4] == [50, 100, 200, 400] and max(b - a for a, b in zip(ends, ends[1:], strict=False)) == lookups.ROUND
    urls, add, sizes = spark.createDataFrame([(f"http://h{i % 7}/{i}",) for i in range(600)], "url string"), lookups.Cache.add, []
    monkeypatch.setattr(lookups.Cache, "add", lambda self, df: (add(self, df), sizes.append(len(asked()))))
    assert lookups.looked_up(urls, str(tmp_path / "cache"), round_size=5, **ASK).count() == 600
    assert len(sizes) <= 9 and sizes[-1] == 600  # 120 rounds of 5 before


def test_details_metrics_pages_and_dois(spark, tmp_path, asked):
    entries = [{"dc:title": f"T{i}", "prism:coverDate": "2020-05-06", "prism:url": f"http://s/abstract/{i}", "prism:issn": "1-2", "prism:publicationName": "J", "prism:doi": "10.1/s" if i else None} for i in range(2)]
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"search-results": {"entry": entries}}))
    raw = captures.read_scopus(spark, str(path))
    cache = str(tmp_path / "cache")
    with pytest.raises(ValueError):
        lookups.scopus_details(raw, cache, **ASK)
    a, b = n.scopus(raw, lookups.scopus_details(raw, cache, "s3cret", **ASK)).orderBy("seq").collect()
    assert (a.abstract, b.abstract, a.authors) == ("Abstract of 0", "Abstract of 1", ["Lee A."])
    papers = conform(n.scopus(raw).withColumn("urls", F.array(F.lit("http://p/1"), F.lit("http://p/x.pdf")))).withColumn("seq", F.col("seq.position"))
    made = lookups.tables(papers, str(tmp_path / "more"), "s3cret", **ASK)
    with_metrics = enrich.enrich_from_metrics(papers, made["metrics"]).first()
    assert (with_metrics.publication.sjr, with_metrics.publication.publisher) == (1.5, "House")
    assert {r.url for r in made["pages"].collect()} == {"http://p/1", "https://doi.org/10.1/s"}
    assert [tuple(r) for r in made["resolved"].collect()] == [("10.1/s", "https://evil.example.org/x")]
    publishers = spark.createDataFrame([("Evil", "http://evil.example.org")], "name string, url string")
    journals = spark.createDataFrame([], "name string, url string")
    spec = SearchSpec("[t0] OR [t1]", databases=("Scopus",))
    out = {r.title: r for r in api.run(papers, spec, journals=journals, publishers=publishers, **made).collect()}
    assert set(out) == {"A longer title of 1", "T1"} and out["T1"].publication.is_potentially_predatory
    for r in spark.read.parquet(cache).collect():
        assert "s3cret" not in str(r)
