"""Lookups of live sources by key, as joins: details of Scopus entries, journal metrics by ISSN, pages, and where DOIs lead.

Answers are kept in a cache, a Parquet table by address in shared storage: what it has isn't asked again, whoever asks.
New addresses are asked in rounds, each of which is added to the cache when it is done, so that a job that is lost loses one
round at most; a round is as large as those before it together, so that there are few of them. A host's addresses are one task's, which keeps to the host's pace. An address that gives no answer is left out of the cache
and asked again by the next run.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import host
from ..operators.enrich import visited
from ..operators.normalize import serial_metrics
from ..scratch import Scratch
from ..spec import credentials
from .captures import SERIALS, parse_details
from .live import PAUSE, TIMEOUT, TOKEN, HttpReader

#: Addresses of the largest rounds, if the first isn't larger.
ROUND = 100_000
CACHE = "url string, status int, body string"
# Fixed value: where a journal's metrics are by ISSN.
SERIAL_URL = "https://api.elsevier.com/content/serial/title/issn/"


def resolve(url: str) -> tuple[int, str]:
    """Status of an address and, for its body, the address that it leads to."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "quillmine"}), timeout=TIMEOUT) as answer:
        return answer.status, answer.geturl()


class Cache:
    """Answers by address: folders of Parquet, one for each round that was finished."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self.at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        """url, status, body of all that is known; of an address asked twice (by two jobs at once) one answer."""
        if not self.fs.exists(self.at):
            return self.spark.createDataFrame([], CACHE)
        return self.spark.read.schema(CACHE).parquet(self.root).dropDuplicates(["url"])

    def add(self, answers: DataFrame) -> None:
        """Adds a round's answers, all or none of them."""
        answers.select("url", "status", "body").write.mode("append").parquet(self.root)


def asked(urls: DataFrame, delay: float = 1.0, token: str = "", **options: str) -> DataFrame:
    """url, status, body of addresses of urls(url, host); all of a host are asked by one task, `delay` seconds or more apart,
    retries too. A pace that a host allows is one that a task can keep; hosts are asked side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = HttpReader({"pause": max(delay, PAUSE)} | options), {}
        get = reader.getter()
        for batch in batches:
            rows = []
            for url, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wait = last.get(name, float("-inf")) + delay - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                status, body, _ = reader.tried(get, url.replace(TOKEN, token) if token else url)
                last[name] = time.monotonic()
                rows.append((url, status, body))
            kinds = (pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 3, kinds, strict=True)], names=["url", "status", "body"])

    return urls.select("url", "host").repartition("host").mapInArrow(run, CACHE)


def round_ends(count: int, first: int, most: int = ROUND) -> list[int]:
    """Where rounds end: the first has so many addresses, later ones as many as those before them together, or `most`."""
    ends = []
    while count > (done := ends[-1] if ends else 0):
        ends.append(min(count, done + max(first, min(done, most))))
    return ends


def looked_up(urls: DataFrame, cache: str, round_size: int = ROUND, **options) -> DataFrame:
    """url, status, body of every distinct address of urls(url) that has an answer, from the cache or, if it lacks one, asked
    now. Addresses stand for tokens as live.TOKEN, also in the cache; null ones are left out. The first round has round_size
    addresses, about, and a lost job loses no more than that or, later, than what is done already."""
    spark = urls.sparkSession
    known, scratch = Cache(spark, cache), Scratch(spark, "lookup")
    wanted = scratch.save(urls.select("url").filter("url is not null").distinct(), "wanted")
    new = scratch.save(wanted.join(known.read().select("url"), "url", "left_anti").withColumn("host", F.coalesce(host(F.col("url")), F.lit(""))), "new")
    count = new.count()
    ends = round_ends(count, round_size)
    if len(ends) > 1:  # dealt out once, so that each round reads its own addresses
        place = F.pmod(F.xxhash64("url", F.lit(3)), F.lit(count))
        number = sum(((place >= end).cast("int") for end in ends[:-1]), F.lit(0))
        new = scratch.save(new.withColumn("round", number).repartition("round"), "dealt", by="round")
    for k in range(len(ends)):
        part = new if len(ends) == 1 else new.filter(F.col("round") == k)
        known.add(asked(part, **options).filter("body is not null"))
    return wanted.join(known.read(), "url")


def _keyed(source: str, token: str, options: dict) -> dict:
    token = token or credentials().get(source, "")
    if not token:
        raise ValueError(f"{source} needs a token")
    return options | {"token": token}


def scopus_details(entries: DataFrame, cache: str, token: str = "", **options) -> DataFrame:
    """Details of Scopus entries, as normalize.scopus takes them, of entries with an address in prism:url."""
    at = F.concat("url", F.lit(f"?apiKey={TOKEN}&httpAccept=text%2Fxml"))
    urls = entries.select(F.col("`prism:url`").alias("url")).filter("url is not null").distinct()
    got = looked_up(urls.select(at.alias("url")), cache, **_keyed("Scopus", token, options))
    named = got.select(F.substring_index("url", "?apiKey=", 1).alias("url"), F.col("body").alias("value"))
    return parse_details(named)


def journal_metrics(papers: DataFrame, cache: str, token: str = "", **options) -> DataFrame:
    """Metrics of the journals whose ISSN papers have, as enrich_from_metrics takes them."""
    issn = papers.select(F.col("publication.issn").alias("issn")).filter("issn is not null").distinct()
    got = looked_up(issn.select(F.concat(F.lit(SERIAL_URL), F.col("issn"), F.lit(f"?apiKey={TOKEN}")).alias("url")), cache, **_keyed("Scopus", token, options))
    asked_for = F.regexp_extract("url", r"/issn/([^?]*)", 1)
    entry = got.select(asked_for.alias("asked"), F.explode(F.from_json("body", SERIALS)["serial-metadata-response"]["entry"]).alias("entry"))
    return serial_metrics(entry.select("asked", "entry.*").withColumn("prism:issn", F.col("asked")))  # under the ISSN that the papers have


def pages_of(papers: DataFrame, cache: str, **options) -> DataFrame:
    """url and html of the pages that enrichment looks up: the DOI's, or those of all addresses that lead to no PDF."""
    urls = papers.select(F.explode(visited(F.col("doi"), F.col("urls"))).alias("url"))
    return looked_up(urls, cache, **options).select("url", F.col("body").alias("html"))


def resolved_dois(papers: DataFrame, cache: str, **options) -> DataFrame:
    """doi and final_url, the address that each paper's DOI leads to, as flag_predatory takes them."""
    base = "https://doi.org/"
    urls = papers.filter("doi is not null").select(F.concat(F.lit(base), F.col("doi")).alias("url"))
    got = looked_up(urls, cache, **({"fetch": "quillmine.sources.lookups.resolve"} | options))
    return got.select(F.substr("url", F.lit(len(base) + 1)).alias("doi"), F.col("body").alias("final_url"))


def tables(papers: DataFrame, cache: str, token: str = "", **options) -> dict[str, DataFrame]:
    """What api.run() takes for these papers: pages, resolved and, with a token for them, metrics. Each has its own cache."""
    out = {"pages": pages_of(papers, f"{cache}/pages", **options), "resolved": resolved_dois(papers, f"{cache}/resolved", **options)}
    if token or credentials().get("Scopus"):
        out["metrics"] = journal_metrics(papers, f"{cache}/metrics", token, **options)
    return out
