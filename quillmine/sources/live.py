"""Live sources as a Python data source: pages of a remote interface are partitions, or one partition walks a cursor.

spark.read.format("quillmine_http").option("urls", "\\n".join(addresses)).option("delay", 1).load() gives one row for each
address: url, status, body, attempts. Addresses of one host stay in one partition, in order, with a pause between them.
With a "follow" option each address begins a walk of "pages" pages at most: NEXT gives the next page's address.
Records that result pages name (PubMed ids, preprint DOIs) are as many as a query finds: fetch_all() takes their
addresses from a table, in chunks, each a task that is done again on its own if its executor is lost.
capture() walks in rounds of some pages. Each round's pages are a table beside the captured files, with the address that
comes next, so that a walk that broke goes on at the page where it broke, and one that has found as many papers as the
search wants stops. Tokens are put into addresses where they are asked; nothing that is written holds one.
There is no network in the tests; the fetching function can be replaced by an importable one ("fetch" option).
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
import re
import time
from dataclasses import dataclass
from urllib.parse import parse_qs, urlencode, urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans import dialects
from ..spec import SearchSpec, credentials
from .captures import rxiv_dois

# Attempts, seconds between them, and the timeout of a request.
ATTEMPTS, PAUSE, TIMEOUT = 2, 3.0, 20.0
AGENT = "Mozilla/5.0 (compatible; quillmine)"
#: Detail records that one task fetches; result pages of a round.
CHUNK, ROUND = 200, 20
#: Stands for the token in addresses.
TOKEN = "TOKEN-GOES-HERE"


@dataclass
class Host(InputPartition):
    urls: list[str]


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillmine_http"

    def schema(self) -> str:
        return "url string, status int, body string, attempts int, next string"

    def reader(self, schema) -> HttpReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.delay, self.pause = float(options.get("delay", 1)), float(options.get("pause", PAUSE))
        self.fetch, self.proxy = options.get("fetch", ""), options.get("proxy", "")
        self.follow, self.most = options.get("follow", ""), int(options.get("pages", 0)) or float("inf")
        self.token = options.get("token", "")

    def partitions(self) -> list[Host]:
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        return [Host(x) for x in hosts.values()] or [Host([])]

    def read(self, partition: Host):
        get = self.getter()
        walk, first = NEXT.get(self.follow), True
        for url in partition.urls:
            page, seen = url, set()
            while page and page not in seen and len(seen) < self.most:
                if not first:
                    time.sleep(self.delay)
                first = False
                seen.add(page)
                status, body, attempts = self.tried(get, page.replace(TOKEN, self.token) if self.token else page)
                after = page if body is None else walk(page, body) if walk else None  # a page that gave nothing is asked again
                after = after.replace(self.token, TOKEN) if after and self.token else after
                yield page, status, body, attempts, after
                page = None if body is None else after

    def getter(self):
        """The function that fetches an address: the session's own, or the importable one that was named."""
        return getattr(importlib.import_module(self.fetch.rpartition(".")[0]), self.fetch.rpartition(".")[2]) if self.fetch else self.http

    def tried(self, get, url: str) -> tuple[int | None, str | None, int]:
        """Status, body and attempts; a null status if all attempts failed, so that other addresses go on."""
        for attempt in range(1, ATTEMPTS + 1):
            try:
                return *get(url), attempt
            except Exception:  # noqa: BLE001
                if attempt < ATTEMPTS:
                    time.sleep(self.pause)
        return None, None, ATTEMPTS

    def http(self, url: str) -> tuple[int, str]:
        """Through the proxy if there is one, and directly if that fails. The openers, with their cookies, are kept for a task."""
        for opener in self.openers():
            try:
                with opener.open(url, timeout=TIMEOUT) as answer:
                    return answer.status, answer.read().decode("utf-8", "replace")
            except OSError:
                continue
        raise OSError(f"no answer from {urlsplit(url).netloc}")

    def openers(self) -> list:
        from urllib.request import HTTPCookieProcessor, ProxyHandler, build_opener

        if not hasattr(self, "_openers"):
            proxies = [{"http": self.proxy, "https": self.proxy}] if self.proxy else []
            self._openers = [build_opener(ProxyHandler(p), HTTPCookieProcessor()) for p in [*proxies, {}]]
            for opener in self._openers:
                opener.addheaders = [("User-Agent", AGENT)]
        return self._openers


def fetch_all(urls: DataFrame, **options: str) -> DataFrame:
    """url, status, body, attempts of every address of urls(url), CHUNK of them a task.

    The pause between a task's requests grows with the tasks that run at a time, so that all together ask no host more
    often than once in `delay` seconds.
    """
    tasks = max(1, -(-urls.count() // CHUNK))
    lanes = min(tasks, urls.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        import pyarrow as pa

        reader, first = HttpReader(options), True
        get = reader.getter()
        for b in batches:
            rows = []
            for url in b.column(0).to_pylist():
                if not first:
                    time.sleep(reader.delay * lanes)
                first = False
                rows.append((url, *reader.tried(get, url)))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], names=["url", "status", "body", "attempts"])

    return urls.select("url").repartition(tasks).mapInArrow(run, "url string, status int, body string, attempts int")


def _moved(url: str, parameter: str, page: int, total: int, first: int = 0) -> str | None:
    """The address with its offset moved by a page, None past the total."""
    parts = urlsplit(url)
    asked = {k: v[0] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    at = int(asked.get(parameter, first)) + page
    return parts._replace(query=urlencode(asked | {parameter: at})).geturl() if at - first < total else None


def _number(pattern: str, body: str) -> int:
    found = re.search(pattern, body)
    return int(found[1].replace(",", "")) if found else 0


def scopus_next(url: str, body: str) -> str | None:
    """The address that the response itself names as next."""
    links = json.loads(body).get("search-results", {}).get("link", [])
    return next((x.get("@href") for x in links if x.get("@ref") == "next"), None)


def rxiv_next(url: str, body: str) -> str | None:
    tag = re.search(r'<a[^>]*class="link-icon link-icon-after"[^>]*>', body)
    href = tag and re.search(r'href="([^"]*)"', tag[0])
    return urljoin(url, href[1]) if href else None


#: Next pages by source.
NEXT = {
    "arXiv": lambda url, body: _moved(url, "start", dialects.ARXIV_PAGE, _number(r"totalResults[^>]*>\s*([0-9,]+)", body)),
    "PubMed": lambda url, body: _moved(url, "retstart", dialects.PUBMED_PAGE, _number(r"<Count>\s*([0-9]+)", body)),
    "IEEE": lambda url, body: _moved(url, "start_record", dialects.IEEE_PAGE, _number(r'"total_records"\s*:\s*([0-9]+)', body), first=1),
    "Scopus": scopus_next,
    "medRxiv": rxiv_next,
    "bioRxiv": rxiv_next,
}


def first_urls(spec: SearchSpec, source: str, token: str = "", today: dt.date | None = None) -> list[str]:
    """Where a source's search begins: one address, or one for each alternative. IEEE and Scopus need a token."""
    today, types = today or dt.date.today(), list(spec.publication_types) if spec.publication_types else None
    if source in ("IEEE", "Scopus") and not token:
        raise ValueError(f"{source} needs a token")
    if source == "arXiv":
        return [dialects.arxiv_url(spec.tree)]
    if source == "PubMed":
        return [dialects.pubmed_url(spec.tree, spec.since, spec.until, today)]
    if source == "IEEE":
        return [dialects.ieee_url(spec.tree, token, spec.since, spec.until, types)]
    if source == "Scopus":
        return [dialects.scopus_url(spec.tree, token, spec.since, spec.until, types)]
    return dialects.rxiv_urls(spec.tree, source, spec.since, spec.until, today)


def detail_urls(pages: DataFrame, source: str) -> DataFrame:
    """url and seq, its first place, of each detail record that result pages(number, body) name: PubMed ids, preprint DOIs."""
    if source == "PubMed":
        ids = F.regexp_extract_all("body", F.lit(r"<Id>\s*([0-9]+)\s*</Id>"), 1)
        base = f"{dialects.PUBMED_URL}/efetch.fcgi?db=pubmed&rettype=abstract&id="
    else:
        ids, base = rxiv_dois(F.col("body")), f"https://api.biorxiv.org/details/{source.lower()}/"
    placed = pages.select("number", F.posexplode(ids).alias("place", "id"))
    return placed.groupBy(F.concat(F.lit(base), F.col("id")).alias("url")).agg(F.min(F.struct("number", "place")).alias("seq"))


class WalkBroken(RuntimeError):
    """A page gave no answer; what was captured before it is there, and the next call goes on with it."""


class Captured:
    """A folder of captured files: round=<alternative>-<number>/ has a round's bodies, _walk/ its pages and what they led to."""

    def __init__(self, spark: SparkSession, folder: str, source: str):
        self.spark, self.root, self.source = spark, folder.rstrip("/"), source
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.at = lambda name: path(f"{self.root}/{name}")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def done(self, name: str) -> bool:
        return self.fs.exists(self.at(f"{name}/_SUCCESS"))

    def table(self, name: str, make) -> DataFrame:
        """A table of the walk, made if it isn't there yet; a half-written one is made anew."""
        at = f"{self.root}/_walk/{name}"
        if not self.done(f"_walk/{name}"):
            make().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def bodies(self, name: str, df: DataFrame) -> None:
        """Bodies in order as files of this round: PubMed's records stand behind one another, others are a file each."""
        if not self.done(f"round={name}"):
            writer = df.select("body").write.mode("overwrite")
            (writer if self.source == "PubMed" else writer.option("maxRecordsPerFile", 1)).text(f"{self.root}/round={name}")

    def earlier(self, kind: str, before: str) -> DataFrame | None:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at("_walk"))] if self.fs.exists(self.at("_walk")) else []
        names = sorted(n for n in names if n.startswith(f"{kind}-") and n < f"{kind}-{before}")
        return self.spark.read.parquet(*(f"{self.root}/_walk/{n}" for n in names)) if names else None


def _numbered(pages: DataFrame) -> DataFrame:
    """Pages of one walk, which is one task's, numbered in order."""
    return pages.withColumn("number", F.monotonically_increasing_id())


def _details(into: Captured, pages: DataFrame, name: str, options: dict) -> DataFrame:
    """number and body of the detail records that a round's pages name and no earlier round named, in the pages' order."""

    def new() -> DataFrame:
        found, before = detail_urls(pages, into.source), into.earlier("urls", name)
        return found if before is None else found.join(before, "url", "left_anti")

    urls = into.table(f"urls-{name}", new)
    details = into.table(f"details-{name}", lambda: fetch_all(urls, **options).join(urls, "url"))
    return details.filter("body is not null").select(F.col("seq").alias("number"), "body")


def capture(spark: SparkSession, spec: SearchSpec, source: str, folder: str, token: str = "", today: dt.date | None = None, enough=None, **options: str) -> str:
    """Walks a source's result pages, and its detail records if it has some, round by round, into files that the capture
    readers read.

    enough(spark, round's folder) gives the keys of the papers that the search accepts of a round, key; with it the walk ends
    as soon as there are as many distinct ones as the search's limits ask for, which is all that the limits let through.
    A page that can't be had raises WalkBroken when the round is written; another call goes on there, and one after the end
    asks nothing. Without a token or a proxy option those of the environment are taken. Addresses of detail records stay in
    tables; of each round only the next page's address and a count reach the driver.
    """
    known = credentials()
    token, options = token or known.get(source, ""), ({"proxy": known["proxy"]} if known.get("proxy") else {}) | options
    spark.dataSource.register(HttpPages)
    into = Captured(spark, folder, source)
    wanted = min([n for n in (spec.limit, spec.limit_per_database) if n], default=None) if enough else None
    each, held = int(options.pop("pages", ROUND)), {"token": token} if token else {}
    if source in ("IEEE", "Scopus") and not token:
        raise ValueError(f"{source} needs a token")
    for i, first in enumerate(first_urls(spec, source, TOKEN if token else "", today)):
        page, number = first, 0
        while page:
            name = f"{i:03d}-{number:06d}"
            start = page
            fresh = not into.done(f"_walk/pages-{name}")
            pages = into.table(f"pages-{name}", lambda: _numbered(spark.read.format("quillmine_http").options(urls=start, follow=source, pages=str(each), **held, **options).load()))
            end = pages.select(F.max(F.struct("number", "next", F.col("body").isNull().alias("broken"))).alias("e")).first()["e"]
            if end is None:
                break
            got = pages.filter("body is not null")
            if source in ("PubMed", "medRxiv", "bioRxiv"):
                got = _details(into, got, name, options)
            into.bodies(name, got.orderBy("number"))
            page, number = end["next"], number + 1
            if wanted:
                into.table(f"keys-{name}", lambda: enough(spark, f"{folder}/round={name}"))
                if into.earlier("keys", "~").select("key").distinct().limit(wanted).count() >= wanted:
                    return folder
            if end["broken"] and fresh:
                raise WalkBroken(f"{source}: no answer from {page}")
    return folder
