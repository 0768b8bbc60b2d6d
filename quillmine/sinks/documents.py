"""Sinks: saved searches as JSON, BibTeX files, download plans."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as r
from ..operators.reports import counts_by_database, newest_first
from ..scratch import Scratch
from ..spec import SearchSpec

#: An entry that credits the tool, to be put before others.
SELF_CITATION = "@misc{{quillmine,\n    title = {{Quillmine: literature search and record linkage on Spark}},\n    year = {{{year}}}\n}}\n"


def envelope(spec: SearchSpec, papers: DataFrame, processed_at: dt.datetime | None = None) -> dict:
    """The parameters and counts of a saved search; the counts are one row for each database."""
    at = processed_at or dt.datetime.now(dt.UTC)
    text = lambda d: d.isoformat() if d else None
    return {
        "query": spec.query, "since": text(spec.since), "until": text(spec.until), "limit": spec.limit, "limit_per_database": spec.limit_per_database,
        "processed_at": at.strftime("%Y-%m-%d %H:%M:%S"), "databases": list(spec.databases), "publication_types": list(spec.publication_types) if spec.publication_types else None,
        "number_of_papers": papers.count(), "number_of_papers_by_database": {x["database"]: x["n"] for x in counts_by_database(papers).collect()},
    }


def paper_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"})


def write_search(papers: DataFrame, spec: SearchSpec, path: str, processed_at: dt.datetime | None = None) -> None:
    """A folder with the papers as Parquet (papers/) and the envelope as JSON (envelope/): the form for large results."""
    papers.write.mode("errorifexists").parquet(f"{path}/papers")
    spark = papers.sparkSession
    saved = spark.read.parquet(f"{path}/papers")
    spark.createDataFrame([(json.dumps(envelope(spec, saved, processed_at), sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/envelope")


def write_search_json(papers: DataFrame, spec: SearchSpec, path: str, processed_at: dt.datetime | None = None) -> None:
    """One JSON document, newest papers first, keys sorted, two spaces deep, in parts: path's files, one after another.

    The papers are computed once and sorted by range; each range is indented and written by a task of its own, the head and
    foot of the document stand in the first and the last one. Spark commits all parts or none, so that a job that fails
    leaves no document. Nothing goes through the driver but the counts.
    """
    scratch = Scratch(papers.sparkSession, "json")
    saved = scratch.save(papers.withColumn("row_of_json", F.monotonically_increasing_id()), "papers")
    head = json.dumps(envelope(spec, saved, processed_at) | {"papers": "@"}, indent=2, sort_keys=True, ensure_ascii=False)
    before, after = head.split('"@"')
    columns = sorted(c for c in papers.columns if c not in ("seq", "n_merged", "paper_key", "publication_key", "source"))
    key = F.col("paper_key") if "paper_key" in papers.columns else F.lit("")
    placed = saved.select(F.lit(1).alias("section"), "publication_date", "title", key.alias("key"), F.col("row_of_json").alias("row"), paper_json(columns).alias("j"))
    last = placed.orderBy(F.asc_nulls_first("publication_date"), F.desc_nulls_last("title"), F.desc_nulls_last("key"), F.desc("row")).select("row").first()
    ends = papers.sparkSession.createDataFrame([(0, None, None, None, None, before + "["), (2, None, None, None, None, "  ]" + after)], "section int, publication_date date, title string, key string, row bigint, j string")
    lines = placed.unionByName(ends).orderBy("section", F.desc("publication_date"), "title", "key", "row").select("section", "row", "j")
    final = last["row"] if last else None

    def indented(batches):
        import pyarrow as pa

        def text(section, row, j):
            if section != 1:
                return j
            whole = json.dumps(json.loads(j), indent=2, sort_keys=True, ensure_ascii=False).split("\n")
            return "\n".join("    " + x for x in whole) + ("" if row == final else ",")

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([text(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.string())], names=["value"])

    lines.mapInArrow(indented, "value string").write.option("lineSep", "\n").text(path)
    scratch.drop()


def bibtex_entries(papers: DataFrame) -> DataFrame:
    """The papers with an entry column; a paper whose entry can't be written has none."""
    p = F.col("publication")
    fields = {c: F.col(c) for c in ("title", "authors", "publication_date", "urls", "comments", "pages")}
    return papers.withColumn("entry", r.bibtex(fields | {"publication_title": p["title"], "category": p["category"], "publisher": p["publisher"], "has_publication": p.isNotNull()}))


def write_bibtex(papers: DataFrame, path: str, credit_tool: bool = False) -> None:
    """Entries, newest papers first, a blank line after each."""
    entries = newest_first(bibtex_entries(papers).filter("entry is not null")).select("entry")
    if credit_tool:
        first = papers.sparkSession.range(1).select(F.lit(SELF_CITATION.format(year=dt.date.today().year)).alias("entry"))
        entries = first.unionByName(entries)
    entries.write.option("lineSep", "\n").text(path)


#: Bytes of a file's name that all common file systems take, with room for the ending of a half-written file.
NAME = 200


def bounded(name: Column) -> Column:
    """A name of at most NAME bytes: longer ones are cut and end in a hash of the whole, so that they stay apart."""
    return F.when(F.octet_length(name) <= NAME, name).otherwise(F.concat(F.substr(name, F.lit(1), F.lit(32)), F.lit("-"), F.sha2(name, 256), F.lit(".pdf")))


def download_plan(papers: DataFrame) -> DataFrame:
    """paper_key, file_name, urls (all candidates in order), pdf_urls (what the hosts' rules make of them), collision.

    Names are bounded in bytes. Two papers of a year with the same cleaned title share a file name; the first by seq keeps it, the others have
    collision set. Nothing is fetched here.
    """
    doi = F.when(F.col("doi").isNotNull(), F.array(F.concat(F.lit("http://doi.org/"), F.col("doi")))).otherwise(F.array().cast("array<string>"))
    urls = F.array_union(F.sort_array("urls"), doi)
    from pyspark.sql import Window

    named = papers.select("paper_key", "seq", bounded(r.file_name(F.col("publication_date"), F.col("title"))).alias("file_name"), urls.alias("urls"), F.col("doi"))
    pdfs = F.filter(F.transform("urls", lambda u: r.pdf_url(u, F.col("doi"))), lambda u: u.isNotNull())
    taken = F.row_number().over(Window.partitionBy("file_name").orderBy("seq")) > 1
    return named.select("paper_key", "file_name", "urls", pdfs.alias("pdf_urls"), taken.alias("collision"))


#: What became of a plan's rows, by address.
LOG = "paper_key string, file_name string, status string, url string, error string"


def fetch(plan: DataFrame, folder: str, get) -> DataFrame:
    """Runs a plan and writes its log: paper_key, file_name, status ([DOWNLOADED], [COLLECTED] or [FAILED]), and the last
    address and error.

    get(url) returns (content type, bytes) or None; it is called on executors, for the PDF addresses first, and what it
    raises ends that address only. What goes wrong with a paper's file (a name that the store refuses, a null one) ends that
    paper only, and is its error in the log. A finished file is moved to its name in one step, so a half one never counts; a file
    that exists isn't fetched again. folder is a URI that all executors reach; the log joins those of earlier runs in
    folder/download.log, as JSON lines.
    """
    import pyarrow as pa
    import pyarrow.fs as pafs

    names = [f.split()[0] for f in LOG.split(", ")]

    def one(fs, root: str, x: dict) -> None:
        """Fetches one paper of the plan and notes in x what became of it."""
        path = f"{root}/{x['file_name']}"
        if x["collision"] or fs.get_file_info(path).is_file:
            x["status"] = "[COLLECTED]"
            return
        for url in dict.fromkeys([*(x["pdf_urls"] or []), *(x["urls"] or [])]):
            x["url"] = url
            try:
                got = get(url)
                if not got or "application/pdf" not in got[0].lower():
                    x["error"] = "no PDF"
                    continue
                part = f"{path}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as out:
                    out.write(got[1])
                fs.move(part, path)
            except Exception as e:  # noqa: BLE001  the next address goes on
                x["error"] = f"{type(e).__name__}: {e}"[:500]
                continue
            x |= {"status": "[DOWNLOADED]", "error": None}
            return

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            rows = b.to_pylist()
            for x in rows:
                x |= {"status": "[FAILED]", "url": None, "error": None}
                try:
                    one(fs, root, x)
                except Exception as e:  # noqa: BLE001  the other papers go on
                    x["error"] = f"{type(e).__name__}: {e}"[:500]
            yield pa.RecordBatch.from_pylist([{k: x[k] for k in names} for x in rows], schema=pa.schema([(k, pa.string()) for k in names]))

    done = Scratch(plan.sparkSession, "fetch").save(plan.mapInArrow(run, LOG), "log")  # fetched once, however often it is read
    done.write.mode("append").json(f"{folder.rstrip('/')}/download.log")
    return done
