"""Incremental search: captured papers that land in a folder are merged into a consolidated table, batch by batch.

A paper that comes again enriches the stored one, so dropping duplicates within a watermark would not do. The rules of
survivorship don't depend on how papers are grouped on the way, so a batch is written as a run of its own, one row for each of
its keys, and rows of a key in several runs are merged when the table is read. Runs of about one size are merged into one
as soon as there are FAN of them: a row is written again only when its run grows FAN times, so that what batches write is in
proportion to their keys (times the logarithm of the table), and a reader meets few runs.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import select
from ..operators.consolidate import merge_papers, with_keys
from ..spec import SearchSpec


#: Runs of one size that are merged into one.
FAN = 4


class Consolidated:
    """A table of merged papers in runs, which are folders of Parquet.

    versions/<number> is one small file for each batch: the runs' folders, in order, with their rows. A version is written beside its
    place and moved there in one step, and the greatest one counts; none is ever overwritten. So a batch that fails at
    any point changes nothing, and what it left behind is removed when a later batch has been merged, as are folders
    that neither the latest version nor the one before it (which readers may still hold) names.
    """

    def __init__(self, spark: SparkSession, root: str, fan: int = FAN):
        self.spark, self.root, self.fan = spark, root.rstrip("/"), fan
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.at = lambda name: path(f"{self.root}/{name}")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def listed(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder))) if self.fs.exists(self.at(folder)) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.listed("versions") if n.isdigit())

    def runs_of(self, version: int) -> list[tuple[str, int]]:
        return [tuple(x) for x in json.loads(self.spark.read.text(f"{self.root}/versions/{version}", wholetext=True).first()[0])]

    def publish(self, version: int, runs: list[tuple[str, int]]) -> None:
        """Writes a version's file and moves it to its place, which is one step of the file system."""
        scratch = f"writing-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(runs),)], "value string").coalesce(1).write.text(f"{self.root}/{scratch}")
        part = next(n for n in self.listed(scratch) if n.startswith("part-"))
        self.fs.mkdirs(self.at("versions"))
        if self.fs.exists(self.at(f"versions/{version}")) or not self.fs.rename(self.at(f"{scratch}/{part}"), self.at(f"versions/{version}")):
            raise RuntimeError(f"version {version} is there already")
        self.fs.delete(self.at(scratch), True)

    def read(self) -> DataFrame | None:
        """The merged papers as of the latest version: paper_key, seq and the canonical columns."""
        versions = self.versions()
        runs = self.runs_of(versions[-1]) if versions else []
        return self.merged(self.stored(runs)) if len(runs) > 1 else self.stored(runs) if runs else None

    def stored(self, runs: list[tuple[str, int]]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/data/{name}" for name, _ in runs))

    @staticmethod
    def merged(papers: DataFrame) -> DataFrame:
        return merge_papers(papers, "paper_key").drop("n_merged")

    def write(self, papers: DataFrame, number: int) -> tuple[str, int]:
        """A new run with these papers, and how many they are."""
        name = f"{number}-{uuid.uuid4().hex[:8]}"
        self.merged(papers).write.parquet(f"{self.root}/data/{name}")
        return name, self.spark.read.parquet(f"{self.root}/data/{name}").count()

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merges one batch; a batch number that was merged before is skipped, which makes retries harmless."""
        versions = self.versions()
        if versions and versions[-1] >= number:
            return
        runs = self.runs_of(versions[-1]) if versions else []
        new = self.write(with_keys(batch), number)
        runs = [*runs, new] if new[1] or not runs else runs
        size = lambda rows: int(math.log(max(rows, 1), self.fan))
        while True:
            last = size(runs[-1][1])
            alike = next((k for k, (_, rows) in enumerate(reversed(runs)) if size(rows) > last), len(runs))  # runs at the end that are no larger
            if alike < self.fan:
                break
            runs = [*runs[:-alike], self.write(self.stored(runs[-alike:]), number)]
        self.publish(number, runs)
        self.tidy()

    def tidy(self) -> None:
        """Removes folders that none of the latest two versions names, and older versions."""
        versions = self.versions()
        named = {name for v in versions[-2:] for name, _ in self.runs_of(v)}
        for folder in self.listed("data"):
            if folder not in named:
                self.fs.delete(self.at(f"data/{folder}"), True)
        for v in versions[:-2]:
            self.fs.delete(self.at(f"versions/{v}"), False)


def follow(papers: DataFrame, spec: SearchSpec, table: Consolidated, checkpoint: str, available_now: bool = True):
    """Starts a query over a stream of canonical papers (with source and a long seq) that keeps the table up to date."""
    writer = select(papers, spec).writeStream.foreachBatch(lambda batch, number: table.merge(batch, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
