"""Tables written to the folder that driver and executors share: they cut lineage and survive the loss of any executor."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder given to setCheckpointDir.

    Where neither is set a session of one process (master local or local[n]) gets a folder of its own; on a cluster that
    is an error, as no machine's own folder is seen by the others.
    """
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    conf = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or (given.get() if given.isDefined() else None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="quillmine-")
    return shared_dir.own


#: Folders of this driver that are still there, with their sessions.
_folders: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone already; the folder's owner cleans up then
        pass


def clean() -> None:
    """Deletes all scratch folders of this driver. Lazy results read them: call it when these are written or collected."""
    while _folders:
        _delete(*reversed(_folders.popitem()))


atexit.register(clean)


class Scratch:
    """A new folder in the shared one. drop() removes a table early; clean(), or the driver's end, removes the rest."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.saved = spark, 0
        self.root = f"{shared_dir(spark)}/quillmine-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str | None = None, by: str | None = None) -> DataFrame:
        """Writes a table, in a folder for each value of a column if one is given, and returns it as read back; without a name
        it gets a number."""
        self.saved += 1
        _folders[self.root] = self.spark
        path = self.path(name or f"t{self.saved}")
        df.write.mode("overwrite").parquet(path, partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        _delete(self.spark, self.path(name) if name else self.root)
        if not name:
            _folders.pop(self.root, None)
