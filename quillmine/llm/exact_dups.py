"""Exact duplicates by merging sorted runs of digests along a tree, in DataFrame functions alone.

Each input partition is a run: its distinct texts by digest, each with the best identifier and the number of its rows.
Runs meet in binomial rounds: run k hands its rows to the run whose number lacks the bits of the round, so that one
multiway merge takes 2^BITS runs, and after a logarithmic number of rounds one run, dealt by digest over all tasks,
knows every group. Answers go back the way they came. A text that a third of all rows share is one row of each run,
so no task ever meets more than 2^BITS rows of it, in merges as in the joins on the way back. Groups are verified at
every level: equal digests with unequal lengths or second hashes stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Bits of a run's number that one round clears: 64 runs are merged at once, 800,000 in four rounds.
BITS = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What makes two texts one: SHA-256, and what verifies it.
TEXT = ["digest", "n_bytes", "other_hash"]


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as empty; all else counts."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own), run (the partition it comes from) and TEXT of every row, each run sorted by digest."""
    plain = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    marked = plain.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"), F.xxhash64("t").alias("other_hash"),
    )
    return marked.sortWithinPartitions("digest")


def merged(runs: DataFrame, bits: int) -> DataFrame:
    """The runs that are left when `bits` bits of each run's number are cleared; best wins, counts add up."""
    return runs.groupBy(F.shiftright("run", bits).alias("run"), *TEXT).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """Every row's doc_id, row and TEXT with best (doc_id, row) of the row that stays and n, its group's rows."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.save(digested(docs), "rows")
    known, number = F.col("doc_id").isNotNull().alias("known"), F.col("doc_id")
    # null doc_ids come last; the rest by doc_id, then by place, upwards or downwards
    sign = 1 if keep == "largest" else -1
    best = F.struct(known, (number * sign).alias("by"), (F.col("row") * sign).alias("place"), number.alias("doc_id"), "row")
    levels = [scratch.save(merged(rows.select("run", *TEXT, best.alias("best"), F.lit(1).cast("long").alias("n")), 0), "level0")]
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        levels.append(scratch.save(merged(levels[-1], BITS), f"level{len(levels)}"))
        runs = -(-runs >> BITS)
    answer = levels[-1].filter("n > 1").select("run", *TEXT, "best", "n")
    for level, below in enumerate(reversed(levels[:-1])):
        up = answer.withColumnRenamed("run", "up")
        own = below.select("run", *TEXT, F.shiftright("run", BITS).alias("up"))
        answer = scratch.save(own.join(up, ["up", *TEXT]).drop("up"), f"answer{level}")
    alone = F.col("n").isNull()
    found = rows.join(answer, ["run", *TEXT], "left")
    own = F.struct("doc_id", "row")
    return found.select("doc_id", "row", *TEXT, F.when(alone, own).otherwise(F.struct("best.doc_id", "best.row")).alias("best"), F.coalesce("n", F.lit(1)).cast("long").alias("n"))


def exact_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; texts are equal when identical after lower-casing A-Z.

    Of equal texts the row with the largest doc_id stays, or the smallest with keep="smallest". Null counts as the empty
    text, so null and empty texts are one group. Rows that repeat a doc_id with one text are rows of one group, of which
    one stays; rows with a null doc_id stay only if their group has no other, and their keep_id is null then. An empty
    table gives an empty result; other columns aren't read.
    """
    found = groups(docs, keep)
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs, with their columns, less all rows of each group of equal texts but the one that stays.

    Rows that repeat doc_id and text are one document, and so are those with equal texts and null doc_ids, if nothing else
    has that text: the row whose columns come first as JSON stays. Nulls and empty tables as in exact_duplicates.
    """
    scratch = Scratch(docs.sparkSession, "exact-kept")
    taken = {c.lower() for c in docs.columns}
    name = next(c for c in ("_text_key", *(f"_text_key{i}" for i in range(len(taken) + 1))) if c not in taken)
    found = groups(docs, keep)
    stays = scratch.save(found.filter("row = best.row").select(F.struct("doc_id", *TEXT).alias("of"), F.col("n") > 1), "stays").toDF("of", "shared")
    t = normalised(F.col("text"))
    own = F.struct("doc_id", F.unhex(F.sha2(t, 256)).alias("digest"), F.octet_length(t).cast("long").alias("n_bytes"), F.xxhash64(t).alias("other_hash"))
    keyed = docs.select(own.alias(name), F.struct(*docs.columns).alias("whole"))
    alone = keyed.join(stays.filter("not shared"), F.col(name).eqNullSafe(F.col("of")), "left_semi").select("whole.*")
    again = keyed.join(stays.filter("shared"), F.col(name).eqNullSafe(F.col("of")), "left_semi")
    one = again.groupBy(name).agg(F.min_by("whole", F.to_json("whole")).alias("whole"))
    return alone.unionByName(one.select("whole.*"))
