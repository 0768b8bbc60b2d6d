"""Connected components of link tables, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def fewer_links(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components as those of links(a, b), where each a has a bounded number of partners.

    An a is linked with its least partner alone, and its other partners with that one: one link for each a, and one
    for each distinct pair of partners, however many of the a share them.
    """
    stars = links.filter(F.col("a") != F.col("b")).groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("all"))
    ends = F.concat(F.array("a"), F.filter("all", lambda b: b != F.col("m")))
    return stars.select(F.explode(ends).alias("a"), F.col("m").alias("b")).distinct()


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, component for every id of links(a, b): the smallest id that can be reached. Null ids link nothing.

    Each round every vertex joins that of its neighbours (and itself) which comes first in an order drawn anew for the
    round, and the links are rewritten to what their ends have joined; those inside one vertex go, equal ones become
    one. So links and vertices shrink geometrically, whatever the order of the ids, and the rounds together read a
    small multiple of the links. Settled components take part no more. The rounds' vertices then pass their labels
    back. All joins are of written tables, whose hot keys Spark can split; minima are partly taken before the shuffle.
    """
    save, k, rounds = scratch.save, 0, []
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = save(links.filter(F.col("a") != F.col("b")).select(*ends("a", "b")).distinct(), f"{name}-links")
    while k == 0 or edges.limit(1).count():
        place = lambda c, k=k: F.xxhash64(c, F.lit(k))
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        first = both.groupBy("u").agg(F.min_by("v", place("v")).alias("v"))
        joined = save(first.select("u", F.when(place("v") < place("u"), F.col("v")).otherwise(F.col("u")).alias("p")), f"{name}-{k}")
        rounds.append(joined)
        a, b = (joined.toDF(c, f"p{c}") for c in ("a", "b"))
        rewritten = edges.join(a, "a").join(b, "b").filter("pa != pb").select(*ends("pa", "pb")).distinct()
        before, edges = f"{name}-links{k or ''}", save(rewritten, f"{name}-links{k + 1}")
        scratch.drop(before)
        k += 1
    labels = rounds[-1].toDF("id", "root")
    for joined in reversed(rounds[:-1]):
        labels = joined.toDF("id", "p").join(labels.toDF("p", "q"), "p", "left").select("id", F.coalesce("q", "p").alias("root"))
    labels = save(labels, f"{name}-roots")
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return save(labels.join(least, "root").select("id", "component"), f"{name}-labels")
