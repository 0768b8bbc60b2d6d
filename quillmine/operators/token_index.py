"""A token index for queries that are asked again and again over the same papers.

postings/bucket=<n>/ holds, for each token, the papers that have it and its places in them; terms/ is the dictionary. A query
reads the buckets of its own tokens, and a token with a wildcard those of the dictionary's tokens that fit it; a phrase needs its
tokens side by side. What comes out holds every match and little else: the query's predicate then decides on those papers, so
that results equal those of a scan. Terms behind AND NOT narrow nothing and aren't looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.predicates import WORD
from ..plans.query import Group, Term, alternatives

#: Folders that tokens are dealt into, and tasks that write one of them, so that no task holds all of a frequent token.
BUCKETS, WRITERS = 64, 4
#: Papers whose postings one task writes, about: more papers are more tasks, so that none has to sort more than fits its memory.
PAPERS = 10_000


def tokens_of(text: Column) -> Column:
    """The words of a text in order, lower-cased: what lies between word borders of the predicates."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD}]+)"), 1)


def term_tokens(text: str) -> list[str]:
    """A term's tokens, ? and * in them."""
    return [t for t in re.findall(r"[\w?*]+", text.lower().replace("-", " ")) if t]


def postings_of(papers: DataFrame) -> DataFrame:
    """token, seq and places of papers(seq, tokens), a row for each token that a paper has. A paper's places are put together
    where it is read: only postings are moved, once, not every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            counts = np.asarray(batch.column(1).value_lengths().fill_null(0))
            ends = np.cumsum(counts)
            while start < batch.num_rows:
                to = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 500_000)))
                part = batch.slice(start, to - start)
                start = to
                sizes = np.asarray(part.column(1).value_lengths().fill_null(0))
                words = part.column(1).flatten().dictionary_encode()
                paper = np.repeat(np.arange(len(sizes)), sizes)
                place = (np.arange(len(paper)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
                key = paper * max(1, len(words.dictionary)) + np.asarray(words.indices)
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order]))
                at = order[first]
                yield pa.RecordBatch.from_arrays([words.dictionary.take(words.indices.take(pa.array(at))), part.column(0).take(pa.array(paper[at])), places], names=["token", "seq", "places"])

    return papers.select("seq", "tokens").mapInArrow(run, f"token string, seq {papers.schema['seq'].dataType.simpleString()}, places array<int>")


class TokenIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.postings = spark.read.parquet(f"{self.path}/postings")
        self.terms = spark.read.parquet(f"{self.path}/terms")
        self.buckets = int(spark.read.json(f"{self.path}/about").first()["buckets"])

    @classmethod
    def build(cls, papers: DataFrame, path: str, buckets: int = BUCKETS) -> TokenIndex:
        """Indexes titles, abstracts and keywords of papers by seq, as one text, so that no scope of a source is narrower."""
        spark, text = papers.sparkSession, F.concat_ws(" ", "title", "abstract", F.array_join("keywords", " "))
        postings = postings_of(papers.select("seq", tokens_of(text).alias("tokens"))).withColumn("bucket", _bucket(F.col("token"), buckets))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-papers.count() // PAPERS))
        writers = F.pmod(F.xxhash64("seq"), F.lit(max(WRITERS, -(-4 * tasks // buckets))))
        dealt = postings.repartition(tasks, "bucket", writers).sortWithinPartitions("bucket", "token", "seq")
        dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
        terms = spark.read.parquet(f"{path}/postings").groupBy("bucket", "token").agg(F.count("*").alias("papers"))
        terms.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/terms")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path}/about")
        return cls(spark, path)

    def of_token(self, token: str) -> DataFrame:
        """Postings of a token; of one with wildcards, those of all tokens that fit it."""
        if "?" not in token and "*" not in token:
            return self.postings.filter((F.col("bucket") == _bucket(F.lit(token), self.buckets)) & (F.col("token") == token))
        head = re.match(r"[^?*]*", token)[0]
        pattern = "".join(f"[{WORD}]" if c == "?" else f"[{WORD}]*" if c == "*" else c for c in token)
        fitting = self.terms.filter(F.col("token").startswith(head) & F.col("token").rlike(f"^{pattern}$"))
        return self.postings.join(fitting.select("bucket", "token"), ["bucket", "token"])

    def with_term(self, text: str) -> DataFrame | None:
        """seq of the papers that have a term's tokens side by side; None if the term has none that can be looked up."""
        tokens = term_tokens(text)
        loose = any(set(t) <= {"*"} for t in tokens)  # may stand for nothing, so that its neighbours needn't be apart
        tokens = [t for t in tokens if not set(t) <= {"*"}]
        if not tokens:
            return None
        if len(tokens) == 1:
            return self.of_token(tokens[0]).select("seq").distinct()
        slots = reduce(DataFrame.unionByName, (self.of_token(t).select("seq", F.lit(k).alias("slot"), "places") for k, t in enumerate(tokens)))
        places = lambda k: F.flatten(F.collect_list(F.when(F.col("slot") == k, F.col("places")))).alias(f"p{k}")
        found = slots.groupBy("seq").agg(*(places(k) for k in range(len(tokens))))
        if loose:
            return found.filter(reduce(lambda a, b: a & b, (F.size(f"p{k}") > 0 for k in range(len(tokens))))).select("seq")
        reach = F.col("p0")
        for k in range(1, len(tokens)):
            reach = F.array_intersect(F.transform(reach, lambda x: x + 1), F.col(f"p{k}"))
        return found.filter(F.size(reach) > 0).select("seq")

    def candidates(self, node: Term | Group) -> DataFrame | None:
        """seq, each once, of papers among which all matches of the query are; None if they may be any."""
        if isinstance(node, Term):
            return self.with_term(node.text)
        out = None
        for both in alternatives(node):
            known = [c for c in (self.candidates(m) for negated, m in both if not negated) if c is not None]
            if not known:
                return None
            met = reduce(lambda a, b: a.join(b, "seq", "left_semi"), known)
            out = met if out is None else out.unionByName(met)
        return out.distinct()

    def narrow(self, papers: DataFrame, node: Group) -> DataFrame:
        """The papers among which the query's matches are."""
        found = self.candidates(node)
        return papers if found is None else papers.join(found, "seq", "left_semi")


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")
