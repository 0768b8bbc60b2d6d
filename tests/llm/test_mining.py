"""Hard negatives, phrases and exact duplicates against brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmine.llm import _bits, collocations, exact_dups, hard_negatives

from .conftest import edge_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups_of(rows, keep=max):
    """(doc_id, keep_id, group_size, kept, sha) by text; of rows that repeat, any one may be the one that is kept."""
    by = {}
    for i, t in rows:
        by.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        kept = False
        for i in ids:
            first = i == best and not kept
            kept |= first
            out.append((i, best, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("keep", "choose"), [("largest", max), ("smallest", min)])
def test_exact_duplicates_of_odd_rows(make, empty, keep, choose):
    rows = [*edge_texts(), (9, "ONE"), (10, "İ"), (11, "i̇"), (12, ""), (13, None), (None, "only null"), (None, "only null")]
    got = [tuple(r) for r in exact_dups.exact_duplicates(make(rows), keep).collect()]
    assert sorted(got, key=str) == groups_of(rows, choose)
    assert exact_dups.exact_duplicates(empty).collect() == []


def test_exact_duplicates_over_many_runs(spark):
    """A text that a third of all rows share, in 300 runs: three levels of merges; each merge meets it 64 times at most."""
    df = spark.range(0, 9000, numPartitions=300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("t"), F.col("id") % 1000)).alias("text"))
    got = sorted((tuple(r) for r in exact_dups.exact_duplicates(df).collect()), key=str)
    assert got == groups_of([(i, "hot" if i % 3 == 0 else f"t{i % 1000}") for i in range(9000)])
    plan = exact_dups.exact_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_drop_copies_keeps_columns(spark):
    rows = [(1, "A", {"x": 1}, "keep"), (2, "a", {"y": 2}, "me"), (2, "a", {"z": 3}, "twice"), (None, None, None, "n"), (None, "", {}, "m"), (3, "b", None, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Digest map<string,int>, Row string")
    out = exact_dups.drop_copies(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in got) == [("2", "a"), ("3", "b"), ("None", "")]
    assert {str(r) for r in got} <= {str(r) for r in df.collect()}
    assert exact_dups.drop_copies(df.limit(0)).collect() == []


def phrases_of(rows, longest=3, least=10, within=50, first=2000):
    """The contract, phrase by phrase."""
    out = []
    for lang in {x or "und" for x, _ in rows}:
        counts, n = Counter(), 0
        for x, text in rows:
            if (x or "und") == lang:
                for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(LOWER)):
                    words = re.findall("[^\\x20\\x09]+", piece)
                    n += len(words)
                    for size in range(1, longest + 1):
                        counts.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            inside = lambda q, p=p: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            if any(100 * b >= within * a for q, b in found.items() if inside(q)):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def prose(seed, n=300):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "ç", "dd", "e|e", "漢字", "f", "g"])
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?", " \r\n", "\x0b", "\x00 ", " "]
    return [(rng.choice(["en", "en", "en", None, "und", "fr"]), rng.choice([None, "", "  ", "."]) if rng.random() < 0.05 else "".join(word() + rng.choice(ends) for _ in range(rng.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "longest", "shard", "together"), [(1, 3, 1 << 20, 1 << 16), (2, 3, 500, 64), (3, 4, 200, 7), (4, 2, 1000, 1 << 16)])
def test_collocations_equal_the_contract(spark, monkeypatch, seed, longest, shard, together):
    """One shard for each language and many, phrases extended all together and in parts of one word's bitmap."""
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "TOGETHER", together)
    monkeypatch.setattr("quillmine.llm._shared.SLICE_ROWS", 50)
    rows = prose(seed)
    df = spark.createDataFrame([(i, t, x, "clash", "clash") for i, (x, t) in enumerate(rows)], "doc_id int, text string, lang string, word string, id string").repartition(3)
    got = collocations.collocations(df, longest, 10, 50, 60)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == phrases_of(rows, longest, 10, 50, 60)


def test_collocations_of_odd_rows(spark, edge, empty):
    assert collocations.collocations(empty).collect() == []
    rows = [("en", t) for _, t in edge_texts()]
    assert sorted(tuple(r) for r in collocations.collocations(edge).collect()) == phrases_of(rows)
    one = spark.createDataFrame([("en", "same " * 50_000)], "lang string, text string")
    assert [tuple(r) for r in collocations.collocations(one).collect()] == phrases_of([("en", "same " * 50_000)])


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    """If two words get one id, another seed is taken."""
    rows = [("en", "aa bb cc dd " * 20)]
    seen = []
    real = collocations.shards

    def clashing(docs, seed=0):
        seen.append(seed)
        out = real(docs, seed)
        return out if seed else out.withColumn("id", F.when(F.col("word").isin("aa", "bb"), F.lit(7)).otherwise(F.col("id")))

    monkeypatch.setattr(collocations, "shards", clashing)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(tuple(r) for r in got.collect()) == phrases_of(rows) and seen == [0, 1]


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "filter_bits", lambda phrases: b"\xff" * (collocations.FILTER // 8))
    rows = prose(9, 150)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), first=50)
    assert sorted(tuple(r) for r in got.collect()) == phrases_of(rows, first=50)


def test_shift_and_popcount():
    rng = np.random.default_rng(1)
    pos = np.flatnonzero(rng.random(5000) < 0.7)
    pos[pos > 2500] += 9000
    word = rng.integers(0, 5, len(pos))
    w, at, mask = _bits.entries(word, pos)
    assert (_bits.places(*_bits.steps_of(at)) == at).all()
    far = np.array([3, 5000, 5001, 900_000])
    assert (_bits.places(*_bits.steps_of(far)) == far).all()
    rows = _bits.Rows(w, at, mask)
    entry, other, _, both = rows.follow(w, at, mask)
    got, by = Counter(), dict(zip(pos.tolist(), word.tolist(), strict=True))
    for a, b, m in zip(w[entry].tolist(), other.tolist(), both.tolist(), strict=True):
        got[a, b] += m.bit_count()
    assert got == Counter((by[p], by[p + 1]) for p in by if p + 1 in by)


def mined(rows, relabel, positives=5, negatives=3):
    """The contract over (vec_id, embedding, label): all scores."""
    kept = [(i, [math.floor(256 * float(x)) for x in e], relabel(i, y)) for i, e, y in rows if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for x, (i, q, y) in enumerate(kept):
        if i % 50:
            continue
        others = [(-dot(q, e), j, z) for k, (j, e, z) in enumerate(kept) if k != x and len(e) == len(q)]
        for p, j in sorted((s, j) for s, j, z in others if z == y)[:positives]:
            fit = sorted((s, k) for s, k, z in others if z != y and 50 * -p <= 100 * -s <= 95 * -p)[:negatives]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 0.3
    rows = []
    for i in range(n):
        v = (centres[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.3])).astype(np.float32)
        rows.append((i, [float(x) for x in v], int(rng.integers(4))))
    return rows


MOVED = lambda i, y: (y + 1) % 10 if i % 7 == 0 else y
RELABEL = lambda: F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize(("seed", "block", "anchors", "kind"), [(1, 2048, 4096, "float"), (2, 40, 3, "float"), (3, 64, 2, "double")])
def test_hard_negatives_equal_all_scores(spark, monkeypatch, seed, block, anchors, kind):
    """Ties by equal vectors, one label in most rows, one block and many."""
    monkeypatch.setattr(hard_negatives, "ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rows = vectors(seed)
    rows += [(1000 + i, rows[0][1], 1) for i in range(60)]  # a group of copies
    got = hard_negatives.mine(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").repartition(4), RELABEL())
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, MOVED)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(50, None, 1), (None, [1.0, 1.0], 1), (100, [1.0, nan], 1), (150, [inf, 1.0], 1), (200, [1.0, None], 1), (250, [1.0, 1.0], None), (300, [1.0, 2.0, 3.0], 1), (350, [0.0, 0.0], 2), (400, [-1.0, -1.0], 3), (1, [-1.0, -1.0], 3), (2, [-0.4, -0.3], 4), (450, [], 1)]
    plain = [(i, [1.0 + i / 100, 0.5], i % 2) for i in range(500, 560)] + [(3, [1.0, 1.0, 1.0], 1), (4, [0.3, 0.3, 0.3], 2)]
    rows = odd + plain
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id bigint, embedding array<double>, label int, row string, score string")
    assert sorted(tuple(r) for r in hard_negatives.mine(df, RELABEL()).collect()) == mined([r for r in rows if r[1] != []], MOVED)
    assert hard_negatives.mine(df.limit(0), RELABEL()).collect() == []
    few = spark.createDataFrame([(50, [1.0], 1), (1, [1.0], 2)], "vec_id bigint, embedding array<double>, label int")
    assert hard_negatives.mine(few).collect() == []  # no positive


def test_hard_negatives_beyond_doubles(spark):
    """Scores that doubles can't hold exactly."""
    rng = random.Random(4)
    rows = [(i, [rng.uniform(1e6, 2e6) for _ in range(3)], i % 3) for i in range(0, 150)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), RELABEL())
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, MOVED)


def test_repeated_anchors(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (7, [0.8, 0.0], 2), (8, [0.7, 0.1], 3)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    want = mined(rows, lambda i, y: y)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 4


def test_pivots_bracket_scores():
    """No score lies outside of its bracket, and brackets leave rows out."""
    rng = np.random.default_rng(3)
    x = np.floor(np.concatenate([rng.normal(size=(300, 24)) * 5 + c for c in (-200, 0, 200)]))
    pivots = hard_negatives.Pivots(x[::7], float((x * x).sum(1).max()))
    q = x[::50]
    low, high = hard_negatives.brackets(pivots, (q * q).sum(1), pivots.of_anchors(q), pivots.of_rows(x))
    score = q @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert (high < np.sort(score, axis=1)[:, -5, None]).mean() > 0.5
