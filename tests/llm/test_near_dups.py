"""Near-duplicates against comparisons of all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quillmine.llm import _words, embedding_dups, minhash

from .conftest import edge_texts


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows, size, percent):
    """(doc_id, n_shingles, component_id, kept) of rows in the order of doc_id."""
    sets = [minhash.shingle_set(t, size) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = components(len(rows), links)
    return sorted((i, len(sets[k]), rows[roots[k]][0], rows[roots[k]][0] == i) for k, (i, _) in enumerate(rows))


def families(seed, n=150):
    """Families of edited copies, so that many pairs lie on either side of the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 6)))
    bases = [[word() for _ in range(rng.choice([3, 12, 60, 150]))] for _ in range(5)]
    out = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = word().upper() if rng.random() < 0.3 else word()
        out.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return out


@pytest.mark.parametrize("size, percent, block, shingles", [(3, 85, 1024, 400_000), (5, 80, 1024, 500), (3, 85, 16, 400_000), (2, 60, 8, 400_000)])
def test_links_of_edited_copies(make, monkeypatch, size, percent, block, shingles):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SHINGLES", shingles)
    rows = families(size * 100 + percent + block)
    got = minhash.near_duplicates(make(rows), size, percent).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, size, percent)


def test_pivot_rounds(make, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", 4)
    rows = families(9)
    assert sorted(tuple(r) for r in minhash.near_duplicates(make(rows), 3, 85).collect()) == brute(rows, 3, 85)


def test_documents(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    assert sorted(tuple(r) for r in minhash.near_duplicates(documents, 3, 85).collect()) == brute(rows, 3, 85)


def test_odd_rows(edge, empty, make):
    got = minhash.near_duplicates(edge, 3, 85).collect()
    assert len(got) == len(edge_texts())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[-7] == [(0, -7, True)]
    assert by[None] == [(2, None, True)]
    assert by[3] == [(1, 3, True)] * 2 and by[8] == [(1, 3, False)]
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.keep_one(edge)
    assert left.columns == edge.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in left.select("doc_id").collect() if r.doc_id is not None) == [(False, i) for i in (-7, 1, 2, 3, 4, 5, 6)]
    assert left.filter("doc_id is null").count() == 1
    assert minhash.near_duplicates(make([(1, "a b c d")]), 3, 85).collect()[0].component_id == 1


def test_rows_without_ids_stay_beside_repeated_ids(make):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (None, None), (3, "one two"), (3, "one two"), (4, None), (4, None)]
    left = minhash.keep_one(make(rows))
    assert left.columns == make(rows).columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([*rows[:4], rows[4], rows[6]], key=str)
    assert minhash.keep_one(make(rows[:5])).count() == 5


def test_repeated_ids_lose_no_text(make):
    """Rows are kept by their own texts, whatever other row has their doc_id."""
    a, b, c = "a b c d e f g h", "one two three four five six", "x y z u v w"
    left = lambda rows: sorted(((r.doc_id, r.text) for r in minhash.keep_one(make(rows)).collect()), key=str)
    assert left([(1, a), (5, a), (5, b)]) == [(1, a), (5, b)]
    assert left([(5, a), (5, b), (3, a), (7, b)]) == [(3, a), (5, b)]  # row (5, b) leads its own group
    assert left([(5, a), (5, a + " i"), (5, c), (2, c)]) in ([(2, c), (5, a)], [(2, c), (5, a + " i")])
    assert left([(1, a)] * 3 + [(None, a)] * 2 + [(2, None)] * 2 + [(2, "")]) == sorted([(1, a), (None, a), (None, a), (2, None), (2, "")], key=str)
    got = minhash.near_duplicates(make([(5, a), (5, b), (3, a), (7, b)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False)]


def test_repeats_with_other_columns_keep_one_of_them(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", "z"), (3, None, "p"), (3, None, "q"), (4, "other words altogether", "r")]
    schema = "doc_id bigint, text string, row string"
    kept = [sorted(map(tuple, minhash.keep_one(spark.createDataFrame(order, schema).repartition(n)).collect()), key=str) for order, n in ((rows, 1), (rows[::-1], 3))]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 3, 4]
    assert minhash.keep_one(spark.createDataFrame([], schema)).columns == ["doc_id", "text", "row"]


def test_links_for_each_member_are_few_in_families_of_any_size(spark, monkeypatch):
    rng, rows = random.Random(8), []
    passed = {}
    whole = minhash.connected_components
    monkeypatch.setattr(minhash, "connected_components", lambda links, scratch, name: passed.setdefault(name, []).append(links.count()) or whole(links, scratch, name))
    for n in (200, 800):
        base = [f"w{i}" for i in range(120)]
        rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(10**6)}" for w in base)) for i in range(n)]
        passed.clear()
        minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80)
        assert passed["first-components"][0] <= 1.7 * n


def test_estimates_are_unbiased(spark):
    """The estimate by equal lanes, corrected for chance, is near the true similarity on average."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(4_000)]
    pairs = []
    for i in range(60):
        common = rng.choice(words, 200, replace=False)
        own = [" ".join([*common[: 150 + k], *rng.choice(words, 50, replace=False)]) for k in (0, 40)]
        pairs += [(2 * i, own[0]), (2 * i + 1, own[1])]
    df = spark.createDataFrame(pairs, "doc_id bigint, text string")
    sig = {r.doc_id: r for r in minhash.signatures(df, 1, 24, 5).collect()}
    low, errors = int("01" * 32, 2), []
    for i in range(60):
        a, b = sig[2 * i], sig[2 * i + 1]
        differ = sum(bin((d | (d >> 1)) & low).count("1") for x, y in zip(a.packed, b.packed, strict=True) for d in [(x ^ y) & (2**64 - 1)])
        x, y = (minhash.shingle_set(t, 1) for t in (pairs[2 * i][1], pairs[2 * i + 1][1]))
        errors.append(((1 - differ / 120) - 0.25) / 0.75 - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_words_on_bytes():
    texts = [None, "", " \t", "One  two\nTWO three", "é É x" * 700, "a" * 5_000, "b"]
    column = pa.array(texts)
    whole = _words.words(column, shapes=True)
    cut = _words.CHUNK
    try:
        _words.CHUNK = 64
        parts = _words.words(column, shapes=True)
    finally:
        _words.CHUNK = cut
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))
    assert whole[1].tolist() == [len(minhash.WORD.findall((t or "").encode())) for t in texts]
    sliced = _words.words(column.slice(3, 2))
    assert (sliced[0] == whole[0][: sliced[1].sum()]).all()


def brute_vectors(rows, threshold):
    ok = lambda v: v is not None and len(v) and None not in v and all(map(math.isfinite, v)) and any(v)
    unit = [np.array(v, np.float64) / np.linalg.norm(v) if ok(v) else None for _, v in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    roots = components(len(rows), links)
    n = [sum(k in p for p in links) for k in range(len(rows))]
    return sorted((i, n[k], rows[roots[k]][0], rows[roots[k]][0] == i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("bucket, block", [(1024, 2048), (16, 2048), (16, 8)])
def test_vectors(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(embedding_dups, "BUCKET", bucket)
    monkeypatch.setattr(embedding_dups, "BLOCK", block)
    rng = np.random.default_rng(bucket + block)
    centres = rng.normal(size=(12, 24))
    vectors = [(centres[i % 12] + rng.normal(size=24) * rng.choice([0.02, 0.2, 0.35])).astype(np.float32).tolist() for i in range(220)]
    vectors += [vectors[0], vectors[0], vectors[5], [0.0] * 24, None, [], [float("nan")] * 24, [None, *[1.0] * 23], [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0], [1e30] * 24, [1e-30] * 24]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, n_links string")
    got = embedding_dups.near_duplicates(df, 0.9).collect()
    assert sorted(tuple(r) for r in got) == brute_vectors(rows, 0.9)


def test_vectors_without_ids_or_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    got = embedding_dups.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [(0, 0, None, True), (4, 1, 4, True), (4, 1, 4, True)]
    assert embedding_dups.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_rotated_codes_estimate_without_bias():
    """<rotated query, code> / factor has the cosine as its mean, and the bound holds."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    errors = []
    for k in range(30):
        q, r = np.linalg.qr(np.random.default_rng(k).normal(size=(64, 64)))
        y = x @ (q * np.sign(np.diag(r))).T
        code, factor = np.sign(y) / 8, np.abs(y).sum(1) / 8
        errors.append((y @ code.T) / factor - x @ x.T)
        bound = embedding_dups.SIGMAS * np.sqrt((1 - factor**2) / factor**2 / 63)
        assert (np.abs(errors[-1]) <= bound + 1e-9).mean() > 0.99999
    assert abs(np.mean(errors)) < 1e-3


@pytest.mark.parametrize("pairs", [1, 3, 5, 100_000])
def test_links_are_carried_over_parts_of_a_block(monkeypatch, pairs):
    monkeypatch.setattr(embedding_dups, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    blocks = [(np.array([2, 1, 3, 0, 4]), np.array([2, 3, 4, 1, 0]))] + [(rng.permutation(16), rng.permutation(16)) for _ in range(40)]
    for place, ids in blocks:  # a chain: each vector links with those beside it only
        n, angles = len(ids), np.deg2rad(20 * place)
        x = np.stack([np.cos(angles), np.sin(angles)], 1).astype("<f4")
        column = lambda v: [v] * n  # noqa: E731, B023
        t = pa.table({
            "dim": column(2), "place": column(0), "i": column(0), "j": column(0), "slot": column(0), "id": ids, "n": np.ones(n, np.int64), "vec": [v.tobytes() for v in x], "keys": column([0]),
        })
        got, links, root = embedding_dups.links_in_block(t, 0.9, "<f4")
        assert (got == ids).all() and (links == np.where((place == 0) | (place == n - 1), 1, 2)).all()
        assert set(root) == {0}


def test_rows_that_fetch_their_vectors_lose_no_pair():
    """Every row with a pair at the threshold is there; of rows far from all others few are."""
    rng = np.random.default_rng(3)
    for dim in (8, 64):
        base = rng.normal(size=(300, dim))
        near = base[:40] + rng.normal(size=(40, dim)) * 0.3 * np.linalg.norm(base[:40], axis=1, keepdims=True) / np.sqrt(dim)
        x = np.concatenate([base, near])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = x @ embedding_dups.rotation(dim).T
        step = np.abs(y).max(1) / 127.5
        levels = np.clip(np.floor(y / step[:, None]), -128, 127)
        n, gap = len(x), np.linalg.norm(y - (levels + 0.5) * step[:, None], axis=1)
        t = pa.table({"dim": [dim] * n, "i": [0] * n, "j": [0] * n, "slot": [0] * n, "step": step, "gap": gap, "factor": np.abs(y).sum(1) / np.sqrt(dim), "levels": [r.tobytes() for r in levels.astype(np.int8)]})
        cosines = x @ x.T - np.eye(n)
        got, want = set(embedding_dups.near_in_block(t, 0.9)), set(np.flatnonzero((cosines >= 0.9).any(1)))
        assert want <= got and len(want) > 30 and got <= set(np.flatnonzero((cosines >= 0.85).any(1)))
