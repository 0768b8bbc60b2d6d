"""Counts, ids and packing against the libraries, on whole tables and odd texts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmine.llm import bpe, packing, token_counts

from .conftest import edge_texts

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SP, TK = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
COUNTER, ENCODER, LIBRARY = token_counts.Counter(PIECES), bpe.Encoder(BYTES), packing.LibraryIds(BYTES)


def ids_of(text):
    return TK.encode(text, add_special_tokens=False).ids


TEXTS = st.text(st.one_of(st.sampled_from("ab c\n\t  ▁é漢.,'0"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_any_text(text):
    assert COUNTER([text]) == [len(SP.encode(text))]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_any_text(text):
    got = ENCODER([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == ids_of(text)
    assert ENCODER.decode(got) == TK.decode(ids_of(text), skip_special_tokens=False) == text


def test_long_words():
    rng = random.Random(1)
    texts = ["".join(rng.choices(a, k=9_000)) for a in ("abcdefghijklmnopqrstuvwxyz", "ab", "漢字é a", "▁ x")]
    assert COUNTER(texts) == [len(x) for x in SP.encode(texts)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER(texts)] == [ids_of(t) for t in texts]


def test_very_long_runs():
    """A million white-space characters and more: the ids of the library, in bounded time, in op5 and in op9 (and so the pipeline)."""
    library = packing.LibraryIds(BYTES)
    rng = random.Random(2)
    for text in (" " * 2_000_000, "\n" * 2_000_000, " \n" * 500_000 + "a", "ab" * 40_000, "word " + " " * 1_000_001 + "x", "".join(rng.choices("aeinrst", k=70_000))):
        want = ids_of(text)
        assert np.frombuffer(library([text])[0], "<u4").tolist() == want
        assert np.frombuffer(ENCODER([text])[0], "<u4").tolist() == want
    library, encoder = packing.LibraryIds(BYTES), ENCODER
    text = "<|endoftext|> a<|endoftext|>\n  b " * 3
    assert np.frombuffer(library([text])[0], "<u4").tolist() == np.frombuffer(encoder([text])[0], "<u4").tolist() == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12), min_size=1, max_size=60))
def test_places_matched_together_are_those_met_one_by_one(words):
    v, joined = ENCODER.vocabulary, b"".join(words)
    kept, bpe.PLACES = bpe.PLACES, 7
    try:
        tokens, seq = v.everywhere(joined, 3)
    finally:
        bpe.PLACES = kept
    assert tokens.tolist() == v.stepped([joined])[0].tolist() and set(seq.tolist()) == {3}


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_by_the_library_any_text(text):
    assert np.frombuffer(LIBRARY([text])[0], "<u4").tolist() == ids_of(text)


def test_every_border_check_agrees_with_merging():
    """compatible() says yes just where merging the joined bytes gives the two tokens back."""
    v, rng = ENCODER.vocabulary, np.random.default_rng(0)
    a, b = rng.integers(0, 50_000, 4_000), rng.integers(0, 50_000, 4_000)
    lone = [i for i in range(4_000) if len(ids_of(v.bytes[a[i]].decode("utf-8", "replace"))) == 1]
    tokens, seq = v.exact([v.bytes[x] + v.bytes[y] for x, y in zip(a, b, strict=True)])
    own = np.zeros(v.size, bool)
    one, at = v.exact([v.bytes[x] for x in range(50_256)])
    single = np.flatnonzero(np.bincount(at, minlength=50_256) == 1)
    own[single] = one[np.searchsorted(at, single)] == single
    ok = v.compatible(a, b)
    for i in lone:
        if own[a[i]] and own[b[i]]:
            assert ok[i] == (tokens[seq == i].tolist() == [a[i], b[i]])


def test_counts_of_tables(edge, empty, documents):
    for df, texts in ((documents, {r.doc_id: r.text for r in documents.collect()}), (edge, dict(edge_texts()))):
        got = token_counts.count_tokens(df, limit=100).collect()
        assert len(got) == df.count()
        for r in got:
            t = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(SP.encode(t)), len(SP.encode(t)) > 100)
    assert token_counts.count_tokens(empty).count() == 0


def test_ids_of_tables(edge, empty, documents):
    for df, texts in ((documents, {r.doc_id: r.text for r in documents.collect()}), (edge, dict(edge_texts()))):
        got = bpe.encode_decode(df).collect()
        assert len(got) == df.count()
        for r in got:
            t = texts[r.doc_id] or ""
            ids = ids_of(t)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.encode_decode(empty).count() == 0
    assert {r.doc_id: r.token_ids for r in bpe.encode(edge).collect()}[3] == ids_of("one")


def greedy(lengths, capacity):
    """Best-fit decreasing, one piece after another."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return len(left)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_places_equal_best_fit_decreasing(case):
    capacity, lengths = case
    rows, bins = packing.best_fit(dict(Counter(lengths)), capacity)
    assert bins == greedy(lengths, capacity)
    filled, numbers = {}, {}
    for length, number, count, first, offset in rows.tolist():
        for k in range(count):
            filled.setdefault(first + k, []).append((offset, length))
            numbers.setdefault(length, []).append(number + k)
    assert {n: sorted(x) for n, x in numbers.items()} == {n: list(range(c)) for n, c in Counter(lengths).items()}
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_of_tables(edge, empty, documents, capacity):
    for df, texts in ((documents, [(r.doc_id, r.text) for r in documents.collect()]), (edge, edge_texts())):
        got = packing.pack(df, capacity).collect()
        want = Counter()
        for i, t in texts:
            ids = [*ids_of(t or ""), 0]
            cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in bins.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) == greedy([r.length for r in got], capacity)
    assert packing.pack(empty).count() == 0


def test_a_worker_keeps_the_words_that_it_has_met(monkeypatch):
    """The tasks of a worker share one memory, and a word that it has isn't learned again."""
    library, learned = packing.library_ids(BYTES), []
    assert packing.library_ids(BYTES) is library
    learn = packing.LibraryIds.learn
    monkeypatch.setattr(packing.LibraryIds, "learn", lambda self, words: (learned.extend(words), learn(self, words)))
    texts = ["zorble quaxix zorble", "é\x7f zorble\n\x00", ""]
    first = library(texts)
    assert packing.library_ids(BYTES)(texts) == first and len(learned) == len(set(learned)) > 0
    assert [np.frombuffer(x, "<u4").tolist() for x in first] == [ids_of(t) for t in texts]
