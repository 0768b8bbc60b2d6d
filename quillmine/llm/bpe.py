"""Byte-level BPE encoding by speculation, and decoding.

Greedy longest match proposes the tokens of every distinct word of a batch, all words stepping through a trie
together. A token sequence is what BPE gives exactly if each token is (a token that BPE gives for its own bytes)
and each adjacent pair is compatible; a vectorised check undoes the merges of both tokens of a pair and looks
for a merge across their border that would have come first. Only the words that fail are merged exactly.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame

from ._merges import PairTable, merge_all
from ._shared import map_text, tokenizer_path

#: The pre-tokenizer's pattern of byte-level BPE (fixed by the vocabulary file's kind).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a worker; the memory is emptied when full, which changes no result.
REMEMBERED = 1_000_000
#: Bytes of a word above which its places are matched together, not its bytes one after another, and places at a time.
STEPPED, PLACES = 64, 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Tables of a byte-level BPE file of the tokenizers library."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        alphabet = byte_alphabet()
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(*ids.values(), *self.special.values())
        self.bytes: list[bytes] = [b""] * self.size
        for text, i in ids.items():
            self.bytes[i] = bytes(map(alphabet.__getitem__, text))
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([ids[x] for x in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.rank = np.full(self.size, -1, np.int64)  # -1: a byte, made by no merge
        self.rank[made] = np.arange(len(made))
        self.pairs = PairTable(left, right, made, self.rank, self.size)
        self.first, self.second = np.arange(self.size), np.arange(self.size)
        self.first[made], self.second[made] = left, right
        self.of_byte = np.zeros(256, np.int64)
        for text, b in alphabet.items():
            self.of_byte[b] = ids[text]
        self.grow()

    def exact(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by merging, and the word of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return merge_all(self.pairs, self.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), lengths))

    def grow(self) -> None:
        """A trie of the tokens that BPE gives for their own bytes, as a hashed table of steps (node, byte) -> node."""
        special = set(self.special.values())
        own = [i for i, b in enumerate(self.bytes) if b and i not in special]
        tokens, seq = self.exact([self.bytes[i] for i in own])
        lone = np.flatnonzero(np.bincount(seq, minlength=len(own)) == 1)
        reached = np.zeros(len(own), bool)
        reached[lone] = tokens[np.searchsorted(seq, lone)] == np.array(own)[lone]
        steps: dict[tuple[int, int], int] = {}
        accepts = [-1]
        for i, ok in zip(own, reached.tolist(), strict=True):
            node = 0
            for b in self.bytes[i] if ok else b"":
                if (nxt := steps.get((node, b))) is None:
                    nxt = steps[node, b] = len(accepts)
                    accepts.append(-1)
                node = nxt
            if ok:
                accepts[node] = i
        node, byte = np.array(list(steps), np.int64).T
        self.accepts = np.array(accepts, np.int64)
        self.longest = max(len(self.bytes[i]) for i in own)
        self.steps = PairTable(byte, node, np.array(list(steps.values())), np.zeros(len(accepts), np.int64), len(accepts))

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words, and the word of each; every byte is a token, so a match exists."""
        long = [i for i, w in enumerate(words) if len(w) > STEPPED]
        if not long:
            return self.stepped(words)
        out = [self.everywhere(words[i], i) for i in long]
        short = np.array([i for i, w in enumerate(words) if len(w) <= STEPPED], np.int64)
        if len(short):
            tokens, seq = self.stepped([words[i] for i in short])
            out.append((tokens, short[seq]))
        tokens, seq = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(seq, kind="stable")
        return tokens[order], seq[order]

    def everywhere(self, word: bytes, number: int) -> tuple[np.ndarray, np.ndarray]:
        """propose() for one long word: the longest matches at all its places, which step together; then a walk over them."""
        tokens: list[int] = []
        start = 0
        for a in range(0, len(word), PLACES):
            data = np.frombuffer(word[a : a + PLACES + self.longest], np.uint8).astype(np.int64)
            n = min(PLACES, len(word) - a)
            at, node, going = np.arange(n), np.zeros(n, np.int64), np.arange(n)
            token, size = np.full(n, -1, np.int64), np.zeros(n, np.int64)
            depth = 0
            while len(going):
                rank, node = self.steps.join(data[at], node)
                there = rank == 0
                depth += 1
                going, at, node = going[there], at[there] + 1, node[there]
                whole = self.accepts[node] >= 0
                token[going[whole]], size[going[whole]] = self.accepts[node[whole]], depth
                inside = at < len(data)
                going, at, node = going[inside], at[inside], node[inside]
            token, size = token.tolist(), size.tolist()
            while start < a + n:
                tokens.append(token[start - a])
                start += size[start - a]
        return np.array(tokens, np.int64), np.full(len(tokens), number, np.int64)

    def stepped(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """propose() for words of like lengths: all go through the trie together, byte by byte."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.r_[np.frombuffer(b"".join(words), np.uint8).astype(np.int64), 0]
        end = np.cumsum(lengths)
        at = end - lengths
        word = np.arange(len(words))
        node, token, after = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64), at.copy()
        out_token, out_word = [], []
        while len(word):
            inside = at < end
            rank, to = self.steps.join(np.where(inside, data[at], -1), node)
            moved = rank == 0
            node = np.where(moved, to, node)
            at = np.where(moved, at + 1, at)
            ends = np.where(moved, self.accepts[node], -1)
            token, after = np.where(ends >= 0, ends, token), np.where(ends >= 0, at, after)
            stuck = np.flatnonzero(~moved)
            out_token.append(token[stuck])
            out_word.append(word[stuck])
            at[stuck], node[stuck], token[stuck] = after[stuck], 0, -1
            if (after[stuck] >= end[stuck]).any():
                going = np.ones(len(word), bool)
                going[stuck] = after[stuck] < end[stuck]
                word, node, token, after, at, end = (x[going] for x in (word, node, token, after, at, end))
        tokens, seq = np.concatenate(out_token), np.concatenate(out_word)
        order = np.argsort(seq, kind="stable")
        return tokens[order], seq[order]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between the tokens of each pair.

        The later merge of the two is undone first. A merge across the border is a failure if its rank is
        below that of the merge just undone; on the right side also if it is the same merge, as the leftmost
        place of a merge comes first.
        """
        ok = np.ones(len(left), bool)
        todo, a, b = np.arange(len(left)), left.copy(), right.copy()
        limit = np.full(len(left), np.int64(1) << 39)
        while len(todo):
            across, _ = self.pairs.join(a, b)
            bad = across < limit
            ok[todo[bad]] = False
            undo_left = self.rank[a] > self.rank[b]
            over = (self.rank[a] < 0) & (self.rank[b] < 0)
            limit = np.where(undo_left, self.rank[a], self.rank[b] + 1)
            a, b = np.where(undo_left, self.second[a], a), np.where(undo_left, b, self.first[b])
            going = ~(bad | over)
            todo, a, b, limit = todo[going], a[going], b[going], limit[going]
        return ok


class Words:
    """Cuts texts where no merge crosses; special strings in a text are words of their own."""

    def __init__(self, special: dict[str, int]):
        import regex

        self.cut = regex.compile(PATTERN).findall
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

    def __call__(self, text: str) -> list[str]:
        if self.split and any(s in text for s in self.special):
            return [w for part in self.split(text) for w in ([part] if part in self.special else self.cut(part))]
        return self.cut(text)


class Remembering:
    """Token ids of texts, as little-endian unsigned 32-bit integers, from those of their words; learn() adds new words."""

    def __init__(self, special: dict[str, int]):
        self.words = Words(special)
        self.known: dict[str, bytes] = dict(self.words.special)

    def learn(self, words: list[str]) -> None:
        raise NotImplementedError

    def remember(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Takes the words' ids, one after another, and how many each word has."""
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        self.known.update((w, data[a:b]) for w, a, b in zip(words, [0, *ends], ends, strict=False))

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = dict(self.words.special)
        get = self.known.get
        found = [list(map(get, words)) for words in cut]
        lacking = [(words, ids) for words, ids in zip(cut, found, strict=True) if None in ids]
        new = {w for words, ids in lacking for w, x in zip(words, ids, strict=True) if x is None}
        if new:
            self.learn(list(new))
            for words, ids in lacking:
                ids[:] = [get(w) if x is None else x for w, x in zip(words, ids, strict=True)]
        return [b"".join(ids) for ids in found]


class Encoder(Remembering):
    """Encodes by speculation; words that fail the check are merged exactly."""

    def __init__(self, file: str):
        self.vocabulary = Vocabulary(file)
        super().__init__(self.vocabulary.special)
        self.proposed = self.failed = 0

    def learn(self, words: list[str]) -> None:
        v, raw = self.vocabulary, [w.encode() for w in words]
        tokens, seq = v.propose(raw)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        pairs, back = np.unique(tokens[inside] * v.size + tokens[inside + 1], return_inverse=True)
        wrong = inside[~v.compatible(pairs // v.size, pairs % v.size)[back]]
        failed = np.unique(seq[wrong])
        self.proposed, self.failed = self.proposed + len(words), self.failed + len(failed)
        self.remember(words, tokens, np.bincount(seq, minlength=len(words)))
        if len(failed):
            tokens, seq = v.exact([raw[i] for i in failed])
            self.remember([words[i] for i in failed], tokens, np.bincount(seq, minlength=len(failed)))

    def decode(self, ids: bytes) -> str:
        """The text of token ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Null texts count as empty (no ids); a null doc_id stays null; repeated rows are encoded each; an empty
    table gives an empty result; other columns of docs aren't read. Texts of any length are whole.
    """

    def make():
        encoder = Encoder(tokenizer_path(vocabulary))

        def step(texts: list[str]) -> list:
            ids = encoder(texts)
            return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids]]

        return step

    return map_text(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and token_ids, the whole ids as an array; rows as in encode_decode."""
    import pyarrow as pa

    def make():
        encoder = Encoder(tokenizer_path(vocabulary))
        return lambda texts: [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in encoder(texts)], pa.list_(pa.int32()))]

    return map_text(docs, make, "token_ids array<int>")
