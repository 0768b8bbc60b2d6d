"""Token counts of whole texts by rank-synchronous merging of ragged numpy arrays.

The texts of a batch are cut into pre-tokens that no merge can cross; every distinct pre-token becomes one
sequence of a ragged array. Each round finds the lowest-ranked adjacent pair of every sequence at once and
joins all its places, until no sequence has a pair left; the surviving symbols are counted.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._merges import PairTable, merge_all
from ._shared import map_text, tokenizer_path

SPACE = "▁"
#: Pre-tokens remembered by a worker; the memory is emptied when full, which changes no result.
REMEMBERED = 200_000


class Pieces:
    """A sentencepiece BPE vocabulary: the symbol of each character and the pairs that join."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        order = sorted(plain.values(), key=lambda i: (-sp.get_score(i), i))
        rank = np.zeros(n, np.int64)
        rank[order] = np.arange(len(order))
        self.chars = {p: i for p, i in plain.items() if len(p) == 1}
        self.by_point = np.full(0x110000, -1, np.int32)
        self.by_point[[ord(c) for c in self.chars]] = list(self.chars.values())
        ways = [(plain[p[:k]], plain[p[k:]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        left, right, made = np.array(ways, np.int64).T
        self.pairs = PairTable(left, right, made, rank, n + 1)
        # if no piece holds a space mark after another character, no merge crosses one
        self.splits = all(SPACE not in p.lstrip(SPACE) for p in plain)


class Counter:
    """Counts tokens as a sentencepiece BPE model with byte fallback does, without begin and end tokens."""

    def __init__(self, model_file: str):
        self.pieces = Pieces(model_file)
        self.known: dict[str, int] = {}
        self.runs = re.compile(f"{SPACE}+[^{SPACE}]*")

    def pretokens(self, text: str) -> list[str]:
        """The text's pre-tokens, each without its first space mark."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if not self.pieces.splits:
            return [marked[1:]]
        if SPACE * 2 not in marked:
            return marked.split(SPACE)[1:]
        return [x[1:] for x in self.runs.findall(marked)]

    def learn(self, words: list[str]) -> None:
        chars = self.pieces.chars
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        points = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = self.pieces.by_point[points].astype(np.int64)
        seq = np.repeat(np.arange(len(words)), lengths)
        counts = np.bincount(merge_all(self.pieces.pairs, flat, seq)[1], minlength=len(words))
        for i in np.unique(seq[flat < 0]):  # characters outside the vocabulary: a token for each byte
            counts[i] += sum(len(c.encode("utf-8", "replace")) - 1 for c in words[i] if c not in chars)
        self.known.update(zip(words, counts.tolist(), strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [self.pretokens(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*cut) - self.known.keys()
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in cut]


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Null texts count as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows are counted each;
    an empty table gives an empty result; other columns of docs aren't read. Texts of any length are whole.
    """

    def make():
        counter = Counter(tokenizer_path(model))
        return lambda texts: [counter(texts)]

    counted = map_text(docs.withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), make, "n_tokens bigint", ("doc_id", "_bytes"))
    return counted.select("doc_id", F.col("_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
