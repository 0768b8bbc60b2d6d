"""Secret scans: three fixed patterns, and novelty under a primed zstandard compressor.

A string near a sensitive word is compressed behind its surroundings, with a dictionary of identifiers. What it
adds to the compressed size, per character, tells a random key (which nothing before it predicts) from a name, a
path or a word (which repeat pieces of the context or the dictionary). Incompressible strings are reported.
What is near a reported string counts as near the word, on either side, so that wrapped keys and lists are followed
to their ends. Strings of digits alone or letters alone are measured in ordinary text besides their own, in which words
and names are compressible; numbers of less than 20 digits (ids, times, card numbers) are no secrets.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import map_text, slices

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
#: Words that make the text around them sensitive.
SENSITIVE = re.compile(r"(?ai:pass(?:word|wd|phrase)|secret|token|api[ _-]?key|credential|authorization|bearer|private[ _-]?key|access[ _-]?key|signature)")
SENSITIVE_WORDS = (*ASSIGN_WORDS, "credential", "authoriz", "bearer", "private", "access", "signature", "passphrase")
SHORTEST = 16
#: Marks like . ! @ are no part of it: with them mail addresses and ends of sentences would be reported (README).
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{{{SHORTEST - 1},}}")
#: A candidate with what parts it from the next one of a list.
LISTED = re.compile(rf"({CANDIDATE.pattern})[\s,;'\"]*")
#: What may follow the last full line of a wrapped key, and the line that ends a block of them.
REST = re.compile(rf"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_=-]{{1,{SHORTEST - 1}}})[ \t]*(?:\r?\n[ \t]*(-----END)|\r?\n|\Z)")
#: Characters between a candidate and the sensitive word or the secret that makes it one, and characters around it that
#: prime the compressor.
REACH = CONTEXT = 400
#: Characters of a piece that two candidates must share for one to predict the other.
PIECE = 6
#: Compressed bytes a character must add. A string that nothing before it predicts adds about 1.
NOVELTY = 0.8
#: Digits that a string of digits alone must have: shorter ones are 64-bit ids, times, card and account numbers.
LONG_NUMBER = 20
#: Text with the usual frequencies of letters and digits, in which strings of digits or letters alone are measured.
ORDINARY = (
    "When we moved the old ledger to another building in March 1987, nobody could say how many volumes there were: 213 by one count, 240 by the next. Most had been bound "
    "before 1956, and a few still smelled of smoke. Quite often a page was missing; Jack Fox, Eva Zhou and I kept a list, which grew to 65 lines. On 9 July the rain came through "
    "the roof, just above the shelves for X, Y and Z, so that we carried everything downstairs again. Do not expect a happy end. Half of it is gone, but what remains tells us plenty. "
)
#: What identifiers, paths and settings are made of; primes the compressor.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1111111111111111 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX "
    "password passwd secret token api_key apikey access_key private_key public_key client_id client_secret credential authorization bearer signature "
    "config settings options parameter environment variable default example sample placeholder changeme replace_me your_ my_ test dummy none null true false undefined "
    "function return import class public static final void string integer boolean self this const let var def lambda async await print format value name user account "
    "request response session connection database server client service manager handler factory controller repository provider context application component "
    "http https www .com .org .net .example localhost /usr/local/bin /etc/ /var/lib/ /home/ .json .yaml .xml .txt .html index.html index.php "
    "get_ set_ create_ update_ delete_ find_ load_ save_ read_ write_ open_ close_ start_ stop_ init_ build_ parse_ "
    "getUser setValue createSession updateAccount deleteToken findByName loadConfig saveState readFile writeFile SHA256 base64 utf-8 sha512 "
)


class Scanner:
    """Finds (kind, start, end) in code points, end exclusive, ordered by start and then kind."""

    def __init__(self):
        import zstandard

        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.measured = 0  # candidates whose novelty was asked for
        self.size = lambda data, c=zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False): len(c.compress(data))

    def base(self, text: str, lower: str) -> list[tuple[int, int, int]]:
        found = []
        if any(w in lower for w in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return found

    def novelty(self, text: str, start: int, end: int, reach: int = CONTEXT) -> float:
        """Bytes that text[start:end] adds behind its surroundings, per byte of it.

        Other candidates there count only if they share a piece with it: the lines of one key don't predict each
        other, but their letters' frequencies alone would make each line look compressible.
        """
        self.measured += 1
        pieces = {text[i : i + PIECE] for i in range(start, end - PIECE + 1)}
        kept = lambda m: m[0] if any(m[1][i : i + PIECE] in pieces for i in range(len(m[1]) - PIECE + 1)) else ""
        around = (LISTED.sub(kept, part) for part in (text[max(0, start - reach) : start], text[end : end + CONTEXT]))
        before = "\n".join(around).encode("utf-8", "replace")
        own = text[start:end].encode("utf-8", "replace")
        return (self.size(before + b"\n" + own) - self.size(before + b"\n")) / len(own)

    def novel(self, text: str, start: int, end: int) -> bool:
        """Whether a candidate's novelty makes it a secret. Numbers and letters alone are measured in ordinary text, in which
        names and words are compressible, however short the text is; letters of one case count as small ones."""
        own = text[start:end]
        digits, letters = any(c.isdigit() for c in own), any(c.isalpha() for c in own)
        if digits and letters:
            return self.novelty(text, start, end) >= NOVELTY
        if not letters and sum(c.isdigit() for c in own) < LONG_NUMBER:
            return False
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        whole = f"{ORDINARY}{before}{own}{after}"
        if letters and (own.isupper() or own.islower()) and len(low := whole.lower()) == len(whole):
            whole = low
        start = len(ORDINARY) + len(before)
        return self.novelty(whole, start, start + len(own), len(ORDINARY) + CONTEXT) >= NOVELTY

    def candidates(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The sensitive words, and the runs of SHORTEST characters and more between them, wherever they stand."""
        words = [m.span() for m in SENSITIVE.finditer(text)]
        gaps = zip([0, *(b for _, b in words)], [*(a for a, _ in words), len(text)], strict=True) if words else ()
        return words, [m.span() for a, b in gaps for m in CANDIDATE.finditer(text, a, b)]

    def added(self, text: str, lower: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates that are novel and near a sensitive word or another such candidate, those in base spans too.

        One pass forward and one back find all of them: what a string found on the way back lies near to is near, too,
        to that which made it one.
        """
        if not any(w in lower for w in SENSITIVE_WORDS):
            return []
        words, runs = self.candidates(text)
        novel: dict[tuple[int, int], bool] = {}

        def measured(run: tuple[int, int]) -> bool:
            if run not in novel:
                novel[run] = self.novel(text, *run)
            return novel[run]

        both = sorted([(*w, True) for w in words] + [(*r, False) for r in runs])
        limit = -1
        for a, b, word in both:
            if word or (a <= limit and measured((a, b))):
                limit = b + REACH
        limit = len(text) + 1
        for a, b, word in reversed(both):
            if word or novel.get((a, b)) or (b >= limit and measured((a, b))):
                limit = a - REACH
        found = sorted((a, 3, b) for (a, b), yes in novel.items() if yes)
        spans = merged(sorted(taken))
        return found + self.rests(text, found, [a for a, _, _ in spans], spans)

    def rests(self, text: str, found: list[tuple[int, int, int]], starts: list[int], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Last lines of wrapped keys that are too short for candidates: behind two lines of one length, or before an END line."""
        out, before = [], (0, 3, 0)
        for span in found:
            wrapped = before[2] - before[0] == span[2] - span[0] and text[before[2] : span[0]].strip() == "" and "\n" in text[before[2] : span[0]]
            if (m := REST.match(text, span[2])) and (m[2] or wrapped and not m[1].isalpha()):
                i = bisect_left(starts, m.end(1))
                if not i or spans[i - 1][2] <= m.start(1):
                    out.append((m.start(1), 3, m.end(1)))
            before = span
        return out

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        lower = text.lower()
        base = self.base(text, lower)
        return sorted(base + self.added(text, lower, base))


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    novel spans are the runs of 16 letters, digits and +/_=- (none starts with =; sensitive words part them) that are at
    most 400 characters from a sensitive word or from another novel run, on either side, and that add 0.8 compressed
    bytes a character at least; numbers of less than 20 digits are none. Runs inside base spans are measured like
    others, so a novel span may lie in a base span. The short last line of a wrapped key goes with the lines before.
    Null texts count as empty: no spans, and base_sha256 is that of the empty string. A null doc_id stays null;
    repeated rows are scanned each; an empty table gives an empty result; other columns of docs aren't read.
    """

    def make():
        scanner = Scanner()

        def step(texts: list[str]) -> list:
            found = [scanner(t) for t in texts]
            counts = [[sum(k == kind for _, k, _ in s) for s in found] for kind in range(3)]
            return [*counts, [hashlib.sha256(show([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found], [show(s) for s in found]]

        return step

    return map_text(docs, make, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns, with every found span of text replaced by the mark; n_chars, if there, follows.

    A null text stays null; clean texts, other columns and repeated rows stay as they are.
    """
    columns, schema = docs.columns, docs.schema
    i = columns.index("text")

    def run(batches):
        import pyarrow as pa

        scanner = Scanner()
        for whole in batches:
            for batch in slices(whole, whole.schema.names[i]):
                texts = batch.column(i).to_pylist()
                for j, text in enumerate(texts):
                    for a, _, b in reversed(merged(scanner(text)) if text else []):
                        texts[j] = texts[j][:a] + mark + texts[j][b:]
                yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if k == i else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(schema["n_chars"].dataType)) if "n_chars" in columns else out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping spans as one."""
    out: list[tuple[int, int, int]] = []
    for a, k, b in spans:
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(b, out[-1][2]))
        else:
            out.append((a, k, b))
    return out
