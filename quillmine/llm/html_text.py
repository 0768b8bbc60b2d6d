"""Main text of web pages by differences between pages with neighbouring URLs, and by structure.

Every page becomes lines of block text, each marked as body (in an article), as boilerplate (by its elements) or as open.
Pages are ordered by URL path within each host, and the lines of each, as hashes, are aligned with those of its nearest
pages by longest common subsequence: shared lines are deleted. Copies of a page are passed over, and two neighbours
have to agree, as one may quote the page. Structure then takes what differencing can't tell: menus that differ from page
to page go with their elements, and lines of an article stay where a few pages share them, as these copy and quote; those that
all of many neighbours have (MANY) are the site's notices.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ._shared import slices

#: What a line is. WRAPPED: boilerplate by a class, id or role, which an article inside (not one of comments) undoes.
BODY, OPEN, BOILERPLATE, WRAPPED = 0, 1, 2, 3
#: Part of the text that two pages must not share, in either of them, to be no copies of one another.
OWN = 0.1
#: Pages in a chunk that is compared at once, and pages on either side of a page among which its neighbours are looked for.
CHUNK, WINDOW = 256, 16
#: Different pages that must all have a line of an article for it to be no text of the article.
MANY = 8
#: Elements whose content is no text, up to their end tag.
RAW = ("script", "style", "noscript", "template", "iframe", "annotation", "annotation-xml", "object", "canvas", "audio", "video", "textarea", "title", "head")
#: Elements that are never main text, wherever they stand; a header counts only outside of the article.
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset"}
#: Words of a class, id or role that mark an element as no main text.
MARKS = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification",
    "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar",
}
#: Words that say nothing of what an element holds. Inside of an article, whose own subjects may have names like those above
#: (social policy, share-price), a name marks an element only if all its words are of either kind.
FILL = {"area", "bar", "block", "box", "button", "buttons", "container", "content", "element", "group", "holder", "inline", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "panel", "post", "posts", "right", "row", "section", "slot", "top", "unit", "widget", "wrap", "wrapper"}
#: Words that leave no doubt, whatever other classes an element has; the others mark it only if all of its names do.
PLAIN = {"ad", "ads", "adv", "advert", "advertisement", "advertising", "sponsored", "comments", "disqus", "newsletter", "cookie", "cookies", "gdpr", "breadcrumb", "breadcrumbs", "pagination", "sidebar", "navbar"}
#: Those of the marks that hold articles of their own.
TALK = {"comment", "comments", "disqus", "replies", "respond", "related", "sponsored", "ad", "ads"}
#: Words of a name that tells how something is, not what it is.
STATES = {"has", "with", "no", "without", "open", "closed", "enabled", "disabled"}
BLOCKS = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
    "li", "main", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *OUTSIDE,
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Quotes count only behind an equals sign; possessive runs keep broken markup linear.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<([!?])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>=]++|=)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?""")
ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


def attributes_of(text: str) -> dict[str, str]:
    """An element's attributes by lower-cased name, the first of a name; a value is never taken for a name."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    return out


def names(given: dict[str, str]) -> list[list[str]]:
    """The words of each name in an element's class, id and role; names that tell a state, as has-sidebar, are left out."""
    out = []
    for name in " ".join(given.get(a, "") for a in ("class", "id", "role")).split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        if words and STATES.isdisjoint(words):
            out.append(words)
    return out


def hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or bool(re.search(r"(?i)display\s*:\s*none", given.get("style", "")))


def marked(name: str, given: dict[str, str], inside: bool) -> int:
    """OPEN, WRAPPED or BOILERPLATE by an element's attributes. A page's own frame (html, body, main) isn't judged by them.

    An article is one whatever its classes say of it, unless one of them calls it a comment or an advert and nothing else.
    inside: whether the element stands in an article, where only whole names count.
    """
    if name in ("html", "body", "main"):
        return OPEN
    if hidden(given):
        return BOILERPLATE
    found = names(given)
    if is_body(name, given):
        return BOILERPLATE if any(words[0] in TALK and len(words) <= 2 for words in found) else OPEN
    if inside:
        whole = [not MARKS.isdisjoint(x) and MARKS.issuperset(set(x) - FILL) for x in found]
        if not any(w and not PLAIN.isdisjoint(x) for w, x in zip(whole, found, strict=True)) and not (any(whole) and all(w or FILL.issuperset(x) for w, x in zip(whole, found, strict=True))):
            return OPEN
    words = {w for x in found for w in x}
    return OPEN if words.isdisjoint(MARKS) else WRAPPED if words.isdisjoint(TALK) else BOILERPLATE


def is_body(name: str, given: dict[str, str]) -> bool:
    return name in ("article", "main") or given.get("role") == "main"


def lines(page: str) -> list[tuple[str, int]]:
    """The page's blocks of text in order, each with BODY, OPEN, BOILERPLATE or WRAPPED."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that change the kind of the text in them, or enclose such
    kind, at, n = OPEN, 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, kind))

    while at < n:
        m = TAG.search(page, at)
        held.append(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        attributes = m[4] or ""
        if m[2]:
            if name in BLOCKS:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        kind = stack[k][1]
                        del stack[k:]
                        break
        elif name in ENDS:
            if not attributes.endswith("/"):
                end = ENDS[name].search(page, at)
                at = end.end() if end else (n if name in ("script", "style", "textarea", "title") else at)
        else:
            if name == "br":
                held.append(" ")
            if name in BLOCKS:
                flush()
            if name in VOID or attributes.endswith("/") or name not in BLOCKS:
                continue
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name == "li"):  # its end tag was left out
                kind = stack.pop()[1]
            inner = kind
            if kind != BOILERPLATE:
                given = attributes_of(attributes)
                mark = marked(name, given, kind == BODY) if given else OPEN
                if name in OUTSIDE or (name == "header" and kind != BODY) or mark == BOILERPLATE:
                    inner = BOILERPLATE
                elif mark == WRAPPED:
                    inner = WRAPPED
                elif is_body(name, given):
                    inner = BODY
            if name != "p" and name != "li":
                stack.append((name, kind))
                kind = inner
            elif inner != kind:  # such an element ends where the next of its kind begins; only marked ones are held
                stack.append((name, kind))
                kind = inner
    flush()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b, by bit-parallel rows over b."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [full], full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    found, i, j = set(), len(a), len(b)
    while i and j:
        here = length(i, j)
        if not here:
            break
        if length(i - 1, j) == here:
            i -= 1
        elif length(i, j - 1) == here:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.add(i)
    return found


@dataclass
class Signature:
    """A page's lines as hashes, with their lengths and kinds: what pages are compared by."""

    hashes: list[int]
    sizes: list[int]
    kinds: list[int]

    @classmethod
    def of(cls, page: list[tuple[str, int]]) -> Signature:
        import xxhash

        signed = (xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in page)
        return cls(list(signed), [len(t) for t, _ in page], [k for _, k in page])

    def text(self) -> dict[int, int]:
        """Lengths of the different lines that are no boilerplate."""
        return {h: n for h, n, k in zip(self.hashes, self.sizes, self.kinds, strict=True) if k in (BODY, OPEN)}


def apart(a: Signature, b: Signature) -> tuple[bool, bool]:
    """Whether a tenth (OWN) of a's text, body and open, isn't in b, and the same of b."""
    x, y = a.text(), b.text()
    own = lambda p, q: sum(n for h, n in p.items() if h not in q) >= OWN * sum(p.values()) > 0
    return own(x, y), own(y, x)


def shared_lines(own: Signature, near: Iterator[Signature]) -> list[int]:
    """Places of the lines that the page shares with its nearest pages, given pages from the nearest on.

    Copies are passed over, as are pages without text: the two taken are no copies of the page or of each other. A line counts if both share it: one
    alone may quote the page. A single one counts only if each of the two pages has text of its own. Of a page with an
    article only lines of its body matter: other pages may have copied these, so all of MANY different pages have to share
    one; a body of nothing else stays.
    """
    body = {i for i, k in enumerate(own.kinds) if k == BODY}
    left, taken = set(body), []
    for other in near:
        if other.text() and any(apart(own, other)) and all(any(apart(other, x)) for x in taken):
            taken.append(other)
            if body:
                has = set(other.hashes)
                left = {i for i in left if own.hashes[i] in has}
            if len(taken) == (MANY if body else 2) or (body and not left):
                break
    if body:
        if len(taken) < MANY or not left:
            return []
        left = left.intersection(*(common(own.hashes, other.hashes) for other in taken))
        return sorted(left) if left != body else []
    if not taken or (len(taken) == 1 and not all(apart(own, taken[0]))):
        return []
    return sorted(set.intersection(*(common(own.hashes, other.hashes) for other in taken)))


def main_text(page: list[tuple[str, int]], shared: list[int] | None = None) -> str:
    """The page's main text: its article if it has one, else what no element marks, without what its neighbours share."""
    kind = BODY if any(k == BODY for _, k in page) else OPEN
    gone = set(shared or ())
    return "\n".join(t for i, (t, k) in enumerate(page) if k == kind and i not in gone)


def signed(pages: DataFrame) -> DataFrame:
    """host, path, page_id, key (a hash of the html), sig (one of the lines), body, hashes, sizes, kinds of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch, "html"):
                made = [Signature.of(lines(x or "")) for x in part.column(4).to_pylist()]
                whole = [xxhash.xxh3_64_intdigest(repr((m.hashes, m.kinds)).encode()) - (1 << 63) for m in made]
                arrays = [pa.array([getattr(m, c) for m in made], pa.list_(t)) for c, t in (("hashes", pa.int64()), ("sizes", pa.int32()), ("kinds", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(whole, pa.int64()), pa.array([BODY in m.kinds for m in made]), *arrays], names=["host", "path", "page_id", "key", "sig", "body", "hashes", "sizes", "kinds"])

    narrow = pages.select("host", "path", "page_id", "key", "html")
    return narrow.mapInArrow(run, f"host string, path string, page_id {kind}, key bigint, sig bigint, body boolean, hashes array<bigint>, sizes array<int>, kinds array<int>")


def differences(signatures: DataFrame, scratch: Scratch) -> DataFrame:
    """host, sig, body, shared of every page that shares lines with its nearest ones by URL; signatures as of signed().

    Pages of a host with the same lines are one. What is left is numbered in the order of URLs over all hosts, and cut
    into chunks of CHUNK pages by number, each with WINDOW pages more on either side. So the neighbours don't depend on
    partitions, no chunk is larger than another, however many pages a host has, and only hashes are moved.
    """
    spark = signatures.sparkSession
    at = F.min(F.struct("path", "page_id", "key")).alias("at")
    same = [F.first(c).alias(c) for c in ("body", "hashes", "sizes", "kinds")]  # alike in all pages with that sig
    found = signatures.groupBy("host", "sig").agg(at, *same)
    ordered = found.repartitionByRange("host", "at", "sig").sortWithinPartitions("host", "at", "sig")
    places = scratch.save(ordered.withColumn("place", F.monotonically_increasing_id()), "places")
    part = F.shiftright("place", 33)
    counts = sorted((r["part"], r["n"]) for r in places.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    firsts, total = [], 0
    for k, n in counts:
        firsts.append((k, total))
        total += n
    first = F.broadcast(spark.createDataFrame(firsts, "part bigint, first bigint"))
    numbered = places.join(first, part == F.col("part")).withColumn("number", F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1))
    chunk = lambda by: F.floor((F.col("number") + by) / CHUNK).cast("long")
    spread = numbered.withColumn("own", chunk(0)).withColumn("chunk", F.explode(F.array_distinct(F.array(chunk(-WINDOW), chunk(0), chunk(WINDOW)))))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("number")
        rows = t.to_pylist()
        signs = [Signature(r["hashes"], r["sizes"], r["kinds"]) for r in rows]
        out = []
        for i, r in enumerate(rows):
            if r["own"] == r["chunk"]:
                near = (signs[j] for d in range(1, WINDOW + 1) for j in (i - d, i + d) if 0 <= j < len(rows) and rows[j]["host"] == r["host"])
                if shared := shared_lines(signs[i], near):
                    out.append((r["host"], r["sig"], r["body"], shared))
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["host", "sig", "body", "shared"])

    moved = spread.select("chunk", "own", "number", "host", "sig", "body", "hashes", "sizes", "kinds")
    return scratch.save(moved.groupBy("chunk").applyInArrow(run, "host string, sig bigint, body boolean, shared array<int>"), "shared")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row, from the whole html.

    Null and empty html give an empty text; a null url is a host of its own kind; a null page_id stays null; repeated rows
    are extracted each; an empty table gives an empty result; other columns aren't read. A page's nearest pages are those
    beside it in the order of path and page_id among the host's pages with different lines, the earlier one first; pages
    that differ in less than a tenth of their text are copies, which are passed over, up to WINDOW pages on either
    side. On a host of two pages what both have counts as shared, even a quoted passage, as nothing tells it from a menu.
    """
    scratch = Scratch(pages.sparkSession, "html")
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"(/|/index\.html?|\.html?)$", ""), F.lit(""))
    keyed = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), F.xxhash64("html").alias("key"))
    signatures = scratch.save(signed(keyed), "signatures")
    verdicts = signatures.select("host", "sig", "key").join(differences(signatures, scratch), ["host", "sig"]).groupBy("host", "key").agg(F.first("shared").alias("shared"))
    verdicts = scratch.save(verdicts, "verdicts")
    if verdicts.limit(1).count():
        keyed = keyed.join(verdicts, ["host", "key"], "left")
    else:
        keyed = keyed.withColumn("shared", F.lit(None).cast("array<int>"))
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(lines(x or ""), gone) for x, gone in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return keyed.select("page_id", "url", "html", "shared").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
