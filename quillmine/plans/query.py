"""The boolean query language: [term] AND ([term] OR [ter*]) AND NOT [t?rm].

A query is read once into a tree of Term and Group nodes; everything else (predicates, remote dialects, depth,
rewriting of terms) works on that tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

TOKEN = re.compile(r"\[(?P<term>[^\[\]]*)\]|(?P<open>\()|(?P<close>\))|(?P<connector> ?(?:AND NOT|AND|OR) ?)")
CONNECTORS = ("AND", "OR", "AND NOT")


@dataclass(frozen=True)
class Term:
    text: str

    @property
    def wildcard(self) -> bool:
        return "?" in self.text or "*" in self.text


@dataclass(frozen=True)
class Group:
    """Members side by side, and the connectors between them; no precedence is implied by the tree."""

    members: tuple[Term | Group, ...]
    connectors: tuple[str, ...] = ()


class QueryError(ValueError):
    """The query breaks a rule of the language."""


def sanitize(query: str) -> str:
    """White space runs become one space; none is left at the ends."""
    return " ".join(query.split())


def parse(query: str, strict: bool = True) -> Group:
    """Reads a query; strict also enforces the rules for wildcards."""
    text = sanitize(query)
    root, at = _group(text, 0, nested=False)
    if at != len(text):
        raise QueryError(f"unbalanced parentheses at {at}: {text[at:at + 20]!r}")
    if strict:
        for term in terms(root):
            check_wildcards(term)
    return root


def _group(text: str, at: int, nested: bool) -> tuple[Group, int]:
    """Members up to the closing parenthesis (nested) or the end."""
    members: list[Term | Group] = []
    connectors: list[str] = []
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"a term in brackets, a parenthesis or a connector is missing at {at}: {text[at:at + 20]!r}")
        if m["close"]:
            break
        due = len(members) == len(connectors)  # a member is due, not a connector
        if m["connector"]:
            if due or not (m[0].startswith(" ") and m[0].endswith(" ")):
                raise QueryError(f"a misplaced connector at {at}, or none of the spaces it needs")
            connectors.append(m[0].strip())
            at = m.end()
            continue
        if not due:
            raise QueryError(f"a connector is missing at {at}")
        if m["open"]:
            inner, at = _group(text, m.end(), nested=True)
            if at >= len(text):
                raise QueryError("unbalanced parentheses")
            members.append(inner)
            at += 1
        else:
            if not m["term"].strip():
                raise QueryError(f"an empty term at {at}")
            members.append(Term(m["term"]))
            at = m.end()
    if not members or len(members) != len(connectors) + 1:
        raise QueryError("an empty group, or a connector without a term after it")
    if not nested and at < len(text):
        raise QueryError(f"unbalanced parentheses at {at}")
    return Group(tuple(members), tuple(connectors)), at


def check_wildcards(term: Term) -> None:
    """Wildcards: one in a single word, not first; an asterisk only last, behind three characters or more."""
    text = term.text
    if not term.wildcard:
        return
    if len(text.split()) > 1:
        raise QueryError(f"wildcards need a single word: [{text}]")
    if text[0] in "?*":
        raise QueryError(f"a wildcard can't come first: [{text}]")
    if text.count("?") + text.count("*") > 1:
        raise QueryError(f"only one wildcard fits in a term: [{text}]")
    if "*" in text and (not text.endswith("*") or len(text) < 4):
        raise QueryError(f"an asterisk comes last, behind three characters or more: [{text}]")


def is_valid(query: str, strict: bool = True) -> bool:
    try:
        parse(query, strict)
    except QueryError:
        return False
    return True


def terms(node: Term | Group) -> list[Term]:
    return [node] if isinstance(node, Term) else [t for m in node.members for t in terms(m)]


def depth(node: Term | Group) -> int:
    """How deeply groups are nested; 0 without parentheses."""
    return max((depth(m) + 1 for m in node.members if isinstance(m, Group)), default=0)


def tree(node: Term | Group, top: bool = True) -> dict:
    """The tree as plain dicts: root, group, term and connector nodes, connectors between their members."""
    if isinstance(node, Term):
        return {"node_type": "term", "value": node.text}
    children = [tree(node.members[0], False)]
    for connector, member in zip(node.connectors, node.members[1:], strict=True):
        children += [{"node_type": "connector", "value": connector}, tree(member, False)]
    return {"node_type": "root" if top else "group", "children": children}


def render(node: Term | Group, term: Callable[[Term], str] = lambda t: f"[{t.text}]", connectors: dict[str, str] | None = None, top: bool = True) -> str:
    """The query as text again, with each term and connector written the way a dialect wants it."""
    if isinstance(node, Term):
        return term(node)
    names = connectors or {}
    out = render(node.members[0], term, connectors, False)
    for c, m in zip(node.connectors, node.members[1:], strict=True):
        out += f" {names.get(c, c)} {render(m, term, connectors, False)}"
    return out if top else f"({out})"


def map_terms(node: Term | Group, change: Callable[[str], str]) -> Term | Group:
    """The same tree with every term's text changed."""
    return Term(change(node.text)) if isinstance(node, Term) else Group(tuple(map_terms(m, change) for m in node.members), node.connectors)


def alternatives(node: Group) -> list[list[tuple[bool, Term | Group]]]:
    """A group as OR of ANDs over its members, by the usual precedence: (negated, member) lists."""
    out: list[list[tuple[bool, Term | Group]]] = [[(False, node.members[0])]]
    for c, m in zip(node.connectors, node.members[1:], strict=True):
        if c == "OR":
            out.append([(False, m)])
        else:
            out[-1].append((c == "AND NOT", m))
    return out
