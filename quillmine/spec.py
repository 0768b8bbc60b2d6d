"""What a search asks for, checked once on the driver."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass, field

from .plans.query import Group, parse, sanitize
from .schema import PUBLICATION_TYPES, SOURCES


@dataclass(frozen=True)
class SearchSpec:
    """Query, inclusive dates, limits on distinct papers, sources and publication types (None: all).

    Unknown sources or types and limits below 1 raise ValueError; case doesn't count in either.
    """

    query: str
    since: dt.date | None = None
    until: dt.date | None = None
    limit: int | None = None
    limit_per_database: int | None = None
    databases: tuple[str, ...] | None = None
    publication_types: tuple[str, ...] | None = None
    strict: bool = True
    tree: Group = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        put("query", sanitize(self.query))
        put("tree", parse(self.query, self.strict))
        for name in ("limit", "limit_per_database"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        if self.since and self.until and self.since > self.until:
            raise ValueError("since is after until")
        known = {s.lower(): s for s in SOURCES}
        put("databases", tuple(_known(self.databases, known, "database")) if self.databases is not None else SOURCES)
        if self.publication_types is not None:
            put("publication_types", tuple(_known(self.publication_types, {t: t for t in PUBLICATION_TYPES}, "publication type")))


def from_environment(**given) -> SearchSpec:
    """A spec whose query, if it isn't given, is that of the environment variable QUILLMINE_QUERY."""
    query = given.pop("query", None) or os.environ.get("QUILLMINE_QUERY")
    if not query:
        raise ValueError("no query is given, and QUILLMINE_QUERY is not set")
    return SearchSpec(query, **given)


def credentials() -> dict[str, str]:
    """Tokens by source and the proxy's address, of those that the environment sets: QUILLMINE_IEEE_TOKEN,
    QUILLMINE_SCOPUS_TOKEN, QUILLMINE_PROXY."""
    names = {"IEEE": "QUILLMINE_IEEE_TOKEN", "Scopus": "QUILLMINE_SCOPUS_TOKEN", "proxy": "QUILLMINE_PROXY"}
    return {k: os.environ[v] for k, v in names.items() if os.environ.get(v)}


def _known(names, known: dict[str, str], what: str) -> list[str]:
    out = []
    for n in names:
        if n.strip().lower() not in known:
            raise ValueError(f"unknown {what}: {n}")
        if known[n.strip().lower()] not in out:
            out.append(known[n.strip().lower()])
    return out
