"""Query nodes and the terms they name."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Occur(Enum):
    MUST = "MUST"
    SHOULD = "SHOULD"
    MUST_NOT = "MUST_NOT"


class Query:
    """A node; str() explains it."""


@dataclass(frozen=True)
class Term(Query):
    term: str
    boost: float = 1.0
    lowercase: bool = True

    @property
    def text(self) -> str:
        return self.term.lower() if self.lowercase else self.term


@dataclass(frozen=True)
class FieldTerm(Query):
    field: str
    term: str
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase(Query):
    terms: tuple[str, ...]
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class And(Query):
    queries: tuple[Query, ...]


@dataclass(frozen=True)
class Or(Query):
    queries: tuple[Query, ...]


@dataclass(frozen=True)
class Clause:
    query: Query
    occur: Occur
    boost: float = 1.0


@dataclass(frozen=True)
class Boolean(Query):
    clauses: tuple[Clause, ...]


@dataclass(frozen=True)
class Not(Query):
    """A leading NOT: matches nothing."""

    query: Query


@dataclass(frozen=True)
class Must(Query):
    query: Query


@dataclass(frozen=True)
class Should(Query):
    """A union in which unknown terms are ignored."""

    queries: tuple[Query, ...]


@dataclass(frozen=True)
class Range(Query):
    field: str
    lower: str
    upper: str
    kind: str  # "number" or "time"
    inclusive: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class Wildcard(Query):
    field: str
    prefix: str
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy(Query):
    field: str
    term: str
    distance: int = 1
    boost: float = 1.0

    def __post_init__(self):
        if self.distance != 1:
            raise ValueError("only fuzzy distance 1 is supported")


def extract_terms(q: Query | None) -> list[str]:
    """Terms to highlight, in order, without repeats; a phrase comes whole before its words."""
    out: dict[str, None] = {}

    def walk(n):
        if isinstance(n, (Term, FieldTerm)):
            out.setdefault(n.text if isinstance(n, Term) else n.term.lower())
        elif isinstance(n, Phrase):
            for t in (" ".join(n.terms), *n.terms):
                out.setdefault(t)
        elif isinstance(n, (And, Or, Should)):
            for x in n.queries:
                walk(x)
        elif isinstance(n, Boolean):
            for c in n.clauses:
                walk(c.query)
        elif isinstance(n, (Must, Not)):
            walk(n.query)
        elif isinstance(n, Wildcard):
            out.setdefault(n.prefix.lower())
        elif isinstance(n, Fuzzy):
            out.setdefault(n.term.lower())

    walk(q)
    return [t for t in out if t]
