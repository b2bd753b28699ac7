"""What a query asks of the dictionary, so that an index reads those terms only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Match:
    """Terms equal to text, that begin with it, or within one edit of it; in a field, or in any for ""."""

    kind: str  # "term", "prefix" or "near"
    text: str
    field: str = ""

    def fits(self, word: Column, normal: Callable[[Column], Column] = lambda t: t) -> Column:
        """normal lower-cases ASCII at most, so lengths may be taken before it."""
        n = len(self.text)
        if self.kind == "term":
            return (F.octet_length(word) == len(self.text.encode())) & (normal(word) == self.text)
        if self.kind == "prefix":
            return normal(F.substring(word, 1, n)) == self.text
        return F.length(word).between(n - 1, n + 1) & (F.levenshtein(normal(word), F.lit(self.text), 1) >= 0)

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.field}:{self.text}"


@dataclass(frozen=True)
class Wanted:
    matches: frozenset[Match]

    def covers(self, other: Wanted) -> bool:
        return other.matches <= self.matches

    def fits(self, word: Column, normal: Callable[[Column], Column] = lambda t: t) -> Column:
        found = F.lit(False)
        for kind, text in sorted({(m.kind, m.text) for m in self.matches}):
            found = found | Match(kind, text).fits(word, normal)
        return found

    def may_hold(self, text: Column, lower: bool) -> Column:
        """Texts without any of the terms as a substring can't hold one as a token; a cheap test before tokenizing."""
        if any(m.kind == "near" for m in self.matches):
            return F.lit(True)
        held = F.lit(False)
        for t in sorted({m.text for m in self.matches}):
            quoted = "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E"
            held = held | text.rlike(("(?i)" if lower else "") + quoted)  # without (?u), ASCII only
        return held

    @property
    def fielded(self) -> list[Match]:
        return sorted((m for m in self.matches if m.field), key=lambda m: m.key)
