"""Text analysis as Column expressions: tokens, lower-casing, stop words, length limits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    "a am an and are as at be by for from has he i in is it its of on that the to was were will with you your we our or not this but if then".split()
)
TOKEN = r"[\p{L}\p{N}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """Only A-Z change, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


@dataclass(frozen=True)
class Analyzer:
    """Tokenize, lower-case, drop stop words, keep min..max bytes; then any extra filters, each Column -> keep Column.

    Positions count every token before filters, so dropped words leave gaps.
    """

    stop_words: tuple[str, ...] = STOP_WORDS
    lower: bool = True
    min_bytes: int = 2
    max_bytes: int = 50
    pattern: str = TOKEN
    filters: tuple[Callable[[Column], Column], ...] = field(default=())

    def words(self, text: Column) -> Column:
        """array<string> of every match, before lower-casing and filters; empty for null."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def normal(self, word: Column) -> Column:
        return lower_ascii(word) if self.lower else word

    def tokens(self, text: Column) -> Column:
        """array<struct<term, pos>>; empty for null."""
        return F.filter(F.transform(self.words(text), lambda t, i: F.struct(self.normal(t).alias("term"), i.alias("pos"))), lambda x: self.keeps(x.getField("term")))

    def chosen(self, words: Column, fits: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
        """Those tokens of words() that fit(word, normal): only they are lower-cased and filtered; positions as in tokens()."""
        made = F.transform(words, lambda t, i: F.when(fits(t, self.normal), F.struct(self.normal(t).alias("term"), i.alias("pos"))))
        return F.filter(made, lambda x: x.isNotNull() & self.keeps(x.getField("term")))

    def terms(self, words: Column) -> Column:
        """array<string>: the terms of tokens(), with repeats."""
        return F.filter(F.transform(words, self.normal), self.keeps)

    def counted(self, words: Column) -> Column:
        """As many elements as tokens() has; only words short enough for a stop word are lower-cased."""
        if not self.lower or self.filters:
            return self.terms(words)
        longest = max((len(w.encode()) for w in self.stop_words), default=0)
        return F.filter(words, lambda t: F.octet_length(t).between(self.min_bytes, self.max_bytes) & ((F.octet_length(t) > longest) | ~self.normal(t).isin(*self.stop_words)))

    def keeps(self, term: Column) -> Column:
        ok = F.octet_length(term).between(self.min_bytes, self.max_bytes)
        if self.stop_words:
            ok = ok & ~term.isin(*self.stop_words)
        for f in self.filters:
            ok = ok & f(term)
        return ok


def token_type(term: Column) -> Column:
    return F.when(term.rlike(r"^\p{Nd}+$"), "number").otherwise("word")
