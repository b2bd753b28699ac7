"""Hit highlighting as Column expressions over a document's fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.documents import string_value
from .binding import let

SIZE = 160
_SPAN = r"[\p{L}\p{Nd}_-]+"


def find(text: Column, term: str) -> Column:
    """First case-insensitive place of the term, from 0, or null."""
    return F.nullif(F.position(F.lit(term.lower()), F.lower(text)), F.lit(0)) - 1


def exact(name: Column, text: Column, term: str) -> Column:
    start = find(text, term)
    cut = F.substring(text, F.greatest(start - SIZE // 2, F.lit(0)) + 1, F.lit(SIZE))
    return F.when(start.isNotNull(), _hit(name, start, start + len(term), cut))


def _hit(name, start, end, fragment) -> Column:
    return F.struct(name.alias("field"), start.cast("int").alias("start"), end.cast("int").alias("end"), fragment.alias("fragment"))


def approximate(name: Column, text: Column, term: str) -> Column:
    """First word that starts with the term or, for terms of 3 or more characters, is within edit distance 1."""
    t = term.strip().lower()

    def fits(w: Column) -> Column:
        starts = F.lower(w).startswith(t)
        near = F.length(w).between(len(t) - 1, len(t) + 1) & (F.levenshtein(F.lower(w), F.lit(t), 1) >= 0)
        return starts if len(t) < 3 else starts | near

    def place(x: Column) -> Column:
        """x: words, and k, the number of the first that fits, from 1. What lies between words is split off once."""
        before = F.slice(F.split(text, _SPAN, -1), 1, x["k"])
        total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
        start = total(before) + total(F.slice(x["words"], 1, x["k"] - 1))
        return F.struct(start.alias("s"), (start + F.length(F.get(x["words"], x["k"] - 1))).alias("e"))

    def cut(at: Column) -> Column:
        """SIZE characters around the word, within the text; a word of over SIZE characters is cut at its end."""
        n = F.length(text)
        left = F.greatest(at["s"] - SIZE // 2, F.lit(0))
        right = F.least(F.greatest(left + SIZE, at["e"]), n)
        left = F.greatest(left, right - SIZE)
        return _hit(name, at["s"], at["e"], F.when(n <= SIZE, text).otherwise(F.substring(text, left + 1, right - left)))

    numbered = let(F.regexp_extract_all(text, F.lit(_SPAN), F.lit(0)), lambda w: F.struct(w.alias("words"), F.array_position(F.transform(w, fits), F.lit(True)).cast("int").alias("k")))
    return let(numbered, lambda x: F.when(x["k"] > 0, let(place(x), cut)))


def highlights(terms: list[str], near: bool = True) -> Column:
    """At most one hit: fields in order, text and keyword only; within a field, exact terms in order, then near ones."""
    terms = [t for t in terms if t.strip()]
    none = F.lit(None).cast("struct<field:string,start:int,end:int,fragment:string>")
    if not terms:
        return none
    shown = F.filter("fields", lambda f: f["type"].isin("text", "keyword") & (string_value(f) != ""))
    kinds = (exact, approximate) if near else (exact,)
    per_field = F.transform(shown, lambda f: F.coalesce(*[kind(f["name"], string_value(f), t) for kind in kinds for t in terms]))
    return F.try_element_at(F.filter(per_field, lambda h: h.isNotNull()), F.lit(1))
