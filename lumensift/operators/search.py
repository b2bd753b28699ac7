"""Searching an index: pages of hits with highlights, views and aggregations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.highlight import highlights
from ..plans.ast import Query, extract_terms
from ..plans.compiler import compile_query
from ..plans.parser import parse
from ..sources.documents import first_field, string_value
from . import aggregate
from .index import Index

MAX_SIZE = 200
DEFAULT_SIZE = 20


def as_query(index: Index, q: str | Query | None) -> Query | None:
    return parse(q, index.field_terms) if isinstance(q, str) else q


def hits(index: Index, q: str | Query | None) -> DataFrame:
    """All hits, unordered: doc_id, score."""
    return compile_query(index, as_query(index, q))


def top(index: Index, q: str | Query | None, n: int) -> DataFrame:
    """The n best, by score, then doc_id; n <= 0 runs nothing."""
    if n <= 0:
        return compile_query(index, None)
    return hits(index, q).orderBy(F.desc("score"), "doc_id").limit(n)


def page(index: Index, q: str | Query | None, start: int = 0, size: int = DEFAULT_SIZE) -> DataFrame:
    if start < 0:
        raise ValueError("from must not be negative")
    if not 1 <= size <= MAX_SIZE:
        raise ValueError(f"size must lie between 1 and {MAX_SIZE}")
    return hits(index, q).orderBy(F.desc("score"), "doc_id").offset(start).limit(size)


def count(index: Index, q: str | Query | None) -> DataFrame:
    return hits(index, q).agg(F.count("*").alias("count"))


def with_documents(index: Index, few: DataFrame) -> DataFrame:
    """Hits of a page (at most MAX_SIZE rows) with their documents."""
    return index.documents.join(F.broadcast(few), "doc_id")


def summary(limit: int = 100) -> Column:
    """First non-blank of message, raw (cut), path, external id."""
    value = lambda name: F.nullif(F.trim(string_value(first_field(name))), F.lit(""))
    return F.coalesce(value("message"), truncate(value("raw"), limit), value("path"), F.nullif(F.trim("ext_id"), F.lit("")), F.lit("(no summary)"))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def field_list(text: str) -> list[str]:
    """Names of a comma list, without repeats; ValueError for empty or odd names."""
    if not text.strip():
        return []
    names = [x.strip() for x in text.split(",")]
    for x in names:
        if not x or not re.fullmatch(r"[\w.\-]+", x):
            raise ValueError(f"bad field name {x!r}")
    return list(dict.fromkeys(names))


def flag(text: str | None) -> bool:
    return (text or "").strip().lower() in ("1", "true", "yes")


def view(fields: list[str] | None = None) -> Column:
    """map of field name to its first value as text, limited to the names given."""
    kept = F.filter("fields", lambda f: f["name"].isin(*fields)) if fields else F.col("fields")
    names = F.array_distinct(F.transform(kept, lambda f: f["name"]))
    first = lambda n: string_value(F.element_at(F.filter(kept, lambda f: f["name"] == n), 1))
    return F.map_from_arrays(names, F.transform(names, first))


def search(index: Index, q: str, start: int = 0, size: int = DEFAULT_SIZE, include_doc: bool = False, fields: list[str] | None = None) -> DataFrame:
    """A page: doc_id, score, summary, highlight, and doc if asked for."""
    terms = extract_terms(as_query(index, q))
    d = with_documents(index, page(index, q, start, size))
    out = d.select("doc_id", "score", summary().alias("summary"), highlights(terms).alias("highlight"), *([view(fields).alias("doc")] if include_doc or fields else []))
    return out.orderBy(F.desc("score"), "doc_id")


def aggregations(index: Index, q: str, agg: str | None = None, group: str | None = None, start: int = 0, size: int = DEFAULT_SIZE, scope: str = "page") -> DataFrame:
    """count or group over the page (default) or over all hits."""
    if scope not in ("page", "all"):
        raise ValueError("scope must be page or all")
    if group is None:
        return aggregate.count(page(index, q, start, size) if scope == "page" else hits(index, q), agg or "count")
    if scope == "page":
        return aggregate.group(with_documents(index, page(index, q, start, size)), group)
    keys = index.documents.select("doc_id", aggregate.key(group))  # texts stay out of the join
    return aggregate.counted(keys.join(hits(index, q).select("doc_id"), "doc_id"))


def listing(index: Index, n: int = 100) -> DataFrame:
    return index.documents.orderBy("doc_id").limit(n).select("doc_id", summary().alias("summary"))
