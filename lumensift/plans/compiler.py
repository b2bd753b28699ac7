"""Query nodes to lazy plans of (doc_id, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import micros, parse_time, python_time
from ..operators.index import Index, UnknownTerm
from ..operators.wanted import Match, Wanted
from ..sources.documents import number_value
from .ast import And, Boolean, FieldTerm, Fuzzy, Must, Not, Occur, Or, Phrase, Query, Range, Should, Term, Wildcard


def empty(index: Index) -> DataFrame:
    return index.documents.sparkSession.createDataFrame([], "doc_id long, score double")


def compile_query(index: Index, q: Query | None, strict: bool | None = None) -> DataFrame:
    """strict: unknown terms raise (default: the index's strict_terms); clauses where they may be missing pass False."""
    index.documents  # raises if the index is closed, also where only postings are read
    strict = index.strict_terms if strict is None else strict
    if q is None:
        return empty(index)
    return _NODES[type(q)](index.narrowed(Wanted(frozenset(matches(q)))), q, strict)


def matches(q: Query) -> list[Match]:
    """What the nodes under q read of the dictionary, so that one pass serves them all."""
    if isinstance(q, Term):
        return [Match("term", q.text)]
    if isinstance(q, FieldTerm):
        return [Match("term", q.term.lower(), q.field)]
    if isinstance(q, Phrase):
        return [Match("term", t.lower()) for t in q.terms]
    if isinstance(q, Wildcard):
        return [Match("prefix", q.prefix.lower(), q.field)]
    if isinstance(q, Fuzzy):
        return [Match("near", q.term.lower(), q.field)]
    if isinstance(q, (And, Or, Should)):
        return [m for x in q.queries for m in matches(x)]
    if isinstance(q, Boolean):
        kinds = {c.occur for c in q.clauses}
        unused = {Occur.SHOULD} if Occur.MUST in kinds else set() if Occur.SHOULD in kinds else set(Occur)
        return [m for c in q.clauses if c.occur not in unused for m in matches(c.query)]
    return matches(q.query) if isinstance(q, Must) else []  # a Not matches nothing; a Range reads the documents


def _term(index, q: Term, strict):
    return _posting_scores(index, q.text, q.boost, strict)


def _posting_scores(index, term, boost, strict, more=()):
    rows = index.postings.where(F.col("term") == term)
    if strict and not rows.limit(1).count():
        raise UnknownTerm(term)
    df = F.broadcast(rows.agg(F.count("*").alias("df")))  # one row
    kept = [c for c in more if c in rows.columns]
    return index.score(rows.crossJoin(df), F.col("df"), kept).select("doc_id", (F.col("score") * boost).alias("score"), *kept)


def _field_term(index, q: FieldTerm, strict):
    m = Match("term", q.term.lower(), q.field)
    return _in_field(index, _posting_scores(index, m.text, q.boost, strict, ("within",)), m).select("doc_id", "score")


def _in_field(index: Index, rows: DataFrame, m: Match) -> DataFrame:
    """The rows whose document's field holds a term that fits: noted when the postings were read, or read from the documents."""
    if not m.field:
        return rows
    if "within" in rows.columns:
        return rows.where(F.array_contains("within", m.key))
    return rows.join(index.holding(m), "doc_id", "left_semi")


def _phrase(index, q: Phrase, strict):
    terms = [t.lower() for t in q.terms]
    hits = index.postings.where(F.col("term") == terms[0])
    if strict and not hits.limit(1).count():
        raise UnknownTerm(terms[0])
    df = F.broadcast(hits.agg(F.count("*").alias("df")))  # one row
    d = hits.crossJoin(df).withColumnRenamed("positions", "p0")
    for i, t in enumerate(terms[1:], 1):
        later = index.postings.where(F.col("term") == t).select("doc_id", F.col("positions").alias("pi"))
        d = d.join(later, "doc_id")
        # each later word may lean on another place of the first
        gap = lambda a, b, i=i: (b - a - i).between(0, q.slop)
        d = d.where(F.exists("p0", lambda a: F.exists("pi", lambda b: gap(a, b)))).drop("pi")
    return index.score(d, F.col("df")).select("doc_id", (F.col("score") * q.boost).alias("score"))


def fold(parts: list[DataFrame]) -> DataFrame:
    """Inner joins; the score is ((s1 + s2) / 2 + s3) / 2 ..., in textual order whatever order Spark joins in."""
    named = [p.select("doc_id", F.col("score").alias(f"s{i}")) for i, p in enumerate(parts)]
    joined = reduce(lambda a, b: a.join(b, "doc_id"), named)
    return joined.select("doc_id", reduce(lambda a, i: (a + F.col(f"s{i}")) / 2, range(1, len(parts)), F.col("s0")).alias("score"))


def _and(index, q: And, strict):
    return fold([compile_query(index, x, strict) for x in q.queries]) if q.queries else empty(index)


def best(parts: list[DataFrame]) -> DataFrame:
    """Union with the largest score; documents whose best isn't over 0 vanish."""
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.max("score").alias("score")).where("score > 0")


def _or(index, q: Or, strict):
    return best([compile_query(index, x, strict) for x in q.queries]) if q.queries else empty(index)


def _should(index, q: Should, strict):
    return best([compile_query(index, x, False) for x in q.queries]) if q.queries else empty(index)


def _boolean(index, q: Boolean, strict):
    by = {o: [c for c in q.clauses if c.occur is o] for o in Occur}
    run = lambda c, s: compile_query(index, c.query, s).select("doc_id", (F.col("score") * c.boost).alias("score"))
    if by[Occur.MUST]:
        hits = fold([run(c, strict) for c in by[Occur.MUST]])  # with a MUST, SHOULD clauses play no part
    elif by[Occur.SHOULD]:
        hits = best([run(c, False) for c in by[Occur.SHOULD]])
    else:
        return empty(index)
    for c in by[Occur.MUST_NOT]:
        hits = hits.join(run(c, False).select("doc_id"), "doc_id", "left_anti")
    return hits


def _between(value: Column, lower, upper, inclusive: bool) -> Column:
    return value.between(lower, upper) if inclusive else (value > lower) & (value < upper)


def _range(index, q: Range, strict):
    mine = F.filter("fields", lambda f: f["name"] == q.field)
    if q.kind == "number":
        ok = lambda f: _between(number_value(f), F.lit(float(q.lower)), F.lit(float(q.upper)), q.inclusive)
    elif q.kind == "time":
        lo, hi = python_time(q.lower), python_time(q.upper)
        if lo is None or hi is None:
            raise ValueError("bounds are not times")
        ok = lambda f: _between(F.unix_micros(parse_time(f["str"], dates=True)), F.lit(micros(lo)), F.lit(micros(hi)), q.inclusive)
    else:
        raise ValueError(f"unknown kind of range {q.kind!r}")
    hit = F.exists(mine, lambda f: F.coalesce(ok(f), F.lit(False)))
    return index.documents.where(hit).select("doc_id", F.lit(float(q.boost)).alias("score"))


def _expanded(index, m: Match, boost):
    """Best score over all dictionary terms that match, within documents whose field has a match."""
    rows = index.postings.where(m.fits(F.col("term")))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    scored = index.score(_in_field(index, rows, m).join(df, "term"), F.col("df"))
    return best([scored.select("doc_id", (F.col("score") * boost).alias("score"))])


def _wildcard(index, q: Wildcard, strict):
    return _expanded(index, Match("prefix", q.prefix.lower(), q.field), q.boost)


def _fuzzy(index, q: Fuzzy, strict):
    return _expanded(index, Match("near", q.term.lower(), q.field), q.boost)


_NODES = {
    Term: _term,
    FieldTerm: _field_term,
    Phrase: _phrase,
    And: _and,
    Or: _or,
    Boolean: _boolean,
    Not: lambda index, q, strict: empty(index),
    Must: lambda index, q, strict: compile_query(index, q.query, strict),
    Should: _should,
    Range: _range,
    Wildcard: _wildcard,
    Fuzzy: _fuzzy,
}
