"""The engine's operators as queries over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.analysis import Analyzer, token_type
from ..functions.binding import let
from ..functions.highlight import highlights
from ..functions.timeutil import normalize_time
from ..operators import aggregate
from ..operators import search as s
from ..operators.index import Index
from ..sources import documents as d
from ..sources.logs import detect_format, log_fields, parse_lines
from ..sources.storage import Store
from .ast import Boolean, Clause, Fuzzy, Must, Not, Occur, Phrase, Range, Should, Term, Wildcard
from .compiler import compile_query
from .parser import parse

_indexes: dict[tuple, Index] = {}


def _read(spark, sf, table) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def documents_index(spark: SparkSession, sf: str) -> Index:
    """The index of the documents table, one per session and path; the postings of queried terms stay in executor storage."""
    key = (spark.sparkContext.applicationId, sf, "documents")
    if key not in _indexes:
        _indexes[key] = Index(d.from_table(_read(spark, sf, "documents"), "doc_id", text=("text",), keyword=("lang", "source"), integer=("n_chars",))).cache()
    return _indexes[key]


def conversations_index(spark, sf) -> Index:
    key = (spark.sparkContext.applicationId, sf, "conversations")
    if key not in _indexes:
        t = _read(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
        _indexes[key] = Index(d.from_table(t, "id", text=("text",), keyword=("role",))).cache()
    return _indexes[key]


def orders_index(spark, sf) -> Index:
    t = _read(spark, sf, "orders").withColumn("day", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return Index(d.from_table(t, "o_orderkey", text=("day",), keyword=("o_orderstatus", "o_orderpriority"), integer=("o_custkey",), real=("o_totalprice",)))


def parts_index(spark, sf) -> Index:
    return Index(d.from_table(_read(spark, sf, "part"), "p_partkey", text=("p_name", "p_type"), keyword=("p_brand",)))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.round("score", 4).alias("score"))


def _top(hits: DataFrame, n: int = 10, start: int = 0) -> DataFrame:
    return _rounded(hits).orderBy(F.desc("score"), "doc_id").offset(start).limit(n)


A, B, C = "tion", "thre", "eaux"  # tokens of the documents


def log_lines(spark, sf) -> DataFrame:
    """Log lines made of the events: JSON, Logback and broken ones by turns."""
    e = _read(spark, sf, "events")
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS")
    js = F.concat(F.lit('{"ts":"'), ts, F.lit('","severity":" warn ","msg":"'), F.col("event_type"), F.lit('","user":'), F.col("user_id").cast("string"), F.lit("}"))
    lb = F.concat(ts, F.lit(" info app.Service - got "), F.col("event_type"))
    turn = F.col("event_id") % 3
    return e.select(F.lit("events.log").alias("source"), F.col("event_id").alias("line_no"), F.when(turn == 0, js).when(turn == 1, lb).otherwise(F.concat(F.lit("broken "), F.col("event_type"))).alias("line"))


def _log(fmt):
    def run(spark, sf):
        p = parse_lines(log_lines(spark, sf), fmt)
        get = lambda n: let(let(d.first_field(n), d.string_value), lambda v: F.nullif(v, F.lit("")))
        return p.where("parsed").select("ext_id", *[get(n).alias(n) for n in ("message", "level", "timestamp", "user")])

    return run


def _highlighted(docs: DataFrame, near: bool) -> DataFrame:
    h = docs.select("doc_id", F.inline(F.array(highlights([B], near)))).where("field = 'text'")
    return h.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), "fragment")


def _events_docs(spark, sf) -> DataFrame:
    e = _read(spark, sf, "events").withColumn("timestamp", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return d.from_table(e, "event_id", keyword=("event_type", "timestamp"), real=("value",))


def _stored(spark, sf):
    """Round trip of a stored index: add, delete, commit, delete and update after the commit, then read back."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
        root = "file://" + tempfile.mkdtemp(prefix="lumensift-")
    store = Store(spark, f"{root.rstrip('/')}/index-{uuid.uuid4().hex}").create()
    store.add(d.from_table(_read(spark, sf, "documents"), "doc_id", text=("text",), keyword=("source",), ext_id="doc_id").select("ext_id", "fields"))
    live = lambda: store.index().documents
    store.delete(live().where("cast(ext_id AS bigint) % 7 = 0").select("doc_id"))
    store.commit()
    store.delete(live().where("cast(ext_id AS bigint) % 11 = 0").select("doc_id"))
    store.update(live().where("ext_id = '5'").first()["doc_id"], live().where("ext_id = '4'").select("fields"))
    get = lambda n: d.string_value(d.first_field(n))
    return live().select("ext_id", get("source").alias("source"), F.md5(get("text")).alias("text_md5"))


QUERIES = {
    "analyze_tokens": lambda p, f: _read(p, f, "documents").select("doc_id", F.inline(Analyzer().tokens(F.col("text")))).groupBy("term", token_type(F.col("term")).alias("type")).agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos")),
    "index_postings": lambda p, f: documents_index(p, f).postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")),
    "index_term_stats": lambda p, f: documents_index(p, f).term_stats.select("term", "df", F.col("cf").cast("long").alias("cf")),
    "index_doc_lengths": lambda p, f: documents_index(p, f).doc_lengths,
    "index_corpus_stats": lambda p, f: documents_index(p, f).stats().select("num_docs", "num_terms", F.round("avg_dl", 6).alias("avg_dl")),
    "term_bm25_topk": lambda p, f: _top(s.hits(documents_index(p, f), Term(A))),
    "term_tfidf_topk": lambda p, f: _top(s.hits(documents_index(p, f).with_similarity("tfidf"), Term(A))),
    "term_bm25l_topk": lambda p, f: _top(s.hits(documents_index(p, f).with_similarity("bm25l"), Term(A))),
    "term_bm25_custom": lambda p, f: _top(s.hits(documents_index(p, f).with_similarity(sim.BM25(2.0, 0.5)), Term(A))),
    "term_boost": lambda p, f: _rounded(s.hits(documents_index(p, f), Term(B, boost=2.5))),
    "score_terms_sum": lambda p, f: _rounded(documents_index(p, f).score_terms([A, B, C])),
    "and_query": lambda p, f: _rounded(s.hits(documents_index(p, f), f"{A} AND {B}")),
    "and3_query": lambda p, f: _rounded(s.hits(documents_index(p, f), f"{A} {B} ti")),
    "or_query": lambda p, f: _rounded(s.hits(documents_index(p, f), f"{A} OR {B} OR {C}")),
    "not_query": lambda p, f: _rounded(s.hits(documents_index(p, f), f"{A} NOT {B}")),
    "and_not_empty": lambda p, f: _rounded(s.hits(documents_index(p, f), f"{A} AND NOT {B}")),
    "leading_not_empty": lambda p, f: _rounded(compile_query(documents_index(p, f), Not(Term(A)))),
    "must_passthrough": lambda p, f: _rounded(compile_query(documents_index(p, f), Must(Term(B)))),
    "should_union": lambda p, f: _rounded(compile_query(documents_index(p, f), Should((Term(A), Term("nosuchterm"), Term(C))))),
    "bool_must_should_not": lambda p, f: _rounded(compile_query(documents_index(p, f), Boolean((Clause(Term(A), Occur.MUST, 2.0), Clause(Term("ti"), Occur.MUST), Clause(Term(C), Occur.SHOULD), Clause(Term(B), Occur.MUST_NOT))))),
    "bool_should_only": lambda p, f: _rounded(compile_query(documents_index(p, f), Boolean((Clause(Term(A), Occur.SHOULD, 0.5), Clause(Term(C), Occur.SHOULD), Clause(Term(B), Occur.MUST_NOT))))),
    "phrase_query": lambda p, f: _rounded(s.hits(documents_index(p, f), '"er en"')),
    "phrase_slop": lambda p, f: _rounded(compile_query(conversations_index(p, f), Phrase(("de", "la", "de"), slop=3))),
    "range_numeric": lambda p, f: compile_query(orders_index(p, f), parse("o_totalprice:[1000 TO 50000]")),
    "range_exclusive": lambda p, f: compile_query(orders_index(p, f), Range("o_custkey", "10", "20", "number", inclusive=False, boost=1.5)),
    "range_time": lambda p, f: compile_query(orders_index(p, f), parse("day:[1995-01-01 TO 1995-06-30T00:00:00Z]")),
    "wildcard_prefix": lambda p, f: _rounded(compile_query(documents_index(p, f), Wildcard("text", "thre"))),
    "fuzzy_distance1": lambda p, f: _rounded(compile_query(documents_index(p, f), Fuzzy("text", "tion"))),
    "query_string_mixed": lambda p, f: _rounded(s.hits(documents_index(p, f), f"({A} AND ti) OR text:thre* OR n_chars:[100 TO 400]")),
    "field_scoped_term": lambda p, f: _rounded(s.hits(documents_index(p, f).with_options(field_terms=True), f"text:{B}")),
    "page_offset": lambda p, f: _rounded(s.page(documents_index(p, f), Term(A), 5, 10)),
    "count_query": lambda p, f: s.count(documents_index(p, f), f"{A} OR {B}"),
    "group_by_field": lambda p, f: aggregate.group(documents_index(p, f).documents, "source"),
    "group_hits_by_lang": lambda p, f: s.aggregations(documents_index(p, f), A, None, "lang", scope="all"),
    "group_by_time_5m": lambda p, f: aggregate.group(_events_docs(p, f), "time(5m)"),
    "group_by_time_7h": lambda p, f: aggregate.group(_events_docs(p, f), "time(7h)"),
    "highlight_fragment": lambda p, f: _highlighted(documents_index(p, f).documents, near=False),
    "highlight_near": lambda p, f: _highlighted(documents_index(p, f).documents, near=True).where(~F.lower("fragment").contains(B)),
    "doc_summary": lambda p, f: d.from_table(_read(p, f, "documents").withColumn("raw", F.when(F.col("doc_id") % 2 == 0, F.col("text"))), "doc_id", text=("raw",), keyword=("source",), ext_id="source").select("doc_id", s.summary().alias("summary")),
    "field_projection": lambda p, f: documents_index(p, f).documents.select("doc_id", s.view(["lang", "n_chars"]).alias("v")).select("doc_id", F.col("v")["lang"].alias("lang"), F.col("v")["n_chars"].alias("n_chars")),
    "point_lookup": lambda p, f: documents_index(p, f).get(7).select("doc_id", d.string_value(d.first_field("source")).alias("source")),
    "terms_prefix": lambda p, f: documents_index(p, f).terms("thr", 25),
    "doc_list": lambda p, f: s.listing(documents_index(p, f), 20).select("doc_id"),
    "delete_docs": lambda p, f: _rounded(s.hits(documents_index(p, f).delete(documents_index(p, f).documents.where("doc_id % 2 = 0").select("doc_id")), Term(A))),
    "update_docs": lambda p, f: (lambda ix: ix.update(3, ix.documents.where("doc_id = 4").select("fields")).documents.select("doc_id", d.string_value(d.first_field("source")).alias("source")))(documents_index(p, f)),
    "store_round_trip": _stored,
    "log_json_parse": _log("json"),
    "log_logback_parse": _log("logback"),
    "log_auto_detect": lambda p, f: log_lines(p, f).select("line_no", detect_format(F.col("line")).alias("format")).groupBy("format").agg(F.count("*").alias("n")),
    "log_auto_parse": _log("auto"),
    "time_normalize": lambda p, f: _read(p, f, "events").select("event_id", normalize_time(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss,SSS")).alias("t")),
    "part_wildcard_keyword": lambda p, f: _rounded(compile_query(parts_index(p, f), Wildcard("p_type", "pro"))),
}

_STOP = ",".join(f"'{w}'" for w in Analyzer().stop_words)
_U, _L = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tokens(table: str, key: str) -> str:
    return f"""toks AS (SELECT doc_id, term, pos FROM (SELECT doc_id, translate(t, '{_U}', '{_L}') AS term, pos FROM
  (SELECT {key} AS doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (SELECT *, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS ts FROM {table})))
  WHERE strlen(term) BETWEEN 2 AND 50 AND term NOT IN ({_STOP})),
lens AS (SELECT a.{key} AS doc_id, coalesce(n, 0)::BIGINT AS dl FROM (SELECT {key} FROM {table}) a LEFT JOIN (SELECT doc_id, count(*) AS n FROM toks GROUP BY doc_id) b ON a.{key} = b.doc_id),
corpus AS (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avg FROM lens)"""


def _base(where: str = "", table: str = "documents", key: str = "doc_id", whole: str = "SELECT doc_id, lang AS term, 0 AS pos FROM documents UNION ALL SELECT doc_id, source, 0 FROM documents UNION ALL SELECT doc_id, n_chars::VARCHAR, 0 FROM documents") -> str:
    docs = table if not where else f"(SELECT * FROM {table} WHERE {where})"
    return f"WITH {_tokens(docs, key)}, every AS (SELECT * FROM toks UNION ALL ({whole})), post AS (SELECT term, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS ps FROM every GROUP BY term, doc_id)"


_BASE = _base()
_CONV = _base(table="(SELECT conv_id * 1000 + turn AS doc_id, role, text FROM conversations)", whole="SELECT conv_id * 1000 + turn AS doc_id, role AS term, 0 AS pos FROM conversations")
BM25 = "(ln(n::DOUBLE / df + 1) + 1) * (tf * 2.2) / (tf + 1.2 * (0.75 * dl / avg + 0.25))"


def _hits(term: str, formula: str = BM25, boost: float = 1.0) -> str:
    return f"(SELECT doc_id, ({formula}) * {boost} AS s FROM (SELECT p.doc_id, p.tf, l.dl, c.n, c.avg, count(*) OVER () AS df FROM post p JOIN lens l ON p.doc_id = l.doc_id CROSS JOIN corpus c WHERE term = '{term}'))"


def _many(cond: str) -> str:
    return f"(SELECT doc_id, max(s) AS s FROM (SELECT doc_id, {BM25} AS s FROM (SELECT p.doc_id, p.tf, l.dl, c.n, c.avg, count(*) OVER (PARTITION BY term) AS df FROM post p JOIN lens l ON p.doc_id = l.doc_id CROSS JOIN corpus c WHERE {cond})) GROUP BY doc_id)"


def _out(inner: str) -> str:
    return f"SELECT doc_id, round(s, 4) AS score FROM {inner}"


def _topq(inner: str, n=10, start=0) -> str:
    return f"{_out(inner)} ORDER BY score DESC, doc_id LIMIT {n} OFFSET {start}"


def _any(*parts: str) -> str:
    return "(SELECT doc_id, max(s) AS s FROM (" + " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts) + ") GROUP BY doc_id HAVING max(s) > 0)"


def _near(term: str, word: str = "term") -> str:
    """Edit distance of at most 1 in code points: an equal rest after dropping or replacing one place."""
    cut = lambda x: f"list_transform(range(6), lambda k: x[:k] || x[k + 2:])".replace("x[", f"{x}[")
    return f"({word} = '{term}' OR list_contains({cut(word)}, '{term}') OR list_contains({cut(f"('{term}')")}, {word}) OR (length({word}) = {len(term)} AND len(list_filter(range({len(term)}), lambda k: {word}[k + 1] <> ('{term}')[k + 1])) <= 1))"


def _after(first: str, later: str, i: int, slop: int) -> str:
    """Documents where `later` stands i places after `first`, give or take slop to the right."""
    at = lambda t, x: f"(SELECT doc_id, unnest(ps) AS {x} FROM post WHERE term = '{t}')"
    return f"SELECT a.doc_id FROM {at(first, 'x')} a JOIN {at(later, 'y')} b ON a.doc_id = b.doc_id AND y - x - {i} BETWEEN 0 AND {slop}"


_SPAN = r"[\p{L}\p{Nd}_-]+"  # a word that highlighting can mark
_EMPTY = "SELECT 1::BIGINT AS doc_id, 1::DOUBLE AS score WHERE false"
_AND = f"(SELECT a.doc_id, (a.s + b.s) / 2 AS s FROM {_hits(A)} a JOIN {_hits('ti')} b ON a.doc_id = b.doc_id)"
_THRE = _many("starts_with(term, 'thre')")
_LOG = r"""WITH e AS (SELECT event_id, event_type, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((millisecond(ts) % 1000)::VARCHAR, 3, '0') AS t FROM events),
n AS (SELECT *, regexp_replace(t, '\.?0+$', '') AS cut FROM e),
r AS (SELECT 'events.log:' || event_id AS ext_id, event_id % 3 AS k, event_type, user_id, CASE WHEN t LIKE '%.000' THEN left(t, 19) ELSE left(t, 20) || regexp_replace(right(t, 3), '0+$', '') END || 'Z' AS timestamp FROM n)
"""
_LOG_JSON = "SELECT ext_id, event_type AS message, 'WARN' AS level, timestamp, user_id::VARCHAR AS \"user\" FROM r WHERE k = 0"
_LOG_BACK = "SELECT ext_id, 'got ' || event_type AS message, 'INFO' AS level, timestamp, NULL::VARCHAR AS \"user\" FROM r WHERE k = 1"


def _bucket(width: str) -> str:
    return f"SELECT strftime(time_bucket(INTERVAL '{width}', ts, TIMESTAMP '0001-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS key, count(*) AS count FROM events GROUP BY 1"


_PART = _base(table="(SELECT p_partkey AS doc_id, p_name || ' ' || p_type AS text FROM part)", whole="SELECT p_partkey AS doc_id, p_brand AS term, 0 AS pos FROM part")

ORACLES = {
    "analyze_tokens": f"WITH {_tokens('documents', 'doc_id')} SELECT term, CASE WHEN regexp_full_match(term, '\\p{{Nd}}+') THEN 'number' ELSE 'word' END AS type, count(*) AS n, min(pos) AS first_pos FROM toks GROUP BY term",
    "index_postings": f"{_BASE} SELECT term, doc_id, tf, array_to_string(ps, ',') AS positions FROM post",
    "index_term_stats": f"{_BASE} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
    "index_doc_lengths": f"{_BASE} SELECT doc_id, dl FROM lens",
    "index_corpus_stats": f"{_BASE} SELECT n AS num_docs, (SELECT count(DISTINCT term) FROM post) AS num_terms, round(avg, 6) AS avg_dl FROM corpus",
    "term_bm25_topk": f"{_BASE} {_topq(_hits(A))}",
    "term_tfidf_topk": f"{_BASE} {_topq(_hits(A, 'sqrt(tf::DOUBLE) * (ln(n::DOUBLE / df) + 1)'))}",
    "term_bm25l_topk": f"{_BASE} {_topq(_hits(A, '(ln(n::DOUBLE / df + 1) + 1) * (tf * 2.2 + 1.0) / (tf + 1.2 * (0.25 + 0.75 * dl / avg) + 1.0)'))}",
    "term_bm25_custom": f"{_BASE} {_topq(_hits(A, '(ln(n::DOUBLE / df + 1) + 1) * (tf * 3.0) / (tf + 2.0 * (0.5 * dl / avg + 0.5))'))}",
    "term_boost": f"{_BASE} {_out(_hits(B, boost=2.5))}",
    "score_terms_sum": f"{_BASE} SELECT doc_id, round(sum(s), 4) AS score FROM (SELECT * FROM {_hits(A)} UNION ALL SELECT * FROM {_hits(B)} UNION ALL SELECT * FROM {_hits(C)}) GROUP BY doc_id",
    "and_query": f"{_BASE} SELECT a.doc_id, round((a.s + b.s) / 2, 4) AS score FROM {_hits(A)} a JOIN {_hits(B)} b ON a.doc_id = b.doc_id",
    "and3_query": f"{_BASE} SELECT a.doc_id, round(((a.s + b.s) / 2 + c.s) / 2, 4) AS score FROM {_hits(A)} a JOIN {_hits(B)} b ON a.doc_id = b.doc_id JOIN {_hits('ti')} c ON a.doc_id = c.doc_id",
    "or_query": f"{_BASE} {_out(_any(_hits(A), _hits(B), _hits(C)))}",
    "not_query": f"{_BASE} {_out(_hits(A))} WHERE doc_id NOT IN (SELECT doc_id FROM {_hits(B)})",
    "and_not_empty": _EMPTY,
    "leading_not_empty": _EMPTY,
    "must_passthrough": f"{_BASE} {_out(_hits(B))}",
    "should_union": f"{_BASE} {_out(_any(_hits(A), _hits(C)))}",
    "bool_must_should_not": f"{_BASE} SELECT a.doc_id, round((a.s + b.s) / 2, 4) AS score FROM {_hits(A, boost=2.0)} a JOIN {_hits('ti')} b ON a.doc_id = b.doc_id WHERE a.doc_id NOT IN (SELECT doc_id FROM {_hits(B)})",
    "bool_should_only": f"{_BASE} {_out(_any(_hits(A, boost=0.5), _hits(C)))} WHERE doc_id NOT IN (SELECT doc_id FROM {_hits(B)})",
    "phrase_query": f"{_BASE} {_out(_hits('er'))} WHERE doc_id IN ({_after('er', 'en', 1, 0)})",
    "phrase_slop": f"{_CONV} {_out(_hits('de'))} WHERE doc_id IN ({_after('de', 'la', 1, 3)}) AND doc_id IN ({_after('de', 'de', 2, 3)})",
    "range_numeric": "SELECT o_orderkey AS doc_id, 1.0::DOUBLE AS score FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000",
    "range_exclusive": "SELECT o_orderkey AS doc_id, 1.5::DOUBLE AS score FROM orders WHERE o_custkey > 10 AND o_custkey < 20",
    "range_time": "SELECT o_orderkey AS doc_id, 1.0::DOUBLE AS score FROM orders WHERE date_trunc('second', o_orderdate) BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'",
    "wildcard_prefix": f"{_BASE} {_out(_THRE)} WHERE doc_id IN (SELECT doc_id FROM toks WHERE starts_with(term, 'thre'))",
    "fuzzy_distance1": f"{_BASE} {_out(_many(_near('tion')))} WHERE doc_id IN (SELECT doc_id FROM toks WHERE {_near('tion')})",
    "query_string_mixed": f"{_BASE} {_out(_any(_AND, _THRE, '(SELECT doc_id, 1.0::DOUBLE AS s FROM documents WHERE n_chars BETWEEN 100 AND 400)'))}",
    "field_scoped_term": f"{_BASE} {_out(_hits(B))} WHERE doc_id IN (SELECT doc_id FROM toks WHERE term = '{B}')",
    "page_offset": f"{_BASE} SELECT doc_id, round(s, 4) AS score FROM {_hits(A)} ORDER BY s DESC, doc_id LIMIT 10 OFFSET 5",
    "count_query": f"{_BASE} SELECT count(*) AS count FROM {_any(_hits(A), _hits(B))}",
    "group_by_field": "SELECT coalesce(nullif(trim(source), ''), '(unknown)') AS key, count(*) AS count FROM documents GROUP BY 1",
    "group_hits_by_lang": f"{_BASE} SELECT coalesce(nullif(trim(lang), ''), '(unknown)') AS key, count(*) AS count FROM documents WHERE doc_id IN (SELECT doc_id FROM {_hits(A)}) GROUP BY 1",
    "group_by_time_5m": _bucket("5 minutes"),
    "group_by_time_7h": _bucket("7 hours"),
    "highlight_fragment": f"SELECT doc_id, i::BIGINT AS start, (i + {len(B)})::BIGINT AS stop, substring(text, greatest(i - 80, 0)::BIGINT + 1, 160) AS fragment FROM (SELECT *, instr(lower(text), '{B}') - 1 AS i FROM documents) WHERE i >= 0",
    "highlight_near": rf"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '{_SPAN}') AS ws, string_split_regex(text, '{_SPAN}') AS gaps FROM documents WHERE instr(lower(text), '{B}') = 0),
k AS (SELECT *, list_position(list_transform(ws, lambda v: {_near(B, "lower(v)")}), true) AS k FROM w),
p AS (SELECT doc_id, text, k, ws, (list_sum(list_transform(gaps[:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ws[:k - 1], lambda v: length(v))), 0))::BIGINT AS s FROM k WHERE k > 0),
e AS (SELECT *, s + length(ws[k]) AS e, greatest(s - 80, 0) AS l FROM p),
c AS (SELECT *, least(greatest(l + 160, e), length(text)) AS r FROM e)
SELECT doc_id, s AS start, e AS stop, CASE WHEN length(text) <= 160 THEN text ELSE substring(text, greatest(l, r - 160)::BIGINT + 1, (r - greatest(l, r - 160))::BIGINT) END AS fragment FROM c""",
    "doc_summary": "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 AND trim(text) <> '' THEN CASE WHEN length(trim(text)) > 100 THEN substring(trim(text), 1, 100) || '...' ELSE trim(text) END END, nullif(trim(source), ''), '(no summary)') AS summary FROM documents",
    "field_projection": "SELECT doc_id, lang, n_chars::VARCHAR AS n_chars FROM documents",
    "point_lookup": "SELECT doc_id, source FROM documents WHERE doc_id = 7",
    "terms_prefix": f"{_BASE} SELECT DISTINCT term FROM post WHERE starts_with(term, 'thr') ORDER BY term LIMIT 25",
    "doc_list": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20",
    "delete_docs": f"{_base('doc_id % 2 = 1', whole='SELECT doc_id, lang AS term, 0 AS pos FROM documents WHERE false')} {_out(_hits(A))}",
    "update_docs": "SELECT doc_id, source FROM documents WHERE doc_id <> 3 UNION ALL SELECT (SELECT max(doc_id) + 1 FROM documents), source FROM documents WHERE doc_id = 4",
    "store_round_trip": "SELECT doc_id::VARCHAR AS ext_id, source, md5(text) AS text_md5 FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id <> 5 UNION ALL SELECT NULL, source, md5(text) FROM documents WHERE doc_id = 4",
    "log_json_parse": f"{_LOG} {_LOG_JSON}",
    "log_logback_parse": f"{_LOG} {_LOG_BACK}",
    "log_auto_detect": "SELECT CASE WHEN event_id % 3 = 0 THEN 'json' ELSE 'logback' END AS format, count(*) AS n FROM events GROUP BY 1",
    "log_auto_parse": f"{_LOG} {_LOG_JSON} UNION ALL {_LOG_BACK}",
    "time_normalize": f"{_LOG} SELECT event_id, CASE WHEN t LIKE '%.000' THEN left(t, 19) ELSE left(t, 20) || regexp_replace(right(t, 3), '0+$', '') END || 'Z' AS t FROM e",
    "part_wildcard_keyword": f"{_PART} {_out(_many('starts_with(term, ' + chr(39) + 'pro' + chr(39) + ')'))} WHERE doc_id IN (SELECT p_partkey FROM part WHERE list_has_any([true], list_transform(regexp_extract_all(p_type, '[\\p{{L}}\\p{{N}}]+'), lambda x: starts_with(translate(x, '{_U}', '{_L}'), 'pro'))))",
}
