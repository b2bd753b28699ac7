"""Engine semantics on small corpora: analysis, scores, query language, boolean rules, logs, storage, API, CLI."""

import json

import pytest
from pyspark.sql import functions as F

from lumensift import cli
from lumensift.api import Api
from lumensift.functions import similarity as sim
from lumensift.functions.analysis import Analyzer
from lumensift.functions.highlight import highlights
from lumensift.functions.timeutil import bucket_start, normalize_time, parse_duration
from lumensift.operators import aggregate
from lumensift.operators import search as s
from lumensift.operators.index import ClosedIndex, Index, UnknownTerm
from lumensift.plans.ast import And, Boolean, Clause, Fuzzy, Not, Occur, Or, Phrase, Range, Term, Wildcard, extract_terms
from lumensift.plans.compiler import compile_query
from lumensift.plans.parser import ParseError, parse
from lumensift.sources import documents as d
from lumensift.sources.files import import_json, read_files
from lumensift.sources.logs import Registry, parse_lines
from lumensift.sources.storage import Store
from lumensift.streaming.ingest import ingest_logs


def corpus(spark, texts):
    return d.from_table(spark.createDataFrame(list(enumerate(texts, 1)), "id long, content string"), "id", text=("content",))


@pytest.fixture(scope="module")
def f1(spark):
    return Index(corpus(spark, ["go programming language", "python programming tutorial", "java development guide", "go and python are programming languages"])).cache()


@pytest.fixture(scope="module")
def f2(spark):
    rows = [(1, "iphone 15", "roam", 199, "2026-02-10T09:15:00Z"), (2, "ipad air", "room", 499, "2026-02-10T09:45:00Z"), (3, "android phone", "foam", 299, "2026-02-10T10:30:00Z")]
    t = spark.createDataFrame(rows, "id long, title string, name string, price long, timestamp string")
    return Index(d.from_table(t, "id", text=("title", "name", "timestamp"), integer=("price",)))


def got(frame):
    return [(r["doc_id"], round(r["score"], 4)) for r in frame.orderBy(F.desc(F.round("score", 6)), "doc_id").collect()]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("go", [(1, 2.1668), (4, 1.9176)]),
        ("go OR java", [(3, 2.6942), (1, 2.1668), (4, 1.9176)]),
        ("go AND programming", [(1, 2.0371), (4, 1.8028)]),
        ("programming NOT java", [(1, 1.9073), (2, 1.9073), (4, 1.6879)]),
        ("(go AND programming) OR python", [(2, 2.1668), (1, 2.0371), (4, 1.9176)]),
        ('"programming language"', [(1, 1.9073)]),
        ("go AND NOT java", []),
        ("NOT go", []),
        ("java OR NOT go", [(3, 2.6942)]),
        ("GO", [(1, 2.1668), (4, 1.9176)]),
        ("go nosuch", []),
        ("  ", []),
    ],
)
def test_queries(f1, query, want):
    assert got(s.hits(f1, query)) == want


def test_similarities(f1):
    assert got(s.hits(f1.with_similarity("tfidf"), "go")) == [(1, 1.6931), (4, 1.6931)]
    assert got(s.hits(f1.with_similarity("bm25l"), "go")) == [(1, 2.145), (4, 1.9707)]


def test_similarity_points(spark):
    def at(model, *x):
        return round(spark.range(1).select(model.score(*map(F.lit, x))).first()[0], 4)

    assert at(sim.TFIDF(), 2, 10, 100, 100.0, 1000) == 7.9269
    assert at(sim.BM25(), 2, 10, 100, 100.0, 1000) == 7.7208
    assert at(sim.BM25(), 3, 5, 20, 100.0, 500) == 10.6494
    assert at(sim.BM25(), 0, 5, 20, 100.0, 500) == 0 and at(sim.TFIDF(), 1, 0, 20, 100.0, 500) == 0 and at(sim.BM25L(), 1, 1, 1, 1.0, 0) == 0


def test_advanced(f2):
    assert got(s.hits(f2, "price:[100 TO 300]")) == [(1, 1.0), (3, 1.0)]
    assert got(s.hits(f2, "timestamp:[2026-02-10T09:00:00Z TO 2026-02-10T10:00:00Z]")) == [(1, 1.0), (2, 1.0)]
    assert got(s.hits(f2, "title:iph*")) == [(1, 2.3863)]
    assert got(s.hits(f2, "name:roam~1")) == [(1, 2.3863), (2, 2.3863), (3, 2.3863)]
    assert got(s.hits(f2, "price:[100 TO 300] AND title:iph*")) == [(1, 1.6931)]
    assert got(s.hits(f2, "price:[100 TO 500] NOT title:iph*")) == [(2, 1.0), (3, 1.0)]
    assert got(compile_query(f2, Range("price", "199", "499", "number", inclusive=False))) == [(3, 1.0)]
    assert got(s.hits(f2, "price:[2025 TO 2026]")) == []
    assert got(s.hits(f2, "name:roam")) == []
    assert got(s.hits(f2.with_options(field_terms=True), "name:roam")) == [(1, 2.3863)]


@pytest.mark.parametrize("bad", ["title:*phone", "name:roam~2", "a:", ":b", "a:[1 TO", "a:[1 2]", "a:[ TO 2]", "a:[x TO y]", "a:b?c", "a:*", "a:~1", 'f:"x y"', '" "', "go AND", "(go"])
def test_parse_errors(bad):
    with pytest.raises(ParseError):
        parse(bad)


def test_parse_trees():
    assert parse("a b c") == And((And((Term("a"), Term("b"))), Term("c")))
    assert parse("a OR b OR c") == Or((Term("a"), Term("b"), Term("c")))
    assert parse("Title:iph*") == Wildcard("Title", "iph")
    assert parse("") is None and parse('""') is None and parse('go "" x') == parse("go x")
    assert parse('ab"cd"ef') == parse("ab cd ef")  # a quote ends the word
    assert parse("a OR b AND NOT c d") == Or((Term("a"), And((And((Term("b"), Not(Term("c")))), Term("d")))))
    assert parse("t:[1 to 2] (x)") == And((Range("t", "1", "2", "number"), Term("x")))
    assert extract_terms(parse('"go lang" NOT t:ab~1')) == ["go lang", "go", "lang", "ab"]
    with pytest.raises(ValueError):
        Fuzzy("f", "x", 2)


def test_boolean_rules(f1):
    both = Boolean((Clause(Term("programming"), Occur.MUST), Clause(Term("go"), Occur.SHOULD, 9.0)))
    assert got(compile_query(f1, both)) == got(s.hits(f1, "programming"))
    assert got(compile_query(f1, Boolean((Clause(Term("go"), Occur.MUST_NOT),)))) == []
    assert got(compile_query(f1, Phrase(("go", "programming"), slop=1))) == [(1, 2.1668)]
    assert [x for x, _ in got(compile_query(f1, Phrase(("go", "programming"), slop=3)))] == [1, 4]


def test_strict_terms(f1):
    with pytest.raises(UnknownTerm):
        s.hits(f1.with_options(strict_terms=True), "go OR nosuch")


def test_pages(f1):
    assert [r["doc_id"] for r in s.page(f1, "go OR java", 1, 2).collect()] == [1, 4]
    assert s.page(f1, "go OR java", 3, 2).count() == 0 and s.top(f1, "go", 0).count() == 0
    for bad in ((-1, 5), (0, 0), (0, 201)):
        with pytest.raises(ValueError):
            s.page(f1, "go", *bad)


def test_lengths_and_postings(spark):
    t = spark.createDataFrame([(1, "go go gopher", "DOC-001"), (2, "", "x")], "id long, content string, k string")
    ix = Index(d.from_table(t, "id", text=("content",), keyword=("k",)))
    assert {(r["doc_id"], r["dl"]) for r in ix.doc_lengths.collect()} == {(1, 3), (2, 0)}
    p = ix.postings.where("term = 'go'").first()
    assert (p["tf"], list(p["positions"])) == (2, [0, 1])
    assert ix.contains_term("DOC-001") and not ix.contains_term("doc") and ix.corpus_row == (2, 1.5)


@pytest.mark.parametrize(("text", "want"), [("The quick brown fox jumps over the lazy dog", "quick brown fox jumps over lazy dog"), ("this is a test document", "test document"), ("I am a boy", "boy"), ("the an and or", ""), (",!?:;", ""), (None, ""), ("hello 中文 world É", "hello 中文 world É")])
def test_analyzer(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(Analyzer().tokens(F.col("t")).alias("x")).first()
    assert " ".join(t["term"] for t in row["x"]) == want


def test_mutations(f1, spark):
    more = corpus(spark, ["rust language"]).select("fields")
    ix = f1.add(more)
    assert ix.exists(5) and ix.doc_count() == 5 and f1.doc_count() == 4
    assert [x for x, _ in got(s.hits(ix.delete([1]), "go"))] == [4]
    up = ix.update(2, more)
    assert not up.exists(2) and up.exists(6)
    with pytest.raises(LookupError):
        ix.delete([99], strict=True)
    other = Index(corpus(spark, ["x"]))
    other.close()
    with pytest.raises(ClosedIndex):
        other.documents


def test_aggregations(spark):
    t = spark.createDataFrame([(1, "INFO", "2026-02-10T10:01:00Z"), (2, "ERROR", "2026-02-10T10:04:59Z"), (3, "ERROR", "2026-02-10T10:08:00Z"), (4, None, "soon")], "id long, level string, timestamp string")
    docs = d.from_table(t, "id", keyword=("level", "timestamp"))
    pairs = lambda x: [(r["key"], r["count"]) for r in x.collect()]
    assert pairs(aggregate.group(docs, "level")) == [("ERROR", 2), ("(unknown)", 1), ("INFO", 1)]
    assert pairs(aggregate.group(docs, "time(5m)")) == [("2026-02-10T10:00:00Z", 2), ("(unknown)", 1), ("2026-02-10T10:05:00Z", 1)]
    for bad in ("time(bad)", "time(-5m)", "time(0s)", ""):
        with pytest.raises(ValueError):
            aggregate.group(docs, bad)
    with pytest.raises(ValueError):
        aggregate.count(docs, "sum")
    assert parse_duration("1h30m") == 5_400_000_000


def test_times(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("2026-02-10 09:30:01.123", normalize_time) == "2026-02-10T09:30:01.123Z"
    assert one("2026-02-10T09:30:01+08:00", normalize_time) == "2026-02-10T09:30:01+08:00"
    assert one("2026-02-10T09:30:01", normalize_time) == "2026-02-10T09:30:01" and one("2026", normalize_time) == "2026"
    assert one("2026-02-10T10:04:59Z", lambda c: bucket_start(c, parse_duration("7h"))) == "2026-02-10T04:00:00Z"


@pytest.mark.parametrize(("text", "term", "want"), [("Go language is great", "language", (3, 11)), ("Error happened", "error", (0, 5)), ("abc def ghi jkl", "ghi", (8, 11)), ("my roam-ing fooam", "foam", (12, 17)), ("nothing", "zzz", None)])
def test_highlight(spark, text, term, want):
    h = corpus(spark, [text]).select(highlights([term]).alias("h")).first()["h"]
    assert (h and (h["start"], h["end"])) == want


def test_summary_and_view(spark):
    t = spark.createDataFrame([(1, "x" * 120, None, "p"), (2, None, " hi ", "p"), (3, None, None, None)], "id long, raw string, message string, path string")
    docs = d.from_table(t, "id", text=("raw", "message"), keyword=("path",))
    assert [r[0] for r in docs.orderBy("doc_id").select(s.summary()).collect()] == ["x" * 100 + "...", "hi", "(no summary)"]
    assert docs.where("doc_id = 2").select(s.view(["path"])).first()[0] == {"path": "p"}
    assert s.field_list(" a, b,a ") == ["a", "b"] and s.flag("YES") and not s.flag("no")
    for bad in ("a,,b", "message;drop"):
        with pytest.raises(ValueError):
            s.field_list(bad)


LINES = [
    '{"timestamp":"2026-02-10T09:00:00Z","level":"error","logger":"api","message":"request failed","code":7,"ratio":1.5,"ok":true,"deep":{"a":1},"Level":"x"}',
    "2026-02-10 09:30:01.123 INFO com.example.OrderService - order created",
    "invalid line",
    "",
    '{"level":',
    '{"severity":" warn ","msg":"m","class":"c","ts":"soon"}',
]


def test_logs(spark):
    rows = spark.createDataFrame([("f.log", i, x) for i, x in enumerate(LINES, 1)], "source string, line_no long, line string")
    out = {r["ext_id"]: r for r in parse_lines(rows, "auto").collect()}
    assert {k for k, r in out.items() if not r["parsed"]} == {"f.log:3", "f.log:5"} and "f.log:4" not in out
    value = lambda f: next(x for x in (f["str"], f["long_v"], f["dbl_v"], f["bool_v"]) if x is not None)
    fields = lambda n: {f["name"]: (f["type"], value(f)) for f in out[f"f.log:{n}"]["fields"]}
    a, b, c = fields(1), fields(2), fields(6)
    assert a["level"] == ("keyword", "ERROR") and a["line_no"] == ("int", 1) and a["code"] == ("int", 7) and a["ratio"] == ("float", 1.5) and a["ok"] == ("bool", True) and a["deep"][0] == "stored" and "Level" not in a
    assert b["logger"][1] == "com.example.OrderService" and b["message"][1] == "order created" and b["timestamp"][1] == "2026-02-10T09:30:01.123Z"
    assert c["level"][1] == "WARN" and c["logger"][1] == "c" and c["timestamp"][1] == "soon"
    r = Registry()
    for name in ("auto", " ", None):
        with pytest.raises(ValueError):
            r.register(name, lambda x: x)
    with pytest.raises(ValueError):
        r.get("nosuch")


def test_files_and_store(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("alpha beta")
    (tmp_path / "in/sub/b.MD").write_text("alpha gamma")
    (tmp_path / "in/c.bin").write_text("alpha")
    assert read_files(spark, str(tmp_path / "in"), True).count() == 2
    (tmp_path / "d.json").write_text(json.dumps([{"id": "x", "fields": {"t": "alpha", "n": 1.5, "b": True, "z": None, "o": {"k": 1}}}]))
    kinds = {f["name"]: f["type"] for f in import_json(spark, str(tmp_path / "d.json")).first()["fields"]}
    assert kinds == {"t": "text", "n": "float", "b": "bool"}
    store = Store(spark, str(tmp_path / "ix")).create()
    store.add(read_files(spark, str(tmp_path / "in"), True))
    assert store.pending() == 1 and store.index().doc_count() == 2  # replayed before any commit
    assert store.commit() and not store.commit()
    store.delete([1])
    store.delete([77])
    assert store.index().doc_count() == 1 and got(s.hits(store.index(), "alpha"))[0][0] == 2
    store.commit()
    assert store.info()["last_id"] == 2 and store.index().doc_count() == 1
    store.drop()
    assert not store.exists()


def test_api_and_cli(spark, tmp_path):
    store = Store(spark, str(tmp_path / "ix")).create()
    t = spark.createDataFrame([(1, "alpha one", "INFO"), (2, "alpha two", "ERROR")], "id long, message string, level string")
    store.add(d.from_table(t, "id", text=("message",), keyword=("level",)).coalesce(1).select("fields"))
    store.commit()
    api = Api(store)
    code, r = api.handle("GET", "/search?q=alpha&fields=message,level&agg=count&group=level")
    assert code == 200 and r["total"] == 2 and set(r["results"][0]["doc"]) == {"message", "level"} and r["aggregations"]["count"] == 2
    for bad in ("q=alpha&fields=message;drop", "q=alpha&size=0", "q=", "q=a:*x"):
        assert api.handle("GET", f"/search?{bad}".replace(";", "%3B"))[0] == 400
    assert api.handle("GET", "/doc/9")[0] == 404 and api.handle("GET", "/doc/1")[0] == 200
    code, r = api.handle("POST", "/add", b'{"id": "n", "fields": {"message": "alpha three"}}')
    assert code == 200 and api.handle("GET", "/search?q=alpha")[1]["total"] == 3
    assert api.handle("DELETE", f"/delete?id={r['id']}")[0] == 200 and api.handle("GET", "/stats")[1]["num_docs"] == 2
    run = lambda *a: cli.run(["--index", str(tmp_path / "ix"), *a], spark)
    assert "count: 2" in run("count", "alpha")[1] and run("search", "alpha", "-o", "json", "--agg", "count")[0] == 0
    (tmp_path / "l.log").write_text("\n".join(LINES))
    assert run("parse-log", str(tmp_path / "l.log"))[1] == "added: 3\nskipped: 2"
    assert "request" in run("terms", "-p", "req")[1] and run("list")[0] == 0 and run("stats")[0] == 0 and run("info")[0] == 0
    assert run("search", "a:*x")[0] == 1 and run("version")[0] == 0 and run("delete-doc", "1")[0] == 0 and run("delete")[0] == 0


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(LINES))
    store = Store(spark, str(tmp_path / "ix")).create()
    ingest_logs(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination()
    assert store.index().doc_count() == 3


def test_queries_match_their_sql(spark):
    import os

    import duckdb

    from lumensift.plans.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf}/{f}") else "")
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    assert QUERIES.keys() == ORACLES.keys()
    for name in QUERIES:
        mine, theirs = QUERIES[name](spark, sf).toPandas(), db.execute(ORACLES[name]).df()
        cols = sorted(mine.columns)
        rows = lambda x: sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).values.tolist()))
        assert sorted(theirs.columns) == cols and rows(mine) == rows(theirs), name
