"""Queries read the postings of their own terms only, and the statistics do without postings."""

import pytest
from pyspark.sql import functions as F

from lumensift.functions.analysis import Analyzer
from lumensift.operators import search as s
from lumensift.operators.index import Index
from lumensift.operators.wanted import Match, Wanted
from lumensift.plans import queries as registered
from lumensift.plans.ast import Boolean, Clause, Fuzzy, Not, Occur, Phrase, Term
from lumensift.plans.compiler import matches
from lumensift.sources import documents as d
from lumensift.sources.storage import Store

TEXTS = ["The TION thread, The tION", "é ü THIS thrEE " + "x" * 51, "a\\Eb Kelvin tio", None, "", "tions then " + "y" * 50, "threnody of Tion"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "tion" if i % 2 else "De", 100 * i) for i, t in enumerate(TEXTS, 1)]
    return d.from_table(spark.createDataFrame(rows, "id long, text string, k string, n long"), "id", text=("text",), keyword=("k",), integer=("n",))


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_narrowed_postings_are_those_of_the_terms(docs):
    ix = Index(docs)
    every = ix.postings
    for m, cond in ((Match("term", "tion"), "term = 'tion'"), (Match("term", "De"), "term = 'De'"), (Match("prefix", "thre"), "term LIKE 'thre%'"), (Match("near", "tion"), "levenshtein(term, 'tion') <= 1")):
        got = ix.narrowed(Wanted(frozenset({m}))).postings.drop("within")
        assert rows_of(got) == rows_of(every.where(cond)) and got.count() > 0, m


def test_queries_keep_no_other_postings(spark, docs):
    ix = Index(docs).cache()
    assert s.hits(ix, "tion AND thread").count() == 1
    assert not ix.postings.is_cached  # before: every posting in executor storage, read again for each term
    kept = list(ix._memo["kept"].values())
    assert [sorted({r["term"] for r in k.collect()}) for k in kept] == [["thread", "tion"]] and kept[0].is_cached
    s.hits(ix.with_similarity("tfidf"), "thread tion").count()
    assert len(ix._memo["kept"]) == 1
    ix.close()
    assert not kept[0].is_cached


def test_matches_of_nodes():
    both = Boolean((Clause(Term("a"), Occur.MUST), Clause(Term("b"), Occur.SHOULD), Clause(Phrase(("c", "D")), Occur.MUST_NOT), Clause(Not(Term("e")), Occur.MUST)))
    assert sorted(m.text for m in matches(both)) == ["a", "c", "d"] and matches(Fuzzy("f", "Ab")) == [Match("near", "ab", "f")]


def test_statistics_without_postings(docs):
    ix = Index(docs)
    p = ix.postings
    assert rows_of(ix.term_stats) == rows_of(p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    assert ix.stats().first()["num_terms"] == p.select("term").distinct().count()
    for a in (Analyzer(), Analyzer(lower=False), Analyzer(stop_words=()), Analyzer(filters=(lambda t: t != "tion",))):
        sizes = docs.select("doc_id", F.size(a.tokens(d.string_value(d.first_field("text")))).cast("long").alias("dl")).where("dl >= 0")
        lengths = Index(docs, analyzer=a).doc_lengths
        assert rows_of(lengths.where("dl > 0")) == rows_of(sizes.where("dl > 0")) and lengths.count() == len(TEXTS)


def test_fields_of_a_stored_index(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path / "ix")).create()
    store.add(docs.coalesce(1).select("fields"))
    store.commit()
    for q in ("text:tion~1", "k:tion OR text:thre*"):
        mine, stored = (s.hits(ix.with_options(field_terms=True), q).select("doc_id", F.round("score", 6)) for ix in (Index(docs), store.index()))
        assert rows_of(mine) == rows_of(stored) and mine.count() > 0, q


def test_groups_of_all_hits_join_keys_only(docs):
    plan = s.aggregations(Index(docs), "tion", None, "k", scope="all")
    assert {(r["key"], r["count"]) for r in plan.collect()} == {("tion", 4)}
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "fields" not in text[: text.index("Join")]  # before: the key was taken above the join, of whole documents


def test_a_commit_shuffles_no_documents(spark, docs, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "ix")).create()
    store.add(docs.coalesce(1).select("fields"))
    store.delete([1, 99])
    store.update(2, docs.where("doc_id = 3").select("fields"))
    store.delete([4])
    plan = store.documents()._jdf.queryExecution().optimizedPlan().toString()
    window = next(x for x in plan.split("\n") if "Window " in x and "doc_id" in x)
    assert "row_number" not in window  # before: whole documents were sorted by id to number their changes
    assert [r["doc_id"] for r in store.documents().orderBy("doc_id").collect()] == [3, 5, 6, 7, 8]
    ranged = []
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda self, *a: ranged.append(a) or self)
    store.commit()
    assert not ranged  # before: all postings were made twice, to find the ranges and to deal them out
    for f in (tmp_path / "ix/v1/postings").glob("*.parquet"):
        terms = [r["term"] for r in spark.read.parquet(str(f)).collect()]
        assert terms == sorted(terms)
    assert sorted(r["doc_id"] for r in s.hits(store.index(), "tion").collect()) == [3, 5, 7, 8]


@pytest.mark.parametrize("name", "and_not_empty and_query bool_should_only count_query field_scoped_term fuzzy_distance1 group_hits_by_lang index_corpus_stats index_postings index_term_stats must_passthrough not_query page_offset phrase_query".split())
def test_registered_queries_store_little(spark, name, monkeypatch):
    """Blocks that a query leaves in executor storage are read whole by single tasks; before, they held every posting."""
    sf = "/root/testdata/sf0.001"
    stored = lambda: sum(r.memSize() + r.diskSize() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    texts = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(registered, "_indexes", {})
    before = stored()
    registered.QUERIES[name](spark, sf).collect()
    took = stored() - before
    for ix in registered._indexes.values():
        ix.close()
    assert took < texts / 10
