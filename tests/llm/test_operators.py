"""Corpus operators against brute force, SQL, round trips and held-out labels, and on odd inputs."""

import gzip
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumensift.llm import cotraining, decontamination, license_scan, line_dedup, mixing, near_dedup, quality_rules, suffix_dedup, toxicity, warc
from lumensift.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def table(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_rules_base(spark, table):
    odd = [(10_000, None), (10_001, ""), (10_002, "a b c d e f g h " * 5), (10_003, "x\n\n \nx\nx"), (10_004, "#*$%&|<> é")]
    d = spark.createDataFrame(table + odd, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(d).collect()}
    for i, t in table + odd:
        w, t = words(t), t or ""
        grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {k for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        r = got[i]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, i
        assert not (failed and r["kept"])


def test_quality_model_recovers_planted_accuracies():
    """EM over synthetic votes finds the share of good texts and each rule's rates, and one weak bad vote doesn't decide."""
    rnd = random.Random(12)
    planted = [(0.9, 0.01), (0.8, 0.02), (0.7, 0.05), (0.6, 0.1), (0.45, 0.3)]  # chance of a bad vote on bad and on good texts
    votes = Counter()
    for _ in range(20_000):
        good = rnd.random() < 0.85
        cast = [quality_rules.BAD if rnd.random() < p[good] else quality_rules.GOOD for p in planted]
        votes["".join(str(quality_rules.ABSTAIN if rnd.random() < 0.2 else v) for v in cast)] += 1
    m = quality_rules.fit(sorted(votes.items()), len(planted))
    assert m["prior"] == pytest.approx(0.85, abs=0.02)
    for r, (on_bad, on_good) in enumerate(planted):
        assert m["bad"][quality_rules.BAD][r] == pytest.approx(on_bad, abs=0.05) and m["bad"][quality_rules.GOOD][r] == pytest.approx(on_good, abs=0.02)
    p = lambda x: quality_rules.posterior(m, x)
    assert p("11110") > 0.9 and p("11101") > 0.5 and p("00111") < 0.5 and p("22222") == pytest.approx(m["prior"])
    assert quality_rules.fit([], 4)["prior"] == 0.5


def test_quality_verdicts_on_labels(spark):
    """The posterior, not a single vote, decides: labelled bad texts go, good ones stay, and so do most with one bad vote."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    d = quality_rules.quality_rules(spark.read.parquet(f"{path}/documents.parquet")).where("NOT base_failed")
    rows = d.join(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").collect()
    n_bad = lambda r: sum(r[c] == quality_rules.BAD for c in r.asDict() if c.startswith("vote_"))
    bad, good = ([r["kept"] for r in rows if r["quality"] == y] for y in (0, 1))
    one = [r["kept"] for r in rows if n_bad(r) == 1]
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.99 * len(good) and len(one) > 10 and sum(one) >= 0.8 * len(one)
    assert all(r["kept"] == (r["p_good"] >= 0.5) for r in rows)


def test_license_base(spark, table):
    odd = [(10_000, None), (10_001, "Under the MIT license; UNDER the mit-license"), (10_002, "CC BY-NC 4.0 and Apache License, Version 2.0"), (10_003, "")]
    d = spark.createDataFrame(table + odd, "doc_id long, text string")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r["doc_id"]: r for r in license_scan.license_scan(d).collect()}
    for i, t in table + odd:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        hits = [(k, j) for k, p in license_scan.BASE_PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        at = [j for _, j in hits]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for k, _ in hits}))), i
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_templates():
    a = license_scan.Automaton("copyright <<beginOptional>> c <<endOptional>> <<var;max=2>> all rights reserved")
    run = lambda t: a.longest(t.encode().split(), 0)
    assert run("copyright c 2020 me all rights reserved x") == 7 and run("copyright all rights reserved") == 4
    assert run("copyright a b c all rights reserved") == -1 and run("copyright all rights") == -1
    for bad in ("<<beginOptional>> x", "x <<endOptional>>", "<<var;max=2>>"):
        with pytest.raises(ValueError):
            license_scan.Automaton(bad)


def test_license_whole_texts(spark):
    """Whole wordings with their optional and replaced regions are accepted, a changed or missing mandatory word isn't."""
    by = {}
    for label, t in license_scan.TEMPLATES:
        by.setdefault(label, t)
    fill = lambda t: re.sub(r"\s+", " ", re.sub(r"<<var;max=\d+>>", "4.0", t.replace("<<beginOptional>>", "").replace("<<endOptional>>", "")))
    bare = lambda t: re.sub(r"<<var;max=\d+>>", "x", re.sub(r"<<beginOptional>>[^<]*(<<var;max=\d+>>)?[^<]*<<endOptional>>", "", t))
    texts, want = [], []
    for label in ("mit", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2", "gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd"):
        whole = f"before {fill(by[label])} after"
        words = whole.split()
        mandatory = license_scan.Automaton(by[label]).mandatory[-4].decode()
        at = max(i for i, w in enumerate(words) if license_scan.plain_words(w.encode())[:1] == [mandatory.encode()])
        texts += [whole, f"before {bare(by[label])} after", " ".join([*words[:at], "changed", *words[at + 1 :]])]
        want += [(label, True), (label, True), (label, False)]
    out = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    got = [(k, k in out[i]["labels"].split(",")) for i, (k, _) in enumerate(want)]
    # the short notices stay where the long wording is broken
    assert [g for g, (k, _) in zip(got, want, strict=True) if k not in ("mit", "apache-2")] == [w for w in want if w[0] not in ("mit", "apache-2")]
    long_mit = lambda i: any(m["label"] == "mit" and m["end_word"] - m["first_word"] > 100 for m in out[i]["matches"])
    assert long_mit(0) and long_mit(1) and not long_mit(2)


def edit(a, b):
    """Least errors of a anywhere in b."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_myers_and_pigeonhole(spark):
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(n)] for n in (rnd.randint(1, 90), rnd.randint(0, 120)))
        assert decontamination.myers(a, b, 999) == edit(a, b)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, [rnd.choice(vocab) for _ in range(n)]) for i, n in enumerate((2, 5, 20, 45, 45, 20))]
    texts = [None, "", "w1"]
    for i, w in itertools.product(range(6), range(5)):
        q = list(items[i][1])
        for _ in range(w):
            q[rnd.randrange(len(q))] = "zz"
        texts.append(" ".join([rnd.choice(vocab) for _ in range(30)] + q + [rnd.choice(vocab) for _ in range(30)]).upper())
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, ""), (91, None)], "item_id long, text string")
    found = decontamination.decontaminate(frame(spark, texts), b, block_items=4).collect()
    got = {(r["doc_id"], h["item_id"], h["errors"]) for r in found for h in r["hits"]}
    want = set()
    for n, t in enumerate(texts):
        for i, w in items:
            e = edit(w, (t or "").lower().split())
            if e <= len(w) // 10:
                want.add((n, i, e))
    assert got == want and want and any(i == 0 for _, i, _ in got)


def test_decontamination_odd_items(spark):
    """Scripts without blanks, items without an id, of one word, of over 1 MiB; several rows of one id."""
    item = "私は昨日の朝東京駅で古い友人に会いました"
    texts = [f"前置き。{item}。終わり", item.replace("古", "新"), item[:9], "there is a needle here", "needles", None]
    b = spark.createDataFrame([(1, item), (None, "needle"), (4, "!?"), (5, "zz yy xx"), (5, "a needle")], "item_id long, text string")
    d = frame(spark, texts)
    got = {(r["doc_id"], h["item_id"], h["errors"]) for r in decontamination.decontaminate(d, b, rate=0.05).collect() for h in r["hits"]}
    assert got == {(0, 1, 0), (1, 1, 1), (3, None, 0), (3, 5, 0)}
    assert [r["doc_id"] for r in decontamination.without_leaks(d, b, rate=0.05).orderBy("doc_id").collect()] == [2, 4, 5]
    long = " ".join(f"w{i}" for i in range(140_000)).encode()  # one piece of over 1 MiB
    assert decontamination.Matcher([(3, long)], 0.0).find(b"x y " + long + b" z") == {3: 0}


def test_toxicity_held_out(spark):
    rnd = random.Random(5)
    filler = [f"{a}{b}" for a in ("wor", "tal", "min", "sed") for b in ("ka", "lo", "ri", "tu", "ve", "xo")]
    rows, labels = [(900, None), (901, "")], []
    for i in range(600):
        bad = i % 4 == 0
        t = [rnd.choice(filler) for _ in range(40)] + [f"grumbl{rnd.choice(('e', 'ing', 'er'))}" for _ in range(3 * bad)]
        rnd.shuffle(t)
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(d, toxicity.fit(d, lab)).collect()}
    held = [i for i, _ in labels if out[i]["held_out"]]
    import zlib

    assert held == [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0] and held
    assert all(out[i]["predicted"] == (i % 4 == 0) for i in held) and out[900]["predicted"] == out[901]["predicted"] == 0
    none = toxicity.toxicity(d, toxicity.fit(d, lab.limit(0))).select("score").distinct().collect()
    assert len(none) == 1 and none[0][0] < 0.5


@pytest.mark.parametrize(("block", "dense"), [(4, 0), (16, 5), (512, 30)])
def test_block_max_index_is_exact(monkeypatch, block, dense):
    monkeypatch.setattr(toxicity, "MAX_DENSE", dense)
    rnd = random.Random(9)
    weights = {f"t{i}": rnd.uniform(0.5, 3) for i in range(30)}
    probe = toxicity.Index(weights, [], [], [])

    def draw():
        v = {t: rnd.randint(1, 4) * weights[t] for t in rnd.sample(list(weights), rnd.randint(1, 8))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = [draw() for _ in range(500)]
    ix = toxicity.Index(weights, vectors, list(range(500)), [0] * 500, block=block)
    for _ in range(50):
        q, skip = draw(), rnd.choice((-1, rnd.randrange(500)))
        brute = {n: round(sum(q[t] * vectors[n].get(t, 0) for t in q), 9) for n in range(500)}
        if skip >= 0:
            brute.pop(ix.ids[skip])
        want = sorted((c for c in brute.values() if c > 0), reverse=True)[:7]
        got = ix.nearest([probe.numbered(q)], 7, [skip])[0]
        assert [c for c, _ in got] == pytest.approx(want, abs=2e-9)
        assert all(brute[ix.ids[n]] == pytest.approx(c, abs=2e-9) for c, n in got)


def test_toxicity_indexes_all_terms(spark):
    """The whole query against brute force: a few examples of a rare wording and non-toxic ones, over all terms."""
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice("abcdefghij") * 3 + rnd.choice("klmnopq") for _ in range(20))) for i in range(100)]
    rows[1], rows[2] = (1, "zorblat quimdex vrunk"), (2, "zorblat quimdex vrunk now")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i in (1, 2))) for i in range(100)], "doc_id long, toxic int")
    m = toxicity.fit(d, lab)
    used = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5}
    assert set(m.index.ids) == used
    counts = {i: toxicity.terms(t) for i, t in rows}
    weight = dict(zip(m.index.vocabulary.numbers, m.index.weights, strict=True))
    assert set(weight) == {t for i in used for t in counts[i]}
    for t in ("zorblat", next(iter(counts[50]))):  # idf times what sets the classes apart
        a, b = (sum(t in counts[i] for i in used if (i in (1, 2)) == y) for y in (True, False))
        na = len(used & {1, 2})
        nb = len(used) - na
        odds = math.log((a + 0.5) / (na - a + 0.5)) - math.log((b + 0.5) / (nb - b + 0.5))
        error = math.sqrt(sum(1 / (x + 0.5) for x in (a, na - a, b, nb - b)))
        idf = math.log(1 + len(rows) / (1 + sum(t in c for c in counts.values())))
        assert weight[t] == pytest.approx(idf * (toxicity.PLAIN + max(0, abs(odds) - toxicity.CERTAIN * error)))

    def vector(c):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in c.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    out = {r["doc_id"]: r for r in toxicity.toxicity(d, m).collect()}
    for i in (1, 7, 50):
        q = vector(counts[i])
        cosine = {j: sum(x * vector(counts[j]).get(t, 0) for t, x in q.items()) for j in used}
        want = [c for c in sorted(cosine.values(), reverse=True)[:15] if c > 1e-9]
        near = m.scores([rows[i][1]])[0][1]
        assert [c for c, _ in near] == pytest.approx(want, abs=1e-8)
        share = sum(c for c, n in near if m.index.ids[n] in (1, 2))
        assert out[i]["score"] == pytest.approx(m.calibrated((share + toxicity.SHRINK * m.base) / (sum(want) + toxicity.SHRINK)), abs=1e-6)
        assert [(e["doc_id"], round(e["cosine"], 6)) for e in out[i]["evidence"]] == [(m.index.ids[n], round(c, 6)) for c, n in near[:5]]
    assert any(not e["toxic"] for e in out[7]["evidence"])


@pytest.mark.parametrize(("sf", "least", "recall"), [("sf0.01", 0.9, 0.6), ("sf0.1", 0.95, 0.9)])
def test_toxicity_on_held_out_labels(spark, sf, least, recall):
    """sf0.01 has 6 held-out toxic documents and 45 toxic examples, sf0.1 97 and 352."""
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{path}/labels.parquet").where("toxic IS NOT NULL")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    # only labelled documents are scored here; frequencies cover all
    m = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), m).where("held_out").join(labels, "doc_id").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc >= least and sum(s >= 0.5 for s in bad) >= recall * len(bad) and sum(s >= 0.5 for s in good) <= 0.02 * len(good), (auc, sum(s >= 0.5 for s in bad), len(bad), sum(s >= 0.5 for s in good), len(good))


def jaccard_components(texts, k):
    sets = {}
    for i, t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_dedup(spark, table):
    rnd = random.Random(1)
    base = [f"v{i}" for i in range(60)]
    chain = []
    for n in range(12):  # neighbours are linked, the ends are not
        base[rnd.randrange(60)] = f"n{n}"
        chain.append((20_000 + n, " ".join(base)))
    odd = [(10_000, None), (10_001, ""), (10_002, "one"), (10_003, "ONE"), (10_004, " one\n"), (10_005, "two words")]
    texts = table + chain + odd
    for k in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(spark.createDataFrame(texts, "doc_id long, text string"), k).collect()}
        assert got == jaccard_components(texts, k)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (150, 200)], "x long, y long")
    got = {r["node"]: r["comp"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}
    assert components(links.limit(0)).count() == 0


def test_sketch_estimate():
    import numpy as np

    rng = np.random.default_rng(2)
    for j in (0.5, 0.8, 0.95):
        n = 4000
        shared = int(2 * n * j / (1 + j))
        x = near_dedup.mix(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        a, b = x[:n], x[n - shared : 2 * n - shared]
        one = lambda s: near_dedup.sketch(np.sort(s))[None, :]
        e = near_dedup.estimate(one(a), one(b), np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(e - j) < 0.12
        assert (np.maximum(one(a), one(b)) == near_dedup.sketch(np.union1d(a, b))).all()  # sketches merge


def sql(query):
    import duckdb

    db = duckdb.connect()
    for t in ("documents",):
        path = f"{SF}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{SF}/{t}.parquet") else "")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return db.execute(query).df()


@pytest.mark.parametrize(("query", "text"), [(mixing.op6_mixing, mixing.OP6_SQL), (line_dedup.op8_line_dedup, line_dedup.OP8_SQL)])
def test_sql_forms(spark, table, query, text):
    mine, theirs = query(spark, SF).toPandas(), sql(text)
    cols = sorted(mine.columns)
    rows = lambda x: sorted(map(str, x[cols].values.tolist()))
    assert cols == sorted(theirs.columns) and rows(mine) == rows(theirs)


def test_training_order(spark, table):
    """The registered query has rank and positions of the curriculum, and so has the pipeline's stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mine = mixing.op6_mixing(spark, SF).toPandas()
    runs = mixing.curriculum(docs).toPandas()
    assert runs["position"].is_monotonic_increasing and runs["position"].between(0, 1).all()
    words = runs.groupby("doc_id")["words"].sum().to_dict()
    first = [x for x in mine["position_1"] if x == x]
    assert first == sorted(first) and len(mine) == docs.count() and all(x != x for x in mine["position_1"][len(first) :])
    assert all(t == words.get(i, 0) for i, t in zip(mine["doc_id"], mine["taken"], strict=True))
    at = {(r.doc_id, r.epoch): r.position for r in runs.itertuples()}
    for e in range(3):
        assert {i: x for i, x in zip(mine["doc_id"], mine[f"position_{e + 1}"], strict=True) if x == x} == {i: x for (i, k), x in at.items() if k == e}
    stage = corpus_pipeline.mix(spark, docs, SF).toPandas()
    assert stage["position_1"].dropna().tolist() == first


@pytest.mark.parametrize("ramp", [-1.0, -0.5, 0.0, 0.5, 1.0])
def test_position_inverts_the_integrated_schedule(spark, ramp):
    """The numeric integral of the schedule up to a position is the demand that the position was computed for."""
    target, steps = 1000, 20_000
    weight = [1 + ramp * (2 * (i + 0.5) / steps - 1) for i in range(steps)]
    rows = spark.range(0, target + 1, 50).select("id", mixing.position(F.col("id"), F.lit(target), ramp).alias("t")).collect()
    for r in rows:
        n = int(r["t"] * steps)
        part = sum(weight[:n]) + (r["t"] * steps - n) * (weight[n] if n < steps else 0)
        assert part / steps * target == pytest.approx(r["id"], abs=0.2)


def test_mixing_caps_and_curriculum(spark):
    sizes = {"a": [5] * 4, "b": [100] * 10, "c": [7] * 30, None: [50] * 5}
    rows, n = [], 0
    for s, each in sizes.items():
        for k in each:
            rows.append((n, " ".join(["w"] * k), s))
            n += 1
    d = spark.createDataFrame(rows + [(n, None, "a")], "doc_id long, text string, source string")
    r = mixing.place(d).collect()
    total = sum(map(sum, sizes.values()))
    by = {}
    for x in r:
        assert x["taken"] <= 3 * x["size"]
        by.setdefault(x["source"], [x["target"], 0])[1] += x["taken"]
    assert abs(sum(t for t, _ in by.values()) - total) < 1e-6 and all(0 <= t - k < 1 for t, k in by.values())
    assert by["a"][0] == 60  # three times its source
    c = mixing.curriculum(d, {"b": -1.0, "c": 1.0}).collect()
    assert sum(x["words"] for x in c) == sum(k for _, k in by.values())
    at = lambda s: [x["position"] for x in c if x["source"] == s]
    assert [x["position"] for x in c] == sorted(x["position"] for x in c) and sum(at("b")) / len(at("b")) < sum(at("c")) / len(at("c"))
    assert mixing.place(d.limit(0)).count() == 0


def test_line_windows(spark):
    texts = ["a\nb\nc\nd\ne", "x\na\nb\nc\nd\ny", "a\nb", None, "", "\n\n\n\n", "\n\n\n\n", "q\nr\ns\nq\nr\ns"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "x\ny", 2: "a\nb", 3: None, 4: "", 5: texts[5], 6: texts[6], 7: "q\nr\ns"}


def test_warc_round_trip(spark):
    page = '<html lang="EN"><head><title>A &amp; B</title><script>x()</script></head><body><p>One<br>two <b>three</b></p><a href="/x?a=1&amp;b=2">l</a><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "http://e/1", page), (2, "http://e/2\r\nWARC-Type: evil", None), (3, None, "")], "page_id long, url string, html string")
    recs = warc.responses(pages)
    out = {r["key"]: r for r in warc.derivatives(recs).collect()}
    source = {r["key"]: warc.parse(bytes(r["response"])) for r in recs.collect()}
    for k, r in out.items():
        c, text = warc.parse(bytes(r["conversion"]))
        m, facts = warc.parse(bytes(r["metadata"]))
        s, block = source[k]
        assert c["warc-refers-to"] == m["warc-refers-to"] == s["warc-record-id"] == r["refers_to"] and c["warc-target-uri"] == s["warc-target-uri"] and c["warc-date"] == s["warc-date"]
        assert c["warc-block-digest"] == warc.digest(text) and text.decode() == r["text"] and s["warc-block-digest"] == warc.digest(block)
        assert s["warc-block-digest"].encode() in facts and b"source-http-content-type" in facts and m["warc-concurrent-to"] == c["warc-record-id"]
    assert out[1]["text"] == "A & B\nOne\ntwo three\nl" and out[1]["title"] == "A & B" and out[1]["lang"] == "en" and out[1]["n_links"] == 1
    assert source[2][0]["warc-type"] == "response"
    bad = spark.createDataFrame([(1, b"junk"), (2, None), (3, b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx")], "key long, response binary")
    assert all(r["error"] and r["conversion"] is None for r in warc.derivatives(bad).collect())


def test_warc_files(spark):
    """Files of several records of several types and header styles, plain and gzipped by record, and broken ones."""
    page = b"<html><title>A</title><script>open <p>x"
    block = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\nX-Long: a\r\n\r\n<title>T</title>hello" + page
    fields = [("WARC-Target-URI", "http://e/"), ("WARC-Date", "2025-01-02T03:04:05Z"), ("WARC-IP-Address", "192.0.2.1")]
    one = warc.record("response", "<urn:uuid:1>", fields, block)
    folded = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Target-URI:\thttp://e/2\r\nX-Folded: a\r\n\tb\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    others = [warc.record("warcinfo", "<urn:uuid:0>", [], b"software: x\r\n"), warc.record("request", "<urn:uuid:9>", fields, b"GET / HTTP/1.1\r\n\r\n")]
    records = [others[0], one, others[1], folded]
    files = [b"".join(records), b"".join(map(gzip.compress, records)), one + b"junk", gzip.compress(one)[:-9], b"", None]
    d = spark.createDataFrame(list(enumerate(files)), "key long, content binary")
    rows = warc.read_records(d).collect()
    got = [(r["key"], r["n"], warc.parse(bytes(r["response"]))[0]["warc-record-id"]) for r in rows if r["error"] is None]
    assert sorted(got) == [(0, 1, "<urn:uuid:1>"), (0, 3, "<urn:uuid:2>"), (1, 1, "<urn:uuid:1>"), (1, 3, "<urn:uuid:2>"), (2, 0, "<urn:uuid:1>")]
    assert sorted(r["key"] for r in rows if r["error"]) == [2, 3, 5]
    out = warc.derivatives(warc.read_records(d).where("error IS NULL")).collect()
    assert all(r["error"] is None and r["text"] == "T\nhello\nA" and r["title"] == "T" for r in out)
    facts = {r["refers_to"]: warc.parse(bytes(r["metadata"]))[1] for r in out}
    assert b"source-http-x-long: a" in facts["<urn:uuid:1>"] and {r["target_uri"] for r in out} == {"http://e/", "http://e/2"}
    assert warc.visible_text("<script>" * 50_000) == ""


def test_warc_file_cut_in_its_last_bytes():
    """The checksum is missing: no record of that member counts, whatever the zlib at hand has given out by then."""
    one = warc.record("response", "<urn:uuid:1>", [], b"HTTP/1.1 200 OK\r\n\r\nx")
    for cut in (1, 4, 8, 9):
        got = warc.split(gzip.compress(one) + gzip.compress(one)[:-cut])
        assert next(got)[1] == one.rstrip()
        with pytest.raises(ValueError, match="ends early"):
            next(got)


def brute_suffix(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "block"), [(20_000, 65_536), (1, 65_536), (20_000, 40)])
def test_suffix_dedup(spark, table, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_SORTED", block)
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdé ") for _ in range(260))
    texts = [t for _, t in table][:80] + [None, "", "a" * 500, "ab" * 300, passage[:199], passage[10:240] + "!"]
    texts += ["".join(rnd.choice("xyz") for _ in range(50)) + passage[a : a + 210] for a in (0, 5, 20, 40, 50)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(frame(spark, texts), hot_group=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_suffix([(t or "").encode() for t in texts], 200)


def test_suffix_ranks_are_verified(monkeypatch):
    """Windows are found as by brute force, also where every rank collides."""
    rnd = random.Random(2)
    base = bytes(rnd.choice(b"ab") for _ in range(32))
    contexts = []
    for n in range(30):
        x = bytearray(base)
        x[rnd.randrange(32)] = ord("c")
        left = rnd.choice((12, 12, 5))
        contexts.append((n % 3, 7, left, bytes(x[12 - left :])))
    at = lambda c, s: c[3][s - 12 + c[2] : s - 12 + c[2] + 20] if s - 12 + c[2] >= 0 else b""
    want = [[len(at(c, s)) == 20 and any(d is not c and d[0] == c[0] and at(d, s) == at(c, s) for d in contexts) for s in range(13)] for c in contexts]
    assert suffix_dedup.repeated_windows(contexts, 20, 8).tolist() == want and any(map(any, want))
    monkeypatch.setattr(suffix_dedup, "pair", lambda a, b: (a + b) * 0)
    assert suffix_dedup.repeated_windows(contexts, 20, 8).tolist() == want


def test_cotraining_held_out(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        w = ["".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
        bad = i % 5 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w).capitalize() + ".", "en", "s", 9))
        if i < 300:
            labels.append((i, 0 if bad else 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in cotraining.classify(d, cotraining.fit(d, lab)).collect()}
    assert all(out[i]["kept"] == (i % 5 != 0) for i in range(300, 500))
    assert {r["score"] for r in cotraining.classify(d, cotraining.fit(d, lab.limit(0))).collect()} == {0.5}
    few = spark.createDataFrame([(i, int(i % 5 > 0)) for i in (0, 5, 1, 2, 3, 4)], "doc_id long, quality int")
    assert cotraining.fit(d, few).views is not None


def test_cotraining_exchange_helps(spark):
    """Each view alone knows part: labels that they give each other lower the held-out errors."""
    rnd = random.Random(4)
    rows, truth = [], {}
    for i in range(1200):
        bad = rnd.random() < 0.4
        n = rnd.randrange(20) + 20 * (bad if rnd.random() < 0.95 else not bad)  # a page's source mostly tells its class
        t = [f"{'x' if bad else 'y'}{rnd.randrange(300)}" if rnd.random() < 0.3 else f"z{rnd.randrange(200)}" for _ in range(25)]
        rows.append((i, " ".join(t), "en", f"s{n}", 100))
        truth[i] = int(not bad)
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([(i, truth[i]) for i in range(80)], "doc_id long, quality int")
    errors = []
    for rounds in (0, 4):
        m = cotraining.fit(d, lab, rounds=rounds)
        assert (m.given > 0) == (rounds > 0)
        errors.append(sum(r["kept"] != truth[r["doc_id"]] for r in cotraining.classify(d, m).where("doc_id >= 80").collect()))
    assert errors[1] < 0.8 * errors[0], errors


def test_cotraining_on_labels(spark):
    """Held-out labels of sf0.1: every fifth is not learned from."""
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet").where("quality IS NOT NULL")
    m = cotraining.fit(docs, labels.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 > 0"), rounds=1)
    held = labels.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0").select("doc_id", "quality")
    out = cotraining.classify(docs.join(held.select("doc_id"), "doc_id", "left_semi"), m).join(held, "doc_id").collect()
    bad, good = ([r["kept"] for r in out if r["quality"] == y] for y in (0, 1))
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.99 * len(good), (sum(bad), len(bad), sum(good), len(good))


ODD = [None, "", "a", "same text here " * 9, "same text here " * 9, "x y\n" * 30_000, "\n", "é" * 300]
RUNS = {
    "1": lambda d, b, lab: quality_rules.quality_rules(d),
    "2": lambda d, b, lab: license_scan.license_scan(d),
    "3": lambda d, b, lab: toxicity.toxicity(d, toxicity.fit(d, lab)),
    "4": lambda d, b, lab: decontamination.without_leaks(d, b),
    "5": lambda d, b, lab: near_dedup.near_components(d),
    "6": lambda d, b, lab: mixing.place(d),
    "7": lambda d, b, lab: cotraining.accepted(d, cotraining.fit(d, lab)),
    "8": lambda d, b, lab: line_dedup.line_dedup(d),
    "9": lambda d, b, lab: warc.derivatives(warc.responses(d, "doc_id", "source", "text")),
    "10": lambda d, b, lab: suffix_dedup.suffix_dedup(d),
}


@pytest.mark.parametrize("n", RUNS)
def test_odd_rows(spark, n):
    """Nulls in any column, empty and long texts, repeated rows, no rows, and columns that clash with inner names."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None) for i, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (None, "no id", "en", "s", 5), (3, "another text, same id", None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    for c in ("n_words", "kept", "w", "h", "pos", "node", "n", "key", "size", "target", "score", "starts", "y", "i"):
        d = d.withColumn(c, F.lit("clash"))
    b = spark.createDataFrame([(1, None), (None, "a b c d e f")], "item_id long, text string")
    lab = spark.createDataFrame([(0, None, None), (1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert RUNS[n](d, b, lab).count() == len(rows)
    assert RUNS[n](d.limit(0), b.limit(0), lab.limit(0)).count() == 0


def test_pipeline_stages(spark, table):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = read("documents").persist()
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).persist()
        texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "quality classifier":
            bad = {r["doc_id"] for r in read("labels").where("quality = 0").collect()}
            good = {r["doc_id"] for r in read("labels").where("quality = 1").collect()}
            kept = ids(out)
            assert len(kept & good) >= 0.97 * len(good) and len(kept & bad) <= 0.3 * max(1, len(bad))
        if name == "line dedup":
            seen, want = set(), {}
            for i, t in sorted(texts):
                ls = (t or "").split("\n")
                gone = set()
                for p in range(len(ls) - 2):
                    w = tuple(ls[p : p + 3])
                    if "".join(w).strip(" \t\n\x0b\x0c\r"):
                        if w in seen:
                            gone |= {p, p + 1, p + 2}
                        seen.add(w)
                want[i] = "\n".join(x for p, x in enumerate(ls) if p not in gone)
            assert {r["doc_id"]: r["text"] for r in out.collect()} == want
        if name == "near dedup":
            assert ids(out) == {i for i, (_, c) in jaccard_components(texts, 5).items() if i == c}
        if name == "decontamination":
            items = [decontamination.plain_words(r["text"].encode()) for r in read("benchmark").collect()]
            leaky = {i for i, t in texts if any(edit(w, decontamination.plain_words((t or "").encode())) <= len(w) // 10 for w in items if set(w[:9]) & set(decontamination.plain_words((t or "").encode())) or set(w[-9:]) & set(decontamination.plain_words((t or "").encode())))} if len(texts) * len(items) < 20_000 else None
            if leaky is not None:
                assert ids(out) == ids(docs) - leaky
        if name == "mixing":
            assert ids(out) == ids(docs) and out.where("taken > 3 * size").count() == 0
        docs = out


def test_warc_encodings():
    page = b"<html><title>T</title><p>hello there</p></html>"
    raw = zlib.compressobj(wbits=-15)
    chunked = lambda b: b"5;x=1\r\n" + b[:5] + b"\r\n" + f"{len(b) - 5:X}".encode() + b"\r\n" + b[5:] + b"\r\n0\r\n\r\n"

    def derive(head, body):
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
        return warc.derive(warc.record("response", "<urn:x>", [], block))[2]["text"]

    zipped = gzip.compress(page)
    for head, body in [
        (b"Transfer-Encoding: chunked", chunked(page)),
        (b"Content-Encoding: gzip", zipped),
        (b"content-encoding: deflate", zlib.compress(page)),
        (b"Content-Encoding: deflate", raw.compress(page) + raw.flush()),
        (b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked(zipped)),
    ]:
        assert derive(head, body) == "T\nhello there", head
    for head, body in [(b"Content-Encoding: br", page), (b"Content-Encoding: gzip", zipped[:-9]), (b"Transfer-Encoding: chunked", page)]:
        with pytest.raises(ValueError):
            derive(head, body)
