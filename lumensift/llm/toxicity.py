"""Toxicity by nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Learning (labels only from rows whose crc32(doc_id) mod 5 is not 0; at most `max_examples` labelled rows of each
class, the first by digest of their id; equal texts of a class are one example): every word of every example, toxic
or not, is a term of the index. A term's weight in a text is (1 + log tf) * idf * factor: document frequencies come
from one aggregate over all documents, and the factor is PLAIN for every term plus how far the log odds of the classes
among the examples that hold it lie beyond CERTAIN standard errors. So no term is dropped, and the cosine between unit
vectors turns on what sets the classes apart.

Index: examples are numbered so that those with the same heaviest shared terms lie together, and cut into blocks of
BLOCK. A term has postings, and for each of its blocks the largest weight; the few terms that many examples hold have
a dense row of weights instead, multiplied for a batch of texts at a time. A block's largest dense sum and the largest
weights of a text's other terms bound every cosine in the block: the blocks of the highest bounds are scored first,
and then just those whose bound reaches the k-th best cosine found. The k nearest examples are exact.

Scoring: their votes, of either class, weighted by cosine and shrunk to the rate among texts without any term, pass
through a logistic calibration fitted on leave-one-out votes of the examples. The nearest examples are returned as
evidence. Terms that no example holds match nothing and are left out of a text's norm, in the leave-one-out votes as
well (there: terms that no other example holds).

Scale: the index is bounded by max_examples and the terms per example, and its size is checked before it is shipped;
frequencies and scores are one streaming pass over the texts each, and only sums by term are shuffled.

Defined results: null and empty texts have no terms and get the calibrated rate of texts without terms; labels that
are null are not examples; with no labelled row of either class every score is the prior (0.0 without labels);
repeated rows each get the same row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import discard, read, saved
from .per_document import as_batch, map_documents

MAX_EXAMPLES = 2500
NEIGHBOURS = 15
SHRINK = 0.2  # cosine mass that the rate among texts without terms counts as
PLAIN, CERTAIN = 0.05, 3.0
BLOCK = 128  # examples of a block
SEEDS = 2  # blocks scored before the k-th best cosine is known
FREQUENT, MAX_DENSE = 16, 512  # terms that over a FREQUENT-th of the examples hold have a dense row, MAX_DENSE at most
BATCH = 256  # texts scored at a time
MAX_INDEX_ENTRIES = 40_000_000
EPS = 1e-9
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> dict[str, int]:
    """Counts of the lower-cased words."""
    return Counter(_WORD.findall(text.lower()))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Vocabulary:
    """Numbers of terms; a text becomes the numbers and counts of its terms."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers

    def present(self, text: str | None) -> set[int]:
        found = set(map(self.numbers.get, _WORD.findall((text or "").lower())))
        found.discard(None)
        return found

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(map(self.numbers.get, _WORD.findall((text or "").lower())))
        counts.pop(None, None)
        return np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (counts[i] of them) of every i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Index:
    """Block-max inverted index of unit TF-IDF vectors."""

    def __init__(self, weights: dict[str, float], vectors: list, ids: list[int], labels: list[int], block: int = BLOCK):
        """vectors: of each example {term: weight}, or arrays (numbers of terms in the order of weights, weights)."""
        if sum(len(v) if isinstance(v, dict) else len(v[0]) for v in vectors) > MAX_INDEX_ENTRIES:
            raise ValueError("the index is over its size bound; lower max_examples")
        self.vocabulary = Vocabulary({t: n for n, t in enumerate(weights)})
        self.weights = np.fromiter(weights.values(), np.float64, len(weights))
        pairs = [self.numbered(v) if isinstance(v, dict) else v for v in vectors]
        held = np.bincount(np.concatenate([t for t, _ in pairs]), minlength=len(weights)) if pairs else np.zeros(len(weights), np.int64)
        order = self.together(pairs, held)
        pairs = [pairs[i] for i in order]
        self.ids, self.labels = [ids[i] for i in order], np.array([labels[i] for i in order], np.float64)
        example = np.repeat(np.arange(len(pairs), dtype=np.int32), [len(t) for t, _ in pairs])
        term = np.concatenate([t for t, _ in pairs]) if pairs else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in pairs]) if pairs else np.zeros(0)
        by_term = np.argsort(term, kind="stable")
        term, example, weight = term[by_term], example[by_term], weight[by_term]
        self.held, self.block, self.blocks = held, block, -(-len(pairs) // block)
        often = np.argsort(-held, kind="stable")[:MAX_DENSE]
        often = often[held[often] * FREQUENT > len(pairs)]
        self.row = np.full(len(weights), -1)
        self.row[often] = np.arange(len(often))
        in_row = self.row[term] >= 0
        self.dense = np.zeros((len(often), self.blocks * block))
        self.dense[self.row[term[in_row]], example[in_row]] = weight[in_row]
        term, self.example, self.weight = term[~in_row], example[~in_row], weight[~in_row]
        b = self.example // block
        # runs of postings of one term in one block
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        self.run_start, self.run_size = first, np.diff(np.append(first, len(term)))
        self.run_block = b[first]
        self.run_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.runs = np.bincount(term[first], minlength=len(weights))  # runs by term
        self.first_run = np.concatenate([[0], np.cumsum(self.runs)])

    @staticmethod
    def together(pairs: list, held: np.ndarray) -> list[int]:
        """Examples in the order of their heaviest terms that others hold as well."""

        def key(i):
            t, w = pairs[i]
            shared = held[t] > 1
            t, w = t[shared], w[shared]
            return [int(x) for x in t[np.lexsort((t, -w))][:4]], i

        return sorted(range(len(pairs)), key=key)

    def numbered(self, v: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        found = sorted((self.vocabulary.numbers[t], w) for t, w in v.items() if t in self.vocabulary.numbers)
        return np.array([t for t, _ in found], np.int64), np.array([w for _, w in found], np.float64)

    def weighted(self, counted: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of a text's terms and counts."""
        at, n = counted
        w = (1 + np.log(n)) * self.weights[at]
        norm = math.sqrt(float(w @ w))
        return (at, w / norm) if norm else (at[:0], w[:0])

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """Per query the k largest (cosine, example), ties to the lower example number; cosines over 0 only; never the
        query's example in `skip`."""
        common = np.zeros((len(queries), len(self.dense)))
        for q, (at, w) in enumerate(queries):
            r = self.row[at]
            common[q, r[r >= 0]] = w[r >= 0]
        sums = common @ self.dense
        rest = [(at[r < 0], w[r < 0]) for at, w in queries for r in [self.row[at]]]
        return [self._nearest(at, w, c, k, -1 if skip is None else skip[q]) for q, ((at, w), c) in enumerate(zip(rest, sums, strict=True))]

    def _nearest(self, at: np.ndarray, w: np.ndarray, c: np.ndarray, k: int, skip: int) -> list[tuple[float, int]]:
        """c: sums of the dense terms by example; the other terms' postings are added where the bounds call for it."""
        n = len(self.ids)
        if not n:
            return []
        runs = spread(self.first_run[at], self.runs[at])
        w = np.repeat(w, self.runs[at])
        in_block = self.run_block[runs]
        bound = c.reshape(self.blocks, self.block).max(axis=1) + np.bincount(in_block, self.run_max[runs] * w, self.blocks)
        found: list[np.ndarray] = []

        def score(chosen: np.ndarray) -> np.ndarray:
            """Examples of the chosen blocks and their cosines."""
            take = np.flatnonzero(chosen[in_block])
            these = runs[take]
            size = self.run_size[these]
            where = spread(self.run_start[these], size)
            sums = c + np.bincount(self.example[where], self.weight[where] * np.repeat(w[take], size), len(c))
            if skip >= 0:
                sums[skip] = 0
            which = (np.flatnonzero(chosen)[:, None] * self.block + np.arange(self.block)).ravel()
            found.append(np.stack([which, sums[which]]))
            return found[-1][1]

        seeds = np.zeros(self.blocks, bool)
        seeds[np.argsort(-bound, kind="stable")[:SEEDS]] = True
        first = score(seeds)
        least = np.partition(first, -k)[-k] if len(first) > k else 0.0
        more = ~seeds & (bound >= max(least - EPS, EPS))
        if more.any():
            score(more)
        which, cosine = np.concatenate(found, axis=1)
        likely = cosine >= max(least - EPS, EPS)
        which, cosine = which[likely].astype(np.int64), np.round(cosine[likely], 9)
        near = np.lexsort((which, -cosine))[:k]
        return [(float(cosine[i]), int(which[i])) for i in near]


class Model:
    def __init__(self, index: Index, base: float, k: int, slope: float = 1.0, offset: float = 0.0):
        self.index, self.base, self.k, self.slope, self.offset = index, base, k, slope, offset

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Cosine-weighted share of toxic neighbours, shrunk to the rate among texts without any term."""
        w = sum(c for c, _ in near)
        return (sum(c * self.index.labels[n] for c, n in near) + SHRINK * self.base) / (w + SHRINK)

    def calibrated(self, vote: float) -> float:
        p = min(max(vote, 1e-4), 1 - 1e-4)
        return 1 / (1 + math.exp(-(self.slope * math.log(p / (1 - p)) + self.offset)))

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        found = self.index.nearest([self.index.weighted(self.index.vocabulary.count(t)) for t in texts], self.k)
        return [(self.calibrated(self.vote(near)), near) for near in found]


def frequencies(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of rows of docs, and of those that hold each term of the vocabulary."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        v = shared.value
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                n.update(v.present(t.as_py()))
            n[len(v.numbers)] += b.num_rows  # the last number counts rows
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    sums = docs.select(F.col(text_col)).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(vocabulary.numbers) + 1, np.int64)
    n[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return int(n[-1]), n[:-1]


def held_terms(i, y, text):
    found = terms(text or "")
    return i, y, " ".join(found), list(found.values())


def factors(rows: list[tuple], n_terms: int) -> np.ndarray:
    """Of each term: PLAIN and the part of its log odds ratio between the classes beyond CERTAIN standard errors."""
    per_class = [np.zeros(n_terms), np.zeros(n_terms)]
    size = [0, 0]
    for _, y, at, _ in rows:
        per_class[y][at] += 1
        size[y] += 1
    (b, a), (nb, na) = per_class, size
    odds = np.log((a + 0.5) / (na - a + 0.5)) - np.log((b + 0.5) / (nb - b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (na - a + 0.5) + 1 / (b + 0.5) + 1 / (nb - b + 0.5))
    return PLAIN + np.maximum(0, np.abs(odds) - CERTAIN * error)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> Model:
    lab = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)")
    lab = lab.where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    share = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    if not share:
        return Model(Index({}, [], [], []), 0.0, k)
    order = F.md5(F.col("i").cast("string"))
    ids = lab.where("y = 1").orderBy(order, "i").limit(max_examples).unionByName(lab.where("y = 0").orderBy(order, "i").limit(max_examples))
    chosen = F.broadcast(ids)  # at most 2 * max_examples rows of an id and a label
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    texts = d.join(chosen, "i").groupBy("i", "y").agg(F.max("t").alias("t"))
    texts = saved(texts.groupBy("y", "t").agg(F.min("i").alias("i")), "tox-examples")
    counted = map_documents(texts, {"i": "value", "y": "value", "t": "value"}, held_terms, "i long, y int, terms string, counts array<int>").toArrow()  # bounded: 2 * max_examples rows
    discard(texts)
    numbers: dict[str, int] = {}
    rows = []
    for i, y, found, n in sorted(zip(*[counted[c].to_pylist() for c in ("i", "y", "terms", "counts")], strict=True), key=lambda r: hashlib.md5(str(r[0]).encode()).digest()):
        at = np.array([numbers.setdefault(t, len(numbers)) for t in found.split()], np.int64)
        by_number = np.argsort(at)
        rows.append((i, y, at[by_number], np.array(n, np.float64)[by_number]))
    del counted
    sizes = Counter(r[1] for r in rows)
    n_docs, df = frequencies(d, Vocabulary(numbers), "t")
    weights = dict(zip(numbers, (np.log(1 + n_docs / (1 + df)) * factors(rows, len(numbers))).tolist(), strict=True))
    known = [r for r in rows if len(r[2])]
    probe = Index(weights, [], [], [])
    index = Index(weights, [probe.weighted(r[2:]) for r in known], [r[0] for r in known], [r[1] for r in known])
    # each class counts as much as it does among all labelled rows
    weight = {y: share.get(y, 0) / max(1, sizes[y]) for y in (0, 1)}
    empty = {y: weight[y] * sum(1 for r in rows if r[1] == y and not len(r[2])) for y in (0, 1)}
    base = (empty[1] + 0.5 * weight[1]) / (empty[0] + empty[1] + weight[0] + weight[1]) if sum(empty.values()) else share.get(1, 0) / sum(share.values())
    model = Model(index, base, k)
    place = {i: n for n, i in enumerate(index.ids)}
    data = []
    for a in range(0, len(known), BATCH):
        part = known[a : a + BATCH]
        queries = [index.weighted((at[others], n[others])) for _, _, at, n in part for others in [index.held[at] > 1]]
        found = index.nearest(queries, k, [place[r[0]] for r in part])
        data += [(model.vote(near), r[1], weight[r[1]]) for r, near in zip(part, found, strict=True)]
    data += [(base, y, m) for y, m in empty.items()]
    model.slope, model.offset = platt(data)
    return model


def platt(data: list[tuple[float, int, float]], steps: int = 60) -> tuple[float, float]:
    """Slope (kept positive) and offset of a logistic curve over the votes' log odds, by ridge-damped Newton steps."""
    a, b = 1.0, 0.0
    xs = [(math.log(p / (1 - p)), y, w) for v, y, w in data for p in [min(max(v, 1e-4), 1 - 1e-4)]]
    total = sum(w for *_, w in xs)
    if not total or len({y for _, y, _ in xs}) < 2:
        return a, b
    for _ in range(steps):
        ga, gb, haa, hab, hbb = 1e-2 * (a - 1), 1e-2 * b, 1e-2, 0.0, 1e-2
        for x, y, w in xs:
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, a * x + b))))
            w = w / total * 100
            ga, gb, h = ga + w * (p - y) * x, gb + w * (p - y), w * p * (1 - p)
            haa, hab, hbb = haa + h * x * x, hab + h * x, hbb + h
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(0.05, a - max(-1.0, min(1.0, da))), b - max(-1.0, min(1.0, db))
        if abs(da) + abs(db) < 1e-7:
            break
    return a, b


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, evidence (nearest examples: doc_id, cosine, toxic)."""

    schema = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                ids, out, texts = (c.to_pylist() for c in batch.slice(at, BATCH).columns)
                rows = []
                for i, o, (score, near) in zip(ids, out, m.scores(texts), strict=True):
                    rows.append((i, o, score, int(score >= 0.5), [{"doc_id": m.index.ids[n], "cosine": c, "toxic": int(m.index.labels[n])} for c, n in near[:5]]))
                yield as_batch(rows, arrow)

    d = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("o"), F.col(text_col).alias("t"))
    return d.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, read(spark, sf_dir, "labels")))
