"""Quality classifier by co-training two views of a page.

The content view sees the text only: hashed words and word shapes, and its measurements. The metadata view sees only what is known of the
page without its text: columns such as language, source and size. Each is a logistic regression, calibrated on
labelled texts that neither learned from. Over a few rounds both views score every unlabelled document of the table,
and each gives the other the documents that it is surest of, in the proportion of the classes and as many as a share
of the labelled rows, as labels to learn from. The sum of the calibrated log odds scores every document; a view that
can't tell the classes apart is calibrated to odds of nearly nothing, gives no labels and has no say.

Scale: at most `max_labelled` labelled rows are learned from, the first of each class by digest of their id (a
parameter). All else covers the whole table: one streaming pass writes each document's features (at most DIM hashed
counts, so that what reaches the driver is bounded for texts of any length), every round streams through them and
keeps a bounded number of the surest, and a last pass scores all whole texts. No text is shuffled.

Defined results: null texts count as empty; without labels of both classes every score is 0.5 and nothing is
rejected; null labels are not used; rows without id are scored, but not learned from; repeated rows each get the same
row; an empty table gives an empty result; other columns are ignored (a null in a metadata column is a value of its
own).
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, saved
from .per_document import map_documents

MAX_LABELLED = 2000
ROUNDS = 4
SHARE = 5  # a view gives up to a SHARE-th of the rows learned from in each round
SURE = 2.0  # least calibrated log odds of a label that a view gives
DIM, META_DIM = 1 << 12, 1 << 9
MEASURE = 0.3  # weight of a measurement beside the words' vector of unit length
STEPS = 8  # a measurement falls into one of STEPS steps
REJECT_BELOW = 0.5
METADATA = ("lang", "source", "n_chars")
#: Capitals, other letters (and bytes of non-ASCII characters) and digits become A, a and 0, blanks one blank.
_CLASS = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256)], np.uint8)
_ONE_OF_RUN = np.isin(np.arange(256), [65, 97, 48, 32])
_RANDOM = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 256, dtype=np.uint64)
#: Letters count the same in both cases.
_FOLDED = _RANDOM[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 16
_UP = np.cumprod(np.full(SEGMENT, _BASE, np.uint64))
_DOWN = np.cumprod(np.full(SEGMENT, pow(_BASE, -1, 1 << 64), np.uint64))


def word_features(raw: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A number under DIM for each run of bytes that aren't blank: polynomial hashes, as differences of prefix sums."""
    blank = np.concatenate(([True], _CLASS[raw] == 32, [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[raw] * _UP[: len(raw)])))
    h = (sums[end] - sums[start]) * _DOWN[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - DIM.bit_length() + 1)).astype(np.int64)


def segments(text: bytes):
    """Parts of at most SEGMENT bytes, cut at blanks where there are any."""
    at = 0
    while at < len(text):
        end = at + SEGMENT
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


def measured(text: bytes, n_words: int) -> list[int]:
    """Steps of the text's measurements: shares of symbols, bars, exclamation marks, capitals and digits, of lines that
    occurred before and of lines with an end mark, length of words."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    words, n, n_lines = max(1, n_words), max(1, len(text)), max(1, len(lines))
    left = lambda chars: len(text) - len(text.translate(None, chars))
    shares = (
        left(b"#*$%&<>") / words,
        text.count(b"|") / words,
        text.count(b"!") / words,
        2 * left(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
        2 * left(b"0123456789") / n,
        1 - len(set(lines)) / n_lines,
        sum(x.rstrip().endswith((b".", b"!", b"?", b":", b";")) for x in lines) / n_lines,
        n / words / 20,
    )
    # steps are finer for small shares
    return [DIM + i * STEPS + min(STEPS - 1, int(STEPS * x**0.5)) for i, x in enumerate(shares)]


def content_view(text: bytes) -> bytes:
    """Features of a text (two bytes each), then their counts up to 255 (one byte each): words and their shapes
    (capitals, letters, digits and marks, runs as one) hashed to DIM numbers, and its measurements."""
    counts = np.zeros(DIM + 8 * STEPS, np.int64)
    n_words = 0
    for part in segments(text):
        raw = np.frombuffer(part, np.uint8)
        shape = _CLASS[raw]
        shape = shape[np.concatenate(([True], (shape[1:] != shape[:-1]) | ~_ONE_OF_RUN[shape[1:]]))]
        words = word_features(raw, _FOLDED)
        n_words += len(words)
        counts += np.bincount(np.concatenate((words, word_features(shape, _RANDOM))), minlength=len(counts))
    counts[measured(text, n_words)] = 1
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + np.minimum(counts[at], 255).astype(np.uint8).tobytes()


def unpacked(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features, and log counts of unit length for words and shapes, MEASURE for measurements."""
    n = len(content) // 3
    at = np.frombuffer(content, np.uint16, n).astype(np.int64)
    v = 1 + np.log(np.frombuffer(content, np.uint8, n, 2 * n).astype(np.float64))
    v[at >= DIM] = 0
    v /= np.sqrt(v @ v) or 1
    v[at >= DIM] = MEASURE
    return at, v


def metadata_view(values: tuple) -> tuple[np.ndarray, np.ndarray]:
    """One feature for each column: its value, or the half power of two that a number lies in."""
    kinds = [f"{round(2 * np.log2(1 + max(0, v)))}" if isinstance(v, (int, float)) else f"{v}" for v in values]
    return np.array([zlib.crc32(f"{i} {k}".encode("utf-8", "replace")) % META_DIM for i, k in enumerate(kinds)], np.int64), np.ones(len(kinds))


class View:
    """Logistic regression on sparse rows, fitted by full-batch gradient steps with momentum."""

    def __init__(self, dim: int):
        self.w = np.zeros(dim)
        self.b = 0.0
        self.scale, self.shift = 1.0, 0.0

    def raw(self, row: tuple[np.ndarray, np.ndarray]) -> float:
        return float(self.w[row[0]] @ row[1]) + self.b

    def fit(self, rows: list, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 300, rate: float = 4.0) -> None:
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        self.w[:] = 0
        self.b = 0.0
        vw, vb, weight = np.zeros_like(self.w), 0.0, weight / weight.sum()
        for _ in range(steps):
            z = np.bincount(owner, x * self.w[at], len(rows)) + self.b
            g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
            vw = 0.9 * vw - rate * (np.bincount(at, x * g[owner], len(self.w)) + ridge * self.w)
            vb = 0.9 * vb - rate * g.sum() * 0.2
            self.w = np.clip(self.w + vw, -60, 60)
            self.b = float(np.clip(self.b + vb, -60, 60))

    def calibrate(self, rows: list, y: np.ndarray, weight: np.ndarray) -> None:
        """Scale and shift of the log odds by Newton steps; a ridge pulls a view that can't tell to a scale of 0."""
        z = np.clip([self.raw(r) for r in rows], -30, 30)
        weight = weight / weight.sum() * len(y)
        a, c = 0.5, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
            g, h = weight * (p - y), weight * p * (1 - p)
            grad = np.array([(g * z).sum() + 0.5 * a, g.sum() + 0.5 * c])
            step = np.linalg.solve(np.array([[(h * z * z).sum() + 0.5, (h * z).sum()], [(h * z).sum(), h.sum() + 0.5]]), grad)
            a, c = max(0.0, a - np.clip(step[0], -1, 1)), c - np.clip(step[1], -1, 1)
        self.scale, self.shift = float(a), float(c)

    def odds(self, row) -> float:
        return float(np.clip(self.scale * self.raw(row) + self.shift, -8, 8))


class Model:
    def __init__(self, views: list[View] | None, prior: float = 0.0, given: int = 0):
        """prior: log odds of the classes, which both views' odds hold; given: labels that the views gave each other."""
        self.views, self.prior, self.given = views, prior, given

    def score(self, text: bytes, metadata: tuple) -> float:
        if self.views is None:
            return 0.5
        z = self.views[0].odds(unpacked(content_view(text))) + self.views[1].odds(metadata_view(metadata)) - self.prior
        return float(1 / (1 + np.exp(-z)))


def balanced(y: np.ndarray) -> np.ndarray:
    """Both classes together weigh half each."""
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))


def both(content: bytes, metadata: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    return [unpacked(content), metadata_view(metadata)]


def learned(learn: list[list[tuple]], check: list[tuple], share: dict[int, int]) -> list[View]:
    """A fitted and calibrated view of each kind. learn: of each view its rows (features, label); check: (features of
    both views, label); share: labelled rows of each class, which its calibration rows stand for."""
    views = [View(DIM + 8 * STEPS), View(META_DIM)]
    for v, view in enumerate(views):
        y = np.array([c for _, c in learn[v]], float)
        view.fit([r for r, _ in learn[v]], y, balanced(y))
        y = np.array([c for _, c in check], float)
        view.calibrate([r[v] for r, _ in check], y, np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum()))
    return views


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = METADATA, label_col: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    lab = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)").groupBy("i").agg(F.min("y").alias("y"))
    order = F.md5(F.col("i").cast("string"))
    half = max_labelled // 2
    share = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    picked = saved(lab.where("y = 0").orderBy(order, "i").limit(half).unionByName(lab.where("y = 1").orderBy(order, "i").limit(half)), "quality-labels")
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), *[F.col(c).alias(f"m{n}") for n, c in enumerate(meta_cols)]).where("i IS NOT NULL")
    meta = [f"m{n}" for n in range(len(meta_cols))]
    kinds = ", ".join(f"{m} {d.schema[m].dataType.simpleString()}" for m in meta)
    one = lambda i, t, *m: (i, content_view(t or b""), *m)
    table = saved(map_documents(d, {"i": "value", "t": "text", **dict.fromkeys(meta, "value")}, one, f"i long, x binary, {kinds}"), "quality-features")
    try:
        return cotrain(table, meta, picked, share, rounds)
    finally:
        discard(table, picked)


def rows_of(table: DataFrame, meta: list[str], wanted: DataFrame) -> list[tuple]:
    """(id, label, features of both views) of the rows of table named in wanted (bounded: i, y)."""
    found = table.join(F.broadcast(wanted), "i").groupBy("i", "y").agg(F.max(F.struct("x", *meta)).alias("r")).collect()
    found.sort(key=lambda r: (zlib.crc32(str(r["i"]).encode()), r["i"]))
    return [(r["i"], r["y"], both(bytes(r["r"]["x"]), tuple(r["r"][m] for m in meta))) for r in found]


def cotrain(table: DataFrame, meta: list[str], picked: DataFrame, share: dict[int, int], rounds: int) -> Model:
    labelled = rows_of(table, meta, picked)  # at most max_labelled rows
    classes = [[(x, y) for _, y, x in labelled if y == c] for c in (0, 1)]
    if min(map(len, classes)) < 2:
        return Model(None)
    # every fourth row of each class only calibrates
    check = [r for part in classes for r in part[::4]]
    rest = [r for part in classes for n, r in enumerate(part) if n % 4]
    learn = [[(x[v], y) for x, y in rest] for v in (0, 1)]
    good = sum(y for _, y in rest) / len(rest)
    take = max(4, len(rest) // SHARE)
    n_good = min(take - 1, max(1, round(take * good)))
    pool = table.join(F.broadcast(picked.select("i")), "i", "left_anti")
    taken: set[int] = set()
    views = learned(learn, check, share)
    for _ in range(rounds):
        shared = table.sparkSession.sparkContext.broadcast(views)

        def score(batches):
            for b in batches:
                i, x, *m = (c.to_pylist() for c in b.columns)
                z = [[v.odds(r) for v, r in zip(shared.value, both(c, values), strict=True)] for c, values in zip(x, zip(*m, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), *(pa.array([r[v] for r in z], pa.float64()) for v in (0, 1))], names=["i", "z0", "z1"])

        scored = saved(pool.select("i", "x", *meta).mapInArrow(score, "i long, z0 double, z1 double"), "quality-scores")
        free = scored.where(~F.col("i").isin(sorted(taken))) if taken else scored
        sure = []
        for v in (0, 1):
            for y, n in ((0, take - n_good), (1, n_good)):
                z = F.col(f"z{v}") * (2 * y - 1)
                top = free.where(z >= SURE).groupBy("i").agg(F.min(z).alias("z")).orderBy(F.desc("z"), "i").limit(n)
                sure.append(top.select("i", F.lit(y).alias("y"), F.lit(v).alias("v")))
        given = reduce(DataFrame.unionByName, sure).collect()  # at most twice `take` rows
        discard(scored)
        label = {r["i"]: (r["y"], r["v"]) for r in reversed(given)}  # a document that both name is the content view's
        if not label:
            break
        taken.update(label)
        ids = table.sparkSession.createDataFrame([(i, y) for i, (y, _) in label.items()], "i long, y int")
        for i, y, x in rows_of(table, meta, ids):
            other = 1 - label[i][1]
            learn[other].append((x[other], y))
        views = learned(learn, check, share)
    return Model(views, float(np.log(share[1] / share[0])), len(taken))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = METADATA, reject_below: float = REJECT_BELOW) -> DataFrame:
    """Per row: doc_id, _h (hash of the text), score (probability of being good), kept."""

    def one(doc_id, h, text, *metadata):
        score = model.score(text or b"", metadata)
        return doc_id, h, score, score >= reject_below

    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"), *[F.col(c).alias(f"m{n}") for n, c in enumerate(meta_cols)])
    return map_documents(d, dict.fromkeys(d.columns, "value") | {"t": "text"}, one, "doc_id long, _h long, score double, kept boolean")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, fit(docs, read(spark, sf_dir, "labels"))).drop("_h")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", meta_cols: tuple[str, ...] = METADATA, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of docs, all columns, that the classifier doesn't reject; texts are not shuffled."""

    def run(batches):
        for b in batches:
            texts, *metadata = (b.column(b.schema.get_field_index(c)) for c in (text_col, *meta_cols))
            keep = [model.score((t.as_py() or "").encode(), tuple(x.as_py() for x in m)) >= reject_below for t, *m in zip(texts, *metadata, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
