r"""MinHash near-dedup with SetSketch registers.

A text is the set of its distinct k-word shingles (A-Z lower-cased, words between ASCII white space; fewer than k
words make one shingle, none make the empty set). Two texts are linked when their Jaccard similarity reaches a
threshold, and near copies are the connected components.

1. Sketch: SIGNATURE registers hold exponentially spaced, truncated minima (base 1.001, 16 bits). Equal sets have equal
   sketches and sketches merge by maximum, so texts with equal sets collapse into one node, named by its least doc_id.
2. Bands of ROWS registers are locality-sensitive keys. At similarity 0.8 a pair misses all BANDS bands with a chance
   of (1 - 0.8 ** 6) ** 42 < 3e-6, less for closer pairs.
3. Every node is paired with the least node of each of its buckets: a star, not all pairs. The joint likelihood of
   both sketches and set sizes estimates the similarity; pairs that could reach the threshold are verified on the full
   shingle sets. Components of the verified links follow.
4. Exact rest: nodes of buckets that still hold several components are joined by an exact prefix filter: a pair that
   reaches the threshold shares one of its rarest shingles, as many as both set sizes call for. Pairs of different
   components that do are estimated and verified likewise. Pairs within a component need no test, as they cannot
   change it; so no bucket is capped.

Scale: texts are read twice (sketches; sets of candidate nodes only) and shuffled once, by doc_id, for candidates.
Hot groups of copies are one node after map-side aggregation, hot buckets are stars. All tables between steps are
written to the shared folder.

Defined results: null and empty texts have the empty set and are linked with nothing; rows without doc_id cannot be
named, get component_id null and are kept; repeated rows share node and component; an empty table gives an empty
result; other columns are ignored; very long texts are sketched whole in slices.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, release, saved
from .components import components
from .per_document import map_documents

BANDS, ROWS = 42, 6
SIGNATURE = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
SIGMAS = 5.0
_LN_BASE = math.log(BASE)
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Hashes(dict):
    """64-bit hash of a word, remembered; emptied when large, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    words = (raw or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    x = np.full(n, min(k, len(h)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(h))):
            x = mix(x * _C[0] + h[i : i + n])
    return np.unique(x)


def sketch(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set: floor(1 - log_base(least exponential variate)), truncated to 16 bits."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    most = np.zeros(SIGNATURE, np.uint32)
    for at in range(0, len(low), 1024):
        np.maximum(most, (low[at : at + 1024, None] * _A + _B).max(axis=0), out=most)
    least = -np.log1p(-(2.0**32 - most - 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / _LN_BASE), 0, TOP).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows), given both set sizes, by golden-section search."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LN_BASE

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (math.sqrt(5) - 1) / 2
    for _ in range(30):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        better = likelihood(x) >= likelihood(y)
        hi, lo = np.where(better, y, hi), np.where(better, lo, x)
    return (lo + hi) / 2


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), set_key (128-bit hash of the whole set), registers (binary); null key for empty sets."""

    def one(doc_id, raw):
        s = shingles(raw, k)
        if not len(s):
            return doc_id, 0, None, None
        return doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(s).tobytes()

    return map_documents(docs, {id_col: "value", text_col: "text"}, one, "doc_id long, n long, set_key binary, registers binary")


def could_link(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y) of nodes whose estimated similarity is within sampling error of the threshold or above."""
    side = lambda p: nodes.select(F.col("node").alias(p), F.col("n").alias(f"n{p}"), F.col("registers").alias(f"r{p}"))
    d = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "rx", "ry")
    floor = threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / SIGNATURE)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                regs = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, SIGNATURE) for i in (4, 5)]
                na, nb = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
                keep = estimate(*regs, na, nb) >= floor
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array(keep))

    return d.where((F.col("nx") >= threshold * F.col("ny")) & (F.col("ny") >= threshold * F.col("nx"))).mapInArrow(run, "x long, y long")


def full_sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """node, s: the sorted shingle hashes (binary) of the nodes in wanted."""
    keys = nodes.join(wanted, "node", "left_semi").select("node", "set_key")
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("t")).join(keys, "node")

    def one(node, key, raw):
        s = shingles(raw, k)
        if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != bytes(key):
            return None  # another text under the same doc_id
        return node, s.tobytes()

    return saved(map_documents(texts, {"node": "value", "set_key": "value", "t": "text"}, one, "node long, s binary").dropDuplicates(["node"]), "near-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose full shingle sets reach the similarity, by 100 * intersection >= percent * union."""
    side = lambda p: sets.select(F.col("node").alias(p), F.col("s").alias(f"s{p}"))
    d = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "sx", "sy")

    def run(batches):
        for b in batches:
            keep = []
            for sx, sy in zip(b.column(2), b.column(3), strict=True):
                a, c = np.frombuffer(sx.as_buffer(), np.uint64), np.frombuffer(sy.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, c, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(c) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return saved(d.mapInArrow(run, "x long, y long"), "near-links")


def size_classes() -> np.ndarray:
    """Least set size of each class; classes grow by 2 percent, so that sizes of one class need much the same overlap."""
    return np.unique(np.ceil(1.02 ** np.arange(0, 1800)).astype(np.int64))


def prefix_keys(n: int, hashes: np.ndarray, unshared: int, percent: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (and whether as the smaller set of a pair) under which a set of n shingles can meet partners.

    hashes: its shingles that other sets have as well, rarest first, after `unshared` ones that none has. Sets of sizes
    n and m reach the similarity only with an overlap of percent * (n + m) / (100 + percent), and then the first
    n - overlap + 1 and m - overlap + 1 of their shingles have one in common. A key is a shingle and both size classes.
    """
    of = lambda x: int(np.searchsorted(least, x, "right")) - 1
    own = of(n)
    found: list[np.ndarray] = []
    small: list[bool] = []

    def emit(partner: int, a: int, b: int, is_small: bool) -> None:
        overlap = -(-percent * (n + partner) // (100 + percent))
        front = hashes[: max(0, n - overlap + 1 - unshared)]
        with np.errstate(over="ignore"):
            found.append(mix(front * _C[0] + np.uint64(a << 20 | b)))
        small.extend([is_small] * len(front))

    for k in range(own, of(n * 100 // percent) + 1):
        emit(max(n, int(least[k])), own, k, True)
    low = -(-percent * n // 100)
    for k in range(of(low), own + 1):
        emit(max(low, int(least[k])), k, own, False)
    return np.concatenate(found), np.array(small, bool)


def prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rest: node, comp, n -> pairs (x, y) of nodes of different components, every pair among them that reaches the
    similarity: an exact prefix filter over the shingles, rarest first, with the overlap that both sizes call for."""
    least = size_classes()

    def explode(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                parts = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
                owner = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in parts])
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(parts))], names=["node", "h"])

    def keys(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                out: list[list] = [[], [], [], []]
                for node, comp, n, hs in zip(*whole.slice(at, 64).columns, strict=True):
                    h = hs.values.field("h").to_numpy(zero_copy_only=False).view(np.uint64)
                    k, small = prefix_keys(n.as_py(), h, n.as_py() - len(h), percent, least)
                    for col, x in zip(out, (k.view(np.int64), small, np.full(len(k), node.as_py()), np.full(len(k), comp.as_py())), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "small", "node", "comp"])

    rows = sets.join(rest.select("node"), "node", "left_semi").select("node", "s").mapInArrow(explode, "node long, h long")
    common = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    front = rows.join(common, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("hs"))
    keyed = saved(front.join(rest, "node").select("node", "comp", "n", "hs").mapInArrow(keys, "key long, small boolean, node long, comp long"), "near-prefixes")
    # of the largest component under a key only pairs with others matter
    counts = keyed.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
    main = counts.agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("key", "main")
    live = saved(keyed.join(main, "key").select("key", "small", "node", "comp", (F.col("comp") == F.col("main")).alias("inside")), "near-prefixes")
    side = lambda rows, p: rows.select("key", F.col("node").alias(p), F.col("comp").alias("c" + p))
    apart = F.col("cp") != F.col("cq")
    one = side(live.where("small AND NOT inside"), "p").join(side(live.where("NOT small"), "q"), "key").where(apart)
    two = side(live.where("small AND inside"), "p").join(side(live.where("NOT small AND NOT inside"), "q"), "key").where(apart)
    found = saved(one.unionByName(two).select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "near-pairs")
    discard(keyed, live)
    return found


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable), kept (it is that document), set_key."""
    spark = docs.sparkSession
    sig = saved(signatures(docs, k, id_col, text_col), "near-signatures")
    named = sig.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    nodes = saved(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("registers").alias("registers")), "near-nodes")
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("registers", b * width + 1, width)) for b in range(BANDS)])
    rows = nodes.select("node", F.explode(keys).alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("c")).where("c > 1").select("key", "rep")
    buckets = saved(rows.join(shared, "key"), "near-buckets")
    release(spark)
    star = buckets.where("node != rep").select(F.col("rep").alias("x"), F.col("node").alias("y")).distinct()
    sets = full_sets(buckets.select("node").distinct(), docs, nodes, k, id_col, text_col)
    links = verified(saved(could_link(star, nodes, percent / 100), "near-pairs"), sets, percent)
    comp = components(links)
    release(spark)

    labelled = buckets.join(comp, "node", "left").select("key", "node", "rep", F.coalesce("comp", "node").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("key")
    rest = saved(labelled.join(mixed, "key").select("node", "comp").distinct().join(nodes.select("node", "n"), "node"), "near-rest")
    more = prefix_pairs(rest, sets, percent)
    pairs = saved(could_link(more, nodes, percent / 100), "near-pairs")
    if pairs.limit(1).count():
        comp = components(links.unionByName(verified(pairs, sets, percent)))
    discard(buckets, rest, sets)
    release(spark)
    of = nodes.join(comp, "node", "left").select("set_key", F.coalesce("comp", "node").alias("component_id"))
    out = sig.drop("registers").join(of, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "set_key")


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stand for their group: those with its least doc_id (rows without id stay)."""
    gone = near_components(docs, k, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("__nd_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["__nd_id"], "left_anti").select(*docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents"), k=2).drop("set_key")
