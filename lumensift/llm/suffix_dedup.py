r"""Suffix-array dedup: bytes covered by a LENGTH-byte string that starts anywhere else are removed.

Prefix doubling ranks the string of h bytes at each position by the pair (rank at i, rank at i + h/2), doubling h, and
drops positions whose rank is unique, until the threshold is past. Spark sorts and reranks here at a sparse set of
positions that is still exact, and equality is decided by 128-bit hashes of the bytes or by the bytes themselves:

* Anchors. Of any LENGTH - GRAM + 1 consecutive positions the one with the least rank at h = GRAM (the last on ties;
  ranks by doubling inside the document, which only choose positions) is an anchor. That depends on those LENGTH bytes
  only, so equal strings hold the same anchor at the same offset.
* Spark range-sorts the anchors by (rank at h = GRAM, rank of the context, position), where the context is all
  LENGTH-byte strings that hold the anchor, clipped to the document. In sorted order neighbours tell everything: an
  anchor whose rank at GRAM is unique is dropped, as no LENGTH-byte string around it repeats; a context that repeats is
  covered as a whole in every document that has it. A range sort splits groups of any size over tasks; what neighbours
  across a partition's border would tell is taken from its first and last row.
* h = LENGTH, only for contexts that are unique while their anchor's rank is not (the rims of repeats): each LENGTH-byte
  string in them is ranked by pairs at growing offsets and compared with those of the same anchor rank; equal ranks are
  verified on the bytes. Groups of over HOT_GROUP contexts are dealt out one row per string instead of meeting in one
  task, and compared by 128-bit hashes.

Runs of covered bytes are merged per document and the text rebuilt. Matches never cross documents.

Scale: about 2 / (LENGTH - GRAM + 2) of the positions are shuffled, not all; texts are shuffled twice, by document.

Defined results: a null text counts as empty; texts under LENGTH bytes lose nothing; rows with the same doc_id and
text each get the same result (and cover each other); null doc_id is a value like any other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, release, saved
from .per_document import SLICE, as_batch, map_documents, to_arrow_schema

LENGTH = 200
GRAM = 64
HOT_GROUP = 20_000
BLOCK_ROWS, BLOCK_SORTED = 4096, 65_536
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64)
_BYTE2 = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 256, dtype=np.uint64)
_LOW = np.uint64(0xFFFF)
_SEGMENT = 60_000


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of a pair of ranks."""
    x = a * _P
    x += b
    x ^= x >> np.uint64(32)
    x *= _Q
    x ^= x >> np.uint64(29)
    return x


def doubled(x: np.ndarray, h: int, to: int) -> np.ndarray:
    """From ranks of h bytes to ranks of `to` (a power of two times h) along the last axis."""
    while h < to:
        x = pair(x[..., :-h], x[..., h:])
        h *= 2
    return x


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Positions of the anchors of a text of at least `length` bytes."""
    w = length - gram + 1
    g = doubled(_BYTE[np.frombuffer(raw, np.uint8)], 1, gram)
    found = []
    for at in range(0, len(g) - w + 1, _SEGMENT):
        part = g[at : at + _SEGMENT + w - 1]
        m = (part & ~_LOW) | (_LOW - np.arange(len(part), dtype=np.uint64))
        s = 1
        while 2 * s <= w:
            m = np.minimum(m[:-s], m[s:])
            s *= 2
        if s < w:
            m = np.minimum(m[: len(m) - (w - s)], m[w - s :])
        p = (_LOW - (m & _LOW)).astype(np.int64)
        found.append(at + p[np.concatenate(([True], p[1:] != p[:-1]))])
    return np.unique(np.concatenate(found))


ANCHOR = "g long, g2 long, c long, c2 long, doc_id long, h int, pos int"


def anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Per anchor: 128-bit hashes (two longs each) of the gram and of the context, and its place."""
    side = length - gram
    name = xxhash.xxh3_128_digest

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                names, ids, hs, places = [], [], [], []
                for doc_id, h, raw in zip(*[c.to_pylist() for c in whole.slice(at, 64).columns], strict=True):
                    if raw is not None and len(raw) >= length:
                        p = anchors(raw, length, gram)
                        for x in p.tolist():
                            lo = max(0, x - side)
                            names.append(name(raw[x : x + gram]) + name(raw[lo : x + length], x - lo))  # the seed is the anchor's place in its context
                        ids.append(pa.array([doc_id] * len(p), pa.int64()))
                        hs.append(np.full(len(p), h, np.int32))
                        places.append(p.astype(np.int32))
                if names:
                    keys = np.frombuffer(b"".join(names), np.int64).reshape(-1, 4)
                    yield pa.RecordBatch.from_arrays([*[pa.array(keys[:, i].copy()) for i in range(4)], pa.concat_arrays(ids), pa.array(np.concatenate(hs)), pa.array(np.concatenate(places))], names=["g", "g2", "c", "c2", "doc_id", "h", "pos"])

    return docs.mapInArrow(run, ANCHOR)


SETTLED, OPEN, PARTNER = 1, 2, 4


def marks(g: np.ndarray, c: np.ndarray, first: bool, last: bool) -> np.ndarray:
    """Marks of sorted rows from where a new gram or context begins (arrays of bool); first, last: whether the first
    and the last group may go on elsewhere. Those are asked about in any case, so nothing is lost at a border."""
    starts = np.append(c | g, True)
    alone = starts[:-1] & starts[1:]
    group = np.cumsum(g) - 1
    asked = (np.bincount(group, starts[:-1]) > 1) & (np.bincount(group, alone) > 0)
    asked[0] |= first
    asked[-1] |= last
    asked = asked[group]
    out = np.where(alone, 0, SETTLED).astype(np.int8)
    out[alone & asked] = OPEN
    out[~alone & starts[:-1] & asked] |= PARTNER
    return out


def neighbours(rows: DataFrame) -> DataFrame:
    """Anchors in range-sorted order with a mark: SETTLED where the context repeats; OPEN where it doesn't though the
    gram does, in a group of several contexts; PARTNER besides on one row of each repeating context of such a group."""
    keys = ["g", "g2", "c", "c2", "doc_id", "h", "pos"]

    def differs(table: pa.Table, columns: range) -> np.ndarray:
        out = np.zeros(table.num_rows, bool)
        out[:1] = True
        for i in columns:
            x = table.column(i).to_numpy()
            out[1:] |= x[1:] != x[:-1]
        return out

    def run(batches):
        held, size, first = [], 0, True
        for b in chain(batches, [None]):
            if b is not None:
                held, size = [*held, b], size + b.num_rows
                if size < BLOCK_SORTED:
                    continue
            if not size:
                return
            table = pa.Table.from_batches(held)
            g = differs(table, range(2))
            cut = size if b is None else int(np.flatnonzero(g)[-1]) or size  # whole groups; one of over a block is cut as at a border
            part = table.slice(0, cut)
            found = marks(g[:cut], differs(part, range(4)), first, cut == size)
            first = cut == size
            held, size = table.slice(cut).to_batches(), size - cut
            yield from part.append_column("mark", pa.array(found)).filter(pa.array(found > 0)).to_batches()

    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, ANCHOR + ", mark byte")


def windows_of(rows: list[tuple[int, bytes]], length: int, gram: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts (left, bytes): the bytes aligned at the anchor, ranks of every window of `length` bytes, and which of
    them exist. Columns are starts."""
    side = length - gram
    box = np.zeros((len(rows), length + side), np.uint8)
    real = np.zeros((len(rows), side + 1), bool)
    for i, (left, ctx) in enumerate(rows):
        at = side - left
        box[i, at : at + len(ctx)] = np.frombuffer(ctx, np.uint8)
        real[i, at : at + len(ctx) - length + 1] = True
    top = 1
    while 2 * top <= length:
        top *= 2
    big = doubled(table[box], 1, top)
    r = pair(big[:, : side + 1], big[:, length - top : length - top + side + 1])
    return box, pair(r, np.arange(side + 1, dtype=np.uint64)[None, :]), real


def repeated_windows(contexts: list[tuple[int, int, int, bytes]], length: int, gram: int) -> np.ndarray:
    """Which windows (columns: starts) of contexts (g, g2, left, bytes) occur in another context of the same anchor rank:
    by rank, verified on the bytes against the first context of that rank."""
    parts = [windows_of([x[2:] for x in contexts[i : i + 1024]], length, gram, _BYTE) for i in range(0, len(contexts), 1024)]
    box, ranks, real = (np.concatenate(x) for x in zip(*parts, strict=True))
    group = np.fromiter((x[0] ^ x[1] for x in contexts), np.int64, len(contexts)).view(np.uint64)
    row, start = np.nonzero(real)
    _, at, back, counts = np.unique(pair(ranks, group[:, None])[real], return_index=True, return_inverse=True, return_counts=True)
    twin = row[at[back]]
    check = twin != row
    keys = np.array([x[:2] for x in contexts], np.int64)
    couples, which = np.unique(row[check] * len(contexts) + twin[check], return_inverse=True)
    one, two = np.divmod(couples, len(contexts))
    sums = np.zeros((len(couples), box.shape[1] + 1), np.int16)
    np.cumsum(box[one] == box[two], axis=1, out=sums[:, 1:])
    hit = np.zeros(real.shape, bool)
    if (keys[one] == keys[two]).all() and (sums[which, start[check] + length] - sums[which, start[check]] == length).all():
        hit[row, start] = counts[back] > 1
    else:  # two strings share a rank: compare the strings themselves
        seen: dict[tuple, list[tuple[int, int]]] = {}
        for i, x in zip(row.tolist(), start.tolist(), strict=True):
            seen.setdefault((*contexts[i][:2], x, box[i, x : x + length].tobytes()), []).append((i, x))
        for places in seen.values():
            if len(places) > 1:
                hit[tuple(zip(*places, strict=True))] = True
    return hit


PIECE = "g long, g2 long, doc_id long, h int, pos int, open boolean, left int, ctx binary"


def rims(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, h, s, e: the covered run of each open context, comparing all contexts with the same anchor rank.

    contexts are hash-partitioned and sorted by anchor rank; groups stream in blocks of whole groups.
    """
    side = length - gram
    schema = "doc_id long, h int, s int, e int"
    arrow = to_arrow_schema(_parsed(schema))

    def block(rows):
        hit = repeated_windows([(r[0], r[1], r[6], r[7]) for r in rows], length, gram)
        out = []
        for i in np.flatnonzero(hit.any(axis=1)):
            if rows[i][5]:
                base = rows[i][4] - side
                starts = np.flatnonzero(hit[i])  # all of them hold the anchor, so their union is one run
                out.append((rows[i][2], rows[i][3], int(base + starts[0]), int(base + starts[-1] + length)))
        return as_batch(out, arrow)

    def run(batches):
        held: list[tuple] = []
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                held.extend(zip(*[c.to_pylist() for c in whole.slice(at, SLICE).columns], strict=True))
                if len(held) >= BLOCK_ROWS and held[0][:2] != held[-1][:2]:
                    cut = len(held) - 1
                    while held[cut - 1][:2] == held[-1][:2]:
                        cut -= 1
                    yield block(held[:cut])
                    held = held[cut:]
        if held:
            yield block(held)

    return contexts.repartition("g", "g2").sortWithinPartitions("g", "g2").mapInArrow(run, schema)


def _parsed(schema: str):
    from pyspark.sql import types as T

    return T._parse_datatype_string(schema)


def hot_rims(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """As rims, for groups too large for one task: one narrow row per window, range-sorted by two ranks and position, so
    that equal windows are neighbours and no group meets in one task."""
    side = length - gram
    schema = "r long, r2 long, doc_id long, h int, pos int, open boolean, off int"

    def deal(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                rows = list(zip(*[c.to_pylist() for c in whole.slice(at, SLICE).columns], strict=True))
                contexts = [r[6:] for r in rows]
                _, ranks, real = windows_of(contexts, length, gram, _BYTE)
                _, ranks2, _ = windows_of(contexts, length, gram, _BYTE2)
                i, start = np.nonzero(real)
                take = lambda col, kind: pa.array([rows[j][col] for j in i], kind)
                group, group2 = (np.array([r[k] for r in rows], np.int64).view(np.uint64)[i] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(pair(ranks[real], group).view(np.int64)), pa.array(pair(ranks2[real], group2).view(np.int64)), take(2, pa.int64()), take(3, pa.int32()), take(4, pa.int32()), take(5, pa.bool_()), pa.array((start - side).astype(np.int32))], names=["r", "r2", "doc_id", "h", "pos", "open", "off"])

    def compare(batches):
        """hit: equal to a neighbour; border: the first and last row of a batch, whose other neighbour is in another one."""
        for b in batches:
            if b.num_rows:
                r, r2 = (b.column(i).to_numpy() for i in (0, 1))
                same = (r[1:] == r[:-1]) & (r2[1:] == r2[:-1])
                hit, border = np.append(same, False) | np.append(False, same), np.zeros(len(r), bool)
                border[[0, -1]] = True
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit), pa.array(border)], names=[*b.schema.names, "hit", "border"]).filter(pa.array(hit | border))

    keys = ["r", "r2", "doc_id", "h", "pos", "off"]
    w = contexts.mapInArrow(deal, schema).repartitionByRange(*keys).sortWithinPartitions(*keys)
    compared = saved(w.mapInArrow(compare, schema + ", hit boolean, border boolean"), "suffix-windows")
    across = compared.where("border").groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1").select("r", "r2")
    found = compared.where("hit AND open").unionByName(compared.where("border AND open AND NOT hit").join(across, ["r", "r2"], "left_semi"))
    return found.select("doc_id", "h", (F.col("pos") + F.col("off")).cast("int").alias("s"), (F.col("pos") + F.col("off") + length).cast("int").alias("e"))


def repeated_runs(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_group: int = HOT_GROUP) -> DataFrame:
    """keyed: doc_id, h, t (binary) -> doc_id, h, s, e: byte runs that repeated strings cover (they may overlap)."""
    spark = keyed.sparkSession
    everything = saved(anchor_table(keyed, length, gram), "suffix-anchors")  # the sort's sample reads this, not the texts
    marked = saved(neighbours(everything), "suffix-marked")
    discard(everything)
    release(spark)
    side = length - gram
    has = lambda bits: F.col("mark").bitwiseAND(F.lit(bits).cast("byte")) != 0
    settled = marked.where(has(SETTLED)).select("doc_id", "h", F.greatest(F.col("pos") - side, F.lit(0)).alias("s"), (F.col("pos") + length).alias("e"))
    ask = marked.where(has(OPEN | PARTNER)).select("g", "g2", "doc_id", "h", "pos", has(OPEN).alias("open"))
    asked = ask.groupBy("doc_id", "h").agg(F.collect_list(F.struct("g", "g2", "pos", "open")).alias("ask")).withColumnsRenamed({"doc_id": "ai", "h": "ah"})
    texts = keyed.join(asked, keyed["doc_id"].eqNullSafe(asked["ai"]) & (keyed["h"] == asked["ah"])).select("doc_id", "h", "t", "ask")
    arrow = to_arrow_schema(_parsed(PIECE))

    def cut(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                out = []
                for doc_id, h, raw, ask in zip(*[c.to_pylist() for c in whole.slice(at, 64).columns], strict=True):
                    for a in ask:
                        lo = max(0, a["pos"] - side)
                        out.append((a["g"], a["g2"], doc_id, h, a["pos"], a["open"], a["pos"] - lo, raw[lo : a["pos"] + length]))
                yield as_batch(out, arrow)

    pieces = texts.mapInArrow(cut, PIECE)
    hot = saved(ask.groupBy("g", "g2").count().where(F.col("count") > hot_group).select("g", "g2"), "suffix-hot")
    if hot.limit(1).count():
        pieces = saved(pieces, "suffix-pieces")
        # one row for hot_group rows of the other side: broadcast by Spark where its size allows
        rim = rims(pieces.join(hot, ["g", "g2"], "left_anti").select(*pieces.columns), length, gram)
        rim = rim.unionByName(hot_rims(pieces.join(hot, ["g", "g2"], "left_semi").select(*pieces.columns), length, gram))
    else:
        rim = rims(pieces, length, gram)
    runs = saved(settled.unionByName(rim), "suffix-runs")
    discard(marked, hot)
    release(spark)
    return runs


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.pmod(F.xxhash64(text_col), F.lit((1 << 31) - 1)).cast("int").alias("h"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot_group: int = HOT_GROUP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary, the remaining bytes), spans (removed runs)."""
    keyed = keyed_texts(docs, id_col, text_col)
    runs = repeated_runs(keyed, length, gram, hot_group).groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "e")).alias("runs")).withColumnsRenamed({"doc_id": "ri", "h": "rh"})
    j = keyed.join(runs, keyed["doc_id"].eqNullSafe(runs["ri"]) & (keyed["h"] == runs["rh"]), "left").select("doc_id", "t", "runs")

    def one(doc_id, raw, runs):
        merged: list[list[int]] = []
        for s, e in sorted((r["s"], min(r["e"], len(raw))) for r in runs or ()):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        kept, at = [], 0
        for s, e in merged:
            kept.append(raw[at:s])
            at = e
        kept.append(raw[at:])
        rest = b"".join(kept)
        return doc_id, len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest, [{"s": s, "e": e} for s, e in merged]

    return map_documents(j, {"doc_id": "value", "t": "value", "runs": "value"}, one, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<s:int,e:int>>")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).drop("kept", "spans")
