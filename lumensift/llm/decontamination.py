"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as sequences of lower-cased words; in scripts written without blanks (Chinese, Japanese kana, Thai,
Lao, Khmer, Burmese) every character is a word. An item of n words may be quoted with up to floor(n * rate) word
errors (insertions, deletions, replacements). Cut into errors + 1 pieces, at least one piece of any such quotation
stands unchanged; exact piece hits (Aho-Corasick over the whole text) are the candidates, and each is verified with
Myers' bit-parallel approximate matching over the stretch of text around the hit. Items of under 1 / rate words have no
budget: they are found where they stand word for word.

Scale: the documents stream through once a block, without a shuffle. The benchmark is a stated set of queries against
all rows; its items are grouped into blocks bounded in number and bytes, each broadcast to the executors and matched
in its own pass, so memory is bounded whatever the benchmark's size.

Defined results: null and empty texts have no hits; items without a word match nothing; items without an id are
reported with a null id; rows with the same item id are one item, with the least errors of any; repeated rows are each
reported; an empty benchmark or table gives no hits; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .per_document import map_documents, plain_words

ERROR_RATE = 0.1
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
PIECE_BYTES = 1024  # of a longer piece the automaton looks for the beginning, which stands wherever the piece does
#: A character of a script without blanks between words, in UTF-8: Thai and Lao, Burmese and Khmer, kana and Han.
_UNSPACED = re.compile(rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xe3[\x81-\x83\x90-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}")


def tokens(raw: bytes | None) -> list[bytes]:
    return plain_words(raw if raw is None or raw.isascii() else _UNSPACED.sub(rb" \g<0> ", raw))


def budget(n: int, rate: float) -> int:
    return int(n * rate + 1e-9)


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """(start, end) of errors + 1 nearly equal pieces of n words."""
    k = min(errors + 1, n)
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def myers(pattern: list, text: list, most: int) -> int | None:
    """Least number of errors with which the pattern occurs anywhere in the text, None if over `most`.

    Bit-parallel over the pattern's words: one step of a few integer operations for each word of the text.
    """
    m = len(pattern)
    at: dict = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best = m
    for w in text:
        eq = at.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        if mh & high:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best = score
            if not best:
                break
    return best if best <= most else None


class Matcher:
    """Pieces of all items in one Aho-Corasick automaton, over text joined as " w1 w2 ... "."""

    def __init__(self, items: list[tuple[int | None, bytes]], rate: float):
        self.items = [(k, w, budget(len(w), rate)) for k, raw in items if (w := tokens(raw))]
        hits: dict[bytes, list[tuple[int, int]]] = {}
        for n, (_, w, e) in enumerate(self.items):
            for a, b in pieces(len(w), e):
                hits.setdefault((b" " + b" ".join(w[a:b]) + b" ")[:PIECE_BYTES], []).append((n, a))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.hits, self.sizes = list(hits.values()), list(map(len, hits))
        for i, piece in enumerate(hits):
            self.machine.add_word(piece.decode("latin-1"), i)
        if hits:
            self.machine.make_automaton()

    def find(self, raw: bytes | None) -> dict[int | None, int]:
        """Least errors by item id."""
        words = tokens(raw)
        if not words or not self.hits:
            return {}
        joined = b" " + b" ".join(words) + b" "
        near: dict[int, list[int]] = {}
        done, count = 0, 0
        for start, piece in sorted((end + 1 - self.sizes[piece], piece) for end, piece in self.machine.iter(joined.decode("latin-1"))):
            count += joined.count(b" ", done, start)
            done = start
            for n, a in self.hits[piece]:
                near.setdefault(n, []).append(count - a)
        found: dict[int | None, int] = {}
        for n, begins in near.items():
            item, w, e = self.items[n]
            best, seen = None, -1
            for b in sorted(set(begins)):
                lo, hi = max(0, b - e), b + len(w) + e
                if b <= seen:  # candidates next to each other share one stretch of text
                    continue
                seen = b + e
                got = myers(w, words[lo : hi + e], e)
                if got is not None and (best is None or got < best):
                    best = got
            if best is not None and best <= found.get(item, best):
                found[item] = best
        return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Per row of docs and block of the benchmark with a hit: doc_id, _h, hits array<struct<item_id, errors>>."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("binary").alias("t")).where("t IS NOT NULL")
    schema = "doc_id long, _h long, hits array<struct<item_id:long,errors:int>>"
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("text"))

    def scan(block):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        matcher: list[Matcher] = []

        def one(doc_id, h, raw):
            if not matcher:
                matcher.append(Matcher(shared.value, rate))
            found = matcher[0].find(raw)
            order = sorted(found.items(), key=lambda x: (x[0] is None, x[0] or 0))
            return (doc_id, h, [{"item_id": k, "errors": e} for k, e in order]) if found else None

        return map_documents(hashed, {"doc_id": "value", "_h": "value", "text": "text"}, one, schema)

    scans: list[DataFrame] = []
    block: list[tuple[int | None, bytes]] = []
    size = 0
    for r in items.toLocalIterator():  # a block at a time reaches the driver
        block.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
        if len(block) == block_items or size > BLOCK_BYTES:
            scans.append(scan(block))
            block, size = [], 0
    if block or not scans:
        scans.append(scan(block))
    return reduce(DataFrame.unionByName, scans)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that quote no benchmark item."""
    leaks = decontaminate(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("__bd_id"), F.col("_h").alias("__bd_h")).distinct()
    hashed = docs.withColumn("__bd_text_hash", F.xxhash64(text_col))
    return hashed.join(leaks, hashed[id_col].eqNullSafe(leaks["__bd_id"]) & (F.col("__bd_text_hash") == F.col("__bd_h")), "left_anti").select(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair of a document and an item that it quotes."""
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", F.col("hit.errors").alias("n_errors"))
