"""Ranking functions as Column arithmetic: score(tf, df, dl, avg_dl, n)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Similarity(Protocol):
    name: str

    def score(self, tf: Column, df: Column, dl: Column, avg_dl: Column, n: Column) -> Column: ...


def _guarded(tf, df, n, value: Column) -> Column:
    return F.when((tf == 0) | (df == 0) | (n == 0), 0.0).otherwise(value)


def _average(avg_dl: Column) -> Column:
    return F.when(avg_dl <= 0, 1.0).otherwise(avg_dl)


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75
    name: str = "BM25"

    def score(self, tf, df, dl, avg_dl, n):
        idf = F.log(n / F.nullif(df, F.lit(0)) + 1) + 1
        norm = tf + self.k1 * (self.b * dl / _average(avg_dl) + (1 - self.b))
        return _guarded(tf, df, n, idf * (tf * (self.k1 + 1)) / norm)


@dataclass(frozen=True)
class BM25L:
    k1: float = 1.2
    b: float = 0.75
    delta: float = 1.0
    name: str = "BM25L"

    def score(self, tf, df, dl, avg_dl, n):
        idf = F.log(n / F.nullif(df, F.lit(0)) + 1) + 1
        norm = tf + self.k1 * ((1 - self.b) + self.b * dl / _average(avg_dl)) + self.delta
        return _guarded(tf, df, n, idf * (tf * (self.k1 + 1) + self.delta) / norm)


@dataclass(frozen=True)
class TFIDF:
    name: str = "TF-IDF"

    def score(self, tf, df, dl, avg_dl, n):
        return _guarded(tf, df, n, F.sqrt(tf.cast("double")) * (F.log(n / F.nullif(df, F.lit(0))) + 1))


BY_NAME = {"bm25": BM25, "bm25l": BM25L, "tfidf": TFIDF, "tf-idf": TFIDF}
