"""Arrow-batched per-document Python steps over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Every byte that separates words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] becomes a blank, A-Z become a-z.
WORDS_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256)
)


#: Rows turned into Python objects at a time.
SLICE = 512


def plain_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of digits, a-z and non-ASCII characters; empty for null."""
    return (raw or b"").translate(WORDS_TABLE).split()


def map_documents(docs: DataFrame, columns: dict[str, str], fn: Callable[..., tuple | None], schema: str) -> DataFrame:
    """Apply fn to every row, as (values of columns, texts as UTF-8 bytes) -> one output row, or None for no row.

    columns: name -> "text" (cast to binary) or "value". No more than SLICE rows are held as Python objects.
    """
    picked = docs.select(*[(F.col(c).cast("binary") if kind == "text" else F.col(c)).alias(f"c{i}") for i, (c, kind) in enumerate(columns.items())])
    return picked.mapInArrow(streaming(fn, schema), schema)


def streaming(fn: Callable[..., tuple | None], schema: str):
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [r for r in map(fn, *[c.to_pylist() for c in part.columns]) if r is not None]
                yield as_batch(rows, arrow)

    return run


def as_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
