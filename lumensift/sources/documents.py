"""The document model: rows (doc_id, ext_id, boost, fields) with an ordered array of typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = "struct<name:string,type:string,str:string,long_v:bigint,dbl_v:double,bool_v:boolean,stored:boolean,indexed:boolean,tokenized:boolean>"
SCHEMA = f"doc_id bigint, ext_id string, boost float, fields array<{FIELD}>"


def _field(name, kind: str, value: Column, indexed: bool, tokenized: bool) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    typed = {"text": "str", "keyword": "str", "stored": "str", "int": "long_v", "float": "dbl_v", "bool": "bool_v"}[kind]
    parts = {"str": "string", "long_v": "bigint", "dbl_v": "double", "bool_v": "boolean"}
    return F.struct(name.alias("name"), F.lit(kind).alias("type"), *[(value if p == typed else F.lit(None)).cast(t).alias(p) for p, t in parts.items()], F.lit(True).alias("stored"), F.lit(indexed).alias("indexed"), F.lit(tokenized).alias("tokenized"))


def text_field(name, value: Column) -> Column:
    return _field(name, "text", value, True, True)


def keyword_field(name, value: Column) -> Column:
    return _field(name, "keyword", value, True, False)


def int_field(name, value: Column) -> Column:
    return _field(name, "int", value, True, False)


def float_field(name, value: Column) -> Column:
    return _field(name, "float", value, True, False)


def stored_field(name, value: Column, kind: str = "stored") -> Column:
    return _field(name, kind, value, False, False)


def present(*fields: Column) -> Column:
    """The fields whose value is not null, in order."""
    return F.filter(F.array(*fields), lambda f: F.coalesce(f["str"], f["long_v"].cast("string"), f["dbl_v"].cast("string"), f["bool_v"].cast("string")).isNotNull())


def plain_double(x: Column) -> Column:
    """Shortest decimal text without an exponent, whole numbers without a fraction."""
    whole = (x == F.floor(x)) & (F.abs(x) < 9e18)
    return F.when(whole, F.when(whole, x).cast("bigint").cast("string")).otherwise(F.when(F.abs(x) >= 1e-3, x.cast("string")).otherwise(F.regexp_replace(x.try_cast("decimal(38,25)").cast("string"), r"0+$", "")))


def string_value(f: Column) -> Column:
    return F.coalesce(f["str"], f["long_v"].cast("string"), plain_double(f["dbl_v"]), f["bool_v"].cast("string"), F.lit(""))


def first_field(name: str, fields: Column | None = None) -> Column:
    """First field of that exact name, or null."""
    return F.try_element_at(F.filter(F.col("fields") if fields is None else fields, lambda f: f["name"] == name), F.lit(1))


def all_fields(name: str) -> Column:
    return F.filter("fields", lambda f: f["name"] == name)


def number_value(f: Column) -> Column:
    """Number of a field; numeric strings parse, booleans don't."""
    return F.coalesce(f["dbl_v"], f["long_v"].cast("double"), F.trim(f["str"]).try_cast("double"))


def from_table(df: DataFrame, id_col: str, text: tuple[str, ...] = (), keyword: tuple[str, ...] = (), integer: tuple[str, ...] = (), real: tuple[str, ...] = (), stored: tuple[str, ...] = (), ext_id: str | None = None) -> DataFrame:
    """Documents from a flat table; null cells make no field."""
    fields = [text_field(c, F.col(c)) for c in text] + [keyword_field(c, F.col(c)) for c in keyword] + [int_field(c, F.col(c)) for c in integer] + [float_field(c, F.col(c)) for c in real] + [stored_field(c, F.col(c)) for c in stored]
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.col(ext_id).cast("string") if ext_id else F.lit(None).cast("string")).alias("ext_id"), F.lit(1.0).cast("float").alias("boost"), present(*fields).alias("fields"))


def with_ids(df: DataFrame, start: int) -> DataFrame:
    """Number rows start, start + 1, ... in partition order: one small count per partition reaches the driver."""
    d = df.withColumn("_m", F.monotonically_increasing_id())
    counts = {r["p"]: r["count"] for r in d.groupBy(F.shiftright("_m", 33).alias("p")).count().collect()}
    offsets, at = [], start
    for p in sorted(counts):
        offsets += [F.lit(p).cast("bigint"), F.lit(at).cast("bigint")]
        at += counts[p]
    base = F.element_at(F.create_map(*offsets), F.shiftright("_m", 33)) if offsets else F.lit(start)
    return d.withColumn("doc_id", base + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")
