"""count and group aggregations over hits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import bucket_start, parse_duration
from ..sources.documents import first_field, string_value

UNKNOWN = "(unknown)"


def count(docs: DataFrame, agg: str = "count") -> DataFrame:
    if agg.strip().lower() != "count":
        raise ValueError(f"unsupported aggregation {agg!r}")
    return docs.agg(F.count("*").alias("count"))


def group(docs: DataFrame, spec: str) -> DataFrame:
    """key, count by a field or by time(<duration>) of the field timestamp; most first, then by key."""
    return counted(docs.select(key(spec)))


def key(spec: str) -> Column:
    """The column key of documents by which group() counts."""
    spec = spec.strip()
    m = re.fullmatch(r"time\((.*)\)", spec)
    if m:
        f = first_field("timestamp")
        value = bucket_start(string_value(f), parse_duration(m[1].strip()))
    elif spec:
        value = F.nullif(F.trim(string_value(first_field(spec))), F.lit(""))
    else:
        raise ValueError("group needs a field or time(duration)")
    return F.coalesce(value, F.lit(UNKNOWN)).alias("key")


def counted(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")
