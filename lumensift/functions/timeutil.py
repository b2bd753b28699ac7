"""Timestamps in text, durations, and buckets counted from 0001-01-01 (Column expressions, UTC)."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})$"
PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
#: Microseconds from 0001-01-01T00:00:00Z to 1970-01-01T00:00:00Z.
ORIGIN = 62_135_596_800_000_000


def parse_time(text: Column, dates: bool = False) -> Column:
    """TIMESTAMP of RFC 3339 text or `yyyy-MM-dd HH:mm:ss[.,fff]` (no zone means UTC), else null."""
    point = F.regexp_replace(text, ",", ".")
    read = F.when(text.rlike(ZONED), F.try_to_timestamp(point)).when(text.rlike(PLAIN), F.try_to_timestamp(F.concat(point, F.lit("Z"))))
    return read.when(text.rlike(DATE), F.try_to_timestamp(F.concat(point, F.lit(" 00:00:00Z")))) if dates else read


def offset_seconds(text: Column) -> Column:
    """The UTC offset that the text itself names, in seconds."""
    part = lambda z, at: F.substring(z, at, 2).try_cast("int")
    seconds = lambda z: F.when(z.startswith("-"), -1).otherwise(1) * (part(z, 2) * 3600 + part(z, 5) * 60)
    return let(F.regexp_extract(text, r"T.*([+-]\d{2}:\d{2})$", 1), lambda z: F.when(z == "", 0).otherwise(seconds(z))).cast("long")


def rfc3339(micros: Column, offset: Column) -> Column:
    """RFC 3339 text at a UTC offset; the fraction loses trailing zeros."""
    size = F.abs(offset)
    zone = F.when(offset == 0, "Z").otherwise(F.format_string("%s%02d:%02d", F.when(offset < 0, "-").otherwise("+"), F.floor(size / 3600), F.floor(size % 3600 / 60)))
    return F.concat(F.regexp_replace(F.date_format(F.timestamp_micros(micros + offset * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), zone)


def _rewritten(text: Column, micros: Callable[[Column], Column]) -> Column:
    """RFC 3339 text, at the text's own offset, of what micros makes of the text's instant."""
    read = let(F.unix_micros(parse_time(text)), lambda m: F.when(m.isNotNull(), F.struct(micros(m).alias("at"), offset_seconds(text).alias("offset"))))
    return let(read, lambda x: rfc3339(x["at"], x["offset"]))


def normalize_time(text: Column) -> Column:
    """RFC 3339 form in the text's own offset; unparsable text stays as it is."""
    return F.coalesce(_rewritten(text, lambda m: m), text)


def bucket_start(text: Column, width: int) -> Column:
    """RFC 3339 start of the bucket of `width` microseconds, or null. Buckets count from year 1, as instants."""
    return _rewritten(F.trim(text), lambda m: m - F.pmod(m + F.lit(ORIGIN), F.lit(width)))


_UNITS = {"ns": 0.001, "us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def parse_duration(text: str) -> int:
    """Microseconds of a duration such as 5m or 1h30m; ValueError unless positive."""
    parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    total = round(sum(float(a) * _UNITS[b] for a, b in parts))
    if total <= 0:
        raise ValueError(f"not a positive duration: {text!r}")
    return total


def python_time(text: str) -> datetime | None:
    """The instant that a query bound names, or None; the same layouts as parse_time with dates."""
    if re.match(ZONED, text) or re.match(PLAIN, text) or re.match(DATE, text):
        try:
            t = datetime.fromisoformat(re.sub(r"([.,])(\d{6})\d+", r"\1\2", text).replace(",", "."))
            return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
        except ValueError:
            return None
    return None


def micros(t: datetime) -> int:
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
