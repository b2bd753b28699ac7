"""Log lines to documents: JSON and Logback formats, auto-detection, a registry for more, field normalization."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeutil import normalize_time
from .documents import float_field, int_field, keyword_field, present, stored_field, text_field

LOGBACK = r"^\s*(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{3})?)\s+([A-Za-z]+)\s+(\S+)\s+-\s+(.*)$"
MAX_LINE = 4 << 20
COMMON = ("message", "msg", "level", "severity", "logger", "class", "source", "timestamp", "time", "ts")
_SPACE = r"^[\s]+|[\s]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE, "")


def json_fields(line: Column) -> Column:
    """map<string, variant> of a line that holds a non-empty JSON object, else null."""
    parsed = F.from_json(F.when(strip(line).startswith("{"), strip(line)), "map<string,variant>")
    return F.when(F.size(parsed) > 0, parsed)


def logback_fields(line: Column) -> Column:
    # no part but the last can hold a line break, and the last one ends at it
    parts = F.split(F.regexp_replace(line, LOGBACK, "$1\n$2\n$3\n$4"), "\n", 4)
    values = F.transform(parts, lambda v: F.try_variant_get(F.to_variant_object(F.struct(v.alias("v"))), "$.v", "variant"))
    return F.when(line.rlike(LOGBACK), F.map_from_arrays(F.array(*map(F.lit, ("timestamp", "level", "logger", "message"))), values))


class Registry:
    """Formats by name: each maps a line Column to map<string, variant>, null where the line doesn't parse."""

    def __init__(self):
        self._by_name: dict[str, Callable[[Column], Column]] = {}
        self.register("json", json_fields)
        self.register("logback", logback_fields)

    def register(self, name: str, parser: Callable[[Column], Column]) -> None:
        name = (name or "").strip().lower()
        if not name or name == "auto":
            raise ValueError("a format needs a name other than auto")
        if parser is None:
            raise ValueError("a format needs a parser")
        self._by_name[name] = parser

    def get(self, name: str) -> Callable[[Column], Column]:
        name = (name or "").strip().lower()
        if name in ("", "auto"):
            return self.auto
        if name not in self._by_name:
            raise ValueError(f"unknown log format {name!r}")
        return self._by_name[name]

    def formats(self) -> list[str]:
        return sorted(self._by_name)

    def auto(self, line: Column) -> Column:
        return F.when(detect_format(line) == "json", self._by_name["json"](line)).otherwise(self._by_name["logback"](line))


REGISTRY = Registry()


def detect_format(line: Column) -> Column:
    t = strip(line)
    return F.when(t.startswith("{") & t.endswith("}"), "json").otherwise("logback")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    """String form of a string (if not blank) or number; null for everything else."""
    s = F.try_variant_get(v, "$", "string")
    return F.when(_kind(v) == "STRING", F.when(strip(s) != "", s)).when(_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), s)


def pick(fields: Column, *keys: str) -> Column:
    return F.coalesce(*[_text(F.try_element_at(fields, F.lit(k))) for k in keys])


def common_values(fields: Column) -> Column:
    """struct<message, level, logger, time> of the first keys that have a value; time as it stands in the line."""
    level = F.upper(strip(pick(fields, "level", "severity")))
    return F.struct(pick(fields, "message", "msg").alias("message"), level.alias("level"), pick(fields, "logger", "class", "source").alias("logger"), pick(fields, "timestamp", "time", "ts").alias("time"))


def log_fields(raw: Column, fields: Column, common: Column, timestamp: Column) -> Column:
    """Fields of a log document: raw, extra keys in source order, then the normalized common ones."""

    def extra(k, v):
        get = lambda t: F.try_variant_get(v, "$", t)
        k = F.trim(k)
        other = F.to_json(v)
        return (
            F.when(_kind(v) == "STRING", text_field(k, get("string")))
            .when(_kind(v) == "BIGINT", int_field(k, get("bigint")))
            .when(_kind(v).rlike("^(DECIMAL|DOUBLE|FLOAT)"), float_field(k, get("double")))
            .when(_kind(v) == "BOOLEAN", stored_field(k, get("boolean"), "bool"))
            .otherwise(stored_field(k, other))
        )

    own = F.filter(F.map_entries(fields), lambda e: (F.trim(e["key"]) != "") & ~F.lower(F.trim(e["key"])).isin(*COMMON))
    named = present(text_field("message", common["message"]), keyword_field("level", common["level"]), keyword_field("logger", common["logger"]), keyword_field("timestamp", timestamp))
    return F.concat(F.array(text_field("raw", raw)), F.transform(own, lambda e: extra(e["key"], e["value"])), named)


def parse_lines(lines: DataFrame, fmt: str = "auto", line: str = "line", source: str = "source", line_no: str = "line_no", registry: Registry = REGISTRY) -> DataFrame:
    """ext_id, fields, parsed, of every non-blank line; fields are null where the line doesn't parse."""
    d = lines.select(F.col(source).alias("_s"), F.col(line_no).cast("bigint").alias("_n"), strip(F.col(line)).alias("_t")).where("_t != ''")
    # each step is computed once a line: a generator keeps the optimizer from copying it into every use and into filters
    once = lambda **made: F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()])))
    d = d.select("*", once(_f=registry.get(fmt)(F.col("_t"))))
    d = d.select("*", once(_c=F.when(F.col("_f").isNotNull(), common_values(F.col("_f")))))
    d = d.select("*", once(_time=normalize_time(F.col("_c.time"))))
    post = F.array(keyword_field("source", F.col("_s")), int_field("line_no", F.col("_n")))
    ext_id = F.concat("_s", F.lit(":"), F.col("_n").cast("string"))
    fields = F.when(F.col("_f").isNotNull(), F.concat(log_fields(F.col("_t"), F.col("_f"), F.col("_c"), F.col("_time")), post))
    return d.select(once(ext_id=ext_id, fields=fields, parsed=F.col("_f").isNotNull()))


def read_logs(spark: SparkSession, path: str, fmt: str = "auto", registry: Registry = REGISTRY) -> DataFrame:
    """As parse_lines, for the files at path. A line of over 4 MiB is an error, as nothing of such a file may be kept.

    Files are split over tasks: lines are numbered within the block of the file that a task reads, and blocks by the
    lines of those before them.
    """
    registry.get(fmt)
    d = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.regexp_replace("_metadata.file_path", "^file://(?=/)", "").alias("source"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    )
    blocks = d.groupBy("source", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "_block", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    numbered = d.join(blocks, ["source", "_block"]).withColumn("line_no", F.col("_at") + F.col("_shift"))
    checked = F.when(F.octet_length("line") > MAX_LINE, F.raise_error(F.concat(F.lit("line too long in "), F.col("source")))).otherwise(F.regexp_replace("line", "\r$", ""))
    return parse_lines(numbered.select("source", "line_no", checked.alias("line")), fmt, registry=registry)
