"""File sources: whole text files, directories, JSON imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import float_field, keyword_field, present, stored_field, text_field

EXTENSIONS = ("txt", "md", "json")


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """ext_id, fields: a document per file (content, path); a directory takes .txt, .md and .json in any case."""
    d = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).text(path).select(F.col("value"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("n"))
    if recursive:
        d = d.where(F.lower(F.substring_index("n", ".", -1)).isin(*EXTENSIONS) & F.col("n").contains("."))
    where = F.regexp_replace(F.col("p"), "^file://(?=/)", "")
    return d.select(where.alias("ext_id"), present(text_field("content", F.col("value")), keyword_field("path", where)).alias("fields"))


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """ext_id, fields of a JSON array of {id, fields}: strings are text, numbers float, booleans stored; the rest is dropped."""
    d = spark.read.schema("id string, fields map<string,variant>").option("multiLine", True).json(path)
    get = lambda v, t: F.try_variant_get(v, "$", t)
    kind = lambda v: F.schema_of_variant(v)

    def build(k, v):
        return F.when(kind(v) == "STRING", text_field(k, get(v, "string"))).when(kind(v) == "BOOLEAN", stored_field(k, get(v, "boolean"), "bool")).when(kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), float_field(k, get(v, "double")))

    made = F.transform(F.map_entries("fields"), lambda e: build(e["key"], e["value"]))
    return d.select(F.col("id").alias("ext_id"), F.filter(F.coalesce(made, F.array()), lambda f: f.isNotNull()).alias("fields"))
