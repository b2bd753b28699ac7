"""Helpers shared by the corpus operators: scratch tables, word splitting, input pruning."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the complement of the word class [^\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"

_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, from spark.checkpoint.dir.

    Only a single-process session (local[n]) without the setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
    if "root" not in _local_scratch:
        _local_scratch["root"] = tempfile.mkdtemp(prefix="lumensift-")
    return "file://" + _local_scratch["root"]


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage so that lost executors cost only
    the tasks they ran, and lets Spark drop the shuffle files behind it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no unfinished plan reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of the maximal runs outside ASCII white space; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def bound_once(value: Column, body) -> Column:
    """Evaluate value once per row and hand it to body (a let binding that survives project collapsing)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that are no longer referenced (it acts when objects are collected)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
