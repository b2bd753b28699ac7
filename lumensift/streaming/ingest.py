"""Structured Streaming ingest: log files that arrive in a folder are parsed and added to a stored index."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.logs import REGISTRY, parse_lines
from ..sources.storage import Store


def ingest_logs(spark: SparkSession, folder: str, store: Store, checkpoint: str, fmt: str = "auto", available_now: bool = True) -> StreamingQuery:
    """Every micro-batch of new files is one change of the store; the caller commits when it wants a new version."""
    REGISTRY.get(fmt)
    files = spark.readStream.schema("value string").option("wholetext", True).text(folder)
    lines = files.select(F.regexp_replace("_metadata.file_path", "^file://(?=/)", "").alias("source"), F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))

    def add(batch, n):
        # a batch that is replayed after a crash isn't added twice
        store.add(parse_lines(batch.select("source", (F.col("i") + 1).alias("line_no"), "line"), fmt).where("parsed").select("ext_id", "fields"), batch=(checkpoint, n))

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
