"""Versioned indexes on any Hadoop file system: Parquet tables named by a manifest, and an append-only change log.

    <path>/manifest.json            {"version", "last_id", "changes"}
    <path>/v<version>/documents     and postings (each file sorted by term), doc_lengths
    <path>/changes/<n>              op, doc_id, ext_id, boost, fields of one add or delete

A reader applies the changes that the manifest's version has not taken in; commit() folds them into a new version,
and the manifest is swapped last, so a crash at any point leaves the version before it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.index import Index
from .documents import SCHEMA, with_ids


class Store:
    def __init__(self, spark: SparkSession, path: str, **index_options):
        self.spark, self.path, self.options = spark, path.rstrip("/"), index_options

    def _fs(self, sub: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}" if sub else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, sub: str = "manifest.json") -> bool:
        fs, p = self._fs(sub)
        return fs.exists(p)

    def manifest(self) -> dict:
        # between the deletion and the renaming of a swap only the new one is there, and it is complete
        name = next((x for x in ("manifest.json", "manifest.tmp") if self.exists(x)), None)
        if name is None:
            raise FileNotFoundError(f"no index at {self.path}")
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/{name}").first()
        return json.loads(text[0])

    def _swap(self, manifest: dict) -> None:
        fs, temp = self._fs("manifest.tmp")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, target = self._fs("manifest.json")
        if fs.exists(target):
            fs.delete(target, False)
        fs.rename(temp, target)

    def create(self) -> Store:
        if not self.exists() and not self.exists("manifest.tmp"):
            self._swap({"version": 0, "last_id": 0, "changes": 0, "applied": 0})
        return self

    def drop(self) -> None:
        if not self.exists(""):
            raise FileNotFoundError(self.path)
        fs, p = self._fs("")
        fs.delete(p, True)

    def _version(self, m: dict, table: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/v{m['version']}/{table}") if m["version"] else None

    def _pending(self, m: dict) -> DataFrame | None:
        """The change rows not yet folded in, with their sequence number."""
        paths = [f"{self.path}/changes/{n}" for n in range(m["applied"], m["changes"])]
        if not paths:
            return None
        d = self.spark.read.schema(f"op string, {SCHEMA}").parquet(*paths)
        return d.withColumn("seq", F.regexp_extract("_metadata.file_path", r"/changes/(\d+)/[^/]*$", 1).cast("int"))

    def documents(self) -> DataFrame:
        """Live documents: the version's with the pending changes, the last change of an id deciding."""
        m = self.manifest()
        base = self._version(m, "documents")
        base = self.spark.createDataFrame([], SCHEMA) if base is None else base
        return self.replay(base, self._pending(m))

    @staticmethod
    def replay(base: DataFrame, changes: DataFrame | None) -> DataFrame:
        if changes is None:
            return base
        # ids and numbers alone are sorted by id, not the documents
        numbered = changes.select("doc_id", "seq", F.max("seq").over(Window.partitionBy("doc_id")).alias("last"))
        last = changes.join(numbered.where("seq < last").select("doc_id", "seq"), ["doc_id", "seq"], "left_anti")
        deleted = last.where("op = 'DELETE'").select("doc_id")
        added = last.where("op = 'ADD'").select(*base.columns).join(base.select("doc_id"), "doc_id", "left_anti")
        return base.join(deleted, "doc_id", "left_anti").unionByName(added)

    def _log(self, rows: DataFrame, m: dict) -> tuple[int, int | None]:
        """Write a change and name it in the manifest; (rows, largest id) of it."""
        path = f"{self.path}/changes/{m['changes']}"
        rows.write.mode("overwrite").parquet(path)  # what a crashed writer left there isn't in the manifest
        r = self.spark.read.parquet(path).agg(F.count("*"), F.max(F.when(F.col("op") == "ADD", F.col("doc_id")))).first()
        self._swap(m | {"changes": m["changes"] + 1, "last_id": r[1] or m["last_id"]})
        return r[0], r[1]

    @staticmethod
    def _added(docs: DataFrame, m: dict) -> DataFrame:
        have = set(docs.columns)
        d = docs.select((F.col("ext_id") if "ext_id" in have else F.lit(None)).cast("string").alias("ext_id"), (F.col("boost") if "boost" in have else F.lit(1.0)).cast("float").alias("boost"), "fields")
        return with_ids(d, m["last_id"] + 1).select(F.lit("ADD").alias("op"), "doc_id", "ext_id", "boost", "fields")

    def _gone(self, ids: list[int] | DataFrame) -> DataFrame:
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "doc_id long")
        f = SCHEMA.split("fields ")[1]
        return gone.select(F.lit("DELETE").alias("op"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("ext_id"), F.lit(None).cast("float").alias("boost"), F.lit(None).cast(f).alias("fields"))

    def add(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Log documents (fields, and optionally ext_id and boost); returns how many.

        batch: name of a stream and number of its batch; one that was added before is passed over.
        """
        m = self.manifest()
        if batch is not None:
            name, n = batch
            done = m.get("batches", {})
            if done.get(name, -1) >= n:
                return 0
            m = m | {"batches": done | {name: n}}
        return self._log(self._added(docs, m), m)[0]

    def delete(self, ids: list[int] | DataFrame) -> None:
        """Log deletions (a list, or a DataFrame with doc_id); unknown ids do nothing."""
        self._log(self._gone(ids), self.manifest())

    def update(self, doc_id: int, docs: DataFrame) -> None:
        """Deletion and addition in one change."""
        m = self.manifest()
        self._log(self._gone([doc_id]).unionByName(self._added(docs, m)), m)

    def pending(self) -> int:
        m = self.manifest()
        return m["changes"] - m["applied"]

    def commit(self, force: bool = False) -> bool:
        """Fold pending changes into a new version; nothing to do returns False."""
        m = self.manifest()
        if not self.pending() and not force:
            return False
        index = Index(self.documents(), **self.options)
        to = f"{self.path}/v{m['version'] + 1}"
        index.documents.write.mode("overwrite").parquet(f"{to}/documents")
        fresh = Index(self.spark.read.parquet(f"{to}/documents"), **self.options)
        # a file per split of the documents: no shuffle, and a term's rows are found by the statistics of each file's pages
        fresh.postings.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{to}/postings")
        fresh.doc_lengths.write.mode("overwrite").parquet(f"{to}/doc_lengths")
        self._swap(m | {"version": m["version"] + 1, "applied": m["changes"], "cleaned": m["applied"]})
        # readers of the version before this one go on; what only older ones needed goes
        old = [f"v{m['version'] - 1}"] * (m["version"] > 1) + [f"changes/{n}" for n in range(m.get("cleaned", 0), m["applied"])]
        for sub in old:
            fs, p = self._fs(sub)
            fs.delete(p, True)
        return True

    compact = commit

    def index(self) -> Index:
        """The index as stored; postings come from the version unless changes are pending."""
        m = self.manifest()
        if self.pending() or not m["version"]:
            return Index(self.documents(), **self.options)
        return Index(self._version(m, "documents"), derived={t: self._version(m, t) for t in ("postings", "doc_lengths")}, **self.options)

    def info(self) -> dict:
        return self.manifest() | {"path": self.path, "pending": self.pending()}
