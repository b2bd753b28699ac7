"""Line dedup over overlapping windows of three lines (DataFrame functions only).

Every three consecutive lines of a text are hashed together, twice with different seeds (128 bits). A window found more than once in the corpus is kept
where it comes first (by doc_id, then by position) and removed elsewhere; the removed windows of a text are merged,
so that overlapping ones take out one run of lines.

Scale: one row per window of 40 bytes is aggregated by hash with map-side combining (a window that a third of all
documents share becomes one row per task), and joined back under AQE's skew handling. Texts are shuffled only by
document, and only those that lose lines are rebuilt.

Defined results: null texts stay null; texts of under three lines and windows without any visible character are
never touched; lines are compared byte for byte; rows with the same doc_id and text count once as an occurrence and
get the same result; rows without doc_id come last in the order; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, bound_once, read, saved

WINDOW = 3


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per window: _id, _h (hash of the whole text), pos (line from 0), w (two hashes of the three lines)."""
    lines = F.split(text_col, "\n")
    # a line's hash, null where nothing is visible; a window without any visible line is left out
    seen = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(WINDOW), x).alias("k"), (F.length(F.translate(x, BLANKS, "")) > 0).alias("v")))
    three = lambda a, i: F.when(F.get(a, i).getField("v") | F.get(a, i + 1).getField("v") | F.get(a, i + 2).getField("v"), F.struct(*[F.xxhash64(*[F.get(a, i + k).getField(c) for k in range(WINDOW)]).alias(c) for c in "hk"]))
    hashed = bound_once(seen, lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - WINDOW), lambda i: three(a, i)))
    many = F.length(text_col) - F.length(F.translate(text_col, "\n", "")) >= WINDOW - 1
    d = docs.where(many).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.posexplode(hashed).alias("pos", "w"))
    return d.where("w IS NOT NULL")


def removed_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text that loses lines: _id, _h, starts (sorted window starts that are later occurrences)."""
    w = saved(windows(docs, id_col, text_col), "line-windows")  # texts are split once
    at = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_h").alias("h"), F.col("pos").alias("p"))
    first = w.groupBy("w").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last")
    later = w.join(first, "w").where(at != F.col("first")).select("_id", "_h", "pos").distinct()
    return later.groupBy("_id", "_h").agg(F.sort_array(F.collect_list("pos")).alias("starts"))


def without_lines(text: Column, starts: Column) -> Column:
    """The text without the lines that any window in starts covers."""
    gone = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (WINDOW - 1)))))
    kept = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone)
    return bound_once(F.split(text, "\n"), lambda ls: F.array_join(F.transform(kept(ls), lambda i: F.get(ls, i)), "\n"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with text cleaned, and _n_lines_removed (0 where nothing went)."""
    gone = removed_windows(docs, id_col, text_col).withColumnsRenamed({"_id": "__ld_id", "_h": "__ld_h", "starts": "__ld_starts"})
    d = docs.withColumn("__ld_hash", F.xxhash64(text_col))
    j = d.join(gone, d[id_col].eqNullSafe(gone["__ld_id"]) & (F.col("__ld_hash") == F.col("__ld_h")), "left")
    cleaned = F.when(F.col("__ld_starts").isNull(), F.col(text_col)).otherwise(without_lines(F.col(text_col), F.col("__ld_starts")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("__ld_starts", lambda s: F.sequence(s, s + (WINDOW - 1))))))
    j = j.withColumn("_n_lines_removed", F.when(F.col("__ld_starts").isNull(), 0).otherwise(covered).cast("long"))
    return j.withColumn(text_col, cleaned).select(*docs.columns, "_n_lines_removed")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup(read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("_n_lines_removed").alias("n_lines_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("kept_md5"))


LINES_SQL = r"""lines_of AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {docs} WHERE text IS NOT NULL),
wins AS (SELECT doc_id, text, p, ls[p + 1] || chr(10) || ls[p + 2] || chr(10) || ls[p + 3] AS w FROM (SELECT *, unnest(range(len(ls) - 2)) AS p FROM lines_of WHERE len(ls) >= 3)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM wins WHERE length(translate(w, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0),
gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM ranked WHERE k > 1),
all_lines AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS p FROM lines_of),
stay AS (SELECT a.doc_id, string_agg(x, chr(10) ORDER BY a.p) AS text FROM all_lines a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id),
n_gone AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
cleaned AS (SELECT d.* REPLACE (CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text), coalesce(n.n, 0)::BIGINT AS n_lines_removed
  FROM {docs} d LEFT JOIN stay s ON d.doc_id = s.doc_id LEFT JOIN n_gone n ON d.doc_id = n.doc_id)"""

OP8_SQL = "WITH " + LINES_SQL.format(docs="documents") + " SELECT doc_id, n_lines_removed, length(text)::BIGINT AS n_chars_kept, md5(text) AS kept_md5 FROM cleaned"
