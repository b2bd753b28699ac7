"""Mixing sources to target weights as a time-varying curriculum (DataFrame and SQL functions only).

Each source has a weight schedule over training time t in [0, 1]: w(t) = w * (1 + ramp * (2t - 1)). Its integral is
the source's cumulative token demand, target * (t + ramp * (t * t - t)); inverting it turns a cumulative token offset
within the source into a training time, and a range sort of all document occurrences by that time is the training
order. A source is passed over up to `max_epochs` times; its last pass stops where the target is met, inside a
document if need be, so that a source's taken words miss its target by less than one word.

Scale: prefix sums over a source are two-level (a source's documents are dealt into 4096 ranges of a digest; range
totals are summed first), so a source with a third of all rows is spread over thousands of groups. Texts are read
once and only their word counts are shuffled.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, sorted last;
repeated rows are ordered by size after id and digest; an empty table gives an empty result; sources with no words
have target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, read, saved

MAX_EPOCHS = 3
#: Production ramps by a source's weight: light sources fade over training, heavy ones grow.
RAMPS = {1.0: -0.5, 2.0: 0.0, 3.0: 0.5}
RANGE_DIGITS = 3  # hexadecimal digits of the digest: 4096 ranges a source


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Weights 1, 2, 3 repeat over the sources by code point, null last. Targets share all words by weight; a target
    over max_epochs times its source is cut and the excess goes to the others by weight. Sources sorted by cap over
    weight fill up first, so prefix sums find the level at which the rest share (one row per source is windowed).
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = s.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("_cap", (max_epochs * F.col("source_size")).cast("double"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = s.withColumns(
        {
            "_total": F.sum("source_size").over(everything).cast("double"),
            "_w_all": F.sum("weight").over(everything),
            "_cap_before": F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_w_before": F.coalesce(F.sum("weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        }
    )
    level = (F.col("_total") - F.col("_cap_before")) / (F.col("_w_all") - F.col("_w_before"))
    # levels fall after the first source (by ratio) whose cap is not under its share: the largest such level is final
    s = s.withColumn("_level", F.max(F.when(F.col("_cap") >= level * F.col("weight"), level)).over(everything))
    s = s.withColumn("target", F.when(F.col("_cap") <= F.col("_level") * F.col("weight"), F.col("_cap")).otherwise(F.col("_level") * F.col("weight")))
    return s.select("source", "source_size", "weight", "target")


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, _offset (words of its source before it), _weight."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.md5(F.col(id_col).cast("string")).alias("_digest"), F.xxhash64(text_col).alias("_tie"))
    d = saved(d, "mix-sizes")  # narrow: the texts are read and split once
    d = d.withColumn("_range", F.substring(F.coalesce("_digest", F.lit("")), 1, RANGE_DIGITS))
    targets = source_targets(d.select("source", "size"), max_epochs)
    ranges = d.groupBy("source", "_range").agg(F.sum("size").alias("_range_size"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_range_size").over(before), F.lit(0)))
    ranges = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "_range", "_before", "source_size", "target", "weight")
    within = Window.partitionBy("source", "_range").orderBy("_digest", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.alias("d").join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d._range") == F.col("r._range")))
    offset = F.col("_before") + F.col("_within")
    whole = F.floor("target")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), whole - (e * F.col("source_size") + offset))) for e in range(max_epochs)), F.lit(0))
    return d.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"), offset.alias("_offset"), F.col("weight").alias("_weight"))


def position(demand, target, ramp: float):
    """Training time at which a source's cumulative demand reaches `demand` words: the inverse of the integrated schedule."""
    share = F.when(target > 0, F.least(demand / target, F.lit(1.0))).otherwise(F.lit(0.0))
    if ramp == 0:
        return share
    b = 1 - ramp
    return (-b + F.sqrt(b * b + 4 * ramp * share)) / (2 * ramp)


def passes(docs: DataFrame, ramps: dict[str, float] | None = None, max_epochs: int = MAX_EPOCHS, **columns) -> DataFrame:
    """The rows of place() and passes: array of (epoch, words, position) of each pass, words 0 and no position where none is taken.

    ramps: by source, between -1 and 1, how its weight falls or rises over training, 0 where absent; None: RAMPS by weight.
    """
    for k, r in (ramps or {}).items():
        if not -1 <= r <= 1:
            raise ValueError(f"ramp of {k!r} must lie between -1 and 1")
    rules = [(F.col("_weight") == w, r) for w, r in RAMPS.items()] if ramps is None else [(F.col("source") == s, r) for s, r in ramps.items()]
    d = place(docs, max_epochs=max_epochs, **columns)
    each = []
    for e in range(max_epochs):
        start = F.lit(e) * F.col("source_size") + F.col("_offset")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start)).cast("long")
        at = position(start, F.col("target"), 0.0)
        for rule, ramp in rules:
            at = F.when(rule, position(start, F.col("target"), ramp)).otherwise(at)
        each.append(F.struct(F.lit(e).alias("epoch"), words.alias("words"), F.when(words > 0, at).alias("position")))
    return d.withColumn("passes", F.array(*each))


def curriculum(docs: DataFrame, ramps: dict[str, float] | None = None, max_epochs: int = MAX_EPOCHS, **columns) -> DataFrame:
    """One row per document occurrence taken: doc_id, source, epoch, words, position (range-sorted by position)."""
    d = passes(docs, ramps, max_epochs, **columns).select("doc_id", "source", F.inline("passes"))
    return d.where("words > 0").sort("position", "source", "doc_id", "epoch")


def ordered(docs: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document, those with nothing taken too and last, range-sorted by their first training position:
    doc_id, source, size, source_size, target, taken (the words of all passes), position_1, position_2, ..."""
    d = passes(docs, max_epochs=max_epochs)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    at = [F.col("passes")[e]["position"].alias(f"position_{e + 1}") for e in range(max_epochs)]
    d = d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *at)
    return d.sort(F.col("position_1").asc_nulls_last(), "source", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns in training order, and the training position of each pass over a document."""
    return ordered(read(spark, sf_dir, "documents")).drop("source")


SIZE_SQL = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w != ''))"

MIX_SQL = """
, sized AS (SELECT doc_id, source, {size}::BIGINT AS size, text FROM {docs}),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM per_source),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS lev FROM weighted
  WINDOW before AS (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fixed AS (SELECT *, max(CASE WHEN cap >= lev * weight THEN lev END) OVER () AS final FROM levels),
targets AS (SELECT source, source_size, CASE WHEN cap <= final * weight THEN cap ELSE final * weight END AS target FROM fixed),
placed AS (SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM sized s),
mixed AS (SELECT p.doc_id, p.text, p.source, p.size, t.source_size, t.target,
  (greatest(0, least(p.size, floor(target) - off)) + greatest(0, least(p.size, floor(target) - source_size - off)) + greatest(0, least(p.size, floor(target) - 2 * source_size - off)))::BIGINT AS taken
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
"""

_PASS = """CASE WHEN least(m.size, floor(m.target) - {e} * m.source_size - p.off) > 0 THEN {at} END AS position_{n}"""
_SHARE = "least(({e} * m.source_size + p.off) / m.target, 1.0::DOUBLE)"
_AT = f"CASE w.weight WHEN 1 THEN (-1.5::DOUBLE + sqrt(1.5::DOUBLE * 1.5::DOUBLE + -2.0::DOUBLE * {_SHARE})) / -1.0::DOUBLE WHEN 3 THEN (-0.5::DOUBLE + sqrt(0.5::DOUBLE * 0.5::DOUBLE + 2.0::DOUBLE * {_SHARE})) / 1.0::DOUBLE ELSE {_SHARE} END"

OP6_SQL = (
    "WITH base AS (SELECT 1)"
    + MIX_SQL.format(size=SIZE_SQL, docs="documents")
    + "SELECT m.doc_id, m.size, m.source_size, m.target, m.taken, "
    + ", ".join(_PASS.format(e=e, n=e + 1, at=_AT.format(e=e)) for e in range(3))
    + " FROM mixed m JOIN placed p ON m.doc_id = p.doc_id JOIN weighted w ON m.source IS NOT DISTINCT FROM w.source"
)
