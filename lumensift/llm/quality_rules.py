"""Quality rules by weak supervision (DataFrame functions only).

Rules vote good, bad or abstain on every text. None of them is trusted by itself: expectation-maximisation over the
counts of vote patterns estimates the share of good texts and how often each rule is right on texts of either class,
and a text is kept when its posterior probability of being good reaches a threshold. Rules overlap and are noisy (a
short text, a list without full stops or a text with some repeats is not bad by that alone); how much a vote counts is
learned, so there is no all-must-pass filter.

Scale: one pass over the texts writes a narrow table of counts; the model is fitted on counts of distinct vote
patterns (at most 3 ** number of rules rows, whatever the corpus), and a second pass over the narrow table scores.
No shuffle moves text.

Defined results: null and empty texts have zero words and fail the base test; very long texts are handled whole;
repeated rows each get the same row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_RUN, bound_once, read, saved

GOOD, BAD, ABSTAIN = 1, 0, 2
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
VISIBLE = r"[^ \t\x0B\f\r]"  # within a line
SMOOTHING = 1.0  # votes of each kind that every rule is taken to have cast beforehand, in either class


def window_hashes(w: Column) -> Column:
    """Hashes of all windows of WINDOW = 2 * 2 * 2 words: words are hashed once, then neighbours are combined by pairs,
    fours and eights."""

    def combined(step: int):
        # the last `step` places have no partner and are cut off
        return lambda a: F.slice(F.zip_with(a, F.slice(a, step + 1, F.size(a)), lambda x, y: F.xxhash64(x, y)), F.lit(1), F.size(a) - step)

    h = F.transform(w, lambda x: F.xxhash64(x))
    for step in (1, 2, 4):
        h = bound_once(h, combined(step))
    return h


def repeated_words(w: Column) -> Column:
    """Number of words that lie in a window of WINDOW words found twice or more in the array."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j).getField("h") == x.getField("h"), F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x.getField("i")))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a.getField("n") + p + WINDOW - F.greatest(p, a.getField("end"))).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(bound_once(pairs, starts), zero, step, lambda a: a.getField("n"))

    counted = bound_once(window_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(w) > WINDOW, counted).otherwise(F.lit(0)).cast("long")


def count_of(chars: str) -> Column:
    """Number of characters of a regular expression's class in the text: what is left without all runs of others."""
    return F.length(F.regexp_replace("_t", f"[^{chars}]+", "")).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document that the base test and the rules read."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select("doc_id", "_t", F.array_remove(F.split("_t", BLANK_RUN), "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(VISIBLE)).alias("_l"))
    return d.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count_of(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        count_of(r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E").alias("n_marks"),
        count_of("|").alias("n_bars"),
        count_of("!").alias("n_bangs"),
        count_of("A-Z").alias("n_upper"),
        F.size(F.filter("_l", lambda x: x.rlike("[.!?…:;\"'»)][ \\t\\r]*$"))).cast("long").alias("n_ended"),
    )


def _rule(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Named votes over the columns of features(); each compares counts, so no division by zero can arise."""
    c = F.col
    return {
        "symbols": _rule(10 * c("n_symbols") > c("n_words"), 50 * c("n_symbols") <= c("n_words")),
        "bars": _rule(20 * c("n_bars") > c("n_words"), c("n_bars") == 0),
        "bangs": _rule(10 * c("n_bangs") > c("n_words"), 50 * c("n_bangs") <= c("n_words")),
        "capitals": _rule(10 * c("n_upper") > 3 * c("word_chars"), 10 * c("n_upper") <= c("word_chars")),
        "marks": _rule(100 * c("n_marks") > 13 * c("word_chars"), 100 * c("n_marks") <= 8 * c("word_chars")),
        "repetition": _rule((10 * c("n_dup_lines") > 2 * c("n_lines")) | (10 * c("n_repeat_words") > c("n_words")), (c("n_dup_lines") == 0) & (c("n_repeat_words") == 0) & (c("n_words") >= 100)),
        "sentences": _rule(10 * c("n_ended") < 6 * c("n_lines"), (10 * c("n_ended") >= 9 * c("n_lines")) & (c("n_lines") >= 3)),
        "length": _rule(c("n_words") < 50, c("n_words") >= 100),
        "word_length": _rule((c("word_chars") < 4 * c("n_words")) | (c("word_chars") > 9 * c("n_words")), (2 * c("word_chars") >= 9 * c("n_words")) & (c("word_chars") <= 8 * c("n_words"))),
    }


def fit(patterns: list[tuple[str, int]], n_rules: int, rounds: int = 500) -> dict:
    """EM over (vote pattern, count) rows: class prior and, per class and rule, the chance that a cast vote is bad.

    An abstention says nothing about the class. The start gives each text the share of good votes among its own, which
    names the classes; from there on rates are free but for the smoothing.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return {"prior": 0.5, "bad": [[0.5] * n_rules] * 2}
    cast = [[(r, int(v) == BAD) for r, v in enumerate(p) if int(v) != ABSTAIN] for p, _ in patterns]
    soft = [(p.count(str(GOOD)) + 1) / (p.count(str(GOOD)) + p.count(str(BAD)) + 2) for p, _ in patterns]
    model: dict = {}
    for _ in range(rounds):
        bad = [[0.0] * n_rules, [0.0] * n_rules]
        votes = [[0.0] * n_rules, [0.0] * n_rules]
        for c, s, (_, n) in zip(cast, soft, patterns, strict=True):
            for cls, w in ((GOOD, n * s), (BAD, n * (1 - s))):
                for r, is_bad in c:
                    votes[cls][r] += w
                    bad[cls][r] += w * is_bad
        rates = [[(x + SMOOTHING) / (n + 2 * SMOOTHING) for x, n in zip(bad[cls], votes[cls], strict=True)] for cls in (BAD, GOOD)]
        mass = sum(s * n for (_, n), s in zip(patterns, soft, strict=True))
        model = {"prior": (mass + 1) / (total + 2), "bad": rates}
        before, soft = soft, [posterior(model, p) for p, _ in patterns]
        if max(abs(x - y) for x, y in zip(before, soft, strict=True)) < 1e-6:
            break
    return model


def evidence(model: dict, r: int) -> tuple[float, float]:
    """Log odds of good after rule r votes bad, or good."""
    b, g = model["bad"][BAD][r], model["bad"][GOOD][r]
    return math.log(g / b), math.log((1 - g) / (1 - b))


def posterior(model: dict, pattern: str) -> float:
    z = math.log(model["prior"] / (1 - model["prior"])) + sum(evidence(model, r)[int(v)] for r, v in enumerate(pattern) if int(v) != ABSTAIN)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def posterior_column(model: dict, votes: list[str]) -> Column:
    z = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, name in enumerate(votes):
        bad, good = evidence(model, r)
        z = z + F.when(F.col(name) == BAD, bad).when(F.col(name) == GOOD, good).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: the base counts, base_failed, every rule's vote, the posterior p_good, and kept.

    The model is fitted on the texts that pass the base test, as the others are decided.
    """
    votes = {f"vote_{k}": v.cast("int") for k, v in rules().items()}
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    table = saved(features(docs, id_col, text_col).withColumns(votes | {"base_failed": failed}), "quality-rules")
    names = list(votes)
    counted = table.where("NOT base_failed").groupBy(F.concat(*[F.col(n).cast("string") for n in names]).alias("p")).count()
    model = fit(sorted((r["p"], r["count"]) for r in counted.collect()), len(names))  # at most 3 ** rules rows
    return (
        table.withColumn("p_good", posterior_column(model, names))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", *names)
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))
