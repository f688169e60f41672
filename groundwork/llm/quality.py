"""Quality rules: text statistics and a hashed n-gram likelihood ratio, on SQL functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from groundwork.llm.common import WORD, word_list

WINDOW = 8


def word_statistics(text: str = "text") -> dict[str, Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a column, beside the
    columns of ``with_words``."""
    value, lines = F.coalesce(F.col(text), F.lit("")), F.col("_lines")
    return {
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.char_length(F.concat_ws("", "_words")).cast("bigint"),
        "n_symbols": F.regexp_count(value, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": _repeated_words().cast("bigint"),
    }


def with_hashes(docs: DataFrame) -> DataFrame:
    """Adds ``_words`` and the hashes ``_h1`` of words and ``_h2`` of word pairs. Every array
    here is a column of its own, so that it is computed once per row."""
    out = docs.withColumn("_words", word_list(F.col("text"))).withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    return out.withColumn("_h2", _paired(F.col("_h1"), 1))


def with_words(docs: DataFrame) -> DataFrame:
    """``with_hashes``, the hashes ``_windows`` of all 8-word windows, where windows that occur
    twice start (``_starts``, null if none does) and the lines with a word (``_lines``)."""
    out = with_hashes(docs)
    for step, name in ((2, "_h4"), (4, "_windows")):
        out = out.withColumn(name, _paired(F.col(f"_h{step}"), step))
    n = F.size("_windows")
    placed = F.array_sort(F.zip_with("_windows", F.sequence(F.lit(1), n), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < n, placed))
    m = F.size("_placed")
    pairs = F.zip_with(F.slice("_placed", 1, m - 1), F.slice("_placed", 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    out = out.withColumn("_starts", F.when(F.col("_placed").isNotNull(), starts)).drop("_h4", "_placed")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return out.withColumn("_lines", F.filter(lines, lambda line: line.rlike(WORD)))


def _paired(values: Column, step: int) -> Column:
    """Hash of each value with the one ``step`` places later."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 1 + step, n), lambda a, b: F.xxhash64(a, b))


def _repeated_words() -> Column:
    """Words inside 8-word windows that occur twice or more, from the sorted ``_starts`` of
    such windows: what lies between two starts, a window's length at most."""
    starts = F.col("_starts")
    following = F.concat(F.slice(starts, 2, F.size(starts) - 1), F.array(F.element_at(starts, -1) + WINDOW))
    covered = F.aggregate(F.zip_with(starts, following, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda total, x: total + x)
    return F.when(starts.isNotNull(), covered).otherwise(F.lit(0))


def _bucket(h: Column, n: int) -> Column:
    return F.pmod(h, F.lit(n)).cast("int")


def log_ratio_column(ratios: list[float]) -> Column:
    """The model as one constant array: it has as many entries as there are buckets."""
    return F.from_json(F.lit(json.dumps(ratios)), "array<double>")


def score_column(ratios: list[float]) -> Column:
    """Mean log-likelihood ratio over the words and word pairs of ``with_hashes``; null
    without words."""
    model, m, n = log_ratio_column(ratios), len(ratios), F.size("_h1")
    add = lambda total, h: total + F.get(model, _bucket(h, m))
    return F.when(n > 0, F.aggregate("_h2", F.aggregate("_h1", F.lit(0.0), add), add) / (n + F.size("_h2")))


def labelled_sample(labels: DataFrame, per_class: int) -> DataFrame:
    """``doc_id, trusted``: at most ``per_class`` trusted and as many rejected documents,
    those with the smallest hashes. Trusted: quality 1 and not toxic; rejected: quality 0.
    A document that is labelled more than once counts as its worst label."""
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    pick = lambda rows: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    good = pick(one.filter((F.col("q") == 1) & (F.col("t") == 0)).select("doc_id")).withColumn("trusted", F.lit(True))
    bad = pick(one.filter(F.col("q") == 0).select("doc_id")).withColumn("trusted", F.lit(False))
    return good.unionByName(bad)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 10_000, per_class: int = 20_000, keep_share: float = 0.995, slack: float = 0.1, folds: int = 5) -> tuple[list[float], float]:
    """Log ratios per bucket and the threshold.

    The raw multinomial counts every word and word pair of all documents; the target one
    those of the trusted sample (``labelled_sample``; bounded by ``per_class``, so it is
    broadcast) outside one of ``folds`` parts. On that part the threshold is set: the
    score that ``keep_share`` of its trusted documents reach, lowered by ``slack`` of the
    way to the median of its rejected ones. Without trusted documents the model is empty
    and every score passes.
    """
    sample = labelled_sample(labels, per_class).withColumn("test", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)) == 0)
    sample = F.broadcast(sample)
    own = docs.select("doc_id", "text").join(sample, "doc_id", "left")
    own = with_hashes(own.select("text", (F.col("trusted") & ~F.col("test")).alias("learned"))).select("learned", F.concat("_h1", "_h2").alias("h"))
    features = own.select("learned", F.explode("h").alias("h")).select("learned", _bucket(F.col("h"), buckets).alias("bucket"))
    counts = features.groupBy("bucket").agg(F.count("*").alias("raw"), F.count(F.when(F.col("learned"), 1)).alias("target"))
    raw, target = [1] * buckets, [1] * buckets
    for r in counts.collect():  # at most one row per bucket
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if sum(target) == buckets:
        return [0.0] * buckets, -math.inf
    shift = math.log(sum(raw)) - math.log(sum(target))
    ratios = [round(math.log(t) - math.log(r) + shift, 9) for t, r in zip(target, raw, strict=True)]
    tested = docs.select("doc_id", "text").join(sample.filter("test"), "doc_id").select("trusted", "text")
    scored = with_hashes(tested).select("trusted", score_column(ratios).alias("score"))
    marks = scored.agg(F.percentile(F.when(F.col("trusted"), F.col("score")), F.lit(1 - keep_share)).alias("good"), F.percentile(F.when(~F.col("trusted"), F.col("score")), F.lit(0.5)).alias("bad")).first()
    if marks["good"] is None:
        return ratios, -math.inf
    bad = marks["good"] if marks["bad"] is None else min(marks["bad"], marks["good"])
    return ratios, marks["good"] - slack * (marks["good"] - bad)


def judge(docs: DataFrame, model: tuple[list[float], float]) -> DataFrame:
    """Every row of ``docs`` as the struct ``row`` with its statistics, ``score``, ``base_failed``
    and ``kept``. Null or blank texts have no words and fail the base rules; no row is
    dropped. The input's columns stay inside the struct, so their names can't clash."""
    ratios, threshold = model
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    stats = word_statistics()
    out = with_words(whole).select("row", *[v.alias(k) for k, v in stats.items()], score_column(ratios).alias("score"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    passed = F.col("score") >= F.lit(threshold)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(passed, F.lit(False)))


def kept_documents(docs: DataFrame, model: tuple[list[float], float]) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept. The optimizer would move a plain
    filter below the columns it rests on and write each of them out several times; it
    leaves a filter alone that also reads a row number."""
    judged = judge(docs, model).select("row", "kept", F.monotonically_increasing_id().alias("place"))
    return judged.filter("kept AND place >= 0").select("row.*")
