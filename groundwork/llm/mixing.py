"""Mixing sources to target weights: hash-random keys, range sort, prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundwork.llm.common import materialize, word_count

KEY_BITS = 60
_ROW = ["key", "doc_id", "sig"]


def order_key(doc_id: str = "doc_id", seed: str = "mix") -> Column:
    """A random-looking place in the order of a source: 60 bits of an MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint")


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select("doc_id", "source", order_key(seed=seed).alias("key"), F.xxhash64("text").alias("sig"), word_count(F.col("text")).alias("size"))


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 2) -> DataFrame:
    """Targets of ``source, source_size``: weights repeat over the sources in code point
    order, null last; together they get ``share`` of all sizes, none more than
    ``max_epochs`` times its size, and what a full source leaves goes to the others by
    weight. All that are not full get the same amount per weight, so one sorted pass
    finds it. There is one row per source here."""
    every, rank = W.partitionBy(), F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    own = sizes.withColumn("weight", weight).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    own = own.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    others = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(every) - capped) / others
    own = own.withColumn("level", level).withColumn("place", F.row_number().over(order))
    own = own.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.col("place"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return own.select("source", "source_size", target.alias("target"))


def source_cuts(sized: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 2, bucket_bits: int = 12) -> DataFrame:
    """From ``_sized`` rows one row per source: ``target``, whole ``epochs``, and where the last, partial epoch ends.

    Rows are range partitioned by source and key range, so a source of any size is
    spread; each range is sorted and summed, the ranges' totals are summed along the
    source, and the row at which the budget runs out is the cut: the order fields of
    that row, ``cut_left`` words for each row equal to it, and ``cut_whole``: whether
    most of it fits. Rows equal in all order fields share the cut evenly.
    """
    dealt = sized.withColumn("bucket", F.shiftright("key", KEY_BITS - bucket_bits)).repartitionByRange("source", "bucket")
    ranges = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    along = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ranges = materialize(ranges.withColumn("offset", F.coalesce(F.sum("words").over(along), F.lit(0))), "mix-ranges")
    totals = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    plans = source_targets(totals, share, weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1))).cast("int")).otherwise(F.lit(0))
    plans = materialize(plans.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-targets")
    same = lambda a, b, *names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    crossed = ranges.alias("r").join(plans.alias("p"), same("r", "p", "source")).filter("r.offset < p.rest AND p.rest <= r.offset + r.words")
    crossed = crossed.select("r.source", "r.bucket", "r.offset", "p.rest")
    near = dealt.alias("d").join(crossed.alias("c"), same("d", "c", "source", "bucket")).select("d.source", *[f"d.{c}" for c in _ROW], "d.size", "c.offset", "c.rest")
    sums = W.partitionBy("source").orderBy(*_ROW)
    near = near.withColumn("upto", F.col("offset") + F.sum("size").over(sums)).withColumn("peers", F.count("*").over(W.partitionBy("source", *_ROW)))
    near = near.withColumn("before", F.col("upto") - F.col("peers") * F.col("size")).filter("before < rest AND rest <= upto")
    cut = near.groupBy("source").agg(
        F.first(F.struct(*_ROW)).alias("cut"),
        F.first(F.floor((F.col("rest") - F.col("before")) / F.col("peers")).cast("bigint")).alias("cut_left"),
        F.first((F.col("rest") - F.col("before")) * 2 >= F.col("upto") - F.col("before")).alias("cut_whole"),
    )
    joined = plans.alias("p").join(cut.alias("k"), same("p", "k", "source"), "left")
    return joined.select("p.source", "p.source_size", "p.target", "p.epochs", "p.rest", *[F.col(f"k.cut.{c}").alias(f"cut_{c}") for c in _ROW], F.col("k.cut.key").isNotNull().alias("has_cut"), "k.cut_left", "k.cut_whole")


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with order fields beside their source's cut. The cuts are a stored table with
    one row per source, so the planner knows its size."""
    cuts = materialize(cuts, "mix-cuts").withColumnRenamed("source", "cut_source")
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")))


def _place() -> tuple[Column, Column]:
    """Whether a row comes before its source's cut, and whether it is the cut. Null ids sort first."""
    pair = lambda prefix: F.struct(*[F.col(prefix + c).alias(c) for c in _ROW])
    return F.col("has_cut") & (pair("") < pair("cut_")), F.col("has_cut") & pair("").eqNullSafe(pair("cut_"))


def taken_words(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """Per row ``doc_id, size, source_size, target, taken``: the words that the mix takes.

    Each source gives all its documents ``epochs`` times and, in the order of their
    hash-random keys, further documents up to its exact budget; the last of them gives
    only the words that are left. No document gives more than ``max_epochs`` times its
    size. Null texts have size 0; a null source is a source. Nothing depends on the
    partitioning, so reruns agree.
    """
    sized = materialize(_sized(docs, seed), "mix-sizes")
    early, at = _place()
    taken = F.col("epochs") * F.col("size") + F.when(early, F.col("size")).when(at, F.col("cut_left")).otherwise(F.lit(0))
    return _with_cuts(sized, source_cuts(sized, **options)).select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, with the columns of
    ``docs``. Documents stay whole: the one at a source's cut is taken if at least half
    of it fits, so a source is off its budget by half a document at most."""
    sized = materialize(_sized(docs, seed), "mix-sizes")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", order_key(seed=seed).alias("key"), F.xxhash64("text").alias("sig"))
    early, at = _place()
    copies = F.col("epochs") + F.when(early | (at & F.col("cut_whole")), F.lit(1)).otherwise(F.lit(0))
    return _with_cuts(whole, source_cuts(sized, **options)).select("row", F.explode(F.sequence(F.lit(0), copies)).alias("copy")).filter("copy > 0").select("row.*")
