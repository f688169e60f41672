"""Joins and numbering that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from groundwork.session import materialize

HOT_ROWS = 50_000
HOT_SHARE = 1000
#: Rows up to which the planner may broadcast a stored table.
FEW_ROWS = 100_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition an input that has fewer partitions than there are cores before
    CPU-heavy row work; others already are spread and stay untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def sized(df: DataFrame, few: int = FEW_ROWS) -> DataFrame:
    """A stored table that is not broadcast when it has more than ``few`` rows. Repetitive
    rows may take a thousand times less in Parquet than in the hash table that the driver
    would build after the size of the files."""
    return df if df.limit(few + 1).count() <= few else df.hint("merge")


def hot_values(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> dict:
    """Counts of the key values with at least max(min_rows, total / 1000) rows: never more
    than 1,000 values, whatever the size of the table. Counts are combined map-side."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    top = counts.orderBy(F.desc("_n")).limit(HOT_SHARE).collect()
    if not top:
        return {}
    total = df.count()
    return {r[key]: r["_n"] for r in top if r["_n"] >= max(min_rows, total / HOT_SHARE)}


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread_by: str, how: str = "inner", min_rows: int = HOT_ROWS) -> DataFrame:
    """Join with a right side that has one row per key. A hot key's rows on the left are
    spread over as many partitions as its count fills with ``min_rows`` rows each; only
    the hot right rows are replicated."""
    hot = hot_values(left, key, min_rows)
    if not hot:
        return left.join(right, key, how)
    parts = F.create_map(*[F.lit(x) for value, n in hot.items() for x in (value, -(-n // min_rows))])
    width = F.coalesce(F.try_element_at(parts, F.col(key)), F.lit(1))
    salt = F.pmod(F.xxhash64(spread_by), width).cast("int")
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), width.cast("int") - 1)))
    return left.withColumn("_salt", salt).join(salted_right, [key, "_salt"], how).drop("_salt")


def with_dense_index(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Number the rows 0..n-1 in ``order`` without a single-partition window: range
    partitions are numbered apart and shifted by the counts before them."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "index")
    counts = parts.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(W.partitionBy("_pid").orderBy(*order))
    return (
        parts.withColumn("_rn", rank)
        .join(offsets, "_pid")
        .withColumn(name, F.col("_off") + F.col("_rn") - 1 + start)
        .drop("_pid", "_rn", "_off")
    )


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key. The rank filter lets Spark keep only k rows per key
    and task before the shuffle, so a hot key never arrives whole."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")
