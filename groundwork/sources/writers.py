"""Corpus, state and export writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EXPORT_LIMIT = 5000


def canonical_value(name: str, kind: str) -> Column:
    """A column's value as text that any engine can write: numbers with a fraction with six
    digits after the point, times as microseconds, arrays in brackets; ``-`` for null."""
    value = F.col(f"`{name}`")
    six = lambda x: x.cast("double").cast("decimal(38,6)").cast("string")
    if kind in ("double", "float"):
        text = six(value)
    elif kind.startswith("timestamp"):
        text = F.unix_micros(value.cast("timestamp")).cast("string")
    elif kind in ("array<float>", "array<double>"):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, six), ","), F.lit("]"))
    elif kind.startswith(("array", "struct", "map", "variant")):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("-"))


def content_digest(df: DataFrame) -> list[Column]:
    """Order-free digest of the rows, as aggregates: the xor and the sum of the first 60 bits
    of every row's SHA-256 over its canonical values, joined by ``|``."""
    row = F.sha2(F.concat_ws("|", *[canonical_value(c, t) for c, t in df.dtypes]), 256)
    head = F.conv(F.substring(row, 1, 15), 16, 10).cast("bigint")
    return [F.coalesce(F.bit_xor(head), F.lit(0)).cast("string").alias("xor_hash"), F.coalesce(F.sum(head.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hash")]


def digest_of(df: DataFrame) -> DataFrame:
    """One row with ``sha256``: the digest of the number of rows, their xor and their sum."""
    parts = df.agg(F.count("*").cast("string").alias("n"), *content_digest(df))
    return parts.select(F.sha2(F.concat_ws(":", "n", "xor_hash", "sum_hash"), 256).alias("sha256"))


def write_corpus(accepted: DataFrame, stats: DataFrame, path: str, format: str = "json", source_id: str | None = None, inputs: DataFrame | None = None) -> DataFrame:
    """Write the accepted records and one state row of counts, source, content digests of
    input and output (see ``digest_of``) and paths beside them. The output's digest is
    taken from the records as they were written."""
    spark = accepted.sparkSession
    accepted.write.format(format).mode("errorifexists").save(f"{path}/records")
    written = spark.read.schema(accepted.schema).format(format).load(f"{path}/records")
    state = stats.withColumns(
        {
            "source_id": F.lit(source_id).cast("string"),
            "input_sha256": F.lit(None).cast("string") if inputs is None else digest_of(inputs).scalar(),
            "output_sha256": digest_of(written).scalar(),
            "output_path": F.lit(f"{path}/records"), "format": F.lit(format),
        }
    )
    state.write.mode("errorifexists").json(f"{path}/state")
    return spark.read.schema(state.schema).json(f"{path}/state")


def export_samples(df: DataFrame, limit: int | None, order: list[str], split: str | None = None) -> DataFrame:
    """JSON rows in order: the first ``limit`` of them, all if it is None. The usual page
    is ``EXPORT_LIMIT`` rows."""
    rows = df if split is None else df.filter(F.col("split") == split)
    rows = rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(limit)
    return rows.select(*order, F.to_json(F.struct(*df.columns)).alias("sample"))


def inventory(tables: dict[str, DataFrame], digest: bool = False) -> DataFrame:
    """Per table rows, ordered column list and optionally an order-free content digest (see
    ``content_digest``)."""
    out = None
    for name, df in tables.items():
        aggs = [F.count("*").alias("rows")] + (content_digest(df) if digest else [])
        one = df.agg(*aggs).select(F.lit(name).alias("table"), F.lit(",".join(df.columns)).alias("columns"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("covered", F.col("rows") > 0)


def corpus_manifest(sources: DataFrame, by: list[str] = ()) -> DataFrame:
    """Totals over sources and completeness flags. ``sources``: source, pages,
    indexed_pages, images, indexed_images, text_chars."""
    totals = sources.groupBy(*by).agg(F.count("*").alias("sources"), *[F.sum(c).alias(c) for c in ("pages", "indexed_pages", "images", "indexed_images", "text_chars")])
    return totals.withColumns({"all_pages_indexed": F.col("pages") == F.col("indexed_pages"), "all_images_indexed": F.col("images") == F.col("indexed_images")})
