"""Sharding by vector bin packing of text groups over bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from groundwork.llm.common import word_count

DIMS = ["bytes", "tokens", "rows"]


def _vectors(docs: DataFrame, *keep) -> DataFrame:
    """Size vector and text hash of each row beside the columns ``keep``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    return docs.select(
        *keep,
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(1), "text").alias("h2"),
        F.col("doc_id").alias("_id"),
        size.cast("bigint").alias("bytes"),
        word_count(F.col("text")).alias("tokens"),
        F.lit(1).cast("bigint").alias("rows"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"),
    )


def _sums() -> list:
    return [F.sum(d).cast("bigint").alias(d) for d in DIMS]


def _with_piece(vectors: DataFrame, large: DataFrame, pieces: int) -> DataFrame:
    """Adds ``piece``: small groups by text hash, the rows of a large one over its parts."""
    own = vectors.join(F.broadcast(large), ["h1", "h2"], "left")
    part = F.col("first_piece") + F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int")
    return own.withColumn("piece", F.coalesce(part, F.pmod("h1", F.lit(pieces)).cast("int"))).drop("first_piece", "parts")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of an item-by-dimension array of sizes, as shares of all).

    Items go largest first to the shard where the dot product with the residual capacity
    is highest. Ties take the lowest shard."""
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        out[i] = np.argmax(residual @ items[i])
        residual[out[i]] -= items[i]
    return out


def shard_plan(docs: DataFrame, shards: int = 24, pieces: int = 6144) -> tuple[DataFrame, DataFrame]:
    """``large`` (h1, h2, first_piece, parts) and ``map`` (piece, shard, first_slot).

    Groups of equal texts are the units. Groups above a ``pieces``-th of all bytes, tokens
    or rows are large: there are at most three times ``pieces`` of them, whatever the
    table. The others are gathered by hash into ``pieces`` pieces. A large group is dealt
    into parts of about one piece, so no task ever gets a whole hot group; its parts stay
    together if they fit into half a shard and are placed one by one if they don't, since
    no balance could be kept otherwise. Only these bounded tables reach the driver.
    """
    spark = docs.sparkSession
    vectors = _vectors(docs)
    groups = vectors.groupBy("h1", "h2").agg(*_sums())
    total = groups.agg(*_sums()).first()
    sums = np.array([max(1, total[d] or 0) for d in DIMS], dtype=float)
    unit = {d: s / pieces for d, s in zip(DIMS, sums, strict=True)}
    over = F.greatest(*[F.col(d) / F.lit(unit[d]) for d in DIMS])
    found = groups.withColumn("over", over).filter("over > 1").select("h1", "h2", F.least(F.ceil("over"), F.col("rows")).cast("int").alias("parts"), (F.col("over") / pieces).alias("share"))
    rows = found.orderBy("h1", "h2").collect()
    large, at, together = [], pieces, {}
    for r in rows:
        large.append((r["h1"], r["h2"], at, r["parts"]))
        if r["share"] <= 0.5 / shards:
            together |= {at + k: at for k in range(r["parts"])}
        at += r["parts"]
    columns = ["h1", "h2", "first_piece", "parts"]
    frame = pd.DataFrame({c: np.array([x[i] for x in large], dtype=np.int64) for i, c in enumerate(columns)})
    large_df = spark.createDataFrame(frame, "h1 long, h2 long, first_piece long, parts long")
    sizes = _with_piece(vectors, large_df, pieces).groupBy("piece").agg(*_sums()).toPandas().sort_values("piece", ignore_index=True)
    shares = sizes[DIMS].to_numpy(dtype=float).reshape(-1, len(DIMS)) / sums
    unit_of = sizes["piece"].map(lambda p: together.get(int(p), int(p))).to_numpy(dtype=np.int64)
    names, of = np.unique(unit_of, return_inverse=True)
    items = np.zeros((len(names), len(DIMS)))
    np.add.at(items, of, shares)
    placed = pack(items, shards)[of] if len(names) else np.zeros(0, dtype=np.int64)
    out = pd.DataFrame({"piece": sizes["piece"].astype("int64"), "shard": placed, "rows": sizes["rows"].astype("int64")})
    out["first_slot"] = out.groupby("shard")["rows"].cumsum() - out["rows"]
    return large_df, spark.createDataFrame(out[["piece", "shard", "first_slot"]], "piece long, shard int, first_slot long")


def sharded(docs: DataFrame, plan: tuple[DataFrame, DataFrame], keep: list, pieces: int = 6144) -> DataFrame:
    """The columns ``keep`` of every row beside ``size, text_crc32, shard, slot``. Slots are
    gapless from 0 in a shard; rows are numbered inside their piece, and pieces follow
    each other. Null texts have size 8 and the checksum of no bytes."""
    large, places = plan
    own = _with_piece(_vectors(docs, *keep), large, pieces).join(F.broadcast(places), "piece")
    slot = F.col("first_slot") + F.row_number().over(W.partitionBy("piece").orderBy("_id", "h1", "h2")) - 1
    names = [k if isinstance(k, str) else "row" for k in keep]
    return own.select(*names, F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), "shard", slot.cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, pieces: int = 6144) -> DataFrame:
    """All rows and columns of ``docs`` with their place. Of clashing names, the place wins."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]).alias("row")
    return sharded(docs, shard_plan(docs, shards, pieces), [whole], pieces).select("row.*", "shard", "slot")
