"""A store of keys that is asked by every batch of a stream: sorted runs by hash bucket with
a bit filter each, merged in tiers."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of one filter segment, and bits per key of a run's filter.
_SEGMENT, _BITS_PER_KEY = 32_768, 16


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, place = _fs(spark, old)
    fs.rename(place, spark._jvm.org.apache.hadoop.fs.Path(new))


@dataclass(frozen=True)
class Run:
    """A written set of keys: those of the batches ``first`` to ``last``, ``segments`` filter
    segments per bucket."""

    level: int
    first: int
    last: int
    segments: int

    @property
    def name(self) -> str:
        return f"run-{self.level}-{self.first}-{self.last}"


class KeyStore:
    """Keys (hex digests) in ``buckets`` hash buckets. A batch reads, of every run, the filter
    rows of its buckets, and the keys of those buckets only where a filter may hold one of
    its keys. ``fanout`` runs of a level are merged into one of the next, so the number of
    runs, and with it the files that a batch reads, grows with the logarithm of the batches.

    What a batch adds is a run of its own, overwritten if the batch is repeated; only runs
    of earlier batches are merged, so a repeated batch never meets its own keys. The list
    of runs is one small file, replaced after a merge is written and before its inputs go."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, fanout: int = 8):
        self.spark, self.path, self.buckets, self.fanout = spark, path, buckets, fanout

    def runs(self) -> list[Run]:
        if not exists(self.spark, f"{self.path}/runs"):
            return []
        row = self.spark.read.text(f"{self.path}/runs").first()
        return [Run(*r) for r in json.loads(row["value"])]

    def _list(self, runs: list[Run]) -> None:
        text = json.dumps([[r.level, r.first, r.last, r.segments] for r in runs])
        self.spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.path}/runs")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _bits(self, segments: Column | int) -> list[Column]:
        """Two places of a key in the filter of its bucket."""
        width = (F.lit(segments) if isinstance(segments, int) else segments) * _SEGMENT
        return [F.pmod(F.xxhash64(F.lit(seed), "key"), width) for seed in (1, 2)]

    def _write(self, keys: DataFrame, level: int, first: int, last: int) -> Run:
        """``keys`` (key) as a run with its filter."""
        base = f"{self.path}/run-{level}-{first}-{last}"
        keyed = keys.select("key", self._bucket().alias("bucket"))
        keyed.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/keys")
        stored = self.spark.read.schema("key string, bucket int").parquet(f"{base}/keys")
        most = stored.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
        segments = max(1, -(-most * _BITS_PER_KEY // _SEGMENT))
        places = stored.select("bucket", F.explode(F.array(*self._bits(segments))).alias("at"))
        filters = places.groupBy("bucket", F.floor(F.col("at") / _SEGMENT).cast("int").alias("segment")).agg(F.bitmap_construct_agg(F.col("at") % _SEGMENT).alias("bits"))
        filters.repartition(1, "bucket").sortWithinPartitions("bucket", "segment").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/filter")
        return Run(level, first, last, segments)

    def add(self, batch_id: int, keys: DataFrame) -> None:
        """Stores the new keys of a batch."""
        run = self._write(keys, 0, batch_id, batch_id)
        self._list([r for r in self.runs() if not (r.level == 0 and r.first == batch_id)] + [run])

    def merge(self, before: int) -> None:
        """Merges full levels of runs whose batches all lie before ``before``."""
        runs = self.runs()
        level = 0
        while any(r.level >= level for r in runs):
            ready = [r for r in runs if r.level == level and r.last < before]
            if len(ready) >= self.fanout:
                merged = self.keys(ready)
                run = self._write(merged, level + 1, min(r.first for r in ready), max(r.last for r in ready))
                runs = [r for r in runs if r not in ready] + [run]
                self._list(runs)
                for r in ready:
                    delete(self.spark, f"{self.path}/{r.name}")
            level += 1

    def keys(self, runs: list[Run], buckets: list[int] | None = None) -> DataFrame:
        """The keys of runs, of the given buckets only."""
        out = self.spark.createDataFrame([], "key string")
        for r in runs:
            rows = self.spark.read.schema("key string, bucket int").parquet(f"{self.path}/{r.name}/keys")
            out = out.unionByName((rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).select("key"))
        return out

    def suspects(self, keys: DataFrame, run: Run) -> list[int]:
        """Buckets in which the run's filter may hold one of ``keys`` (key, bucket)."""
        touched = [r[0] for r in keys.select("bucket").distinct().collect()]
        filters = self.spark.read.schema("segment int, bits binary, bucket int").parquet(f"{self.path}/{run.name}/filter").filter(F.col("bucket").isin(touched))
        places = keys.select("key", "bucket", F.explode(F.array(*self._bits(run.segments))).alias("at"))
        placed = places.withColumn("segment", F.floor(F.col("at") / _SEGMENT).cast("int")).join(filters, ["bucket", "segment"])
        at = (F.col("at") % _SEGMENT).cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        found = placed.filter((byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1)
        both = found.groupBy("bucket", "key").agg(F.count("*").alias("n")).filter("n = 2")
        return [r[0] for r in both.select("bucket").distinct().collect()]

    def known(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """The keys of ``keys`` (key) that earlier batches stored."""
        asked = keys.select("key", self._bucket().alias("bucket"))
        out = self.spark.createDataFrame([], "key string")
        for run in self.runs():
            if run.last >= batch_id:
                continue
            buckets = self.suspects(asked, run)
            if buckets:
                out = out.unionByName(self.keys([run], buckets))
        return keys.join(out, "key", "left_semi").select("key")
