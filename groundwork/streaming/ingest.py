"""File stream to table: project, drop repeated events, append."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundwork.functions import hashing as H
from groundwork.operators.telemetry import project_event
from groundwork.session import materialize
from groundwork.streaming.keystore import KeyStore, delete, exists, rename

_BATCH = re.compile(r"batch=(\d+)")


def _folders(spark: SparkSession, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def compact_batches(spark: SparkSession, target: str, before: int, fanout: int) -> None:
    """Merges the folders of single batches before ``before`` into one when there are
    ``fanout`` of them. The merged rows are written to a hidden folder first; the move is
    finished by the next call if it was cut short, since a hidden folder that is complete
    names the batches it replaces."""
    for name in _folders(spark, target):
        if name.startswith("_merged-") and exists(spark, f"{target}/{name}/_SUCCESS"):
            for batch in name.removeprefix("_merged-").split("-"):
                delete(spark, f"{target}/batch={batch}")
            rename(spark, f"{target}/{name}", f"{target}/merged={name.split('-')[-1]}")
    single = sorted(int(m[1]) for m in map(_BATCH.fullmatch, _folders(spark, target)) if m and int(m[1]) < before)
    if len(single) >= fanout:
        name = "_merged-" + "-".join(map(str, single))
        rows = spark.read.parquet(*[f"{target}/batch={b}" for b in single])
        rows.write.mode("overwrite").parquet(f"{target}/{name}")
        compact_batches(spark, target, before, fanout)


def read_events(spark: SparkSession, target: str) -> DataFrame:
    """The rows that ``stream_ingest`` stored, of single and merged batches."""
    return spark.read.option("recursiveFileLookup", True).parquet(target)


def stream_ingest(events: DataFrame, target: str, checkpoint: str, json: str = "props", ts: str = "ts", event: str = "event_id", buckets: int = 32, fanout: int = 8):
    """Run the stream over everything available and append to Parquet, one folder per
    batch, which are merged ``fanout`` at a time. An event hash is stored once for ever:
    every batch asks the key store beside the table, so neither late events nor late
    repeats depend on a watermark. A batch that is repeated after a failure overwrites its
    own folder and keys. Restarting with the same checkpoint continues exactly where it
    stopped."""

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = KeyStore(spark, f"{target.rstrip('/')}.keys", buckets, fanout)
        store.merge(batch_id)
        compact_batches(spark, target, batch_id, fanout)
        hashed = batch.withColumn("event_hash", H.hash_key("event", F.col(event), F.col(json))).dropDuplicates(["event_hash"])
        hashed = materialize(hashed, "ingest")
        known = store.known(hashed.select(F.col("event_hash").alias("key")), batch_id)
        fresh = hashed.join(known.withColumnRenamed("key", "event_hash"), "event_hash", "left_anti")
        rows = project_event(fresh, json, event, ts, "event_hash")
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        written = spark.read.schema(rows.schema).parquet(f"{target}/batch={batch_id}")
        store.add(batch_id, written.select(F.col("event_hash").alias("key")))

    query = events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
