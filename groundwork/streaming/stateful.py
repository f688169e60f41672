"""Per-key state on event streams with transformWithState: the streaming twins of the
anchored rate limit, the fault throttle and the learning events.

Events wait in a list state until the watermark has passed them, so events that come late
(within the delay) are judged in their order, and the verdicts equal those of the batch
form. Event-time timers wake a key when its next event is due and when its last window has
ended; then its state is deleted, so keys that rest cost nothing. The RocksDB store keeps
the state outside the heap."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from groundwork.operators.governance import learning_state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _texts(values: Iterable[str]) -> pd.Series:
    """Strings as plain objects, which Arrow takes in one piece also where there are none."""
    return pd.Series(list(values), dtype=object)


class OrderedProcessor(StatefulProcessor):
    """Buffers the events of a key and hands them to ``judge`` in order of (t, id) once the
    watermark has passed them. Incoming chunks are appended one by one; what is due is read
    and the rest written back."""

    fields = ["t", "id"]
    event = "t long, id long"

    def __init__(self, window_micros: int, limit: int):
        self.window, self.limit = window_micros, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.event)
        self.open = handle.getValueState("open", "start long, n int")

    def judge(self, key, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def forget(self, now: int) -> int | None:
        """Drops state that cannot matter after ``now`` and names the time when what is left
        can be dropped."""
        if not self.open.exists():
            return None
        end = self.open.get()[0] + self.window
        if end <= now:
            self.open.clear()
            return None
        return end

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            self.waiting.appendList([tuple(int(x) if f in ("t", "id") else x for f, x in zip(self.fields, r, strict=True)) for r in chunk[self.fields].itertuples(index=False)])
            first = int(chunk["t"].min()) if first is None else min(first, int(chunk["t"].min()))
        if first is not None:
            self._wake(max(first, timerValues.getCurrentWatermarkInMs() * 1000) + 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        if self.waiting.exists():
            for row in self.waiting.get():
                (due if row[0] < now else rest).append(tuple(row))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if due:
            judged = self.judge(key, sorted(due))
            if len(judged):
                yield judged
        times = [t for t in (self.forget(now), min((r[0] for r in rest), default=None)) if t is not None]
        if times:
            self._wake(max(min(times), now) + 1000)

    def close(self) -> None:
        pass


class RateLimiter(OrderedProcessor):
    """State: start of the open window and the number of events in it."""

    def judge(self, key, rows: list[tuple]) -> pd.DataFrame:
        start, n = self.open.get() if self.open.exists() else (None, 0)
        allowed, wait = [], []
        for t, _ in rows:
            if start is None or t - start >= self.window:
                start, n = t, 0
            n += 1
            allowed.append(n <= self.limit)
            wait.append(None if n <= self.limit else max(1, -(-(start + self.window - t) // 1_000_000)))
        self.open.update((start, n))
        return pd.DataFrame({"key": key[0], "id": [r[1] for r in rows], "allowed": allowed, "retry_after": pd.array(wait, dtype="Int64")})


class FaultThrottle(OrderedProcessor):
    """State: open window with its count, and the last acceptance per fingerprint."""

    fields = ["t", "id", "fp"]
    event = "t long, id long, fp string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getMapState("last", "fp string", "at long")

    def judge(self, key, rows: list[tuple]) -> pd.DataFrame:
        start, n = self.open.get() if self.open.exists() else (None, 0)
        kept = []
        for t, event, fp in rows:
            if start is None or t - start >= self.window:
                start, n = t, 0
            if n >= self.limit:
                continue
            seen = self.last.getValue((fp,))[0] if self.last.containsKey((fp,)) else None
            if seen is not None and t - seen < self.window:
                continue
            self.last.updateValue((fp,), (t,))
            n += 1
            kept.append((event, fp))
        self.open.update((start, n))
        return pd.DataFrame({"key": [key[0]] * len(kept), "id": [k[0] for k in kept], "fp": _texts(k[1] for k in kept)})

    def forget(self, now: int) -> int | None:
        ends = [super().forget(now)]
        if self.last.exists():
            for fp, at in list(self.last.iterator()):
                if at[0] + self.window <= now:
                    self.last.removeKey(fp)
                else:
                    ends.append(at[0] + self.window)
        return min((e for e in ends if e is not None), default=None)


class FirstOfKey(OrderedProcessor):
    """Emits the earliest event of a key once and remembers that it did. An event key is
    unique for ever, so this one flag per key is never dropped."""

    fields = ["t", "id", "sample_id"]
    event = "t long, id long, sample_id long"

    def __init__(self):
        super().__init__(0, 0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.done = handle.getValueState("done", "id long")

    def judge(self, key, rows: list[tuple]) -> pd.DataFrame:
        if self.done.exists():
            rows = []
        elif rows:
            self.done.update((rows[0][1],))
        first = rows[:1]
        return pd.DataFrame({"kind": _texts(key[0] for _ in first), "ref": _texts(key[1] for _ in first), "id": [r[1] for r in first], "sample_id": [r[2] for r in first]})


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """Events with their time as event time; ``t`` are microseconds."""
    use_rocksdb(events.sparkSession)
    return events.withColumn("at", F.timestamp_micros("t")).withWatermark("at", delay)


def stream_rate_limit(events: DataFrame, window_seconds: int, limit: int, key_type: str = "long", delay: str = "10 minutes") -> DataFrame:
    """``events``: streaming key, t (microseconds), id. Verdicts appear once the watermark
    has passed an event; events later than ``delay`` are dropped."""
    return _timed(events, delay).groupBy("key").transformWithStateInPandas(
        RateLimiter(window_seconds * 1_000_000, limit), outputStructType=f"key {key_type}, id long, allowed boolean, retry_after long", outputMode="Append", timeMode="EventTime"
    )


def stream_throttle(events: DataFrame, window_seconds: int = 60, limit: int = 8, key_type: str = "long", delay: str = "10 minutes") -> DataFrame:
    """``events``: streaming key, t (microseconds), id, fp; as ``stream_rate_limit``."""
    return _timed(events, delay).groupBy("key").transformWithStateInPandas(
        FaultThrottle(window_seconds * 1_000_000, limit), outputStructType=f"key {key_type}, id long, fp string", outputMode="Append", timeMode="EventTime"
    )


def stream_learning_events(transitions: DataFrame, pool: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The stream form of ``governance.learning_events``. ``transitions``: streaming kind
    (``contribution`` or ``sample``), ref_id, sample_id, group_hash, t (microseconds), id,
    status. A contribution counts when approved, a sample when adjudicated, once each.
    ``pool``: static sample_id, group_hash of known samples, which contributions look up."""
    hits = transitions.filter("(kind = 'contribution' and status = 'approved') or (kind = 'sample' and status = 'adjudicated')")
    ref = F.when(F.col("kind") == "contribution", F.col("ref_id").cast("string")).otherwise(F.concat_ws("|", F.col("sample_id").cast("string"), "group_hash"))
    keyed = _timed(hits.withColumn("ref", ref), delay)
    first = keyed.groupBy("kind", "ref").transformWithStateInPandas(
        FirstOfKey(), outputStructType="kind string, ref string, id long, sample_id long", outputMode="Append", timeMode="EventTime"
    )
    known = pool.select("sample_id", F.col("group_hash").alias("_pool"))
    joined = first.join(known, "sample_id", "left")
    own = F.when(F.col("kind") == "sample", F.substring_index("ref", "|", -1)).otherwise(F.col("_pool"))
    kind = F.when(F.col("kind") == "sample", "adjudicated_training_ready").otherwise("verified_contribution_approved")
    return learning_state(joined.select(kind.alias("event_type"), "ref", F.col("id").alias("event_id"), "sample_id", own.alias("group_hash")))
