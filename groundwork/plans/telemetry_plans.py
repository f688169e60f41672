"""L: event projection, quotas, anchored windows and the ingest stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groundwork.operators import telemetry as L
from groundwork.plans.base import query, table
from groundwork.session import scratch_dir
from groundwork.streaming.ingest import read_events, stream_ingest

HALF_DAY, DAY = 43_200, 86_400


def shadow_json(spark, sf):
    """Events rewritten as telemetry JSON with over-long, blank and out-of-range values."""
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.struct(
        F.when(F.col("event_type") == "click", "general").otherwise("other").alias("mode"), F.repeat(F.col("event_type"), 8).alias("deviceClass"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("m"), k)).alias("modelId"),
        (F.col("value") * 1000).cast("int").cast("string").alias("latencyMs"), F.when(k % 4 == 0, "").otherwise((k / 80).cast("string")).alias("topMoistureProxyScore"),
        F.when(k % 3 == 0, "0").otherwise((F.col("value") / 100).cast("string")).alias("topMoistureReliability"), ((k - 50) / 30).cast("string").alias("coverageDelta"), (k % 2 == 0).cast("string").alias("topColorAgreement"),
    )
    return table(spark, sf, "events").select("event_id", "event_type", F.to_json(body).alias("json"))


_SHADOW = """sh as materialized (select event_id, event_type, case when event_type = 'click' then 'general' else 'normal' end as mode, left(repeat(event_type, 8), 40) as device_class,
      case when k % 5 = 0 then null else 'm' || k end as model_id, least(120000, greatest(0, cast(trunc(value * 1000) as int))) as latency_ms,
      case when k % 4 = 0 then null else least(1.0::double, greatest(0.0::double, k / 80)) end as moisture_score,
      case when k % 3 = 0 then 0.0::double else least(1.0::double, greatest(0.0::double, value / 100)) end as moisture_reliability,
      least(1.0::double, greatest(-1.0::double, (k - 50) / 30)) as coverage_delta, k % 2 = 0 as top_color_agreement
    from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))"""


@query(
    "l01_project_event",
    f"with {_SHADOW} select event_id, 'vision-shadow-v2' as event_schema, mode, device_class, model_id, latency_ms, moisture_score, moisture_reliability, coverage_delta, top_color_agreement, cast(null as double) as glare_ratio from sh",
)
def l01(spark, sf):
    out = L.project_event(shadow_json(spark, sf), "json", "event_id")
    return out.select("event_id", "event_schema", "mode", "device_class", "model_id", "latency_ms", "moisture_score", "moisture_reliability", "coverage_delta", "top_color_agreement", "glare_ratio")


@query(
    "l02_shadow_summary",
    f"""with {_SHADOW} select event_type, count(*) as rows, count(*) filter (where moisture_score = 0) as zero_rows, count(*) filter (where moisture_score <> 0) as non_zero_rows,
    min(moisture_reliability) as min_reliability, max(moisture_reliability) as max_reliability from sh group by event_type""",
)
def l02(spark, sf):
    return L.shadow_summary(L.project_event(shadow_json(spark, sf), "json", "event_type"), "moisture_score", "moisture_reliability", ["event_type"])


def faults(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.when(k % 3 == 0, "Type Error!").when(k % 3 == 1, F.lit("")).otherwise("Net.Fail-1")
    rows = table(spark, sf, "events").filter("event_type = 'error'")
    return rows.withColumn("fp", L.fault_fingerprint(F.lit("error"), name, F.when(k > 50, "app").otherwise("cdn")))


_FAULTS = """faults as (select event_id, user_id, ts, 'error:' || case k % 3 when 0 then 'TypeError' when 1 then 'Error' else 'Net.Fail-1' end || ':' || case when k > 50 then 'app' else 'cdn' end as fp
      from (select *, cast(json_extract_string(props, '$.k') as int) as k from events where event_type = 'error'))"""


@query(
    "l03_throttle_faults",
    f"""with recursive {_FAULTS}, r as materialized (select *, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from faults),
    scan as (select user_id, 0::bigint as rn, null::bigint as start, 0 as n, []::varchar[] as fps, []::bigint[] as ats, null::bigint as event_id, null::varchar as fp, false as ok from (select distinct user_id from r)
      union all select user_id, rn, start, case when ok then n + 1 else n end, case when ok then list_append(fps, fp) else fps end, case when ok then list_append(ats, t) else ats end, event_id, fp, ok from (
        select r.user_id, r.rn, r.t, r.event_id, r.fp, s.fps, s.ats, case when s.start is null or r.t - s.start >= {HALF_DAY}000000 then r.t else s.start end as start,
          case when s.start is null or r.t - s.start >= {HALF_DAY}000000 then 0 else s.n end as n,
          (case when s.start is null or r.t - s.start >= {HALF_DAY}000000 then 0 else s.n end) < 2
            and len(list_filter(s.ats, lambda a, i: s.fps[i] = r.fp and r.t - a < {HALF_DAY}000000)) = 0 as ok
        from scan s join r on r.user_id = s.user_id and r.rn = s.rn + 1))
    select event_id, user_id, fp from scan where ok""",
)
def l03(spark, sf):
    return L.throttle_faults(faults(spark, sf), "user_id", "ts", "event_id", "fp", HALF_DAY, 2)


@query(
    "l04_anchored_rate_limit",
    f"""with recursive r as materialized (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    scan as (select user_id, event_id, t, rn, t as start, 1 as n from r where rn = 1
      union all select r.user_id, r.event_id, r.t, r.rn, case when r.t - s.start >= {DAY}000000 then r.t else s.start end, case when r.t - s.start >= {DAY}000000 then 1 else s.n + 1 end from scan s join r on r.user_id = s.user_id and r.rn = s.rn + 1)
    select event_id, user_id, n <= 3 as allowed, case when n > 3 then greatest(1, cast(ceil((start + {DAY}000000 - t) / 1000000) as bigint)) end as retry_after from scan""",
)
def l04(spark, sf):
    return L.anchored_rate_limit(table(spark, sf, "events"), "user_id", "ts", "event_id", DAY, 3)


@query(
    "l05_daily_quota",
    """with e as (select event_id, user_id, ts, event_type <> 'error' as ok, user_id < 10 as exempt from events),
    r as (select *, row_number() over (partition by user_id, cast(ts as date), ok order by ts, event_id) as rn from e)
    select event_id, case when not ok then 'failed' when exempt then 'exempt' when rn <= 2 then 'allowed' else 'denied' end as verdict from r""",
)
def l05(spark, sf):
    rows = table(spark, sf, "events").withColumn("ok", F.col("event_type") != "error").withColumn("exempt", F.col("user_id") < 10)
    return L.daily_quota(rows, "user_id", "ts", "event_id", "ok", "exempt", 2).select("event_id", "verdict")


@query("l06_fault_fingerprint", f"with {_FAULTS} select fp, count(*) as n from faults group by fp")
def l06(spark, sf):
    return faults(spark, sf).groupBy("fp").agg(F.count("*").alias("n"))


@query("l07_stream_ingest", "select event_id, 'vision-shadow-v2' as event_schema, 'normal' as mode, sha256('event|' || event_id || '|' || props) as event_hash from events")
def l07(spark, sf):
    """Two waves of files: two thirds of the events, then all of them again."""
    events = table(spark, sf, "events")
    folder = f"{scratch_dir(spark)}/ingest-{uuid.uuid4().hex}"
    events.filter("event_id % 3 <> 0").write.parquet(f"{folder}/source/wave=1")
    for wave in (1, 2):
        if wave == 2:
            events.write.parquet(f"{folder}/source/wave=2")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/source").drop("wave")
        stream_ingest(stream, f"{folder}/events", f"{folder}/checkpoint")
    return read_events(spark, f"{folder}/events").select("event_id", "event_schema", "mode", "event_hash")
