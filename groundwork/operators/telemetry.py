"""Event projection, quotas and per-key anchored windows, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundwork.functions import jsonpred as J
from groundwork.operators.joins import salted_lookup, top_k
from groundwork.session import materialize

# Event fields. Strings are (column, JSON key, length, default); numbers
# are (column, JSON key, low, high, type).
STRING_FIELDS = [
    ("event_schema", "eventSchema", 80, "vision-shadow-v2"), ("model_id", "modelId", 120, ""), ("model_sha256", "modelSha256", 64, ""), ("shadow_status", "shadowStatus", 60, ""),
    ("runtime_version", "runtimeVersion", 80, ""), ("feature_version", "shadowFeatureVersion", 80, ""), ("device_class", "deviceClass", 40, ""), ("hardware_tier", "hardwareTier", 24, ""),
    ("hardware_cores", "hardwareCores", 24, ""), ("hardware_memory", "hardwareMemory", 24, ""), ("connection_class", "connectionClass", 24, ""), ("baseline_top_color", "baselineTopColor", 40, ""),
    ("candidate_top_color", "topColorCandidate", 40, ""), ("moisture_label", "topMoistureLabelCandidate", 24, ""), ("pipeline_impact", "pipelineImpact", 80, "none-fire-and-forget-after-response"),
]
_unit = lambda column, key: (column, key, 0, 1, "double")
NUMBER_FIELDS = [
    ("latency_ms", "latencyMs", 0, 120000, "int"), ("moisture_sampled_pixels", "topMoistureSampledPixels", 0, 1000000, "int"), ("coverage_delta", "coverageDelta", -1, 1, "double"),
    _unit("baseline_coverage", "baselineCoverage"), _unit("candidate_coverage", "shadowCoverage"), _unit("glare_ratio", "qcGlareRatio"), _unit("flash_risk", "qcFlashRiskScore"),
    _unit("sharpness", "qcSharpnessProxy"), _unit("median_sulcus_score", "topMedianSulcusScore"), _unit("fissure_score", "topFissureCandidateScore"),
    _unit("moisture_score", "topMoistureProxyScore"), _unit("moisture_reliability", "topMoistureReliability"), _unit("moisture_gloss", "topMoistureGlossRatio"),
    _unit("moisture_strict_gloss", "topMoistureStrictGlossRatio"), _unit("moisture_distributed_gloss", "topMoistureDistributedGlossRatio"),
    _unit("moisture_largest_gloss", "topMoistureLargestGlossComponentRatio"), _unit("moisture_roughness", "topMoistureRoughness"), _unit("moisture_overexposed", "topMoistureOverexposedRatio"),
    _unit("baseline_vessel_ratio", "baselineBottomVesselCandidateRatio"), _unit("candidate_vessel_ratio", "bottomVesselCandidateRatio"), _unit("vessel_visibility", "bottomVesselVisibilityScore"),
    _unit("baseline_dark_purple", "baselineBottomDarkPurpleRatio"), _unit("candidate_dark_purple", "bottomDarkPurpleRatio"), _unit("vessel_balance", "bottomVesselBalance"),
]
FLAG_FIELDS = [("top_color_agreement", "topColorAgreement"), ("baseline_top_fissure", "baselineTopFissure")]


def project_event(df: DataFrame, json: str, *keep: str) -> DataFrame:
    """Typed event columns from JSON text, parsed once: strings cut and blank to null,
    numbers clamped, unknown modes become normal."""
    names = [k for _, k, *_ in STRING_FIELDS + NUMBER_FIELDS] + [k for _, k in FLAG_FIELDS] + ["mode"]
    parsed = df.select(*keep, F.from_json(json, ", ".join(f"`{n}` string" for n in names)).alias("e"))
    at = lambda k: F.col(f"e.`{k}`")
    strings = [J.capped_string(at(k), n, d).alias(c) for c, k, n, d in STRING_FIELDS]
    numbers = [J.bounded_number(at(k), lo, hi, t).alias(c) for c, k, lo, hi, t in NUMBER_FIELDS]
    flags = [at(k).try_cast("boolean").alias(c) for c, k in FLAG_FIELDS]
    mode = F.when(at("mode") == "general", "general").otherwise("normal").alias("mode")
    return parsed.select(*keep, *strings, mode, *numbers, *flags)


def shadow_summary(df: DataFrame, score: str, reliability: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(F.col(score) == 0).alias("zero_rows"), F.count_if(F.col(score) != 0).alias("non_zero_rows"),
        F.min(reliability).alias("min_reliability"), F.max(reliability).alias("max_reliability"),
    )


def fault_fingerprint(kind: Column, name: Column, source: Column) -> Column:
    """kind:name:source with a sanitized name of at most 40 and a total of 80 characters."""
    clean = F.substring(F.regexp_replace(F.coalesce(name, F.lit("Error")), r"[^A-Za-z0-9_.-]", ""), 1, 40)
    return F.substring(F.concat_ws(":", kind, F.when(clean == "", "Error").otherwise(clean), source), 1, 80)


def daily_quota(df: DataFrame, key: str, ts: str, event: str, success: str, exempt: str, limit: int = 5) -> DataFrame:
    """Verdict per event: failed requests consume nothing, exempt keys always pass, the
    first ``limit`` successes of a key and day pass. Only those few rows per key and
    day are ranked; all other successes are denied by an anti-lookup on the event."""
    counted = df.filter(F.col(success) & ~F.col(exempt)).select(key, F.to_date(ts).alias("_day"), ts, event)
    allowed = top_k(counted, [key, "_day"], [F.asc(ts), F.asc(event)], limit, "use_no").select(event, "use_no")
    joined = df.join(allowed, event, "left")
    verdict = F.when(~F.col(success), "failed").when(F.col(exempt), "exempt").when(F.col("use_no").isNotNull(), "allowed").otherwise("denied")
    return joined.withColumn("verdict", verdict)


# --- anchored windows -------------------------------------------------------


def _slots(df: DataFrame, window: int) -> DataFrame:
    return df.withColumn("slot", F.floor(F.col("t") / F.lit(window)).cast("bigint"))


def window_anchors(points: DataFrame, window: int) -> DataFrame:
    """Window starts (key, slot, t) of per-key windows that open at the first event at or
    after the end of the previous one. ``points``: key, t (microseconds).

    Two starts are at least one window apart, so a time slot of that length holds at
    most one. An event without another one in the window before it starts a window for
    certain; from these the next starts are found by following "first event one window
    later" in doubling steps. All work is keyed by (key, slot): a busy key is spread
    over its slots, and no key is processed in one piece."""
    pts = materialize(_slots(points.select("key", "t").distinct(), window), "points")
    slots = materialize(pts.groupBy("key", "slot").agg(F.min("t").alias("lo"), F.max("t").alias("hi")), "slots")
    before = slots.select("key", (F.col("slot") + 1).alias("slot"), F.col("hi").alias("prev_hi"))
    starts = slots.join(before, ["key", "slot"], "left").filter(F.col("prev_hi").isNull() | (F.col("prev_hi") <= F.col("lo") - window))
    reached = materialize(starts.select("key", F.col("lo").alias("t")), "anchors")
    after = slots.select("key", (F.col("slot") - 2).alias("slot"), F.col("lo").alias("far"))
    probes = pts.select("key", (F.col("slot") + 1).alias("slot"), (F.col("t") + window).alias("pos"), F.lit(1).alias("probe"), "t", F.lit(None).cast("bigint").alias("hit"))
    events = pts.select("key", "slot", F.col("t").alias("pos"), F.lit(0).alias("probe"), "t", F.col("t").alias("hit"))
    later = W.partitionBy("key", "slot").orderBy(F.desc("pos"), F.asc("probe")).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = probes.unionByName(events).withColumn("next", F.last("hit", ignorenulls=True).over(later)).filter("probe = 1")
    near = near.select("key", (F.col("slot") - 1).alias("slot"), "t", "next")
    jumps = near.join(after, ["key", "slot"], "left").select("key", "t", F.coalesce("next", "far").alias("next")).filter("next is not null")
    jumps = materialize(jumps, "jumps")
    while True:
        landed = reached.join(jumps, ["key", "t"]).select("key", F.col("next").alias("t")).join(reached, ["key", "t"], "left_anti").distinct()
        landed = materialize(landed, "landed")
        if landed.isEmpty():
            return _slots(reached, window)
        reached = materialize(reached.unionByName(landed), "anchors")
        onward = jumps.select("key", F.col("t").alias("next"), F.col("next").alias("after_next"))
        jumps = materialize(jumps.join(onward, ["key", "next"]).select("key", "t", F.col("after_next").alias("next")), "jumps")


def with_anchor(df: DataFrame, window: int) -> DataFrame:
    """Adds the start of the window that holds each event (columns key, t, id). It lies in
    the event's own slot, not after it, or else in the slot before."""
    events = _slots(df, window)
    anchors = materialize(window_anchors(df, window), "anchors")
    named = lambda slot: F.concat_ws(":", F.col("key").cast("string"), slot.cast("string"))
    here = anchors.select(named(F.col("slot")).alias("_ks"), F.col("t").alias("_own"))
    back = anchors.select(named(F.col("slot") + 1).alias("_ks"), F.col("t").alias("_prior"))
    joined = salted_lookup(events.withColumn("_ks", named(F.col("slot"))), here, "_ks", "id", how="left")
    joined = salted_lookup(joined, back, "_ks", "id", how="left")
    return joined.withColumn("anchor", F.when(F.col("_own") <= F.col("t"), F.col("_own")).otherwise(F.col("_prior"))).drop("_ks", "_own", "_prior", "slot")


def _micros(df: DataFrame, key: str, ts: str, event: str, *more: str) -> DataFrame:
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.select(F.col(key).alias("key"), stamp.alias("t"), F.col(event).alias("id"), *more)


def anchored_rate_limit(df: DataFrame, key: str, ts: str, event: str, window_seconds: int, limit: int) -> DataFrame:
    """Verdict per event: the first ``limit`` events of each anchored window pass; others
    carry the seconds until the window ends (rounded up, at least 1)."""
    window = window_seconds * 1_000_000
    placed = materialize(with_anchor(_micros(df, key, ts, event), window), "placed")
    passed = top_k(placed, ["key", "anchor"], [F.asc("t"), F.asc("id")], limit, "_n").select("id", F.lit(True).alias("_ok"))
    joined = placed.join(passed, "id", "left")
    allowed = F.coalesce("_ok", F.lit(False))
    wait = F.greatest(F.lit(1), F.ceil((F.col("anchor") + window - F.col("t")) / 1_000_000)).cast("bigint")
    return joined.select(F.col("id").alias(event), F.col("key").alias(key), allowed.alias("allowed"), F.when(~allowed, wait).alias("retry_after"))


def _following(placed: DataFrame, window: int) -> DataFrame:
    """``key, anchor, next``: the window after each one, if an acceptance of the first can
    still rest in it, that is if it starts less than two window lengths later. Such a start
    lies in one of the next three slots, so windows meet by (key, slot)."""
    starts = materialize(_slots(placed.select("key", F.col("anchor").alias("t")).distinct(), window).withColumnRenamed("t", "anchor"), "windows")
    later = starts.select("key", "slot", F.col("anchor").alias("next"))
    reach = starts.select("key", "anchor", F.explode(F.transform(F.array(*map(F.lit, (0, 1, 2))), lambda d: F.col("slot") + d)).alias("slot"))
    met = reach.join(later, ["key", "slot"]).filter((F.col("next") > F.col("anchor")) & (F.col("next") < F.col("anchor") + 2 * window))
    return materialize(met.groupBy("key", "anchor").agg(F.min("next").alias("next")), "following")


def throttle_faults(df: DataFrame, key: str, ts: str, event: str, fingerprint: str, window_seconds: int = 60, limit: int = 8, decided: list[int] | None = None) -> DataFrame:
    """Accepted faults: at most ``limit`` per anchored window, and a fingerprint rests for
    one window length after its last acceptance.

    Inside a window a fingerprint is accepted at most once, and an acceptance rests in the
    next window only. So all windows are decided at once as if none came before, and then
    changes are passed on: a window is decided again only if what its predecessor accepts
    has changed, with the acceptances of that window. First windows are right at once,
    their successors after the next pass; most changes die out soon. ``decided`` takes the
    number of rows that each pass decides."""
    window = window_seconds * 1_000_000
    rows = _micros(df, key, ts, event, F.col(fingerprint).alias("fp"))
    placed = materialize(with_anchor(rows, window), "placed")
    following = _following(placed, window)

    def decide(open_: DataFrame) -> DataFrame:
        first = open_.groupBy("key", "anchor", "fp").agg(F.min(F.struct("t", "id")).alias("m")).select("key", "anchor", "fp", "m.*")
        return top_k(first, ["key", "anchor"], [F.asc("t"), F.asc("id")], limit, "_n").select("key", "anchor", "fp", "t", "id")

    def note(df: DataFrame) -> DataFrame:
        if decided is not None:
            decided.append(df.count())
        return df

    layers = [materialize(decide(note(placed)), "accepted")]
    redone = [materialize(placed.select("key", "anchor").distinct(), "redone")]
    changed, delta = redone[0], layers[0]
    while True:
        again = materialize(changed.join(following, ["key", "anchor"]).select("key", F.col("anchor").alias("before"), F.col("next").alias("anchor")), "again")
        if again.isEmpty():
            break
        rest = again.join(delta.select("key", F.col("anchor").alias("before"), "fp", F.col("t").alias("_at")), ["key", "before"]).select("key", "anchor", "fp", "_at")
        mine = note(placed.join(again.select("key", "anchor"), ["key", "anchor"], "left_semi"))
        e, r = mine.alias("e"), rest.alias("r")
        resting = (F.col("e.key") == F.col("r.key")) & (F.col("e.anchor") == F.col("r.anchor")) & (F.col("e.fp") == F.col("r.fp")) & (F.col("r._at") > F.col("e.t") - window)
        new = materialize(decide(e.join(r, resting, "left_anti")), "accepted")
        old = _latest(layers, redone).join(again.select("key", "anchor"), ["key", "anchor"], "left_semi")
        ids = lambda df: df.select("key", "anchor", "id")
        moved = ids(new).join(ids(old), ["key", "anchor", "id"], "left_anti").union(ids(old).join(ids(new), ["key", "anchor", "id"], "left_anti"))
        layers.append(new)
        redone.append(again.select("key", "anchor"))
        changed = materialize(moved.select("key", "anchor").distinct(), "changed")
        delta = new
    found = _latest(layers, redone)
    return found.select(F.col("id").alias(event), F.col("key").alias(key), F.col("fp").alias(fingerprint))


def _latest(layers: list[DataFrame], redone: list[DataFrame]) -> DataFrame:
    """The acceptances of each window from the last pass that decided it."""
    if len(layers) == 1:
        return layers[0]
    passes = redone[1].withColumn("_p", F.lit(1))
    every = layers[0].withColumn("_p", F.lit(0))
    for n in range(1, len(layers)):
        every = every.unionByName(layers[n].withColumn("_p", F.lit(n)))
        if n > 1:
            passes = passes.unionByName(redone[n].withColumn("_p", F.lit(n)))
    last = passes.groupBy("key", "anchor").agg(F.max("_p").alias("_last"))
    return every.join(last, ["key", "anchor"], "left").filter(F.col("_p") == F.coalesce("_last", F.lit(0))).drop("_p", "_last")
