"""Agreement, overlap and interval measures against locked reference labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from groundwork.functions import hashing as H, text as X
from groundwork.operators.joins import top_k
from groundwork.session import materialize

# Agreement gate.
GATE = {"rows": 50, "support": 10, "micro": 0.95, "macro": 0.95, "field": 0.95}
# Observation fields in report order.
FIELDS = [
    "bodyColor", "coatingColor", "coatingThickness", "coatingDistribution", "medianSulcus",
    "fissure", "moistureSurface", "moistureBody", "moistureCoating", "ventralBilateralStructure",
]
# Folded words for "not known".
UNKNOWN_VALUES = ["unknown", "khong xac dinh", "n a", "na", "not assessed", "not-assessed"]
LEAK_SAMPLES = 25
_SHA = "^[0-9a-fA-F]{64}$"


def folded_value(value: Column) -> Column:
    return X.squeeze(X.strip_accents(value, "đ", "d"))


def known(value: Column) -> Column:
    folded = folded_value(value)
    return (folded != "") & ~folded.isin(UNKNOWN_VALUES)


def join_evidence(manifest: DataFrame, reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row per sample of the three inputs with the first broken rule in ``error``.

    manifest: sample_id, digest, group_hash, role, qc_grade; reference: sample_id,
    digest, locked, blind, model_visible; candidate: sample_id, digest, version.
    Inputs are reduced to one row per sample before the joins, so repeated ids are
    counted, not multiplied."""

    def one(df: DataFrame, prefix: str) -> DataFrame:
        rest = [c for c in df.columns if c != "sample_id"]
        agg = df.groupBy("sample_id").agg(F.count("*").alias(f"{prefix}_n"), F.min(F.struct(*rest)).alias("_r"))
        return agg.select("sample_id", f"{prefix}_n", *[F.col(f"_r.{c}").alias(f"{prefix}_{c}") for c in rest])

    groups = manifest.groupBy("digest").agg((F.min("group_hash") != F.max("group_hash")).alias("split_group"))
    m = one(manifest.join(groups, "digest"), "m")
    joined = m.join(one(reference, "r"), "sample_id", "full_outer").join(one(candidate, "c"), "sample_id", "full_outer")
    versions = candidate.agg(F.min("version").alias("lo"), F.max("version").alias("hi"))
    mixed = versions.select(F.col("lo") != F.col("hi")).scalar()
    rules = [
        (F.col("m_n").isNull(), "EXTRA_ROW"),
        (F.col("m_n") > 1, "DUPLICATE_SAMPLE_ID"),
        (~F.col("m_digest").rlike(_SHA), "DIGEST_REQUIRED"),
        (~F.col("m_role").isin("dorsal", "ventral"), "ROLE_INVALID"),
        (~F.col("m_qc_grade").isin("good", "acceptable", "poor"), "QC_INVALID"),
        (F.col("m_split_group"), "SAME_DIGEST_DIFFERENT_GROUP"),
        (F.col("r_n").isNull(), "REFERENCE_MISSING"),
        (F.col("c_n").isNull(), "CANDIDATE_MISSING"),
        ((F.col("r_n") > 1) | (F.col("c_n") > 1), "DUPLICATE_LABEL"),
        ((F.lower("r_digest") != F.lower("m_digest")) | (F.lower("c_digest") != F.lower("m_digest")), "DIGEST_MISMATCH"),
        (~F.col("r_blind") | F.col("r_model_visible"), "REFERENCE_NOT_BLIND"),
        (~F.col("r_locked"), "REFERENCE_NOT_LOCKED"),
        (mixed, "MIXED_VERSIONS"),
    ]
    error = F.coalesce(*[F.when(broken, code) for broken, code in rules])
    return joined.select("sample_id", F.col("m_digest").alias("digest"), F.col("m_role").alias("role"), F.col("m_qc_grade").alias("qc_grade"), error.alias("error"))


def field_slots(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row per sample and field with the flags support, match, leak, unknown.
    ``rows``: sample_id, qc_grade, reference.*, candidate.* (structs of strings)."""
    slots = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"reference.`{f}`").alias("ref"), F.col(f"candidate.`{f}`").alias("cand")) for f in fields])
    flat = rows.select("sample_id", (F.coalesce("qc_grade", F.lit("poor")) == "poor").alias("poor"), F.explode(slots).alias("s")).select("sample_id", "poor", "s.*")
    flat = flat.withColumns({"rk": known(F.col("ref")), "ck": known(F.col("cand")), "same": folded_value(F.col("ref")) == folded_value(F.col("cand"))})
    return flat.select(
        "sample_id", "field",
        (~F.col("poor") & F.col("rk")).alias("support"),
        (~F.col("poor") & F.col("rk") & F.col("ck") & F.col("same")).alias("match"),
        (~F.col("poor") & ~F.col("rk")).alias("unknown"),
        (F.col("ck") & (F.col("poor") | ~F.col("rk"))).alias("leak"),
        F.when(F.col("poor"), "candidate-known-on-poor-qc").otherwise("candidate-known-when-reference-unknown").alias("leak_reason"),
    )


def field_agreement(rows: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Per field support, matches, agreement, leaks; one grouped pass."""
    slots = field_slots(rows, fields)
    counts = slots.groupBy("field").agg(
        F.count_if("support").alias("support"), F.count_if("match").alias("matches"), F.count_if("leak").alias("leaks"), F.count_if("unknown").alias("unknown_slots")
    )
    return counts.withColumn("agreement", F.try_divide("matches", "support"))


def leak_samples(rows: DataFrame, fields: list[str] = FIELDS, cap: int = LEAK_SAMPLES) -> DataFrame:
    """The report's sample of leaks: the first ``cap`` in sample and field order."""
    leaks = field_slots(rows, fields).filter("leak").select("sample_id", "field", "leak_reason")
    position = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
    return leaks.orderBy("sample_id", position).limit(cap)


def agreement_metrics(rows: DataFrame, per_field: DataFrame, policy: dict = GATE) -> DataFrame:
    """Micro and macro agreement with the six gates and their conjunction, one row."""
    enough = F.col("support") >= policy["support"]
    totals = per_field.agg(
        F.sum("support").alias("micro_support"), F.sum("matches").alias("micro_matches"), F.sum("leaks").alias("leaks"),
        F.avg(F.when(enough, F.col("agreement"))).alias("macro"), F.count_if(~enough).alias("thin_fields"),
        F.count_if(enough & (F.col("agreement") < policy["field"])).alias("low_fields"),
    )
    totals = totals.withColumn("rows", rows.agg(F.count("*")).scalar()).withColumn("micro", F.try_divide("micro_matches", "micro_support"))
    gates = {
        "gate_rows": F.col("rows") >= policy["rows"],
        "gate_support": F.col("thin_fields") == 0,
        "gate_field": F.col("low_fields") == 0,
        "gate_micro": F.coalesce(F.col("micro") >= policy["micro"], F.lit(False)),
        "gate_macro": F.coalesce(F.col("macro") >= policy["macro"], F.lit(False)),
        "gate_safety": F.col("leaks") == 0,
    }
    gated = totals.withColumns(gates)
    passed = F.lit(True)
    for name in gates:
        passed = passed & F.col(name)
    return gated.withColumn("eligible", passed)


def presence_confusion(df: DataFrame, gold: Column, pred: Column, usable: Column, by: list[str] = ()) -> DataFrame:
    """tp, tn, fp, fn over usable rows with sensitivity, specificity, accuracy (null on
    an empty denominator) and the number of excluded rows."""
    hit = lambda c: F.count_if(usable & c)
    counts = df.groupBy(*by).agg(
        hit(gold & pred).alias("tp"), hit(~gold & ~pred).alias("tn"), hit(~gold & pred).alias("fp"), hit(gold & ~pred).alias("fn"), F.count_if(~usable).alias("excluded")
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "sensitivity": F.try_divide("tp", F.col("tp") + F.col("fn")),
            "specificity": F.try_divide("tn", F.col("tn") + F.col("fp")),
            "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
        }
    )


def rle_overlap(df: DataFrame, gold: str, pred: str, size: Column) -> DataFrame:
    """Adds gold_pixels, pred_pixels, intersection, dice, iou and mask_error for two
    run-length columns (alternating runs, zeros first). Both run lists are merged by two
    positions that only move forward, one step per run end, so a row costs its runs, and
    no array is copied, joined or shuffled."""
    long = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    total = lambda c: F.aggregate(F.col(c), zero, lambda a, x: a + x.cast("bigint"))
    negative = lambda c: F.exists(F.col(c), lambda x: x.isNull() | (x < 0))
    error = F.when(F.col(gold).isNull() | F.col(pred).isNull(), "MASK_REQUIRED").when(negative(gold) | negative(pred), "RLE_COUNT_INVALID").when((total(gold) != size) | (total(pred) != size), "RLE_LENGTH_MISMATCH")
    run = lambda c, i: long(F.get(c, i))
    # i, j: runs the sweep stands in; a, b: what is left of them; odd runs are ones
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("j"), run(gold, F.lit(0)).alias("a"), run(pred, F.lit(0)).alias("b"),
        zero.alias("gs"), zero.alias("ps"), zero.alias("both"),
    )

    def step(s, _):
        n = F.least(s["a"], s["b"])
        g, p = s["i"] % 2 == 1, s["j"] % 2 == 1
        done_g, done_p = (s["a"] == n) & (s["i"] < F.size(gold)), (s["b"] == n) & (s["j"] < F.size(pred))
        add = lambda field, on: (s[field] + F.when(on, n).otherwise(zero)).alias(field)
        return F.struct(
            (s["i"] + done_g.cast("int")).alias("i"), (s["j"] + done_p.cast("int")).alias("j"),
            F.when(done_g, run(gold, s["i"] + 1)).otherwise(s["a"] - n).alias("a"), F.when(done_p, run(pred, s["j"] + 1)).otherwise(s["b"] - n).alias("b"),
            add("gs", g), add("ps", p), add("both", g & p),
        )

    staged = df.withColumn("mask_error", error)
    steps = F.when(F.col("mask_error").isNull(), F.sequence(F.lit(1), F.greatest(F.size(gold) + F.size(pred), F.lit(1))))
    swept = staged.withColumn("_o", F.aggregate(steps, start, step))
    g, p, both = F.col("_o.gs"), F.col("_o.ps"), F.col("_o.both")
    return swept.withColumns(
        {
            "gold_pixels": g, "pred_pixels": p, "intersection": both,
            "dice": F.when(g + p == 0, 1.0).otherwise(F.try_divide(2 * both, g + p)),
            "iou": F.when(g + p - both == 0, 1.0).otherwise(F.try_divide(both, g + p - both)),
        }
    ).drop("_o")


def holdout_metrics(rows: DataFrame) -> DataFrame:
    """One row for one holdout and one model, with intervals of the mean Dice and IoU.
    ``rows``: sample_id, holdout_version, model_sha256, usable, gold_present,
    pred_present, dice, iou. ``error`` names mixed versions, mixed models or repeated
    samples."""
    usable, gold, pred = F.col("usable"), F.col("gold_present"), F.col("pred_present")
    # read five times: written once, or every reader and every pushed filter computes the overlaps again
    rows = materialize(rows, "holdout")
    repeated = rows.groupBy("sample_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*")).scalar()
    counts = presence_confusion(rows, gold, pred, usable)
    extra = rows.agg(
        F.count("*").alias("samples"), F.count_if(usable).alias("usable"), F.count_if(usable & gold).alias("positives"),
        F.avg(F.when(usable & gold, F.col("dice"))).alias("mean_dice"), F.avg(F.when(usable & gold, F.col("iou"))).alias("mean_iou"),
        (F.min("holdout_version") != F.max("holdout_version")).alias("mixed_holdout"), (F.min("model_sha256") != F.max("model_sha256")).alias("mixed_model"),
    )
    error = F.when(F.col("mixed_holdout"), "MIXED_HOLDOUT_VERSIONS").when(F.col("mixed_model"), "MIXED_MODEL_ARTIFACTS").when(repeated > 0, "DUPLICATE_SAMPLE_ID")
    joined = counts.withColumn("_k", F.lit(1)).join(extra.withColumn("_k", F.lit(1)), "_k")
    for name in ("dice", "iou"):
        ci = bootstrap_ci(rows.filter(usable & gold), name, ["sample_id"])
        joined = joined.join(ci.select(F.lit(1).alias("_k"), F.col("lower").alias(f"{name}_lower"), F.col("upper").alias(f"{name}_upper")), "_k")
    return joined.drop("_k").withColumn("error", error).drop("mixed_holdout", "mixed_model")


BUCKETS = 256


def bootstrap_ci(df: DataFrame, value: str, key: list[str], iterations: int = 2000, seed: int = 20260918) -> DataFrame:
    """Percentile interval of the mean. Every row falls into one of 256 buckets by the
    SHA-256 of its key; a resample draws 256 buckets with replacement, and the mean of a
    draw is the sum over the count of what was drawn. So the work besides one map-side
    aggregate does not depend on the rows. Draws come from SHA-256 of (seed, iteration,
    position): any engine can repeat them. Nulls are left out."""
    place = H.hex_bucket(H.sha256(F.concat_ws(":", *[F.col(k).cast("string") for k in key])), 2)
    rows = df.select(place.alias("bucket"), F.col(value).cast("double").alias("v")).filter("v is not null")
    buckets = materialize(rows.groupBy("bucket").agg(F.sum("v").alias("s"), F.count("*").alias("c")), "buckets")
    spark = df.sparkSession
    pos = F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1)))
    drawn = spark.range(iterations).select(F.col("id").alias("b"), pos.alias("pos"))
    drawn = drawn.select("b", H.hex_bucket(H.sha256(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("pos").cast("string"))), 2).alias("bucket"))
    means = drawn.join(buckets, "bucket").groupBy("b").agg((F.sum("s") / F.sum("c")).alias("mean"))
    low, high = int(np.floor(0.025 * (iterations - 1))), int(np.floor(0.975 * (iterations - 1)))
    ordered = means.agg(F.array_sort(F.collect_list("mean")).alias("m"))  # one value per iteration
    whole = buckets.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum("s").alias("s"))
    joined = whole.withColumn("_k", F.lit(1)).join(ordered.withColumn("_k", F.lit(1)), "_k")
    pick = lambda i: F.when(F.col("n") > 1, F.get("m", F.least(F.lit(i), F.size("m") - 1))).otherwise(F.col("s"))
    return joined.select(pick(low).alias("lower"), pick(high).alias("upper"), F.when(F.col("n") > 1, iterations).otherwise(0).alias("iterations"), "n")


def threshold_sweep(df: DataFrame, score: str, gold: str, grid: list[float], by: list[str] = ()) -> DataFrame:
    """Dice of (score >= threshold) against gold for every threshold; the first maximum
    wins. Rows are counted once, by the number of thresholds they reach; the counts of each
    threshold are sums over that histogram, which has one row per group and grid step. Rows
    without a score or a label count for neither side."""
    levels = sorted(float(t) for t in grid)
    reached = sum((F.coalesce((F.col(score) >= t).cast("int"), F.lit(0)) for t in levels), F.lit(0))
    scored = F.col(score).isNotNull()
    histogram = df.groupBy(*by, reached.alias("_r")).agg(F.count_if(F.col(gold) & scored).alias("_pos"), F.count_if(~F.col(gold) & scored).alias("_neg"))
    cells = F.collect_list(F.struct("_r", "_pos", "_neg"))

    def at(i: int) -> Column:
        count = lambda name, keep: F.aggregate("_h", F.lit(0).cast("bigint"), lambda n, c: n + F.when(keep(c["_r"]), c[name]).otherwise(0))
        tp, fp, fn = count("_pos", lambda r: r > i), count("_neg", lambda r: r > i), count("_pos", lambda r: r <= i)
        both = 2 * tp + fp + fn
        return F.struct(F.when(both == 0, 1.0).otherwise(2 * tp / both).alias("metric"), F.lit(-levels[i]).alias("t"))

    best = histogram.groupBy(*by).agg(cells.alias("_h")).withColumn("m", F.array_max(F.array(*[at(i) for i in range(len(levels))])))
    return best.select(*by, (-F.col("m.t")).alias("threshold"), F.col("m.metric").alias("metric"))


def coverage_agreement(df: DataFrame, pred: str, gold: str, minimum: float = 0.018, by: list[str] = ()) -> DataFrame:
    """Share of rows where both sides are on the same side of the minimum."""
    same = (F.col(pred) >= minimum) == (F.col(gold) >= minimum)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(same.cast("int")).alias("agreement"))


def metrics_by_subset(df: DataFrame, split: str, source: str, gold: Column, pred: Column) -> DataFrame:
    """The same counts per split and per split and source, from one scan."""
    flags = df.select(split, source, gold.alias("g"), pred.alias("p"))
    counts = flags.groupingSets([[F.col(split)], [F.col(split), F.col(source)]], F.col(split), F.col(source)).agg(
        F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g") & ~F.col("p")).alias("tn"),
        F.count_if(~F.col("g") & F.col("p")).alias("fp"), F.count_if(F.col("g") & ~F.col("p")).alias("fn"),
    )
    return with_rates(counts)
