import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.operators import evaluation as E, governance as G


def test_gold_ready_rules(spark):
    ann = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "a", True), (4, "c", False)], "annotation_id long, annotator string, verified boolean")
    adj = spark.createDataFrame([(10, 100, [1, 2]), (11, 101, [1, 3]), (12, 102, [1, 2, 4]), (13, 103, [1, 2, 99])], "adjudication_id long, sample_id long, source_annotation_ids array<long>")
    got = {r["adjudication_id"]: r["gold_ready"] for r in G.gold_ready(adj, ann).collect()}
    assert got == {10: True, 11: False, 12: False, 13: False}


def test_allocation_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [(i, rng.randrange(5)) for i in range(40)]
    done = [(rng.choice("abc"), rng.randrange(60)) for _ in range(50)]
    out = G.allocate_packets(
        spark.createDataFrame(pool, "sample_id long, created_at int"), spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "annotator string"),
        spark.createDataFrame(done, "annotator string, sample_id long"), 7, ["created_at", "sample_id"],
    )
    got = sorted((r["annotator"], r["packet_no"], r["sample_id"]) for r in out.collect())
    order = [s for s, _ in sorted(pool, key=lambda p: (p[1], p[0]))]
    want = [(a, n, s) for a in "abcd" for n, s in enumerate([s for s in order if (a, s) not in set(done)][:7], 1)]
    assert got == want


def members(spark, n=500):
    return spark.range(n).select(F.col("id").alias("sample_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest")).withColumn("split", G.holdout_split(F.col("digest")))


def test_manifest_ignores_partitioning_and_sees_changes(spark):
    base = G.manifest(members(spark)).first()["manifest_sha256"]
    assert G.manifest(members(spark).repartition(7, "digest")).first()["manifest_sha256"] == base
    assert G.manifest(members(spark).withColumn("split", F.lit("train"))).first()["manifest_sha256"] != base
    assert G.manifest_digest(members(spark), 4).first()["members"] == 500
    with pytest.raises(ValueError):
        G.manifest_digest(members(spark), 3)


def test_splits_never_overlap(spark):
    rows = members(spark).withColumn("grp", F.substring("digest", 1, 2)).withColumn("source", F.lit("x"))
    out = G.split_by_group_pct(rows.drop("split"), "grp", "source", "none", "sample_id")
    assert G.leakage_audit(out, ["grp", "digest"]).filter("crossing > 0").count() == 0


def test_version_is_registered_once(spark, tmp_path):
    first = G.register_version(members(spark), str(tmp_path)).first()
    again = G.register_version(members(spark), str(tmp_path)).first()
    assert first["created"] and not again["created"] and first["version"] == again["version"] and again["stored"] == 500


def test_locked_export_refuses_drift(spark):
    locked = members(spark)
    changed = locked.withColumn("digest", F.when(F.col("sample_id") == locked.filter("split = 'holdout'").first()["sample_id"], "other").otherwise(F.col("digest")))
    with pytest.raises(ValueError):
        G.export_locked(locked, changed, "holdout")
    assert G.export_locked(locked, locked, "holdout").count() == locked.filter("split = 'holdout'").count()


def test_balanced_sample_tops_up_negatives(spark):
    rows = [("k", i, i < 6) for i in range(8)]
    out = G.balanced_sample(spark.createDataFrame(rows, "key string, row long, positive boolean"), "key", "row", "positive", 10).collect()
    assert sum(r["positive"] for r in out) == 5 and sum(not r["positive"] for r in out) == 5


def test_champion_replay(spark):
    log = [(1, "promote", "a"), (2, "promote", "b"), (3, "promote", "a"), (4, "rollback", "a"), (5, "rollback", "a"), (6, "rollback", "z")]
    df = spark.createDataFrame([("f", i, i, act, m) for i, act, m in log], "family string, event_id long, d int, action string, model string")
    df = df.select("family", "event_id", F.timestamp_seconds(F.col("d") * 50_000).alias("ts"), "action", "model")
    replay = G.champion_state(df)
    assert {r["event_id"]: r["violation"] for r in replay.collect()} == {1: None, 2: None, 3: "not_a_candidate", 4: None, 5: "already_champion", 6: "never_promoted"}
    assert {r["event_id"]: r["champion"] for r in replay.collect()} == {1: "a", 2: "b", 3: "b", 4: "a", 5: "a", 6: "a"}
    spans = {r["event_id"]: r["valid_to"] is None for r in G.champion_history(replay).collect()}
    assert spans == {1: False, 2: False, 4: True}


def mask_row(spark, gold, pred, size):
    df = spark.createDataFrame([(gold, pred, size)], "g array<int>, p array<int>, n long")
    return E.rle_overlap(df, "g", "p", F.col("n")).first()


def test_mask_overlap(spark):
    same = mask_row(spark, [0, 2, 2], [0, 2, 2], 4)
    assert (same["dice"], same["iou"], same["gold_pixels"]) == (1.0, 1.0, 2)
    empty = mask_row(spark, [4], [4], 4)
    assert (empty["dice"], empty["iou"]) == (1.0, 1.0)
    assert mask_row(spark, [1, 2], [0, 4], 4)["mask_error"] == "RLE_LENGTH_MISMATCH"
    rng = np.random.default_rng(1)
    for _ in range(3):
        bits = rng.random((2, 60)) < 0.5
        runs = []
        for b in bits:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], b.astype(int)]))).tolist() + [60]
            runs.append([int(x) for x in np.diff([0] + edges)])
        row = mask_row(spark, runs[0], runs[1], 60)
        assert (row["gold_pixels"], row["pred_pixels"], row["intersection"]) == (bits[0].sum(), bits[1].sum(), (bits[0] & bits[1]).sum())


def agreement(spark, wrong, leak=False):
    rows = []
    for i in range(50):
        ref = {f: "Đỏ" for f in E.FIELDS}
        cand = {f: "đỏ " for f in E.FIELDS}
        if i < wrong:
            cand["moistureCoating"] = "khô"
        rows.append((str(i), "poor" if leak and i == 49 else "good", ref, cand))
    struct = "struct<" + ",".join(f"{f}:string" for f in E.FIELDS) + ">"
    df = spark.createDataFrame(rows, f"sample_id string, qc_grade string, reference {struct}, candidate {struct}")
    return E.agreement_metrics(df, E.field_agreement(df)).first()


def test_agreement_gate(spark):
    assert agreement(spark, 0)["eligible"]
    failed = agreement(spark, 3)
    assert not failed["eligible"] and not failed["gate_field"] and failed["gate_micro"]
    assert agreement(spark, 0, leak=True)["leaks"] == 10


def test_bootstrap_interval(spark):
    values = [(i, float(v)) for i, v in enumerate(np.random.default_rng(4).normal(10, 2, 4000))]
    df = spark.createDataFrame(values, "i long, v double")
    row = E.bootstrap_ci(df, "v", ["i"], iterations=400).first()
    data = np.array([v for _, v in values])
    draws = np.sort([np.random.default_rng([9, i]).choice(data, len(data)).mean() for i in range(400)])
    assert abs(row["lower"] - draws[9]) < 0.02 and abs(row["upper"] - draws[389]) < 0.02
    again = E.bootstrap_ci(df.repartition(5), "v", ["i"], iterations=400).first()
    assert np.allclose(row[:2], again[:2]) and row["n"] == again["n"] == 4000
    assert E.bootstrap_ci(df.limit(1), "v", ["i"]).first()["iterations"] == 0
    assert E.bootstrap_ci(df.filter("v > 1e9"), "v", ["i"]).first()["lower"] is None



def test_latest_approval_counts(spark):
    """A later rejection does not block; hashes compare without case, versions must agree."""
    candidates = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "cc"), (4, "dd")], "model_id long, sha string")
    reviews = spark.createDataFrame(
        [(1, 1, 10, "approve", 7, 7), (1, 2, 11, "reject", 7, 7), (2, 1, 12, "reject", 8, 8), (4, 1, 13, "approve", 7, 7)],
        "model_id long, created_at long, review_id long, decision string, evaluation_id long, shadow_id long",
    )
    evaluations = spark.createDataFrame([(7, 1, "AA", 200), (8, 2, "bb", 200)], "evaluation_id long, model_id long, sha string, sample_count int")
    shadows = spark.createDataFrame([(7, 1, "aA", 5, 5, True, True)], "shadow_id long, model_id long, sha string, runs int, complete_runs int, device_confirmed boolean, latency_confirmed boolean")
    got = {r["model_id"]: r["blocked_by"] for r in G.promotion_gate(candidates, reviews, evaluations, shadows, 200).collect()}
    assert got == {1: None, 2: "review_not_approved", 3: "review_missing", 4: "evaluation_hash_mismatch"}


def test_near_pairs_refuses_longer_distances(spark):
    from groundwork.operators import dedup as D

    with pytest.raises(ValueError):
        D.near_pairs(spark.createDataFrame([(1, 1, 50)], "ord long, simhash long, canon_len int"), max_distance=4)


def test_export_keeps_the_limit_it_is_given(spark):
    from groundwork.sources import writers as O

    df = spark.range(12_000).withColumn("v", F.col("id") % 7)
    assert O.export_samples(df, 9_999, ["id"]).count() == 9_999 and O.export_samples(df, None, ["id"]).count() == 12_000


def test_holdout_overlaps_are_computed_once(spark):
    """Readers of the rows must not carry the overlap sweep into their plans."""
    masks = spark.createDataFrame([(1, [2, 3, 5], [3, 3, 4]), (2, [0, 10], [1, 9]), (3, [10], [10])], "sample_id long, gold array<long>, pred array<long>")
    swept = E.rle_overlap(masks, "gold", "pred", F.lit(10))
    rows = swept.select("sample_id", F.lit("h").alias("holdout_version"), F.lit("m").alias("model_sha256"), F.lit(True).alias("usable"), (F.col("gold_pixels") > 0).alias("gold_present"), (F.col("pred_pixels") > 0).alias("pred_present"), "dice", "iou")
    out = E.holdout_metrics(rows)
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.first()
    assert (got["samples"], got["positives"], got["tp"], got["tn"], got["error"]) == (3, 2, 2, 1, None)
    assert abs(got["mean_dice"] - (4 / 6 + 18 / 19) / 2) < 1e-9
