"""Hash splits, manifests, annotation gates, allocation, promotion and learning events."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from groundwork.functions import hashing as H, jsonpred as J
from groundwork.operators.joins import salted_lookup, top_k, with_dense_index
from groundwork.session import materialize

# --- splits -----------------------------------------------------------------


def split_by_byte(digest: Column) -> Column:
    """First byte: below 205 train, below 230 validation, else test."""
    byte = H.hex_bucket(digest, 2)
    return F.when(byte < 205, "train").when(byte < 230, "validation").otherwise("test")


def split_by_value(value: Column) -> Column:
    """The same cut for ids that are not hex digests, on their SHA-256."""
    return split_by_byte(H.sha256(value.cast("string")))


def holdout_split(group_hash: Column) -> Column:
    """Modulo 5 = 0 is holdout; of the rest modulo 10 in (1, 6) is validation."""
    number = H.hex_bucket(group_hash, 8)
    return F.when(number % 5 == 0, "holdout").when((number % 10).isin(1, 6), "validation").otherwise("train")


def split_by_group_pct(df: DataFrame, group: str, source: str, external: str, row: str) -> DataFrame:
    """A group with a row of the external source goes to test; else its hash modulo 100:
    below 78 train, below 90 validation. Decided once per group, then looked up."""
    groups = df.groupBy(group).agg(F.max(F.col(source) == external).alias("_ext"))
    pct = H.hex_bucket(H.sha256(F.col(group)), 8, 100)
    rule = F.when(F.col("_ext"), "test").when(pct < 78, "train").when(pct < 90, "validation").otherwise("test")
    return salted_lookup(df, groups.select(group, rule.alias("split")), group, row)


def split_report(df: DataFrame, positive: Column, group: str) -> DataFrame:
    """Per split rows, positives, negatives and groups."""
    rows = df.groupBy("split").agg(F.count("*").alias("n"), F.count_if(positive).alias("positive"), F.count_if(~positive).alias("negative"))
    groups = df.select("split", group).distinct().groupBy("split").agg(F.count("*").alias("groups"))
    return rows.join(groups, "split")


def leakage_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key column the number of values found in more than one split. Minimum and
    maximum are enough and combine map-side, so hot groups cost nothing extra."""
    out = None
    for key in keys:
        crossing = df.groupBy(key).agg((F.min("split") != F.max("split")).alias("_x")).agg(F.count_if("_x").alias("crossing"))
        row = crossing.select(F.lit(key).alias("key"), "crossing")
        out = row if out is None else out.unionByName(row)
    return out


# --- samples ----------------------------------------------------------------


def training_ready(annotation: Column, status: Column, digest: Column, version: int = 3) -> Column:
    """Approved label, object annotation, non-blank digest and a non-blank note; version
    3 also accepts a structured contribution with boolean presence and its basis.
    ``annotation`` is a variant."""
    text = lambda path: F.trim(F.coalesce(F.try_variant_get(annotation, path, "string"), F.lit("")))
    base = (status == "clinician_feedback_approved") & J.json_is(annotation, "$", "object") & (F.trim(F.coalesce(digest, F.lit(""))) != "")
    noted = text("$.clinical_note") != ""
    if version < 3:
        return base & noted
    structured = (
        (text("$.source") == "verified_clinical_contribution_v1")
        & J.json_is(annotation, "$.structured_annotation", "object")
        & J.json_is(annotation, "$.structured_annotation.tongue_present", "boolean")
        & (text("$.verification_basis") == "app_professional_attestation_admin_approved")
    )
    return base & (noted | structured)


def latest_annotation(cases: DataFrame, primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Newest approved contribution (reviewed_at, created_at), else the active legacy row
    of the highest revision. Both sides carry ``payload``."""
    newest = primary.groupBy(key).agg(F.max(F.struct("reviewed_at", "created_at", "payload")).alias("_n"))
    legacy = fallback.groupBy(key).agg(F.max(F.struct("revision", "payload")).alias("_l"))
    joined = cases.join(newest, key, "left").join(legacy, key, "left")
    status = F.when(F.col("_n").isNotNull(), "contribution_approved").when(F.col("_l").isNotNull(), "legacy_active").otherwise("unlabelled")
    return joined.select(*cases.columns, F.coalesce("_n.payload", "_l.payload").alias("annotation"), status.alias("label_status"))


def upsert_samples(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Insert new keys, overwrite the columns of ``updates`` for known keys."""
    changed = [c for c in updates.columns if c != key]
    joined = base.join(updates.select(key, F.lit(True).alias("_u"), *[F.col(c).alias(f"_{c}") for c in changed]), key, "full_outer")
    pick = lambda c: F.when(F.col("_u"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
    return joined.select(key, *[pick(c) for c in base.columns if c != key])


def integrity_digest(**fields: Column) -> Column:
    """SHA-256 of the row's JSON with sorted keys."""
    return H.sha256(H.stable_json(**fields))


# --- manifests --------------------------------------------------------------

MANIFEST_DEPTH = 6


def manifest_digest(members: DataFrame, depth: int = MANIFEST_DEPTH) -> DataFrame:
    """Tree digest over lines ``id:digest:split``. A leaf holds the lines whose SHA-256
    starts with the same ``depth`` hex characters, ordered bytewise; a parent hashes
    the ordered hashes of its 256 children. The depth is one for all versions, so a
    digest means the same at every size; 16 million leaves keep a leaf small."""
    if depth < 2 or depth % 2:
        raise ValueError("the depth must be even")
    line = F.concat_ws(":", F.col("sample_id").cast("string"), "digest", "split")
    lines = members.select(line.alias("_l")).withColumn("_p", F.substring(H.sha256(F.col("_l")), 1, depth))
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    level = lines.groupBy("_p").agg(H.sha256(joined("_l")).alias("_h"), F.count("*").alias("_n"))
    for size in range(depth - 2, -1, -2):
        entry = F.concat_ws(":", "_p", "_h").alias("_e")
        up = level.select(F.substring("_p", 1, size).alias("_q"), entry, "_n")
        level = up.groupBy("_q").agg(H.sha256(joined("_e")).alias("_h"), F.sum("_n").alias("_n")).withColumnRenamed("_q", "_p")
    return level.select(F.col("_h").alias("manifest_sha256"), F.col("_n").alias("members"), F.lit(depth).alias("depth"))


def manifest(members: DataFrame, prefix: str = "ds", depth: int = MANIFEST_DEPTH) -> DataFrame:
    """One row: digest, version (prefix + first 16 hex), members and counts by split."""
    head = manifest_digest(members, depth)
    counts = members.agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "validation", "test", "holdout")])
    joined = head.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return joined.withColumn("version", F.concat(F.lit(prefix + "-"), F.substring("manifest_sha256", 1, 16)))


def register_version(members: DataFrame, path: str, prefix: str = "ds") -> DataFrame:
    """Write the members once under their version. A known version is left alone; one
    that is stored with another digest or member count (two digests with the same first
    16 characters) is an error. Returns the manifest row."""
    spark = members.sparkSession
    head = materialize(manifest(members, prefix), "manifest")
    row = head.first()
    target = os.path.join(path, f"version={row['version']}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")
    exists = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    if not exists:
        members.select("sample_id", "digest", "split").write.mode("errorifexists").parquet(target)
    found = manifest_digest(spark.read.parquet(target)).first()
    stored = found["members"] if found else 0
    if stored != row["members"] or (found and found["manifest_sha256"] != row["manifest_sha256"]):
        raise ValueError(f"version {row['version']} holds {stored} members of another manifest, expected {row['members']}")
    return head.withColumn("created", F.lit(not exists)).withColumn("stored", F.lit(stored).cast("bigint"))


def drift(members: DataFrame, current: DataFrame) -> DataFrame:
    """Members that are missing, moved to another split or changed, with the reason."""
    now = current.select("sample_id", F.col("digest").alias("_d"), F.col("split").alias("_s"))
    joined = members.join(now, "sample_id", "left")
    reason = F.when(F.col("_d").isNull(), "missing").when(F.col("_s") != F.col("split"), "moved").when(F.col("_d") != F.col("digest"), "changed")
    return joined.select("sample_id", reason.alias("reason")).filter("reason is not null")


def export_locked(members: DataFrame, current: DataFrame, split: str = "test") -> DataFrame:
    """The locked split joined on id and digest. Raises when a member has no unchanged
    current row; callers order the result on write."""
    locked = members.filter(F.col("split") == split).select("sample_id", "digest")
    rows = locked.join(current.drop("split"), ["sample_id", "digest"])
    if locked.join(current, ["sample_id", "digest"], "left_anti").limit(1).count():
        raise ValueError("locked members are missing or changed")
    return rows


# --- annotations ------------------------------------------------------------


def verified_annotations(annotations: DataFrame, contributions: DataFrame) -> DataFrame:
    """Annotations backed by an approved, attested contribution of the same case, sample
    hash and annotator whose basis is not blank."""
    good = contributions.filter(
        (F.col("status") == "approved") & F.col("attested") & (F.trim(F.coalesce("basis", F.lit(""))) != "") & F.col("reviewed_at").isNotNull()
    ).select("sample_id", "sample_sha", "annotator").distinct()
    return annotations.join(good, ["sample_id", "sample_sha", "annotator"])


def gold_ready(adjudications: DataFrame, annotations: DataFrame) -> DataFrame:
    """Adjudicated samples with at least two distinct verified annotators among the
    listed annotation ids and no listed id that is unverified or unknown.
    annotations: annotation_id, annotator, verified."""
    listed = adjudications.select("adjudication_id", "sample_id", F.explode("source_annotation_ids").alias("annotation_id"))
    facts = listed.join(annotations.select("annotation_id", "annotator", "verified"), "annotation_id", "left")
    ok = F.coalesce("verified", F.lit(False))
    rolled = facts.groupBy("adjudication_id", "sample_id").agg(
        F.count_distinct(F.when(ok, F.col("annotator"))).alias("verified_annotators"), F.bool_and(ok).alias("all_verified")
    )
    return rolled.select("adjudication_id", "sample_id", "verified_annotators", (F.col("all_verified") & (F.col("verified_annotators") >= 2)).alias("gold_ready"))


def gold_progress(pool: DataFrame, annotations: DataFrame, adjudicated: DataFrame, holdout: DataFrame) -> DataFrame:
    """Per pool sample distinct annotators, eligibility and the two existence flags."""
    pairs = annotations.select("sample_id", "annotator").distinct().groupBy("sample_id").agg(F.count("*").alias("annotators"))
    flag = lambda df, name: df.select("sample_id").distinct().withColumn(name, F.lit(True))
    joined = pool.join(pairs, "sample_id", "left").join(flag(adjudicated, "adjudicated"), "sample_id", "left").join(flag(holdout, "in_holdout"), "sample_id", "left")
    n = F.coalesce("annotators", F.lit(0))
    return joined.select("sample_id", n.alias("annotators"), (n >= 2).alias("eligible"), F.coalesce("adjudicated", F.lit(False)).alias("adjudicated"), F.coalesce("in_holdout", F.lit(False)).alias("in_holdout"))


def expert_rollup(contributions: DataFrame, expert: str, approved: Column, **largest: Column) -> DataFrame:
    """Per expert the largest name fields, approved count and last approval; experts
    without an approved contribution are left out."""
    aggs = [F.max(c).alias(n) for n, c in largest.items()]
    return contributions.groupBy(expert).agg(*aggs, F.count_if(approved).alias("approved"), F.max(F.when(approved, F.col("reviewed_at"))).alias("last_approved")).filter("approved > 0")


def allocate_packets(pool: DataFrame, annotators: DataFrame, done: DataFrame, n: int, order: list[str], start: int = 0) -> DataFrame:
    """For each annotator the first n open samples in ``order`` that are not in ``done``
    (annotator, sample_id). The n first of them lie among the first n + |done| open
    samples, so only those positions are generated: the work is n per annotator plus
    the size of ``done``, not annotators x samples."""
    if n < 1:
        raise ValueError("n must be positive")
    places = materialize(with_dense_index(pool, order, "_place", start).select("sample_id", "_place"), "places")
    finished = materialize(done.select("annotator", "sample_id").distinct().join(places, "sample_id"), "done")
    counts = finished.groupBy("annotator").agg(F.count("*").alias("_c"))
    reach = annotators.select("annotator").join(counts, "annotator", "left").select("annotator", (F.coalesce("_c", F.lit(0)) + n).alias("_reach"))
    offers = reach.select("annotator", F.explode(F.sequence(F.lit(start).cast("bigint"), F.col("_reach") + start - 1)).alias("_place"))
    fresh = offers.join(finished.select("annotator", "_place"), ["annotator", "_place"], "left_anti")
    chosen = top_k(fresh, ["annotator"], [F.asc("_place")], n, "packet_no")
    return chosen.join(places, "_place").select("annotator", "sample_id", "packet_no")


def adjudication_candidates(annotations: DataFrame, closed: DataFrame, adjudicators: DataFrame, n: int = 1) -> DataFrame:
    """For each adjudicator the first n samples with at least two annotators other than
    the adjudicator, not yet adjudicated or assigned (``closed``). A sample with three
    annotators suits everybody, one with exactly two suits everybody but these two."""
    pairs = materialize(annotations.select("sample_id", "annotator").distinct(), "pairs")
    counts = pairs.groupBy("sample_id").agg(F.count("*").alias("_n")).filter("_n >= 2")
    open_ = materialize(counts.join(closed.select("sample_id").distinct(), "sample_id", "left_anti"), "open")
    barred = pairs.join(open_.filter("_n = 2"), "sample_id", "left_semi")
    out = allocate_packets(open_.select("sample_id"), adjudicators.select(F.col("adjudicator").alias("annotator")), barred, n, ["sample_id"])
    return out.withColumnRenamed("annotator", "adjudicator")


def source_pair(annotations: DataFrame) -> DataFrame:
    """First two annotation ids of a sample as an ordered array, and its annotators."""
    first = top_k(annotations.select("sample_id", "annotation_id"), ["sample_id"], [F.asc("annotation_id")], 2, "_r")
    pair = first.groupBy("sample_id").agg(F.array_sort(F.collect_list("annotation_id")).alias("source_annotation_ids"))
    people = annotations.select("sample_id", "annotator").distinct().groupBy("sample_id").agg(F.count("*").alias("annotators"))
    return pair.join(people, "sample_id")


def reviewer_progress(reviewers: DataFrame, assignments: DataFrame, annotations: DataFrame, n_eligible: DataFrame) -> DataFrame:
    """Per reviewer submitted and pending assignments, and done out of eligible."""
    done = annotations.select("reviewer", "sample_id").distinct().groupBy("reviewer").agg(F.count("*").alias("done"))
    given = assignments.select("reviewer", "sample_id", "submitted").groupBy("reviewer", "sample_id").agg(F.bool_or("submitted").alias("submitted"))
    states = given.groupBy("reviewer").agg(F.count_if("submitted").alias("submitted"), F.count_if(~F.col("submitted")).alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = reviewers.select("reviewer").join(done, "reviewer", "left").join(states, "reviewer", "left")
    return joined.select("reviewer", zero("done"), zero("submitted"), zero("pending")).withColumn("eligible", n_eligible.scalar())


def status_rollup(**groups: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """Filtered counts of several tables in one record: one pass per table, joined as
    one-row frames."""
    out = None
    for name, (df, conditions) in groups.items():
        row = df.agg(F.count("*").alias(f"{name}_total"), *[F.count_if(c).alias(f"{name}_{k}") for k, c in conditions.items()]).withColumn("_k", F.lit(1))
        out = row if out is None else out.join(row, "_k")
    return out.drop("_k")


# --- event logs -------------------------------------------------------------


def previous_value(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Value of the preceding row of the same keys, without gathering a hot key in one
    task: the lag runs inside (keys, bucket), and the first row of a bucket takes the
    last value of the previous bucket from a small per-bucket summary."""
    inside = W.partitionBy(*keys, bucket).orderBy(*order)
    marked = df.withColumn("_lag", F.lag(F.struct(value)).over(inside))
    last = df.groupBy(*keys, bucket).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.withColumn("_prev", F.lag("_last").over(W.partitionBy(*keys).orderBy(bucket))).drop("_last")
    joined = marked.join(carried, [*keys, bucket], "left")
    return joined.withColumn(out, F.coalesce(F.col("_lag"), F.col("_prev"))[value]).drop("_lag", "_prev")


def champion_state(log: DataFrame) -> DataFrame:
    """Replay of promote / rollback events (family, event_id, ts, action, model) with the
    model that is champion after each event and its violations.

    A model is a candidate until its first promotion, so a later one is refused. A
    rollback needs an earlier promotion; a rollback to the reigning champion is
    refused too but leaves the same champion. So an event decides the champion iff it
    is a first promotion or a rollback to a promoted model."""
    place = F.struct("ts", "event_id")
    first = log.filter("action = 'promote'").groupBy("family", "model").agg(F.min(place).alias("_first"))
    named = lambda df: df.withColumn("_fm", F.concat_ws(":", "family", "model"))
    judged = salted_lookup(named(log), named(first).select("_fm", "_first"), "_fm", "event_id", how="left").withColumn("_place", place).withColumn("day", F.to_date("ts"))
    promotes = (F.col("action") == "promote") & (F.col("_place") == F.col("_first"))
    restores = (F.col("action") == "rollback") & F.col("_first").isNotNull() & (F.col("_first") < F.col("_place"))
    deciding = materialize(judged.filter(promotes | restores).select("family", "day", "ts", "event_id", "action", "model"), "deciding")
    deciding = previous_value(deciding, ["family"], "day", ["ts", "event_id"], "model", "before")
    refused = judged.filter(~(promotes | restores)).select("family", "event_id", "ts", "action", "model", F.when(F.col("action") == "promote", "not_a_candidate").otherwise("never_promoted").alias("violation"))
    same = F.col("before") == F.col("model")
    kept = deciding.select("family", "event_id", "ts", "action", "model", F.when(same, "already_champion").alias("violation"), F.col("model").alias("_set"))
    every = kept.unionByName(refused.withColumn("_set", F.lit(None).cast(dict(kept.dtypes)["model"]))).withColumn("day", F.to_date("ts"))
    last = kept.withColumn("day", F.to_date("ts")).groupBy("family", "day").agg(F.max_by("_set", F.struct("ts", "event_id")).alias("_set"))
    days = every.select("family", "day").distinct().join(last, ["family", "day"], "left")
    carried = days.withColumn("_carried", F.last("_set", True).over(W.partitionBy("family").orderBy("day").rowsBetween(W.unboundedPreceding, -1))).drop("_set")
    inside = W.partitionBy("family", "day").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = every.withColumn("_inside", F.last("_set", True).over(inside)).join(carried, ["family", "day"])
    return marked.select("family", "event_id", "ts", "action", "model", "violation", F.coalesce("_inside", "_carried").alias("champion"))


def champion_history(replay: DataFrame) -> DataFrame:
    """valid_from / valid_to of each reign, from the events without a violation. The next
    change is found per (family, day) with a per-day summary, like previous_value."""
    changes = replay.filter("violation is null").select("family", "model", "ts", "event_id").withColumn("day", F.to_date("ts"))
    inside = W.partitionBy("family", "day").orderBy("ts", "event_id")
    starts = changes.groupBy("family", "day").agg(F.min("ts").alias("_t"))
    following = starts.withColumn("_next", F.lead("_t").over(W.partitionBy("family").orderBy("day"))).drop("_t")
    marked = changes.withColumn("_lead", F.lead("ts").over(inside)).join(following, ["family", "day"])
    return marked.select("family", "model", F.col("ts").alias("valid_from"), F.coalesce("_lead", "_next").alias("valid_to"), "event_id")


def promotion_gate(candidates: DataFrame, reviews: DataFrame, evaluations: DataFrame, shadows: DataFrame, holdout_count: int, min_runs: int = 5) -> DataFrame:
    """A candidate is promotable iff its latest approving review (a later rejection does
    not block) links a gold evaluation and a shadow evidence of its own version and
    hash, compared without case, the evaluation covers the whole holdout, at least
    ``min_runs`` complete runs carry the hash and both physical confirmations are set.
    ``evaluations`` and ``shadows`` carry model_id and sha; ``shadows`` also runs,
    complete_runs (runs that are complete and of that hash), device_confirmed and
    latency_confirmed."""
    fields = F.struct("created_at", "review_id", "evaluation_id", "shadow_id")
    latest = reviews.groupBy("model_id").agg(F.max(F.when(F.col("decision") == "approve", fields)).alias("r")).select("model_id", F.lit(True).alias("reviewed"), "r.*")
    e = evaluations.select("evaluation_id", F.col("model_id").alias("_emodel"), F.lower("sha").alias("_esha"), "sample_count")
    s = shadows.select("shadow_id", F.col("model_id").alias("_smodel"), F.lower("sha").alias("_ssha"), "runs", "complete_runs", "device_confirmed", "latency_confirmed")
    joined = candidates.join(latest, "model_id", "left").join(e, "evaluation_id", "left").join(s, "shadow_id", "left")
    own = lambda model, sha: (F.col(model) == F.col("model_id")) & (F.col(sha) == F.lower("sha"))
    checks = [
        (F.col("reviewed"), "review_missing"),
        (F.col("review_id").isNotNull(), "review_not_approved"),
        (own("_emodel", "_esha"), "evaluation_hash_mismatch"),
        (F.col("sample_count") == holdout_count, "holdout_not_covered"),
        (own("_smodel", "_ssha"), "shadow_hash_mismatch"),
        (F.col("runs") >= min_runs, "too_few_runs"),
        (F.col("runs") == F.col("complete_runs"), "incomplete_run"),
        (F.col("device_confirmed") & F.col("latency_confirmed"), "physical_confirmation_missing"),
    ]
    return joined.select("model_id", J.first_error(*checks).alias("blocked_by")).withColumn("promotable", F.col("blocked_by").isNull())


def learning_events(contributions: DataFrame, samples: DataFrame, pool: DataFrame) -> DataFrame:
    """Learning events of two status logs: a contribution (contribution_id, sample_id, ts,
    event_id, status) that becomes approved, once per contribution; a sample (sample_id,
    group_hash, ts, event_id, status) that becomes adjudicated, once per sample and group.
    ``pool``: sample_id, group_hash of known samples. Samples whose group hash is in the
    prospective holdout are blocked; ``rebuild`` marks adjudications that call for a new
    snapshot. The first row with the status always is a transition into it, so minima
    decide and no log is ordered."""
    at = F.min(F.struct("ts", "event_id", "sample_id")).alias("e")
    approved = contributions.filter("status = 'approved'").groupBy("contribution_id").agg(at)
    approved = approved.select(F.lit("verified_contribution_approved").alias("event_type"), F.col("contribution_id").cast("string").alias("ref"), "e.*").join(pool, "sample_id", "left")
    adjudicated = samples.filter("status = 'adjudicated'").groupBy("sample_id", "group_hash").agg(F.min(F.struct("ts", "event_id")).alias("e"))
    adjudicated = adjudicated.select(F.lit("adjudicated_training_ready").alias("event_type"), F.concat_ws("|", F.col("sample_id").cast("string"), "group_hash").alias("ref"), "e.*", "sample_id", "group_hash")
    return learning_state(approved.unionByName(adjudicated))


def learning_state(every: DataFrame) -> DataFrame:
    """Key, state and rebuild flag of learning events (event_type, ref, event_id, sample_id,
    group_hash)."""
    held = F.coalesce(H.hex_bucket(F.col("group_hash"), 8, 5) == 0, F.lit(False))
    return every.select(
        H.sha256(F.concat_ws("|", "event_type", "ref")).alias("event_key"), "event_type", "sample_id", "event_id",
        F.when(held, "blocked_holdout").otherwise("queued").alias("state"), (~held & (F.col("event_type") == "adjudicated_training_ready")).alias("rebuild"),
    )


def mark_snapshotted(events: DataFrame, members: DataFrame) -> DataFrame:
    """Queued events whose sample is a member become ``snapshotted``."""
    inside = members.select("sample_id").distinct().withColumn("_m", F.lit(True))
    joined = salted_lookup(events, inside, "sample_id", "event_id", how="left")
    return joined.withColumn("state", F.when((F.col("state") == "queued") & F.col("_m"), "snapshotted").otherwise(F.col("state"))).drop("_m")


def review_queue(contributions: DataFrame, limit: int = 500, content: str = "content_sha256") -> DataFrame:
    """The first ``limit`` rows, pending first, newest first. A resubmission of the same
    content keeps the first row and only moves updated_at."""
    columns = [c for c in contributions.columns if c not in (content, "updated_at")]
    first = contributions.groupBy(content).agg(F.min(F.struct("created_at", *[c for c in columns if c != "created_at"])).alias("_f"), F.max("updated_at").alias("updated_at"))
    rows = first.select(content, *[F.col(f"_f.{c}").alias(c) for c in columns], "updated_at")
    return rows.orderBy((F.col("status") == "pending").desc(), F.col("created_at").desc(), F.col("contribution_id").desc()).limit(limit)


# --- contracts --------------------------------------------------------------


def evidence_contract(df: DataFrame) -> DataFrame:
    """First broken rule of an evaluation record: non-empty JSON objects and their keys.
    JSON text columns: metric_results, calibration_results, baseline_metrics,
    regression_results, provenance; text column baseline_ref."""
    v = lambda c: F.try_parse_json(F.col(c))
    filled = lambda c: J.json_is(v(c), "$", "object") & (F.regexp_replace(c, r"\s", "") != "{}")
    has = lambda c, path: J.json_kind(v(c), path).isNotNull()
    checks = [
        (F.trim(F.coalesce("baseline_ref", F.lit(""))) != "", "baseline_ref_required"),
        (filled("metric_results"), "metric_results_required"),
        (filled("calibration_results"), "calibration_results_required"),
        (filled("baseline_metrics"), "baseline_metrics_required"),
        (filled("regression_results"), "regression_results_required"),
        (filled("provenance"), "evaluation_provenance_required"),
        (J.json_is(v("metric_results"), "$.errorMetrics", "object"), "error_metrics_required"),
        (J.json_is(v("metric_results"), "$.taskMetrics", "object"), "task_metrics_required"),
        (has("calibration_results", "$.method") & J.json_is(v("calibration_results"), "$.calibrationMetrics", "object"), "calibration_contract_invalid"),
        (J.json_is(v("regression_results"), "$.comparison", "object"), "regression_comparison_required"),
    ]
    return df.withColumn("error", J.first_error(*checks))


# Allowed enum values of an annotation.
MORPHOLOGY_ENUMS = [
    ("$.morphology.medianSulcus.prominence", ["none", "mild", "prominent", "uncertain", "not_visible"], "median_sulcus_prominence_invalid"),
    ("$.morphology.fissure.visualStatus", ["absent", "possible", "present", "uncertain"], "fissure_visual_status_invalid"),
    ("$.morphology.fissure.branching", ["absent", "present", "uncertain", "not_applicable"], "fissure_branching_invalid"),
    ("$.morphology.fissure.pattern", ["midline_only", "branched", "multiple", "network", "other", "uncertain", "not_applicable"], "fissure_pattern_invalid"),
    ("$.morphology.toothmarks.status", ["absent", "present", "uncertain"], "toothmarks_status_invalid"),
    ("$.morphology.bodyShape.status", ["normal", "swollen", "thin", "uncertain"], "body_shape_status_invalid"),
    ("$.morphology.fissure.depth", ["not_collected_from_2d"], "fissure_depth_must_not_be_inferred_from_2d"),
]


def annotation_error(annotation: Column, mask_size: int = 160) -> Column:
    """First broken rule of an annotation variant, null when valid. Mask and morphology
    rules apply only when the subject is present."""
    present = F.coalesce(F.try_variant_get(annotation, "$.tongue_present", "boolean"), F.lit(False))
    size = F.try_variant_get(annotation, "$.roi_mask_rle.size", "array<int>")
    counts = F.try_variant_get(annotation, "$.roi_mask_rle.counts", "array<int>")
    when_present = lambda ok: ~present | F.coalesce(ok, F.lit(False))
    checks = [
        (J.json_is(annotation, "$", "object"), "annotation_object_required"),
        (J.json_is(annotation, "$.tongue_present", "boolean"), "tongue_present_boolean_required"),
        (J.json_in(annotation, "$.image_quality", ["usable", "uncertain", "reject"]), "image_quality_invalid"),
        (when_present(J.json_is(annotation, "$.roi_mask_rle", "object")), "roi_mask_rle_required_when_tongue_present"),
        (when_present(size == F.array(F.lit(mask_size), F.lit(mask_size))), f"roi_mask_size_must_be_{mask_size}x{mask_size}"),
        (when_present(F.size(counts) > 0), "roi_mask_counts_required"),
        (when_present(J.json_is(annotation, "$.morphology", "object")), "morphology_object_required_when_tongue_present"),
        (when_present(J.json_in(annotation, "$.morphology.schemaVersion", ["tongue-morphology-label-v1"])), "morphology_schema_invalid"),
    ]
    checks += [(when_present(J.json_in(annotation, path, allowed)), code) for path, allowed, code in MORPHOLOGY_ENUMS]
    return J.first_error(*checks)


# --- sampling ---------------------------------------------------------------


def replay_mix(train: DataFrame, replay: DataFrame, key: str, seed: str = "replay", copies: int = 4, multiplier: int = 4, floor_: int = 16) -> DataFrame:
    """Every training row ``copies`` times plus min(all, max(16, multiplier x n)) replay
    rows without replacement. The sample is the first rows in hash order, numbered over
    range partitions, so it is reproducible and needs no single-task sort."""
    wanted = max(floor_, multiplier * train.count())
    repeated = train.select(key, F.lit("train").alias("origin"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    ordered = replay.select(key).withColumn("_h", H.hash_key(seed, F.col(key)))
    numbered = with_dense_index(ordered, ["_h", key], "_i")
    drawn = numbered.filter(F.col("_i") < wanted).select(key, F.lit("replay").alias("origin"), F.lit(1).alias("copy"))
    return repeated.unionByName(drawn)


def balanced_sample(df: DataFrame, key: str, row: str, positive: str, n: int, seed: str = "balance") -> DataFrame:
    """Per key min(n/2, positives) positives and n minus that many negatives, in hash
    order; negatives repeat only when there are too few (and a key without positives
    gives min(n, negatives)). Output key, row, positive, copy."""
    totals = df.groupBy(key).agg(F.count_if(positive).alias("_p"), F.count_if(~F.col(positive)).alias("_q"))
    want_p = F.least(F.lit(n // 2), F.col("_p"))
    want_n = F.when(F.col("_p") == 0, F.least(F.lit(n), F.col("_q"))).otherwise(n - want_p)
    hashed = df.select(key, row, positive).withColumn("_h", H.hash_key(seed, F.col(row)))
    first = top_k(hashed, [key, positive], [F.asc("_h"), F.asc(row)], n, "_r")
    joined = first.join(totals, key).withColumn("_w", F.when(F.col(positive), want_p).otherwise(want_n)).withColumn("_have", F.when(F.col(positive), F.col("_p")).otherwise(F.col("_q")))
    times = F.floor((F.col("_w") - F.col("_r")) / F.col("_have")) + 1
    return joined.filter(F.col("_r") <= F.col("_w")).select(key, row, positive, F.explode(F.sequence(F.lit(1).cast("bigint"), times)).alias("copy"))


def class_weight(df: DataFrame, positive: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg((F.count_if(~F.col(positive)) / F.greatest(F.lit(1), F.count_if(positive))).alias("positive_weight"))
