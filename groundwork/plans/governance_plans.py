"""G: splits, manifests, annotation gates, allocation, promotion, learning events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groundwork.functions import hashing as H
from groundwork.operators import governance as G
from groundwork.plans import ansi as A
from groundwork.plans.base import query, table
from groundwork.session import materialize, scratch_dir

_BYTE = lambda h: f"case when {A.hexnum(h, 2)} < 205 then 'train' when {A.hexnum(h, 2)} < 230 then 'validation' else 'test' end"
_HOLD = lambda h: f"case when {A.hexnum(h, 8)} % 5 = 0 then 'holdout' when {A.hexnum(h, 8)} % 10 in (1, 6) then 'validation' else 'train' end"
_MEMBERS = f"members as materialized (select doc_id as sample_id, source, lang, digest, {_HOLD('digest')} as split from (select *, sha256(text) as digest from documents))"


def members(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "source", "lang", F.sha2("text", 256).alias("digest"))
    return docs.withColumn("split", G.holdout_split(F.col("digest")))


@query("g01_split_by_byte", f"select split, count(*) as n from (select {_BYTE('sha256(text)')} as split from documents) group by split")
def g01(spark, sf):
    return members(spark, sf).groupBy(G.split_by_byte(F.col("digest")).alias("split")).agg(F.count("*").alias("n"))


@query("g01_split_by_value", f"select split, count(*) as n from (select {_BYTE('sha256(event_id::varchar)')} as split from events) group by split")
def g01_value(spark, sf):
    return table(spark, sf, "events").groupBy(G.split_by_value(F.col("event_id")).alias("split")).agg(F.count("*").alias("n"))


@query("g02_holdout_split", f"with {_MEMBERS} select split, count(*) as n, min(sample_id) as first_id from members group by split")
def g02(spark, sf):
    return members(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_id"))


_GROUPED = f"""grouped as materialized (select doc_id, source, digest, 'g' || substr(digest, 1, 3) as grp from (select *, sha256(text) as digest from documents)),
    splits as (select grp, case when max(cast(source = 'src7' as int)) = 1 then 'test' when {A.hexnum('sha256(grp)', 8)} % 100 < 78 then 'train'
      when {A.hexnum('sha256(grp)', 8)} % 100 < 90 then 'validation' else 'test' end as split from grouped group by grp),
    rows as materialized (select g.*, s.split from grouped g join splits s on s.grp = g.grp)"""


def grouped(spark, sf):
    rows = members(spark, sf).drop("split").withColumn("grp", F.concat(F.lit("g"), F.substring("digest", 1, 3)))
    return G.split_by_group_pct(rows, "grp", "source", "src7", "sample_id")


@query("g03_split_by_group_pct", f"with {_GROUPED} select doc_id as sample_id, grp, split from rows")
def g03(spark, sf):
    return grouped(spark, sf).select("sample_id", "grp", "split")


@query(
    "g04_leakage_audit",
    f"""with {_GROUPED} select 'grp' as key, count(*) as crossing from (select grp from rows group by grp having count(distinct split) > 1)
    union all select 'digest', count(*) from (select digest from rows group by digest having count(distinct split) > 1)
    union all select 'source', count(*) from (select source from rows group by source having count(distinct split) > 1)""",
)
def g04(spark, sf):
    return G.leakage_audit(grouped(spark, sf), ["grp", "digest", "source"])


@query(
    "g04_split_report",
    f"""with {_GROUPED} select split, count(*) as n, count(*) filter (where quality = 1) as positive, count(*) filter (where quality is distinct from 1) as negative,
    count(distinct grp) as groups from rows left join labels using (doc_id) group by split""",
)
def g04_report(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), "quality")
    rows = grouped(spark, sf).join(labels, "sample_id", "left")
    return G.split_report(rows, F.coalesce(F.col("quality") == 1, F.lit(False)), "grp")


@query(
    "g05_training_ready",
    """with s as (select l.doc_id, quality, toxic, lang, n_chars > 300 as ok, toxic = 0 and lang <> 'de' as noted, quality = 1 and lang <> 'es' as structured from labels l join documents d on d.doc_id = l.doc_id)
    select lang, count(*) filter (where ok and noted) as ready_v2, count(*) filter (where ok and (noted or structured)) as ready_v3 from s group by lang""",
)
def g05(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    note = F.when((F.col("toxic") == 0) & (F.col("lang") != "de"), "seen").otherwise("  ")
    structured = F.struct((F.col("toxic") == 1).alias("tongue_present"))
    annotation = F.to_json(
        F.struct(
            F.when(F.col("quality") == 1, "verified_clinical_contribution_v1").otherwise("legacy").alias("source"), note.alias("clinical_note"),
            F.when(F.col("lang") != "es", "app_professional_attestation_admin_approved").otherwise("none").alias("verification_basis"), structured.alias("structured_annotation"),
        )
    )
    status = F.when(F.col("n_chars") > 300, "clinician_feedback_approved").otherwise("draft")
    rows = rows.withColumn("a", F.try_parse_json(annotation))
    ready = lambda v: F.count_if(G.training_ready(F.col("a"), status, F.sha2("text", 256), v))
    return rows.groupBy("lang").agg(ready(2).alias("ready_v2"), ready(3).alias("ready_v3"))


@query(
    "g06_latest_annotation",
    """with p as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders where o_orderstatus = 'F' and o_totalprice > 300000),
    f as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as rn from orders where o_orderstatus = 'O')
    select c_custkey, coalesce(p.o_orderkey, f.o_orderkey) as annotation, case when p.o_orderkey is not null then 'contribution_approved' when f.o_orderkey is not null then 'legacy_active' else 'unlabelled' end as label_status
    from customer left join p on p.o_custkey = c_custkey and p.rn = 1 left join f on f.o_custkey = c_custkey and f.rn = 1""",
)
def g06(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    primary = orders.filter("o_orderstatus = 'F' and o_totalprice > 300000").select("c_custkey", F.col("o_orderdate").alias("reviewed_at"), F.col("o_orderkey").alias("created_at"), F.col("o_orderkey").alias("payload"))
    fallback = orders.filter("o_orderstatus = 'O'").select("c_custkey", F.col("o_totalprice").alias("revision"), F.col("o_orderkey").alias("payload"))
    return G.latest_annotation(table(spark, sf, "customer").select("c_custkey"), primary, fallback, "c_custkey")


@query(
    "g07_upsert_samples",
    """with u as (select o_custkey + 500 as c_custkey, max(o_totalprice) as c_acctbal, min(o_orderpriority) as c_mktsegment from orders group by 1)
    select coalesce(c.c_custkey, u.c_custkey) as c_custkey, c_name, c_nationkey, case when u.c_custkey is not null then u.c_acctbal else c.c_acctbal end as c_acctbal,
      case when u.c_custkey is not null then u.c_mktsegment else c.c_mktsegment end as c_mktsegment from customer c full join u on u.c_custkey = c.c_custkey""",
)
def g07(spark, sf):
    updates = table(spark, sf, "orders").groupBy((F.col("o_custkey") + 500).alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), F.min("o_orderpriority").alias("c_mktsegment"))
    return G.upsert_samples(table(spark, sf, "customer"), updates, "c_custkey")


@query(
    "g08_integrity_digest",
    """select doc_id, sha256('{"digest":"' || sha256(text) || '","doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"note":null,"source":"' || source || '"}') as integrity_sha256 from documents""",
)
def g08(spark, sf):
    docs = table(spark, sf, "documents")
    digest = G.integrity_digest(source=F.col("source"), doc_id=F.col("doc_id"), lang=F.col("lang"), n_chars=F.col("n_chars"), digest=F.sha2("text", 256), note=F.lit(None).cast("string"))
    return docs.select("doc_id", digest.alias("integrity_sha256"))


_MANIFEST = f"""{_MEMBERS}, lines as (select sample_id || ':' || digest || ':' || split as l from members),
    t6 as (select substr(sha256(l), 1, 6) as p, sha256(string_agg(l, chr(10) order by l)) as h from lines group by 1),
    t4 as (select substr(p, 1, 4) as p, sha256(string_agg(p || ':' || h, chr(10) order by p || ':' || h)) as h from t6 group by substr(p, 1, 4)),
    t2 as (select substr(p, 1, 2) as p, sha256(string_agg(p || ':' || h, chr(10) order by p || ':' || h)) as h from t4 group by substr(p, 1, 2)),
    root as (select sha256(string_agg(p || ':' || h, chr(10) order by p || ':' || h)) as manifest_sha256 from t2)"""


@query(
    "g09_manifest",
    f"""with {_MANIFEST} select manifest_sha256, 'ds-' || substr(manifest_sha256, 1, 16) as version, count(*) as members, count(*) filter (where split = 'train') as n_train,
      count(*) filter (where split = 'validation') as n_validation, count(*) filter (where split = 'test') as n_test, count(*) filter (where split = 'holdout') as n_holdout from members, root group by all""",
)
def g09(spark, sf):
    return G.manifest(members(spark, sf)).drop("depth")


@query("g10_register_version", f"with {_MANIFEST} select 'ds-' || substr(manifest_sha256, 1, 16) as version, count(*) as members, count(*) as stored, true as created from members, root group by all")
def g10(spark, sf):
    path = f"{scratch_dir(spark)}/versions-{uuid.uuid4().hex}"
    return G.register_version(members(spark, sf), path).select("version", "members", "stored", "created")


@query(
    "g11_drift",
    f"""with {_MEMBERS}, cur as (select sample_id, case when source = 'src3' then sha256('x' || digest) else digest end as d, case when source = 'src4' then 'train' else split end as s from members where lang <> 'es')
    select * from (select m.sample_id, case when c.sample_id is null then 'missing' when c.s <> m.split then 'moved' when c.d <> m.digest then 'changed' end as reason from members m left join cur c using (sample_id)) where reason is not null""",
)
def g11(spark, sf):
    now = members(spark, sf).filter("lang <> 'es'")
    now = now.withColumn("digest", F.when(F.col("source") == "src3", F.sha2(F.concat(F.lit("x"), "digest"), 256)).otherwise(F.col("digest")))
    now = now.withColumn("split", F.when(F.col("source") == "src4", "train").otherwise(F.col("split")))
    return G.drift(members(spark, sf), now)


@query("g12_export_locked", f"with {_MEMBERS} select sample_id, digest, source from members where split = 'holdout'")
def g12(spark, sf):
    locked = materialize(members(spark, sf), "members")
    return G.export_locked(locked.select("sample_id", "digest", "split"), locked.select("sample_id", "digest", "split", "source"), "holdout").orderBy("sample_id")


def annotations(spark, sf):
    """Orders as annotations: the customer is the sample, the priority the annotator."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("annotation_id"), F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("annotator"), (F.col("o_orderstatus") != "P").alias("verified"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("sample_sha"), "o_orderdate", "o_totalprice", "o_orderstatus",
    )


_ANN = "ann as materialized (select o_orderkey as annotation_id, o_custkey as sample_id, o_orderpriority as annotator, o_orderstatus <> 'P' as verified, o_orderstatus, o_totalprice, o_orderdate from orders)"
_PAIRS = "pairs as materialized (select sample_id, annotation_id, annotator, verified from (select *, row_number() over (partition by sample_id order by annotation_id) as rn from ann) where rn <= 2)"


@query(
    "g13_gold_ready",
    f"""with {_ANN}, {_PAIRS} select sample_id, count(distinct annotator) filter (where verified) as verified_annotators,
    bool_and(verified) and count(distinct annotator) filter (where verified) >= 2 as gold_ready from pairs group by sample_id""",
)
def g13(spark, sf):
    ann = annotations(spark, sf)
    adjudications = G.source_pair(ann).select(F.col("sample_id").alias("adjudication_id"), "sample_id", "source_annotation_ids")
    return G.gold_ready(adjudications, ann).select("sample_id", "verified_annotators", "gold_ready")


@query(
    "g14_verified_annotations",
    """with good as (select distinct o_custkey, o_orderpriority from orders where o_orderstatus = 'F' and o_totalprice > 250000 and o_orderpriority <> '5-LOW')
    select o_orderkey as annotation_id, o_custkey as sample_id, o_orderpriority as annotator from orders join good using (o_custkey, o_orderpriority)""",
)
def g14(spark, sf):
    ann = annotations(spark, sf)
    contributions = ann.select(
        "sample_id", "sample_sha", "annotator", F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"), (F.col("o_totalprice") > 250000).alias("attested"),
        F.when(F.col("annotator") == "5-LOW", " ").otherwise("license").alias("basis"), F.col("o_orderdate").alias("reviewed_at"),
    )
    return G.verified_annotations(ann, contributions).select("annotation_id", "sample_id", "annotator")


@query(
    "g15_gold_progress",
    f"""with {_ANN}, hold as (select c_custkey from customer where {A.hexnum("sha256(cast(c_custkey as varchar))", 8)} % 5 = 0),
    n as (select sample_id, count(distinct annotator) as n, max(o_totalprice) as m from ann group by sample_id)
    select c_custkey as sample_id, coalesce(n, 0) as annotators, coalesce(n, 0) >= 2 as eligible, coalesce(m > 450000, false) as adjudicated, c_custkey in (select c_custkey from hold) as in_holdout
    from customer left join n on n.sample_id = c_custkey""",
)
def g15(spark, sf):
    ann = annotations(spark, sf)
    pool = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"))
    hold = pool.filter(G.holdout_split(F.sha2(F.col("sample_id").cast("string"), 256)) == "holdout")
    return G.gold_progress(pool, ann, ann.filter("o_totalprice > 450000"), hold)


@query(
    "g16_expert_rollup",
    """select o_custkey as expert, max(o_orderpriority) as title, count(*) filter (where o_orderstatus = 'F') as approved, max(case when o_orderstatus = 'F' then o_orderdate end) as last_approved
    from orders group by o_custkey having count(*) filter (where o_orderstatus = 'F') > 0""",
)
def g16(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "expert").withColumnRenamed("o_orderdate", "reviewed_at")
    return G.expert_rollup(orders, "expert", F.col("o_orderstatus") == "F", title=F.col("o_orderpriority"))


@query(
    "g17_allocate_packets",
    """with r as (select s_suppkey as annotator, p_partkey as sample_id, row_number() over (partition by s_suppkey order by p_size, p_partkey) as packet_no
      from supplier cross join part where p_retailprice > 901 and not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_partkey = p_partkey))
    select * from r where packet_no <= 10""",
)
def g17(spark, sf):
    pool = table(spark, sf, "part").filter("p_retailprice > 901").select(F.col("p_partkey").alias("sample_id"), F.col("p_size").alias("created_at"))
    people = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("annotator"))
    done = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("annotator"), F.col("l_partkey").alias("sample_id"))
    out = G.allocate_packets(pool, people, done, 10, ["created_at", "sample_id"])
    return out.withColumn("packet_no", F.col("packet_no").cast("bigint"))


@query(
    "g18_adjudication_candidates",
    f"""with {_ANN}, people as (select distinct annotator as adjudicator from ann union all select 'outsider'),
    s as (select sample_id, list(distinct annotator) as a from ann where sample_id not in (select c_custkey from customer where c_acctbal < 0) group by sample_id),
    r as (select adjudicator, sample_id, row_number() over (partition by adjudicator order by sample_id) as packet_no from people, s where len(list_filter(a, lambda x: x <> adjudicator)) >= 2)
    select * from r where packet_no <= 20""",
)
def g18(spark, sf):
    ann = annotations(spark, sf)
    closed = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("sample_id"))
    people = ann.select(F.col("annotator").alias("adjudicator")).distinct().unionByName(spark.range(1).select(F.lit("outsider").alias("adjudicator")))
    out = G.adjudication_candidates(ann, closed, people, 20)
    return out.withColumn("packet_no", F.col("packet_no").cast("bigint"))


@query(
    "g19_source_pair",
    f"with {_ANN}, {_PAIRS} select p.sample_id, string_agg(p.annotation_id, ',' order by p.annotation_id) as ids, (select count(distinct annotator) from ann a where a.sample_id = p.sample_id) as annotators from pairs p group by p.sample_id",
)
def g19(spark, sf):
    return G.source_pair(annotations(spark, sf)).select("sample_id", F.array_join("source_annotation_ids", ",").alias("ids"), "annotators")


@query(
    "g20_reviewer_progress",
    f"""with {_ANN}, g as (select annotator, sample_id, bool_or(o_orderstatus = 'F') as s from ann group by all)
    select annotator as reviewer, count(*) filter (where s) as done, count(*) filter (where s) as submitted, count(*) filter (where not s) as pending, (select count(*) from customer where c_acctbal > 0) as eligible from g group by annotator""",
)
def g20(spark, sf):
    ann = annotations(spark, sf).withColumnRenamed("annotator", "reviewer").withColumn("submitted", F.col("o_orderstatus") == "F")
    eligible = table(spark, sf, "customer").filter("c_acctbal > 0").agg(F.count("*"))
    return G.reviewer_progress(ann.select("reviewer").distinct(), ann, ann.filter("submitted"), eligible)


@query(
    "g21_status_rollup",
    """select (select count(*) from orders) as orders_total, (select count(*) from orders where o_orderstatus = 'P') as orders_pending, (select count(*) from orders where o_orderstatus = 'F') as orders_approved,
    (select count(*) from documents) as documents_total, (select count(*) from documents where n_chars < 200) as documents_short, (select count(*) from labels) as labels_total, (select count(*) from labels where quality = 1) as labels_good,
    (select count(*) from labels where toxic = 1) as labels_toxic""",
)
def g21(spark, sf):
    t = lambda n: table(spark, sf, n)
    return G.status_rollup(
        orders=(t("orders"), {"pending": F.col("o_orderstatus") == "P", "approved": F.col("o_orderstatus") == "F"}),
        documents=(t("documents"), {"short": F.col("n_chars") < 200}),
        labels=(t("labels"), {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}),
    )


def registry_log(spark, sf):
    events = table(spark, sf, "events")
    model = F.concat(F.lit("m"), (F.get_json_object("props", "$.k").cast("int") % 12).cast("string"))
    return events.select(F.col("user_id").alias("family"), "event_id", "ts", F.when(F.col("event_type").isin("purchase", "signup"), "promote").otherwise("rollback").alias("action"), model.alias("model"))


_REPLAY = """log as (select user_id as family, event_id, ts, case when event_type in ('purchase', 'signup') then 'promote' else 'rollback' end as action, 'm' || (cast(json_extract_string(props, '$.k') as int) % 12) as model
      from events),
    ranked as materialized (select *, row_number() over (partition by family order by ts, event_id) as pos from log),
    firsts as (select family, model, min(pos) as first_pos from ranked where action = 'promote' group by all),
    judged as materialized (select r.*, first_pos, coalesce(case when action = 'promote' then pos = first_pos else first_pos < pos end, false) as deciding from ranked r left join firsts f using (family, model)),
    lagged as (select *, lag(model) over (partition by family order by pos) as before from judged where deciding),
    replay as materialized (select family, event_id, ts, action, model, case when before = model then 'already_champion' end as violation from lagged
      union all select family, event_id, ts, action, model, case when action = 'promote' then 'not_a_candidate' else 'never_promoted' end from judged where not deciding)"""


@query(
    "g22_champion_state",
    f"""with {_REPLAY} select family, event_id, action, replay.model as model, violation,
      last_value(case when r.deciding then r.model end ignore nulls) over (partition by family order by r.pos rows between unbounded preceding and current row) as champion
      from replay join (select event_id, pos, deciding, model from judged) r using (event_id)""",
)
def g22(spark, sf):
    return G.champion_state(registry_log(spark, sf)).drop("ts")


@query("g22_champion_history", f"with {_REPLAY} select family, model, event_id, ts as valid_from, lead(ts) over (partition by family order by ts, event_id) as valid_to from replay where violation is null")
def g22_history(spark, sf):
    replay = materialize(G.champion_state(registry_log(spark, sf)), "replay")
    return G.champion_history(replay)


@query(
    "g23_promotion_gate",
    """with rv as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders where o_orderstatus = 'F'),
    sh as (select l_orderkey, count(*) as runs, count(*) filter (where l_quantity > 5) as complete_runs, max(l_discount) > 0.03 as dev from lineitem group by l_orderkey),
    j as (select c_custkey, rv.*, sh.* from customer left join rv on rv.o_custkey = c_custkey and rn = 1 left join sh on sh.l_orderkey = rv.o_orderkey),
    k as (select c_custkey as model_id, case when c_custkey not in (select o_custkey from orders) then 'review_missing' when o_orderkey is null then 'review_not_approved' when o_orderpriority = '5-LOW' then 'evaluation_hash_mismatch'
      when not o_totalprice > 60000 then 'holdout_not_covered' when l_orderkey is null then 'shadow_hash_mismatch' when runs < 3 then 'too_few_runs' when runs <> complete_runs then 'incomplete_run'
      when not dev then 'physical_confirmation_missing' end as blocked_by from j) select *, blocked_by is null as promotable from k""",
)
def g23(spark, sf):
    sha = lambda c: F.sha2(c.cast("string"), 256)
    candidates = table(spark, sf, "customer").select(F.col("c_custkey").alias("model_id"), sha(F.col("c_custkey")).alias("sha"))
    orders = table(spark, sf, "orders")
    reviews = orders.select(
        F.col("o_custkey").alias("model_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("review_id"),
        F.when(F.col("o_orderstatus") == "F", "approve").otherwise("reject").alias("decision"), F.col("o_orderkey").alias("evaluation_id"), F.col("o_orderkey").alias("shadow_id"),
    )
    evaluations = orders.select(
        F.col("o_orderkey").alias("evaluation_id"), F.col("o_custkey").alias("model_id"), F.when(F.col("o_orderpriority") == "5-LOW", sha(F.lit("other"))).otherwise(F.upper(sha(F.col("o_custkey")))).alias("sha"),
        F.when(F.col("o_totalprice") > 60000, 200).otherwise(100).alias("sample_count"),
    )
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("shadow_id")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("l_quantity") > 5).alias("complete_runs"), (F.max("l_discount") > 0.03).alias("device_confirmed")
    )
    shadows = runs.join(orders.select(F.col("o_orderkey").alias("shadow_id"), F.col("o_custkey").alias("model_id"), sha(F.col("o_custkey")).alias("sha")), "shadow_id").withColumn("latency_confirmed", F.lit(True))
    return G.promotion_gate(candidates, reviews, evaluations, shadows, 200, min_runs=3)


def learning(spark, sf):
    """Users are samples; a user's events with one number k are a contribution. Every
    seventh user is not in the pool."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    events = table(spark, sf, "events").select(F.col("user_id").alias("sample_id"), "ts", "event_id", "event_type", (F.col("user_id") * 1000 + k).alias("contribution_id"))
    group = F.sha2(F.col("sample_id").cast("string"), 256)
    contributions = events.withColumn("status", F.when(F.col("event_type") == "purchase", "approved").otherwise("pending"))
    samples = events.withColumns({"status": F.when(F.col("event_type") == "signup", "adjudicated").otherwise("open"), "group_hash": group})
    users = events.select("sample_id").distinct()
    pool = users.filter("sample_id % 7 <> 0").withColumn("group_hash", group)
    return G.learning_events(contributions, samples, pool), users


_LEARN = f"""e as (select user_id as sample_id, ts, event_id, event_type, user_id * 1000 + cast(json_extract_string(props, '$.k') as bigint) as contribution_id from events),
    ev as materialized (select sha256('verified_contribution_approved|' || contribution_id) as event_key, 'verified_contribution_approved' as event_type, sample_id, event_id,
        case when sample_id % 7 <> 0 and {A.hexnum("sha256(cast(sample_id as varchar))", 8)} % 5 = 0 then 'blocked_holdout' else 'queued' end as state, false as rebuild
      from (select *, row_number() over (partition by contribution_id order by ts, event_id) as rn from e where event_type = 'purchase') where rn = 1
      union all select sha256('adjudicated_training_ready|' || sample_id || '|' || sha256(cast(sample_id as varchar))), 'adjudicated_training_ready', sample_id, event_id,
        case when {A.hexnum("sha256(cast(sample_id as varchar))", 8)} % 5 = 0 then 'blocked_holdout' else 'queued' end, {A.hexnum("sha256(cast(sample_id as varchar))", 8)} % 5 <> 0
      from (select *, row_number() over (partition by sample_id order by ts, event_id) as rn from e where event_type = 'signup') where rn = 1)"""


@query("g24_learning_events", f"with {_LEARN} select event_key, event_type, sample_id, event_id, state, rebuild from ev")
def g24(spark, sf):
    return learning(spark, sf)[0]


@query("g25_mark_snapshotted", f"with {_LEARN} select event_id, case when state = 'queued' and sample_id < 60 then 'snapshotted' else state end as state from ev")
def g25(spark, sf):
    events, users = learning(spark, sf)
    return G.mark_snapshotted(materialize(events, "learning"), users.filter("sample_id < 60")).select("event_id", "state")


@query(
    "g26_review_queue",
    """with c as (select sha256(o_custkey || '|' || o_orderpriority) as h, o_orderkey, case when o_orderstatus = 'O' then 'pending' else 'done' end as status, o_orderdate from orders),
    f as (select *, row_number() over (partition by h order by o_orderdate, o_orderkey) as rn, max(o_orderdate) over (partition by h) as updated_at from c)
    select o_orderkey as contribution_id, status, o_orderdate as created_at, updated_at from f where rn = 1 order by status = 'pending' desc, created_at desc, contribution_id desc limit 200""",
)
def g26(spark, sf):
    rows = table(spark, sf, "orders").select(
        H.hash_key(F.col("o_custkey"), F.col("o_orderpriority")).alias("content_sha256"), F.col("o_orderkey").alias("contribution_id"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    )
    return G.review_queue(rows, 200).select("contribution_id", "status", "created_at", "updated_at")


@query(
    "g27_evidence_contract",
    """with e as (select event_id, event_type as t, cast(json_extract_string(props, '$.k') as int) as k from events)
    select event_id, case when k % 10 = 0 then 'baseline_ref_required' when t = 'error' then 'metric_results_required' when k % 7 = 0 then 'calibration_results_required'
      when k % 13 = 0 then 'regression_results_required' when t = 'click' then 'error_metrics_required' when t = 'view' then 'task_metrics_required'
      when k < 20 then 'calibration_contract_invalid' when k < 30 then 'regression_comparison_required' end as error from e""",
)
def g27(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.col("event_type")
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(k % 10 == 0, " ").otherwise("base-1").alias("baseline_ref"),
        F.when(t == "error", "{}").when(t == "click", '{"taskMetrics": {}}').when(t == "view", '{"errorMetrics": {"a": 1}}').otherwise('{"errorMetrics": {}, "taskMetrics": {}}').alias("metric_results"),
        F.when(k % 7 == 0, "[1]").when(k < 20, '{"method": "platt"}').otherwise('{"method": "platt", "calibrationMetrics": {"ece": 0.1}}').alias("calibration_results"),
        F.col("props").alias("baseline_metrics"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).when(k < 30, '{"comparison": 1}').otherwise('{"comparison": {}}').alias("regression_results"),
        F.col("props").alias("provenance"),
    )
    return G.evidence_contract(rows).select("event_id", "error")


@query(
    "g28_replay_mix",
    """with t as (select doc_id from labels where quality = 1 and toxic = 0), m as (select greatest(16, 2 * count(*)) as m from t),
    r as (select doc_id, row_number() over (order by sha256('replay|' || doc_id), doc_id) as rn from documents)
    select doc_id, 'train' as origin, cast(unnest([1, 2, 3, 4]) as bigint) as copy from t union all select doc_id, 'replay', 1 from r, m where rn <= m""",
)
def g28(spark, sf):
    train = table(spark, sf, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    out = G.replay_mix(train, table(spark, sf, "documents").select("doc_id"), "doc_id", multiplier=2)
    return out.withColumn("copy", F.col("copy").cast("bigint"))


@query(
    "g29_balanced_sample",
    """with d as (select source, l.doc_id, quality = 1 as positive, sha256('balance|' || l.doc_id) as h from labels l join documents d on d.doc_id = l.doc_id),
    r as (select *, row_number() over (partition by source, positive order by h, doc_id) as r, count(*) over (partition by source, positive) as have,
      count(*) filter (where positive) over (partition by source) as p, count(*) filter (where not positive) over (partition by source) as q from d),
    w as (select *, case when positive then least(12, p) when p = 0 then least(24, q) else 24 - least(12, p) end as w from r)
    select source, doc_id, positive, unnest(range(1, cast(floor((w - r) / have) as bigint) + 2)) as copy from w where r <= w""",
)
def g29(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    rows = table(spark, sf, "labels").join(docs, "doc_id").select("source", "doc_id", (F.col("quality") == 1).alias("positive"))
    return G.balanced_sample(rows, "source", "doc_id", "positive", 24)


_ERRORS = [
    "annotation_object_required", "tongue_present_boolean_required", "image_quality_invalid", None, "roi_mask_rle_required_when_tongue_present", "roi_mask_size_must_be_160x160",
    "roi_mask_counts_required", "morphology_object_required_when_tongue_present", "morphology_schema_invalid", "median_sulcus_prominence_invalid", "fissure_depth_must_not_be_inferred_from_2d", None,
]


@query(
    "g30_annotation_valid",
    "select event_id, case cast(json_extract_string(props, '$.k') as int) % 12 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(_ERRORS) if e) + " end as error from events",
)
def g30(spark, sf):
    case = F.get_json_object("props", "$.k").cast("int") % 12
    at = lambda i, special, usual: F.when(case == i, special).otherwise(usual)
    fissure = F.concat(F.lit('{"visualStatus": "absent", "branching": "absent", "pattern": "other", "depth": "'), at(10, "deep", "not_collected_from_2d"), F.lit('"}'))
    morphology = F.concat(
        F.lit('{"schemaVersion": "'), at(8, "v0", "tongue-morphology-label-v1"), F.lit('", "medianSulcus": {"prominence": "'), at(9, "huge", "mild"),
        F.lit('"}, "fissure": '), fissure, F.lit(', "toothmarks": {"status": "absent"}, "bodyShape": {"status": "normal"}}'),
    )
    mask = F.concat(F.lit('{"size": '), at(5, "[160,80]", "[160,160]"), F.lit(', "counts": '), at(6, "[]", "[5,10]"), F.lit("}"))
    text = F.concat(
        F.lit('{"tongue_present": '), at(1, '"yes"', at(3, "false", "true")), F.lit(', "image_quality": "'), at(2, "bad", "usable"),
        F.lit('", "roi_mask_rle": '), at(4, "null", mask), F.lit(', "morphology": '), at(7, '"none"', morphology), F.lit("}"),
    )
    rows = table(spark, sf, "events").select("event_id", F.try_parse_json(at(0, "[]", text)).alias("a"))
    return rows.select("event_id", G.annotation_error(F.col("a")).alias("error"))
