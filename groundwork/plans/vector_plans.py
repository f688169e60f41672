"""V: vector similarity over embeddings. A 12-value signature folds all components of every
embedding: value i is made of the mean size of components i, i + 12, i + 24 and so on."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from groundwork.functions import hashing as H
from groundwork.operators import vectors as V
from groundwork.plans.base import query, table

COMPONENTS = 64
GLOBAL_DIMS = V.NAMES
# The signature value is min(1, mean |component| * scale); aspect is shifted.
_SCALES = [3.0, 3.0, 3.0, 4.0, 4.0, 0.6, 0.9, 0.7, 0.15, 0.3, 2.0, 2.5]


def signatures(spark, sf):
    def e(i):
        own = [F.abs(F.col("embedding")[j].cast("double")) for j in range(i, COMPONENTS, len(V.NAMES))]
        return sum(own[1:], own[0]) / len(own)

    dims = [(F.least(F.lit(1.0), e(i) * _SCALES[i]) + (0.5 if n == "aspect" else 0.0)).alias(n) for i, n in enumerate(V.NAMES)]
    return table(spark, sf, "embeddings").select("vec_id", "label", *dims)


SIG_SQL = "sig as materialized (select vec_id, label, " + ", ".join(
    f"least(1.0::double, ({' + '.join(f'abs(cast(embedding[{j + 1}] as double))' for j in range(i, COMPONENTS, 12))}) / {len(range(i, COMPONENTS, 12))} * {_SCALES[i]}::double){' + 0.5::double' if n == 'aspect' else ''} as {n}" for i, n in enumerate(V.NAMES)
) + " from embeddings)"


def cats_sql(t: str) -> dict:
    return {
        "tongue": f"(case when {t}.purple > 0.13 then 'tím' when {t}.r > {t}.g * 1.24::double and {t}.s > 0.34 then 'đỏ' when {t}.s < 0.22 and {t}.v > 0.60 then 'nhợt' else 'đỏ nhạt' end)",
        "coat": f"(case when {t}.yellow > 0.075 and {t}.yellow > {t}.white * 0.55::double then 'vàng' when {t}.white > 0.10 then 'trắng' else 'ít rêu' end)",
        "thick": f"(case when greatest({t}.white, {t}.yellow) > 0.34 then 'dày' when greatest({t}.white, {t}.yellow) > 0.15 then 'mỏng' else 'rất mỏng' end)",
        "fissure": f"({t}.dark > 0.025)",
        "spots": f"({t}.spot > 0.055)",
    }


def similarity_sql(a: str, b: str) -> str:
    total = 0.0
    for _, w, _ in V.DIMENSIONS:
        total += w
    distance = " + ".join(f"{w}::double * least(1.0::double, abs({a}.{n} - {b}.{n}) / {s}::double)" for n, w, s in V.DIMENSIONS)
    ca, cb = cats_sql(a), cats_sql(b)
    cat = " + ".join(f"(case when {ca[n]} = {cb[n]} then {w}::double else 0::double end)" for n, w in V.CATEGORY_WEIGHTS)
    return f"least(1.0::double, greatest(0.0::double, (1 - ({distance}) / {total!r}::double) * 0.82::double + ({cat}) * 0.18::double))"


@query(
    "v01_validate_vector",
    """select vec_id, len(list_filter(embedding, lambda x: not (isfinite(x) and x >= -0.4::float and x <= 0.4::float))) = 0 as valid,
    case when len(list_filter(embedding, lambda x: not (isfinite(x) and x >= -0.4::float and x <= 0.4::float))) = 0 then cast(len(embedding) as bigint) end as dims from embeddings""",
)
def v01(spark, sf):
    kept = V.validate_vector(F.col("embedding"), -0.4, 0.4)
    return table(spark, sf, "embeddings").select("vec_id", kept.isNotNull().alias("valid"), F.when(kept.isNotNull(), F.size(kept)).cast("bigint").alias("dims"))


@query("v02_coarse_category", f"with {SIG_SQL} select vec_id, {', '.join(f'{c} as {n}' for n, c in cats_sql('sig').items())} from sig")
def v02(spark, sf):
    return signatures(spark, sf).select("vec_id", *[c.alias(n) for n, c in V.coarse_category().items()])


@query(
    "v03_mixed_similarity",
    f"with {SIG_SQL} select sig.vec_id, f.vec_id as other, round({similarity_sql('sig', 'f')}, 6) as similarity from sig join sig f on f.vec_id = sig.vec_id + 1",
)
def v03(spark, sf):
    """Every vector with its successor."""
    sigs = signatures(spark, sf)
    a = sigs.select("vec_id", F.struct(*V.NAMES).alias("a"))
    b = sigs.select(F.col("vec_id").alias("other"), F.struct(*V.NAMES).alias("b"))
    return a.join(b, F.col("other") == F.col("vec_id") + 1).select("vec_id", "other", F.round(V.mixed_similarity("a", "b"), 6).alias("similarity"))


@query(
    "v04_vector_topk",
    f"""with {SIG_SQL}, s as (select q.vec_id as query_id, r.vec_id as ref_id, r.label || ':' || floor(r.r * 20) as key, floor({similarity_sql('q', 'r')} * 1000 + 0.5) / 1000 as similarity
      from sig q cross join sig r),
    d as (select *, row_number() over (partition by query_id, key order by similarity desc, ref_id) as dn from s),
    k as (select *, row_number() over (partition by query_id order by similarity desc, ref_id) as rank from d where dn = 1)
    select query_id, ref_id, similarity, rank from k where rank <= 3""",
)
def v04(spark, sf):
    sigs = signatures(spark, sf)
    refs = sigs.withColumn("key", F.concat_ws(":", "label", F.floor(F.col("r") * 20).cast("string"))).withColumnRenamed("vec_id", "ref_id")
    out = V.vector_topk(sigs.withColumnRenamed("vec_id", "query_id"), refs)
    return out.select(F.col("query").alias("query_id"), F.col("ref").alias("ref_id"), "similarity", F.col("rank").cast("bigint").alias("rank"))


@query(
    "v05_class_centroids",
    f"""with {SIG_SQL}, c as (select label, {', '.join(f'avg({d}) as m_{d}' for d in GLOBAL_DIMS)} from sig group by label)
    select vec_id, label, round(least(1.0, greatest(0.0, 1 - ({' + '.join(f'least(1.0, abs({d} - m_{d}))' for d in GLOBAL_DIMS)}) / {len(GLOBAL_DIMS)})), 3) as similarity from sig join c using (label)""",
)
def v05(spark, sf):
    sigs = signatures(spark, sf)
    return V.centroid_similarity(sigs, V.class_centroids(sigs, "label", GLOBAL_DIMS), "label", GLOBAL_DIMS).select("vec_id", "label", "similarity")


_Z = lambda p: "round(sqrt((" + " + ".join(f"pow(({d} - {p}.m_{d}) / greatest(1e-6, {p}.s_{d}), 2)" for d in GLOBAL_DIMS) + f") / {len(GLOBAL_DIMS)}), 4)"


@query(
    "v06_profile_margin",
    f"""with {SIG_SQL}, p as materialized (select label < 5 as inside, {', '.join(f'avg({d}) as m_{d}, stddev_pop({d}) as s_{d}' for d in GLOBAL_DIMS)} from sig group by 1),
    z as (select vec_id, {_Z('i')} as inside_distance, {_Z('o')} as outside_distance from sig, p i, p o where i.inside and not o.inside)
    select *, round(outside_distance - inside_distance, 4) as margin,
      case when outside_distance - inside_distance >= 0 then 'diagnostic-reference-like' else 'context-background-like' end as region from z""",
)
def v06(spark, sf):
    sigs = signatures(spark, sf).withColumn("side", F.when(F.col("label") < 5, "diagnostic").otherwise("context"))
    out = V.profile_margin(sigs, V.class_profiles(sigs, "side", GLOBAL_DIMS), "side", "diagnostic", "context", GLOBAL_DIMS)
    return out.select("vec_id", "inside_distance", "outside_distance", "margin", "region")


@query(
    "v07_learned_topk",
    f"""with {SIG_SQL}, s as (select q.vec_id as query_id, k.vec_id as knowledge_id, q.vec_id = k.vec_id as t, q.label = k.label and k.r > 0.3 and q.r > 0.3 as b, {similarity_sql('q', 'k')} as sim
      from sig q cross join sig k),
    r as (select *, t or b as exact, least(1.0::double, (case when t then 0.35::double else 0 end) + (case when b then 0.10::double else 0 end) + (case when t then 0.55::double else 1 end) * sim) as raw from s),
    o as (select *, row_number() over (partition by query_id order by exact desc, raw desc, knowledge_id desc) as rank from r where exact or sim >= 0.45)
    select query_id, knowledge_id, exact, round(raw, 4) as similarity, rank from o where rank <= 5""",
)
def v07(spark, sf):
    hashed = lambda side: F.when(F.col("r") > 0.3, H.hash_key("bottom", F.col("label"))).otherwise(H.hash_key(side, F.col("vec_id")))
    sigs = signatures(spark, sf).withColumn("top_hash", H.hash_key("top", F.col("vec_id"))).withColumn("approved_at", F.col("vec_id"))
    queries = sigs.withColumn("bottom_hash", hashed("query")).withColumnRenamed("vec_id", "query_id")
    known = sigs.withColumn("bottom_hash", hashed("known")).withColumnRenamed("vec_id", "knowledge_id")
    out = V.learned_topk(queries, known.filter("label < 5"), known.filter("label >= 5"), 5)
    return out.select(F.col("query").alias("query_id"), "knowledge_id", "exact", "similarity", F.col("rank").cast("bigint").alias("rank"))


def weight(layer: int, i: int, j: int) -> float:
    return round(math.sin(1 + layer * 7 + i * 3 + j * 5) * 0.4, 6)


def layer(n: int, inputs: int, outputs: int):
    return [[weight(n, i, j) for j in range(outputs)] for i in range(inputs)], [weight(n, 99, j) for j in range(outputs)]


LAYERS = [layer(1, 12, 24), layer(2, 24, 12), layer(3, 12, 1)]


def _dense(x: str, n: int) -> str:
    w, b = LAYERS[n]
    columns = [[w[i][j] for i in range(len(w))] for j in range(len(b))]
    return f"list_transform(range(1, {len(b) + 1}), lambda j: {b}[j] + list_dot_product({x}, ({columns})[j]))"


@query(
    "v08_mlp_score",
    f"""with {SIG_SQL}, a as (select vec_id, list_transform({_dense('[' + ', '.join(V.NAMES) + ']', 0)}, lambda x: greatest(0, x)) as h from sig),
    b as (select vec_id, list_transform({_dense('h', 1)}, lambda x: greatest(0, x)) as h from a)
    select vec_id, round(1 / (1 + exp(-({_dense('h', 2)})[1])), 6) as score from b""",
)
def v08(spark, sf):
    out = V.mlp_score(signatures(spark, sf), LAYERS, V.NAMES, ["vec_id"])
    return out.select("vec_id", F.round("score", 6).alias("score"))
