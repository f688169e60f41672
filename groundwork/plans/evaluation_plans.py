"""E: agreement and overlap measures over labels, documents and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import hashing as H
from groundwork.operators import evaluation as E
from groundwork.plans import ansi as A
from groundwork.plans.base import query, table

# Reference and candidate values of ten fields, derived from digests of the document id.
_VALUES = ["đỏ nhạt", "Đỏ", "unknown", "", "vàng", "trắng", "dày", "Không xác định", "mỏng", "khô", "nhuận", "bong", "nứt", "tím", "N A", "ướt"]


def _labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("digest"))
    return table(spark, sf, "labels").join(docs, "doc_id")


_LAB_SQL = "lab as materialized (select l.doc_id, quality, toxic, source, lang, n_chars, sha256(text) as digest from labels l join documents d on d.doc_id = l.doc_id)"
_QC_SQL = "case when n_chars < 200 then 'poor' when n_chars < 1500 then 'acceptable' else 'good' end"


def _qc():
    return F.when(F.col("n_chars") < 200, "poor").when(F.col("n_chars") < 1500, "acceptable").otherwise("good")


@query(
    "e01_join_evidence",
    f"""with {_LAB_SQL},
    m as (select doc_id, digest, source as grp, case when toxic = 1 then 'ventral' else 'dorsal' end as role, {_QC_SQL} as qc from lab),
    g as (select digest, min(grp) <> max(grp) as split_group from m group by digest),
    r as (select doc_id, digest, quality = 1 or toxic = 0 as locked from lab where lang <> 'es'),
    c as (select doc_id, case when source = 'src4' then sha256('other') else sha256(text) end as digest from documents where n_chars > 120)
    select coalesce(m.doc_id, r.doc_id, c.doc_id) as sample_id, role, qc as qc_grade,
      case when m.doc_id is null then 'EXTRA_ROW' when split_group then 'SAME_DIGEST_DIFFERENT_GROUP' when r.doc_id is null then 'REFERENCE_MISSING'
        when c.doc_id is null then 'CANDIDATE_MISSING' when r.digest <> m.digest or c.digest <> m.digest then 'DIGEST_MISMATCH' when not locked then 'REFERENCE_NOT_LOCKED' end as error
    from m left join g on g.digest = m.digest full join r on r.doc_id = m.doc_id full join c on c.doc_id = coalesce(m.doc_id, r.doc_id)""",
)
def e01(spark, sf):
    lab = _labelled(spark, sf)
    manifest = lab.select(F.col("doc_id").alias("sample_id"), "digest", F.col("source").alias("group_hash"), F.when(F.col("toxic") == 1, "ventral").otherwise("dorsal").alias("role"), _qc().alias("qc_grade"))
    reference = lab.filter("lang <> 'es'").select(
        F.col("doc_id").alias("sample_id"), "digest", ((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("locked"), F.lit(True).alias("blind"), F.lit(False).alias("model_visible")
    )
    docs = table(spark, sf, "documents").filter("n_chars > 120")
    digest = F.when(F.col("source") == "src4", F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256))
    candidate = docs.select(F.col("doc_id").alias("sample_id"), digest.alias("digest"), F.lit("v1").alias("version"))
    return E.join_evidence(manifest, reference, candidate).select("sample_id", "role", "qc_grade", "error")


def agreement_rows(spark, sf):
    lab = _labelled(spark, sf)
    values = F.array(*[F.lit(v) for v in _VALUES])
    pick = lambda side, i: H.hex_bucket(F.sha2(F.concat_ws(":", F.lit(side), F.lit(i), "doc_id"), 256), 8)
    ref = lambda i: F.get(values, (pick("r", i) % 16).cast("int"))
    other = lambda i: F.get(values, (F.shiftright(pick("c", i), 8) % 16).cast("int"))
    cand = lambda i: F.when(pick("c", i) % 100 < 92, F.upper(ref(i))).otherwise(other(i))
    return lab.select(
        F.col("doc_id").alias("sample_id"), _qc().alias("qc_grade"),
        F.struct(*[ref(i).alias(f) for i, f in enumerate(E.FIELDS)]).alias("reference"),
        F.struct(*[cand(i).alias(f) for i, f in enumerate(E.FIELDS)]).alias("candidate"),
    )


_LIST = "[" + ", ".join(f"'{v}'" for v in _VALUES) + "]"
_FOLD = lambda c: A.squeeze(f"replace(strip_accents(lower({c})), 'đ', 'd')")
_KNOWN = lambda c: f"({_FOLD(c)} <> '' and {_FOLD(c)} not in ('unknown', 'khong xac dinh', 'n a', 'na', 'not assessed', 'not-assessed'))"
_SLOTS_SQL = f"""{_LAB_SQL}, fields as (select unnest(range(0, 10)) as i, unnest([{', '.join(f"'{f}'" for f in E.FIELDS)}]) as field),
    hashes as (select doc_id, {_QC_SQL} = 'poor' as poor, i, field, {A.hexnum("sha256('r:' || i || ':' || doc_id)", 8)} as hr, {A.hexnum("sha256('c:' || i || ':' || doc_id)", 8)} as hc from lab, fields),
    vals as (select *, {_LIST}[1 + cast(hr % 16 as int)] as ref, case when hc % 100 < 92 then upper({_LIST}[1 + cast(hr % 16 as int)]) else {_LIST}[1 + cast((hc >> 8) % 16 as int)] end as cand from hashes),
    flags as materialized (select doc_id, poor, i, field, {_KNOWN('ref')} as rk, {_KNOWN('cand')} as ck, {_FOLD('ref')} = {_FOLD('cand')} as same from vals),
    slots as materialized (select doc_id, poor, i, field, not poor and rk as support, not poor and rk and ck and same as match, not poor and not rk as unknown, ck and (poor or not rk) as leak from flags),
    fld as materialized (select field, count(*) filter (where support) as support, count(*) filter (where match) as matches, count(*) filter (where leak) as leaks,
      count(*) filter (where unknown) as unknown_slots from slots group by field)"""


@query("e02_field_agreement", f"with {_SLOTS_SQL} select field, support, matches, leaks, unknown_slots, round(matches / nullif(support, 0), 6) as agreement from fld")
def e02(spark, sf):
    return E.field_agreement(agreement_rows(spark, sf)).withColumn("agreement", F.round("agreement", 6))


@query(
    "e02_leak_samples",
    f"""with {_SLOTS_SQL} select doc_id as sample_id, field, case when poor then 'candidate-known-on-poor-qc' else 'candidate-known-when-reference-unknown' end as leak_reason
    from slots where leak order by doc_id, i limit 25""",
)
def e02_leaks(spark, sf):
    return E.leak_samples(agreement_rows(spark, sf))


@query(
    "e03_gate",
    f"""with {_SLOTS_SQL}, t as (select cast(sum(support) as bigint) as micro_support, cast(sum(matches) as bigint) as micro_matches, cast(sum(leaks) as bigint) as leaks,
      avg(matches / support) filter (where support >= 10) as macro, count(*) filter (where support < 10) as thin, count(*) filter (where support >= 10 and matches / support < 0.95) as low, (select count(*) from lab) as rows from fld),
    g as (select rows, micro_support, micro_matches, leaks, round(macro, 6) as macro, round(micro_matches / micro_support, 6) as micro, rows >= 50 as gate_rows, thin = 0 as gate_support,
      low = 0 as gate_field, micro_matches / micro_support >= 0.95 as gate_micro, macro >= 0.95 as gate_macro, leaks = 0 as gate_safety from t)
    select *, gate_rows and gate_support and gate_field and gate_micro and gate_macro and gate_safety as eligible from g""",
)
def e03(spark, sf):
    rows = agreement_rows(spark, sf)
    out = E.agreement_metrics(rows, E.field_agreement(rows))
    return out.drop("thin_fields", "low_fields").withColumn("macro", F.round("macro", 6)).withColumn("micro", F.round("micro", 6))


_GOLD, _PRED, _USABLE = "quality = 1", "n_chars > 700", "lang <> 'es'"
_CELLS = lambda f: f"count(*) filter (where {f} and g and p) as tp, count(*) filter (where {f} and not g and not p) as tn, count(*) filter (where {f} and not g and p) as fp, count(*) filter (where {f} and g and not p) as fn"
_RATES = "round(tp / nullif(tp + fn, 0), 6) as sensitivity, round(tn / nullif(tn + fp, 0), 6) as specificity, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 6) as accuracy"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("sensitivity", "specificity", "accuracy")})


@query(
    "e04_presence_confusion",
    f"""with {_LAB_SQL}, f as (select source, {_GOLD} as g, {_PRED} as p, {_USABLE} as u from lab),
    c as (select source, {_CELLS('u')}, count(*) filter (where not u) as excluded from f group by source) select *, {_RATES} from c""",
)
def e04(spark, sf):
    return _rounded(E.presence_confusion(_labelled(spark, sf), F.expr(_GOLD), F.expr(_PRED), F.expr(_USABLE), ["source"]))


def masks(spark, sf):
    """Two run-length masks per order: runs from the quantities of its lines."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")))
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    gold = F.transform("lines", lambda s: s["l_quantity"].cast("bigint"))
    pred = F.transform("lines", lambda s: F.greatest(F.lit(0).cast("bigint"), (s["l_quantity"] + F.round(s["l_tax"] * 100) - 4).cast("bigint")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    staged = orders.select("l_orderkey", gold.alias("g"), pred.alias("p")).withColumn("size", F.greatest(total("g"), total("p")) + 10)
    pad = lambda c: F.concat(c, F.array(F.col("size") - total(c)))
    return staged.select("l_orderkey", "size", pad("g").alias("gold"), pad("p").alias("pred"))


_MASK_SQL = """ln as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) as i,
      cast(l_quantity as bigint) as g, greatest(0, cast(l_quantity + round(l_tax * 100) - 4 as bigint)) as p from lineitem),
    tot as (select l_orderkey, count(*) as n, cast(greatest(sum(g), sum(p)) + 10 as bigint) as size, cast(sum(g) as bigint) as sg, cast(sum(p) as bigint) as sp from ln group by l_orderkey),
    runs as (select l_orderkey, i, 'g' as side, g as c from ln union all select l_orderkey, i, 'p', p from ln
      union all select l_orderkey, n + 1, 'g', size - sg from tot union all select l_orderkey, n + 1, 'p', size - sp from tot),
    iv as materialized (select *, hi - c as lo from (select *, sum(c) over (partition by l_orderkey, side order by i) as hi from runs) where i % 2 = 0),
    gs as (select l_orderkey, cast(coalesce(sum(c) filter (where side = 'g'), 0) as bigint) as gp, cast(coalesce(sum(c) filter (where side = 'p'), 0) as bigint) as pp from runs where i % 2 = 0 group by l_orderkey),
    ov as (select a.l_orderkey, cast(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) as bigint) as inter from iv a join iv b on a.l_orderkey = b.l_orderkey and a.side = 'g' and b.side = 'p' and a.lo < b.hi and b.lo < a.hi group by a.l_orderkey),
    scored as materialized (select t.l_orderkey, coalesce(gp, 0) as gold_pixels, coalesce(pp, 0) as pred_pixels, coalesce(inter, 0) as intersection,
      case when coalesce(gp + pp, 0) = 0 then 1.0::double else 2 * coalesce(inter, 0) / (gp + pp) end as dice,
      case when coalesce(gp + pp, 0) = 0 then 1.0::double else coalesce(inter, 0) / (gp + pp - coalesce(inter, 0)) end as iou
      from tot t left join gs on gs.l_orderkey = t.l_orderkey left join ov on ov.l_orderkey = t.l_orderkey)"""


def overlaps(spark, sf):
    return E.rle_overlap(masks(spark, sf), "gold", "pred", F.col("size"))


@query("e06_rle_overlap", f"with {_MASK_SQL} select l_orderkey, gold_pixels, pred_pixels, intersection, round(dice, 6) as dice, round(iou, 6) as iou, cast(null as varchar) as mask_error from scored")
def e06(spark, sf):
    return overlaps(spark, sf).select("l_orderkey", "gold_pixels", "pred_pixels", "intersection", F.round("dice", 6).alias("dice"), F.round("iou", 6).alias("iou"), "mask_error")


def boot_sql(rows: str, value: str, key: str) -> str:
    """lower, upper and n of the bucket bootstrap over ``rows``."""
    return f"""(with bk as (select {A.hexnum(f"sha256({key})", 2)} as bucket, sum({value}::double) as s, count(*) as c from {rows} where {value} is not null group by 1),
      dr as (select b, {A.hexnum("sha256('20260918:' || b || ':' || p)", 2)} as bucket from range(2000) x(b), range(256) y(p)),
      mn as (select b, sum(s) / sum(c) as mean from dr join bk using (bucket) group by b),
      od as (select list_sort(list(mean)) as m from mn)
      select m[50] as lower, m[1950] as upper, (select sum(c)::bigint from bk) as n from od)"""


@query(
    "e05_holdout_metrics",
    f"""with {_MASK_SQL}, f as materialized (select l_orderkey, l_orderkey > 100 as u, gold_pixels > 20 as g, pred_pixels > 20 as p, dice, iou from scored), ug as (select * from f where u and g),
    c as (select {_CELLS('u')}, count(*) filter (where not u) as excluded, count(*) as samples, count(*) filter (where u) as usable, count(*) filter (where u and g) as positives,
      round(avg(dice) filter (where u and g), 6) as mean_dice, round(avg(iou) filter (where u and g), 6) as mean_iou from f)
    select c.*, {_RATES}, round(d.lower, 6) as dice_lower, round(d.upper, 6) as dice_upper, round(i.lower, 6) as iou_lower, round(i.upper, 6) as iou_upper, cast(null as varchar) as error
    from c, {boot_sql('ug', 'dice', 'l_orderkey::varchar')} d, {boot_sql('ug', 'iou', 'l_orderkey::varchar')} i""",
)
def e05(spark, sf):
    rows = overlaps(spark, sf).select(
        F.col("l_orderkey").alias("sample_id"), F.lit("h1").alias("holdout_version"), F.lit("m1").alias("model_sha256"), (F.col("l_orderkey") > 100).alias("usable"),
        (F.col("gold_pixels") > 20).alias("gold_present"), (F.col("pred_pixels") > 20).alias("pred_present"), "dice", "iou",
    )
    out = _rounded(E.holdout_metrics(rows))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_dice", "mean_iou", "dice_lower", "dice_upper", "iou_lower", "iou_upper")})


_LINE_KEY = "l_orderkey || ':' || l_linenumber"


@query("e07_bootstrap_ci", f"select round(lower, 4) as lower, round(upper, 4) as upper, 2000 as iterations, n from {boot_sql('lineitem', 'l_extendedprice', _LINE_KEY)}")
def e07(spark, sf):
    out = E.bootstrap_ci(table(spark, sf, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"])
    return out.withColumn("lower", F.round("lower", 4)).withColumn("upper", F.round("upper", 4))


GRID = [round(0.30 + 0.05 * i, 2) for i in range(13)]


@query(
    "e08_threshold_sweep",
    f"""with {_LAB_SQL}, s as (select source, quality = 1 as g, least(1.0::double, n_chars / 2000) as score from lab), grid as (select unnest({GRID}::double[]) as t),
    c as (select source, t, count(*) filter (where score >= t and g) as tp, count(*) filter (where score >= t and not g) as fp, count(*) filter (where score < t and g) as fn from s, grid group by source, t),
    m as (select source, t, case when 2 * tp + fp + fn = 0 then 1.0 else 2 * tp / (2 * tp + fp + fn) end as metric from c),
    r as (select *, row_number() over (partition by source order by metric desc, t) as rn from m) select source, t as threshold, round(metric, 6) as metric from r where rn = 1""",
)
def e08(spark, sf):
    rows = _labelled(spark, sf).select("source", (F.col("quality") == 1).alias("g"), F.least(F.lit(1.0), F.col("n_chars") / 2000).alias("score"))
    return E.threshold_sweep(rows, "score", "g", GRID, ["source"]).withColumn("metric", F.round("metric", 6))


@query(
    "e09_coverage_agreement",
    "select l_returnflag, count(*) as n, round(avg(cast((l_discount >= 0.018) = (l_tax >= 0.018) as int)), 6) as agreement from lineitem group by l_returnflag",
)
def e09(spark, sf):
    out = E.coverage_agreement(table(spark, sf, "lineitem"), "l_discount", "l_tax", by=["l_returnflag"])
    return out.withColumn("agreement", F.round("agreement", 6))


@query(
    "e10_metrics_by_subset",
    f"""with {_LAB_SQL}, f as (select case when {A.hexnum('digest', 2)} < 205 then 'train' else 'test' end as split, source, {_GOLD} as g, {_PRED} as p from lab),
    c as (select split, source, {_CELLS('true')} from f group by grouping sets ((split), (split, source))) select *, {_RATES} from c""",
)
def e10(spark, sf):
    rows = _labelled(spark, sf).withColumn("split", F.when(H.hex_bucket(F.col("digest"), 2) < 205, "train").otherwise("test"))
    return _rounded(E.metrics_by_subset(rows, "split", "source", F.expr(_GOLD), F.expr(_PRED)))
