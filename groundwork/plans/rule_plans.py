"""Q: quality grades, rule sets and fusion. The feature table is derived from the
embeddings: one named feature per component, scaled to its usual range."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import rules as Q
from groundwork.plans import ansi as A
from groundwork.plans.base import query, table
from groundwork.session import materialize

# feature -> scale of the absolute component; position in the list is the component.
_UNIT = {
    "coat": 1.6, "dark": 1.2, "dark_neutral": 6.0, "dark_central": 1.5, "dark_posterior": 1.5, "strict": 0.9, "white": 2.2, "yellow": 2.4, "purple": 1.4, "body_sat": 3.5,
    "body_luma": 5.0, "spot": 0.6, "overexposed": 0.2, "gloss_largest": 4.0, "gloss_distributed": 6.0, "aspect": 6.0, "mid": 7.0, "area_fill": 6.0, "edge": 8.0, "tooth": 5.0,
    "bilateral": 3.0, "tooth_color": 3.0, "gloss": 0.25, "gloss_strict": 0.2, "rough": 0.6, "roi_height": 5.0, "roi_width": 4.0, "top_margin": 1.0, "bottom_margin": 1.0, "root": 6.0,
    "mean_width": 6.0, "center_deviation": 0.8, "smoothness": 1.2, "sulcus_score": 7.0, "sulcus_continuity": 4.0, "sulcus_centrality": 5.0, "left_line": 1.0, "right_line": 1.0,
    "line_balance": 5.0, "left_run": 8.0, "right_run": 8.0, "surface_gloss": 0.3, "coverage": 2.0, "surface_strict": 0.08, "surface_distributed": 6.0, "surface_rough": 0.5,
    "body_gloss": 0.2, "body_strict": 0.06, "body_distributed": 6.0, "body_rough": 0.5, "coating_gloss": 0.1, "coating_strict": 0.03, "coating_distributed": 4.0, "coating_rough": 0.6,
}
_COUNTS = {"left_events": (55, 25), "right_events": (56, 25), "neutral_pixels": (57, 2500), "surface_pixels": (58, 8000), "body_pixels": (59, 4000), "coating_pixels": (60, 4000)}


def _definitions(at) -> list[tuple[str, str]]:
    out = [(n, f"least(1.0, abs({at(i)}) * {s})") for i, (n, s) in enumerate(_UNIT.items(), 1)]
    out += [(n, f"cast(floor(abs({at(i)}) * {s}) as int)") for n, (i, s) in _COUNTS.items()]
    pick = lambda i, cuts, last: "case " + " ".join(f"when {at(i)} < {c} then '{v}'" for c, v in cuts) + f" else '{last}' end"
    out += [
        ("quality", pick(61, [(-0.1, "poor"), (0.05, "fair")], "good")), ("norm_applied", f"{at(62)} > -0.1"), ("sulcus_signal", f"{at(63)} > -0.1"), ("bilateral_signal", f"{at(64)} > -0.1"),
        ("body_candidate", pick(62, [(-0.1, "nhợt"), (0.0, "đỏ"), (0.12, "đỏ nhạt")], "")), ("coat_candidate", pick(63, [(-0.1, "trắng"), (0.1, "vàng")], Q.UNKNOWN)),
        ("thickness_candidate", pick(64, [(-0.1, "rất mỏng"), (0.0, "mỏng"), (0.1, "dày")], Q.UNKNOWN)), ("distribution_candidate", pick(61, [(-0.05, "trung tâm–sau"), (0.1, "lan tỏa")], "không rõ")),
        ("norm_bounded", f"{at(1)} > -0.15"), ("anchored", f"{at(2)} > 0.05"),
        ("base_body_color", pick(3, [(-0.15, "hồng"), (-0.1, " ")], "")), ("base_coating_color", pick(4, [(-0.15, "xám")], "")), ("base_coating_thickness", pick(5, [(-0.15, " dày ")], "")),
        ("base_shape", pick(6, [(0.0, "thon")], "")), ("base_toothmarks", pick(7, [(-0.05, "không rõ nét")], " ")), ("base_coating_texture", pick(8, [(0.0, "mịn")], "")),
        ("current_shape", pick(60, [(-0.1, "broad"), (0.0, "narrow"), (0.1, "typical")], "unknown")),
    ]
    return out


_SPARK = _definitions(lambda i: f"cast(element_at(embedding, {i}) as double)")
_DUCK = _definitions(lambda i: f"cast(embedding[{i}] as double)")
_cols = lambda definitions: ", ".join(f"{Q.num(s)} as {n}" for n, s in definitions)
FEAT = f"feat as materialized (select vec_id, {_cols(_DUCK)} from embeddings)"


def features(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", *[F.expr(Q.num(s)).alias(n) for n, s in _SPARK])


def _chain(source: str, definitions) -> str:
    """Nested selects, one per definition, for SQL without lateral aliases."""
    out = source
    for n, s in definitions:
        out = f"(select *, {Q.num(s)} as {n} from {out})"
    return out


def _triple(name: str, rules, default, active: str = Q.ACTIVE) -> str:
    label, confidence, reason = Q.cascade_sql(rules, default)
    on = Q.num(active)
    return f"case when {on} then {label} end as {name}_label, case when {on} then round(cast({confidence} as double), 3) end as {name}_confidence, case when {on} then {reason} end as {name}_reason"


def _flat(df, names, *more):
    return df.select("vec_id", *[F.col(f"{n}.{p}").alias(f"{n}_{p}") for n in names for p in ("label", "confidence", "reason")], *more)


# --- quality ----------------------------------------------------------------

_CHECKS = ["n_chars >= 400", "n_chars <= 6000", "text not like '%|%'", "text like '%.%'", "substr(text, 1, 1) = upper(substr(text, 1, 1))"]
_DETECTED = "lang <> 'es'"
_TERMS = {"resolution": "n_chars / 3000.0", "light": "1 - abs(n_chars - 1400) / 5000.0", "dynamic": "length(source) / 5.0", "focus": "n_chars / 900.0", "exposure": "1 - n_chars / 40000.0"}


@query(
    "q01_grade",
    f"""with p as (select doc_id, {' + '.join(f'cast({c} as int)' for c in _CHECKS)} as passed, {_DETECTED} as detected from documents)
    select doc_id, case when passed = 5 then (case when detected then 'good' else 'fair' end) when passed >= 3 then 'fair' else 'poor' end as grade from p""",
)
def q01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.grade([F.expr(c) for c in _CHECKS], F.expr(_DETECTED)).alias("grade"))


@query(
    "q02_quality_score",
    f"""select doc_id, cast(floor(100 * (0.0::double + {' + '.join(f"{Q.SCORE_WEIGHTS[n]}::double * least(1.0::double, greatest(0.0::double, {Q.num(t)}))" for n, t in _TERMS.items())})
      * (case when {_DETECTED} then 1.0::double else 0.82::double end) + 0.5::double) as bigint) as score from documents""",
)
def q02(spark, sf):
    terms = {n: F.expr(Q.num(t)) for n, t in _TERMS.items()}
    return table(spark, sf, "documents").select("doc_id", Q.quality_score(terms, F.expr(_DETECTED)).alias("score"))


_TEMPER = [
    ("top_confidence", "body_luma"), ("bottom_confidence", "edge"), ("combined_confidence", "area_fill"), ("top_grade", "quality"),
    ("bottom_grade", "case when left_events > 4 then 'poor' when left_events > 2 then 'fair' else 'good' end"), ("general", "right_events > 2"),
    ("top_visible", "case when roi_height > 0.9 then null else roi_height > 0.2 end"), ("root_visible", "root > 0.3"),
    ("under_visible", "mean_width > 0.2"), ("vessels_visible", "case when mid > 0.9 then null else mid > 0.3 end"),
]


# The SQL of q03, q05, q06 and q08 is written out by hand with its own numbers, so that a
# changed threshold of the operators shows. ``_d`` makes decimal literals doubles.
_d = Q.num
_unit = lambda x: f"greatest(0.0, least(1.0, {x}))"


@query(
    "q03_temper_confidence",
    _d(f"""with {FEAT}, t as (select vec_id, quality as tg, case when left_events > 4 then 'poor' when left_events > 2 then 'fair' else 'good' end as bg, right_events > 2 as both_sides,
      body_luma as tc, edge as bc, area_fill as cc, case when roi_height > 0.9 then true else roi_height > 0.2 end as top_seen, root > 0.3 as root_seen, mean_width > 0.2 as under_seen,
      case when mid > 0.9 then true else mid > 0.3 end as vessels_seen from feat),
    g as (select *, case tg when 'good' then 1.0 when 'fair' then 0.72 else 0.35 end as tf, case bg when 'good' then 1.0 when 'fair' then 0.72 else 0.35 end as bf from t)
    select vec_id, least(round({_unit('tc')} * tf, 3), case when top_seen then 1.0 else 0.2 end, case tg when 'poor' then 0.25 when 'fair' then 0.62 else 1.0 end, case when both_sides and not root_seen then 0.72 else 1.0 end) as top,
      case when both_sides then least(round({_unit('bc')} * bf, 3), case when under_seen then 1.0 else 0.2 end, case when vessels_seen then 1.0 else 0.35 end, case bg when 'poor' then 0.25 when 'fair' then 0.62 else 1.0 end) end as bottom,
      least(round({_unit('cc')} * case when both_sides then least(tf, bf) else tf end, 3), case when top_seen then 1.0 else 0.2 end, case when both_sides and not (under_seen and vessels_seen) then 0.4 else 1.0 end,
        case when both_sides and not root_seen then 0.65 else 1.0 end) as combined from g"""),
)
def q03(spark, sf):
    return Q.temper_confidence(Q.derive(features(spark, sf), _TEMPER)).select("vec_id", "top", "bottom", "combined")


# --- rule sets --------------------------------------------------------------

_UNIT_SQL = lambda x: f"greatest(0::double, least(1::double, {x}))"
# Written from the reference's rules, not from the operator's: (label, confidence, reason).
_CAL_CASES = {
    "body_color": (
        "case when purple_ok then 'tím/xanh tím' when pale_ok then 'nhợt' when red_ok then 'đỏ' when body_candidate = 'đỏ nhạt' then 'đỏ nhạt' "
        "when trim(base_body_color) <> '' then trim(base_body_color) when trim(body_candidate) <> '' then trim(body_candidate) else 'Không xác định' end",
        f"case when purple_ok then qb * {_UNIT_SQL('0.66::double + (purple - pg) * 1.6::double')} when pale_ok then qb * 0.82::double when red_ok then qb * 0.84::double "
        "when body_candidate = 'đỏ nhạt' then qb * (case when ready then 0.78::double else 0.62::double end) end",
        "case when purple_ok then 'rtb-purple-qc-gated' when pale_ok then 'normalized-pale-gate' when red_ok then 'normalized-red-gate' "
        "when body_candidate = 'đỏ nhạt' and ready then 'normalized-light-red' when body_candidate = 'đỏ nhạt' then 'light-red-with-limited-color-reference' else 'base-observation' end",
    ),
    "coating_color": (
        "case when dark_ok then 'nghi xám/đen' when bare then 'ít/không rêu rõ' when mixed then 'trắng-vàng/ngả vàng' when yellowish then 'vàng' when whitish then 'trắng' "
        "when trim(base_coating_color) <> '' then trim(base_coating_color) when trim(coat_candidate) <> '' then trim(coat_candidate) else 'Không xác định' end",
        f"case when dark_ok then qb * {_UNIT_SQL('0.66::double + (dark - 0.1::double) * 0.7::double + (dark_neutral - 0.55::double) * 0.2::double')} when bare then 0.74::double "
        f"when mixed then qb * {_UNIT_SQL('0.66::double + least(white, yellow) * 0.3::double')} when yellowish then qb * {_UNIT_SQL('0.7::double + (yellow - 0.3::double) * 0.55::double')} "
        f"when whitish then qb * {_UNIT_SQL('0.68::double + (white - 0.14::double) * 0.35::double')} end",
        "case when dark_ok then 'dedicated-neutral-dark-coating-contrast-gate' when bare then 'low-coating-coverage-gate' when mixed then 'r3-balanced-white-yellow-mixture-gate' "
        "when yellowish then 'yellow-dominance-gate' when whitish then 'white-coating-gate' else 'base-observation' end",
    ),
    "coating_thickness": (
        "case when bare then 'rất mỏng/ít rêu' when thick_ok then 'dày' when eff >= 0.1::double then 'mỏng' "
        "when trim(base_coating_thickness) <> '' then trim(base_coating_thickness) when trim(thickness_candidate) <> '' then trim(thickness_candidate) else 'Không xác định' end",
        f"case when bare then 0.76::double when thick_ok then qb * {_UNIT_SQL('0.72::double + (eff - 0.42::double) * 0.45::double')} when eff >= 0.1::double then qb * 0.74::double end",
        "case when bare then 'low-coating-coverage-gate' when (thick_ok or eff >= 0.1::double) and dark_ok then 'dark-coating-coverage-gate' when thick_ok then 'thick-coating-dual-coverage-gate' "
        "when eff >= 0.1::double then 'thin-coating-coverage-gate' else 'base-observation' end",
    ),
    "shape": (
        "case when wide then 'rộng/mập tương đối theo ảnh 2D' when slim then 'hẹp/gầy tương đối theo ảnh 2D' when trim(base_shape) <> '' then trim(base_shape) else 'Không xác định' end",
        f"case when wide then qb * {_UNIT_SQL('0.67::double + (aspect - 0.72::double) * 0.45::double + (mid - 0.8::double) * 0.35::double')} "
        f"when slim then qb * {_UNIT_SQL('0.67::double + (0.54::double - aspect) * 0.55::double + (0.66::double - mid) * 0.35::double')} end",
        "case when wide then 'rtb-broad-2d-conservative' when slim then 'rtb-thin-2d-conservative' else 'base-observation' end",
    ),
    "toothmarks": (
        "case when marked then 'Có tín hiệu dấu răng' when faint then 'Nghi dấu răng nhẹ' when unmarked then 'Không thấy dấu răng rõ' when trim(base_toothmarks) <> '' then trim(base_toothmarks) else 'Không xác định' end",
        f"case when marked then qb * {_UNIT_SQL('0.72::double + (tooth - 0.6::double) * 0.45::double + least(0.1::double, ev * 0.012::double) + tooth_color * 0.06::double')} "
        f"when faint then qb * {_UNIT_SQL('0.6::double + tooth * 0.12::double + tooth_color * 0.06::double')} when unmarked then qb * 0.68::double end",
        "case when marked then 'multiscale-repeated-concavity-with-bilateral-or-color-support' when faint then 'multiscale-concavity-suspicion-gate' when unmarked then 'adequate-edge-negative-gate' else 'base-observation' end",
    ),
    "coating_texture": (
        "case when slick then 'nghi nhờn/trơn' when coarse then 'thô/không đều' when smooth then 'khá đều' when trim(base_coating_texture) <> '' then trim(base_coating_texture) else 'Không xác định' end",
        f"case when slick then qb * {_UNIT_SQL('0.67::double + (gloss - 0.022::double) * 2.2::double + (gloss_distributed - 0.55::double) * 0.22::double')} when coarse then qb * 0.69::double when smooth then qb * 0.68::double end",
        "case when slick then 'distributed-gloss-plus-low-roughness-flash-gated' when coarse then 'coating-roughness-gate' when smooth then 'low-roughness-gate' else 'base-observation' end",
    ),
    "spots": (
        "case when spot >= sg then 'Có tín hiệu điểm đỏ/gai' else 'Không thấy tín hiệu điểm đỏ/gai nổi bật' end",
        f"qb * (case when spot >= sg then {_UNIT_SQL('0.64::double + (spot - sg) * 1.8::double')} else 0.62::double end)",
        "'red-spot-ratio-qc-gate'",
    ),
}
_CALIBRATED = f"""g as (select *, case quality when 'good' then 0.9::double else 0.7::double end as qb, norm_applied and norm_bounded and neutral_pixels >= 64 as ready, greatest(coat, dark) as eff, left_events + right_events as ev,
      case quality when 'good' then 0.17::double else 0.22::double end as pg, case quality when 'good' then 0.065::double else 0.08::double end as sg,
      {_UNIT_SQL('overexposed * 3.2::double + greatest(0::double, gloss_largest - 0.72::double) * 1.7::double + greatest(0::double, 0.22::double - gloss_distributed) * 0.9::double')} as fl from feat),
    h as (select *, ready and purple >= pg and body_sat >= 0.2::double as purple_ok, ready and body_candidate = 'nhợt' and body_luma >= 0.58::double and body_sat <= 0.22::double as pale_ok,
      ready and body_candidate = 'đỏ' and body_sat >= case quality when 'good' then 0.43::double else 0.47::double end as red_ok,
      ready and dark >= 0.1::double and dark_neutral >= 0.55::double and greatest(dark_central, dark_posterior) >= 0.14::double as dark_ok, eff < 0.055::double and strict < 0.025::double and quality = 'good' as bare,
      coat >= 0.09::double and yellow >= 0.18::double and white >= 0.18::double and yellow <= white * 1.28::double and white <= yellow * 1.28::double as mixed,
      coat >= 0.09::double and yellow >= 0.3::double and yellow > white * 1.28::double as yellowish, coat >= 0.075::double and white >= 0.14::double and yellow < 0.24::double as whitish,
      aspect >= 0.72::double and mid >= 0.8::double and area_fill >= 0.56::double as wide, aspect > 0 and aspect <= 0.54::double and mid > 0 and mid <= 0.66::double as slim,
      edge >= 0.6::double and tooth >= 0.6::double and greatest(left_events, right_events) >= 2 and (least(left_events, right_events) >= 1 or tooth_color >= 0.45::double) as marked,
      edge >= 0.58::double and tooth >= 0.44::double and ev >= 2 and (bilateral >= 0.24::double or tooth_color >= 0.3::double) as faint,
      edge >= 0.68::double and tooth < 0.24::double and ev = 0 and tooth_color < 0.18::double as unmarked,
      coat >= 0.12::double and gloss >= 0.022::double and gloss_strict <= 0.035::double and gloss_distributed >= 0.55::double and gloss_largest <= 0.58::double and rough <= 0.055::double and fl < 0.45::double as slick,
      coat >= 0.1::double and rough >= 0.078::double as coarse, coat >= 0.1::double and rough > 0 and rough <= 0.05::double as smooth from g),
    i as (select *, (coat >= 0.42::double and strict >= 0.18::double) or (dark_ok and dark >= 0.42::double) as thick_ok from h),
    cal as materialized (select vec_id, {', '.join(f"case when quality <> 'poor' then {l} end as {n}_label, case when quality <> 'poor' then round({c}, 3) end as {n}_confidence, case when quality <> 'poor' then {r} end as {n}_reason" for n, (l, c, r) in _CAL_CASES.items())} from i)"""
_triples = lambda names: ", ".join(f"{n}_{p}" for n in names for p in ("label", "confidence", "reason"))


@query("q04_rule_cascade", f"with {FEAT}, {_CALIBRATED} select vec_id, {_triples(Q.CALIBRATED_RULES)} from cal")
def q04(spark, sf):
    return _flat(Q.calibrated_labels(features(spark, sf)), list(Q.CALIBRATED_RULES))


@query(
    "q04_label_distribution",
    f"with {FEAT}, {_CALIBRATED} " + " union all ".join(f"select '{n}' as feature, {n}_label as label, {n}_reason as reason, count(*) as n from cal group by all" for n in Q.CALIBRATED_RULES),
)
def q04_distribution(spark, sf):
    return Q.label_distribution(Q.calibrated_labels(features(spark, sf)), list(Q.CALIBRATED_RULES))


def _moisture_region(name: str, trust: str) -> str:
    """Label, confidence and reason of one region, from its gloss and roughness."""
    gloss, strict, spread, rough, pixels = (f"{name}_{x}" for x in ("gloss", "strict", "distributed", "rough", "pixels"))
    shine = _unit(f"{_unit(f'{gloss} / 0.018')} * 0.50 + {_unit(f'{strict} / 0.006')} * 0.25 + {_unit(f'{spread} / 0.65')} * 0.25")
    grain = _unit(f"({rough} - 0.030) / 0.040")
    return f"""select vec_id, case when quality = 'poor' then null when why in ('insufficient-region-pixels', 'flash-or-specular-confounded', 'qc-insufficient', 'evidence-below-gate') then 'Không xác định'
        when why = 'distributed-specular-signal' then 'nhuận/ướt' when why = 'low-gloss-plus-roughness-signal' then 'khô' else 'khô ướt vừa phải' end as m_{name}_label,
      case when quality <> 'poor' and why like '%-signal' then round(least(0.82, trust * (0.55 + 0.45 * case why when 'distributed-specular-signal' then wet when 'low-gloss-plus-roughness-signal' then dry when 'intermediate-gloss-low-roughness-signal' then even end)), 3) end as m_{name}_confidence_,
      case when quality <> 'poor' then why end as m_{name}_reason
    from (select *, case when pixels < 80 then 'insufficient-region-pixels' when flash >= 0.62 then 'flash-or-specular-confounded' when trust < 0.48 then 'qc-insufficient' when wet >= 0.62 then 'distributed-specular-signal'
        when dry >= 0.64 then 'low-gloss-plus-roughness-signal' when even >= 0.62 and wet < 0.58 and dry < 0.58 then 'intermediate-gloss-low-roughness-signal' else 'evidence-below-gate' end as why
      from (select vec_id, quality, flash, {trust} as trust, {pixels} as pixels, {shine} * (1.0 - flash * 0.72) as wet,
          case when {gloss} <= 0.010 and {grain} >= 0.30 then {_unit(f"(1.0 - {shine}) * 0.45 + {grain} * 0.55")} else 0.0 end * (1.0 - flash * 0.35) as dry,
          case when {gloss} > 0.004 and {gloss} < 0.020 and {rough} < 0.060 then {_unit(f"0.55 + (0.060 - {rough}) * 3.0")} else 0.0 end as even from frame))"""


_REGIONS = {"surface": "sure", "body": "sure", "coating": "sure * 0.92"}
_MOISTURE_SQL = _d(f"""with {FEAT}, lit as (select *, {_unit(f"{_unit('overexposed / 0.045')} * 0.45 + {_unit('(gloss_largest - 0.62) / 0.38')} * 0.35 + {_unit('(surface_gloss - 0.060) / 0.080')} * 0.20")} as flash from feat),
    frame as materialized (select *, {_unit(f"case quality when 'good' then 0.92 else 0.68 end * (0.55 + 0.25 * {_unit('coverage / 0.18')} + 0.20 * {_unit('surface_pixels / 900.0')}) * (1.0 - flash * 0.62)")} as sure from lit),
    {', '.join(f'{n}_ as ({_moisture_region(n, t)})' for n, t in _REGIONS.items())}
    select vec_id, {', '.join(f'm_{n}_label, m_{n}_confidence_ as m_{n}_confidence, m_{n}_reason' for n in _REGIONS)} from surface_ join body_ using (vec_id) join coating_ using (vec_id)""")


@query("q05_evidence_state", _MOISTURE_SQL)
def q05(spark, sf):
    return _flat(Q.evidence_state(features(spark, sf)), [f"m_{r}" for r in Q.MOISTURE_REGIONS])


@query(
    "q06_visibility_gates",
    _d(f"""with {FEAT}, g as (select *, quality <> 'poor' and sulcus_signal and sulcus_score >= 0.62 and sulcus_continuity >= 0.22 and sulcus_centrality >= 0.35 as furrow,
      greatest(coat, dark) as cover from feat)
    select vec_id, case when furrow then 'visible-signal' else 'unknown' end as sulcus_status, case when furrow then round(least(0.78, sulcus_score), 3) end as sulcus_confidence,
      quality <> 'poor' and bilateral_signal and left_line >= 0.05 and right_line >= 0.05 and line_balance >= 0.30 and left_run >= 0.60 and right_run >= 0.60 as bilateral_visible,
      case when quality <> 'poor' and cover >= 0.09 and distribution_candidate <> 'không rõ' then distribution_candidate else 'Không xác định' end as coating_distribution,
      case when quality <> 'poor' and cover >= 0.07 and thickness_candidate <> 'Không xác định' then thickness_candidate else '' end as coating_thickness_gate from g"""),
)
def q06(spark, sf):
    out = Q.visibility_gates(features(spark, sf))
    return out.select("vec_id", "sulcus_status", "sulcus_confidence", "bilateral_visible", "coating_distribution", "coating_thickness_gate")


@query(
    "q07_feature_labels",
    f"""with {FEAT} select vec_id, {', '.join(_triple(n, r, d) for n, (r, d) in Q.FEATURE_RULES.items())},
    case when {Q.num(f'({Q.ACTIVE}) and {Q.FULL_VIEW}')} then true end as whole_visible, case when {Q.num(f'({Q.ACTIVE}) and {Q.FULL_VIEW} and root >= 0.42')} then true end as root_visible from {_chain('feat', [Q.FEATURE_BASE])}""",
)
def q07(spark, sf):
    return _flat(Q.feature_labels(features(spark, sf)), list(Q.FEATURE_RULES), "whole_visible", "root_visible")


_up = lambda c, a, b: f"case when {c} <= {a} then 0.0 else {_unit(f'({c} - {a}) / ({b} - {a})')} end"
_down = lambda c, a, b: f"case when {c} <= 0.0 or {c} >= {a} then 0.0 else {_unit(f'({a} - {c}) / ({a} - {b})')} end"


@query(
    "q08_dual_score_class",
    _d(f"""with {FEAT}, s as (select *,
      round(({_up('aspect', 0.64, 0.78)} + {_up('mid', 0.72, 0.84)} + {_up('area_fill', 0.48, 0.62)} + {_up('root', 0.58, 0.76)} + {_up('mean_width', 0.54, 0.72)}) / 5.0, 3) as broad,
      round(({_down('aspect', 0.64, 0.5)} + {_down('mid', 0.74, 0.6)} + {_down('area_fill', 0.5, 0.38)} + {_down('root', 0.64, 0.48)} + {_down('mean_width', 0.58, 0.44)}) / 5.0, 3) as slim,
      edge < 0.60 or roi_height < case when anchored then 0.08 else 0.28 end or roi_width < case when anchored then 0.12 else 0.18 end or top_margin <= 0.012 or bottom_margin <= 0.012
        or center_deviation > 0.14 or smoothness > 0.22 as shaky from feat),
    w as (select *, case when quality = 'poor' then null when shaky then 'geometry-unstable' when broad >= 0.58 and broad >= slim + 0.18 then 'broad-margin' when slim >= 0.58 and slim >= broad + 0.18 then 'narrow-margin' else 'no-margin' end as why from s),
    l as (select *, case why when 'geometry-unstable' then 'unknown' when 'broad-margin' then 'broad' when 'narrow-margin' then 'narrow' when 'no-margin' then 'typical' end as label from w)
    select vec_id, broad as broad_score, slim as narrow_score, label as shape_class_label, why as shape_class_reason,
      round(case why when 'broad-margin' then case quality when 'good' then 0.88 else 0.68 end * (0.70 + 0.30 * broad) when 'narrow-margin' then case quality when 'good' then 0.88 else 0.68 end * (0.70 + 0.30 * slim)
        when 'no-margin' then case quality when 'good' then 0.82 else 0.64 end * (1.0 - least(0.35, abs(broad - slim))) end, 3) as shape_class_confidence,
      case when current_shape = 'unknown' or coalesce(label, 'unknown') = 'unknown' then 'insufficient' when current_shape = label then 'aligned' when 'typical' in (current_shape, label) then 'partial' else 'conflict' end as shape_agreement from l"""),
)
def q08(spark, sf):
    out = Q.dual_score_class(features(spark, sf))
    return _flat(out, ["shape_class"], F.round("broad_score", 3).alias("broad_score"), F.round("narrow_score", 3).alias("narrow_score"), "shape_agreement")


# --- patterns ---------------------------------------------------------------

# Observation texts by component sign, so that every flag occurs.
_pick = lambda column, *cuts: "case " + " ".join(f"when {column} > {c} then '{v}'" for c, v in cuts[:-1]) + f" else '{cuts[-1]}' end"
OBSERVATIONS = [
    ("body_color", _pick("purple", (0.3, "Tím nhẹ"), (0.2, "đỏ nhạt"), (0.1, "Đỏ sẫm"), (0.05, "trắng nhợt"), "Không xác định")),
    ("coating_color", _pick("white", (0.5, "vàng"), (0.25, "trắng"), (0.1, "xám/đen"), "không thấy rêu trắng")),
    ("coating_thickness", _pick("yellow", (0.4, "dày"), (0.15, "mỏng"), "")), ("coating_texture", _pick("gloss", (0.04, "nhầy dính"), "khá đều")),
    ("stasis", _pick("spot", (0.12, "ban tím"), "không có")), ("fissures", _pick("rough", (0.08, "nứt"), "chưa thấy rõ nứt")),
    ("moisture", _pick("coating_rough", (0.12, "khô ướt vừa phải"), (0.08, "thiên khô"), (0.04, "nhuận"), "unknown")), ("toothmarks", _pick("tooth", (0.6, "dấu răng"), "không thấy dấu răng")),
    ("shape", _pick("aspect", (0.9, "bệu"), (0.5, "gầy mỏng"), "trung bình")), ("spots", _pick("bilateral", (0.4, "điểm đỏ"), "")), ("under_color", _pick("left_line", (0.12, "xanh tím"), "hồng")),
    ("under_dilation", _pick("right_line", (0.12, "giãn nhẹ"), "")),
]
_FLAGS_SQL = ", ".join(
    f"lower(trim({c})) <> '' and not regexp_matches(lower(trim({c})), '{Q.NOT_OBSERVED}') and regexp_matches(lower(trim({c})), '{p}') as {n}" for n, c, p in Q.OBSERVATION_FLAGS
) + f", regexp_matches(lower(trim(body_color)), '{Q.LIGHT_RED}') as light_red"
_OBS = f"obs as materialized (select vec_id, quality, body_luma, edge, {_cols(OBSERVATIONS)} from feat)"
_PATTERNS = f"""{FEAT}, {_OBS}, flags as materialized (select * from {_chain(f'(select *, {_FLAGS_SQL} from obs)', Q.OBSERVATION_COMBINATIONS)}),
    emitted as ({' union all '.join(f"select vec_id, {i} as ord, {label} as label, cast({Q.num(s)} as double) as s, {str(w).lower()} as warning from flags where {Q.num(c)}" for i, (label, c, s, w) in enumerate(Q.PATTERN_RULES))}),
    patterns as materialized (select vec_id, label, round(s, 6) as score, warning, rank from (select *, row_number() over (partition by vec_id order by s desc, ord) as rank from emitted) where rank <= 8)"""


def observations(spark, sf):
    return features(spark, sf).select("vec_id", "quality", "body_luma", "edge", *[F.expr(Q.num(s)).alias(n) for n, s in OBSERVATIONS])


def patterns(spark, sf):
    return Q.emit_patterns(Q.observation_flags(observations(spark, sf)), "vec_id")


@query("q09_emit_patterns", f"with {_PATTERNS} select vec_id, label, score, warning, rank from patterns")
def q09(spark, sf):
    return patterns(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "q10_fuse_layers",
    f"""with {_PATTERNS}, items as (select vec_id, least(1.0::double, body_luma) as c, least(1.0::double, edge) as t, quality from obs),
    r as (select vec_id, label, least(1.0::double, score * 0.9::double) as r from patterns where warning union all select vec_id, 'reading only', 0.9::double from obs where quality = 'good'),
    b as (select coalesce(p.vec_id, r.vec_id) as vec_id, coalesce(p.label, r.label) as label, coalesce(p.score, 0.0::double) as d, coalesce(r.r, p.score) as gp from patterns p full join r on r.vec_id = p.vec_id and r.label = p.label),
    s as (select b.vec_id, label, d, gp, case when t >= 0.72 then 0.82::double when t >= 0.60 then 0.64::double when t >= 0.50 then 0.48::double else 0.25::double end as sup from b join items using (vec_id)),
    w as (select *, least(1.0::double, 0.7::double * d + 0.2::double * gp + 0.1::double * sup) as w, cast(d >= 0.5 as int) + cast(sup >= 0.55 as int) + cast(gp >= 0.55 as int) as layers from s),
    k as (select vec_id, label, round(case when d > 0 then least(d + 0.08::double, w) else w end, 3) as score from w where d >= 0.72 or (d >= 0.5 and layers >= 2)),
    top6 as (select * from (select k.*, row_number() over (partition by vec_id order by k.score desc, o.ord nulls last, label) as rn from k left join (select vec_id, label, rank as ord from patterns) o using (vec_id, label)) where rn <= 6),
    rf as (select vec_id, max(r) as rf from r group by vec_id),
    a as (select vec_id, avg(score) as a, count(*) as n from top6 group by vec_id),
    j as (select i.*, coalesce(a.a, rf, 0.35::double) as a, coalesce(n, 0) as n from items i left join a using (vec_id) left join rf using (vec_id))
    select vec_id, n as candidates, round(greatest(0.0::double, least(case quality when 'good' then 0.88::double when 'fair' then 0.62::double else 0.25::double end, c + 0.08::double, 0.45::double * c + 0.35::double * t + 0.2::double * a)), 3) as confidence,
      case when c >= 0.6 and t >= 0.68 and a >= 0.6 then 'strong' when cast(c >= 0.52 as int) + cast(t >= 0.58 as int) + cast(a >= 0.52 as int) >= 2 then 'moderate' else 'weak' end as agreement from j""",
)
def q10(spark, sf):
    found = materialize(patterns(spark, sf), "patterns")
    obs = observations(spark, sf)
    reasoning = found.filter("warning").select("vec_id", "label", F.least(F.lit(1.0), F.col("score") * 0.9).alias("score"))
    extra = obs.filter("quality = 'good'").select("vec_id", F.lit("reading only").alias("label"), F.lit(0.9).alias("score"))
    reasoning = reasoning.unionByName(extra)
    first = reasoning.groupBy("vec_id").agg(F.max("score").alias("reasoning_first"))
    items = obs.select("vec_id", F.least(F.lit(1.0), F.col("body_luma")).alias("confidence"), F.least(F.lit(1.0), F.col("edge")).alias("atlas"), "quality").join(first, "vec_id", "left")
    return Q.fuse_layers(found.select("vec_id", "label", "score", F.col("rank").alias("ord")), reasoning, items, "vec_id")


_CLAIMS = [
    ("claim", _pick("aspect", (0.9, "Lưỡi bệu"), (0.7, "phù to và dày"), (0.4, "gầy mỏng"), "bình thường")),
    ("seen", _pick("tooth", (0.7, "dấu răng, lấp đầy khoang"), (0.4, "hằn răng"), (0.2, "không thấy dấu răng"), "")),
    ("known_scale", "edge > 0.8"), ("mouth_reference", "case when mid > 0.8 then true when mid > 0.3 then false end"), ("color_reliability", "quality"),
]
_has = lambda k: "regexp_matches(t, '" + "|".join(Q.CLAIM_WORDS[k]) + "')"


@query(
    "q11_ground_claim",
    f"""with {FEAT}, c as (select vec_id, {_cols(_CLAIMS)} from feat), t as (select *, {A.fold("claim || ' ' || seen")} as t from c),
    h as (select *, {_has('puffy')} as puffy, {_has('thin')} as thin, {_has('definition')} as defined, {_has('tooth')} and not {_has('tooth_negative')} as tooth, coalesce(mouth_reference, false) or {_has('mouth')} as mouth from t),
    k as (select *, case when puffy and defined and mouth then 'puffy-supported' when puffy and (defined or tooth) then 'puffy-candidate' when puffy then 'wide-geometry-only' when thin then 'narrow-geometry-only' else 'descriptive-only' end as classification from h)
    select vec_id, classification, case classification {' '.join(f"when '{n}' then '{v}'" for n, v in Q.CLAIM_TEXTS.items())} else claim end as grounded,
      array_to_string(list_filter([case when puffy then 'volume-needs-thickness' end, case when not puffy and thin then 'thickness-not-measured' end, case when not coalesce(known_scale, false) then 'no-absolute-scale' end,
        case when color_reliability = 'poor' then 'color-unreliable' end], lambda x: x is not null), ',') as limitations, case when known_scale then 'calibrated-relative' else 'relative-2d' end as confidence_policy from k""",
)
def q11(spark, sf):
    claims = features(spark, sf).select("vec_id", *[F.expr(Q.num(s)).alias(n) for n, s in _CLAIMS])
    out = Q.ground_claim(claims, "claim", "seen")
    return out.select("vec_id", "classification", "grounded", F.array_join("limitations", ",").alias("limitations"), "confidence_policy")


_SECTIONS = [
    ("Quality", [("Grade", "quality")], 4),
    ("Top", [("Color", "body_color"), ("Shape", "shape"), ("Coating", "coating_color"), ("Coating", "coating_thickness"), ("Texture", "coating_texture"), ("Moisture", "moisture"), ("Toothmarks", "toothmarks")], 5),
    ("Under", [("Color", "under_color"), ("Dilation", "under_dilation")], 8),
]
_ITEMS = [f"select vec_id, {n} as section, '{t}' as title, {i} as ord, '{label}: ' || trim({c}) as item from obs where trim({c}) <> '' and not regexp_matches({c}, '(?i)không xác định|unknown')" for n, (t, fs, _) in enumerate(_SECTIONS, 1) for i, (label, c) in enumerate(fs)]


@query(
    "q12_report_rows",
    f"""with {FEAT}, {_OBS}, items as ({' union all '.join(_ITEMS)}), f as (select *, row_number() over (partition by vec_id, section, lower(item) order by ord) as dup from items),
    r as (select *, row_number() over (partition by vec_id, section order by ord) as item_no from f where dup = 1)
    select vec_id, section, title, item_no, item from r where item_no <= case section when 1 then 4 when 2 then 5 else 8 end""",
)
def q12(spark, sf):
    out = Q.report_rows(observations(spark, sf), "vec_id", _SECTIONS)
    return out.withColumn("item_no", F.col("item_no").cast("bigint"))


@query(
    "q13_quality_dashboard",
    """with l as (select event_type in ('click', 'view') as general, case when value > 20 then 'good' when value > 5 then 'fair' else 'poor' end as tg, case when event_id % 3 = 0 then 'poor' else 'good' end as bg from events order by ts desc, event_id desc limit 100)
    select count(*) as total, count(*) filter (where general) as general, round(avg(cast(tg = 'good' as int)), 4) as share_good, round(avg(cast(tg <> 'poor' and (not general or bg <> 'poor') as int)), 4) as share_passing from l""",
)
def q13(spark, sf):
    rows = table(spark, sf, "events").select(
        "ts", "event_id", F.col("event_type").isin("click", "view").alias("general"), F.when(F.col("value") > 20, "good").when(F.col("value") > 5, "fair").otherwise("poor").alias("top_grade"),
        F.when(F.col("event_id") % 3 == 0, "poor").otherwise("good").alias("bottom_grade"),
    )
    return Q.quality_dashboard(rows, [F.desc("ts"), F.desc("event_id")])


# --- further rule sets ------------------------------------------------------

_TOOTH = [("color_left", "least(1.0, left_line * 4.0)"), ("color_right", "least(1.0, right_line * 4.0)"), ("current_toothmarks", "case when bilateral > 0.5 then 'present' when bilateral > 0.3 then 'suspected' when bilateral > 0.1 then 'absent' else 'unknown' end")]


@query(
    "q08_toothmark_class",
    f"""with {FEAT}, s as (select *, {_triple('tooth_class', Q.TOOTH_RULES, Q.TOOTH_DEFAULT)} from {_chain('feat', _TOOTH + Q.CALIBRATION_INPUTS + Q.TOOTH_INPUTS)}), r as (select *, current_toothmarks as now, coalesce(tooth_class_label, 'unknown') as ref from s)
    select vec_id, {_triples(['tooth_class'])}, case when now = 'unknown' or ref = 'unknown' then 'insufficient' when now = ref then 'aligned'
      when now in ('present', 'suspected') and ref in ('present', 'suspected') then 'partial' else 'conflict' end as tooth_agreement from r""",
)
def q08_tooth(spark, sf):
    return _flat(Q.toothmark_class(Q.derive(features(spark, sf), _TOOTH)), ["tooth_class"], "tooth_agreement")


_RATIOS = [("mean_r", "roi_height"), ("mean_g", "roi_width"), ("mean_s", "body_sat"), ("mean_v", "body_luma"), ("bbox", "area_fill"), ("glare", "gloss"), ("stasis_ratio", "smoothness"), ("light_ok", "neutral_pixels > 100")]


@query("q04_ratio_labels", f"with {FEAT} select vec_id, {', '.join(_triple(n, r, d, 'true') for n, (r, d) in Q.RATIO_RULES.items())} from {_chain('feat', _RATIOS)}")
def q04_ratio(spark, sf):
    return _flat(Q.ratio_labels(Q.derive(features(spark, sf), _RATIOS)), list(Q.RATIO_RULES))


_TOP_COLUMNS = ["body_color", "shape", "coating_color", "coating_thickness", "coating_texture", "moisture", "fissures", "toothmarks", "spots", "stasis"]


@query(
    "q09_fallback_patterns",
    f"""with {FEAT}, {_OBS}, t as (select vec_id, {" || ' · ' || ".join(_TOP_COLUMNS)} as top_text, under_color || ' · ' || under_dilation as under_text from obs),
    fl as (select *, {', '.join(f"regexp_matches(lower({c}), '{p}') as {n}" for n, c, p in Q.FALLBACK_FLAGS)} from t),
    em as ({' union all '.join(f"select vec_id, {i} as ord, {label} as label, {s}::double as score from fl where {c}" for i, (label, c, s, _) in enumerate(Q.FALLBACK_RULES))}
      union all select vec_id, 7, 'Tham Vấn: nguyên tắc đọc thiệt tượng', 0.42::double from fl where not (f_red and f_dry and f_little or f_red and f_yellow or f_pale and f_white or f_pale and (f_tooth or f_broad) or f_purple or f_thick or f_under))
    select vec_id, label, score, rank from (select *, row_number() over (partition by vec_id order by ord) as rank from em) where rank <= 4""",
)
def q09_fallback(spark, sf):
    texts = observations(spark, sf).select("vec_id", F.concat_ws(" · ", *_TOP_COLUMNS).alias("top_text"), F.concat_ws(" · ", "under_color", "under_dilation").alias("under_text"))
    return Q.fallback_patterns(texts, "vec_id").select("vec_id", "label", "score", F.col("rank").cast("bigint").alias("rank"))
