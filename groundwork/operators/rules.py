"""Quality grades, gated labelling rules and layer fusion over feature tables.

Rules are data: SQL conditions and expressions over feature columns. One engine turns a
rule list into a single conditional expression, so a whole rule set is one projection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from groundwork.functions import text as X
from groundwork.operators.joins import top_k

UNKNOWN = "Không xác định"


def num(sql: str) -> str:
    """Decimal literals as doubles, so rule arithmetic is binary floating point."""
    return re.sub(r"(?<![\w.])(\d*\.\d+)(?![\w.])", lambda m: f"{float(m.group(1))!r}e0" if "e" not in repr(float(m.group(1))) else m.group(1), sql)


def clamp(sql: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"greatest({low}, least({high}, {sql}))"


def derive(df: DataFrame, definitions: list[tuple[str, str]]) -> DataFrame:
    """Add columns in order; later definitions may use earlier ones."""
    for name, sql in definitions:
        df = df.withColumn(name, F.expr(num(sql)))
    return df


def cascade_sql(rules: list[tuple[str, str, str, str]], default: tuple[str, str, str]) -> tuple[str, str, str]:
    """Three CASE expressions (label, confidence, reason) of an ordered rule list
    (condition, label, confidence, reason); the first condition that holds wins."""
    out = []
    for i in range(3):
        cases = " ".join(f"when {num(r[0])} then {num(r[1 + i])}" for r in rules)
        out.append(f"case {cases} else {num(default[i])} end")
    return tuple(out)


def rule_cascade(df: DataFrame, name: str, rules: list, default: tuple[str, str, str], active: str = "true") -> DataFrame:
    """Adds the struct ``name`` (label, confidence rounded to 3, reason). Inactive rows,
    such as poor quality, get a null label: unknown stays unknown."""
    label, confidence, reason = cascade_sql(rules, default)
    on = F.expr(num(active))
    body = F.struct(
        F.when(on, F.expr(label)).alias("label"), F.when(on, F.round(F.expr(confidence).cast("double"), 3)).alias("confidence"), F.when(on, F.expr(reason)).alias("reason")
    )
    return df.withColumn(name, body)


def label_distribution(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows per feature, label and reason."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}.label").alias("label"), F.col(f"{n}.reason").alias("reason")) for n in names])).alias("r"))
    return rows.groupBy("r.feature", "r.label", "r.reason").agg(F.count("*").alias("n"))


# --- quality ----------------------------------------------------------------


def grade(checks: list[Column], detected: Column) -> Column:
    """All five checks good, three or more fair, else poor; an undetected region caps
    the grade at fair."""
    passed = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0))
    raw = F.when(passed == len(checks), "good").when(passed >= 3, "fair").otherwise("poor")
    return F.when((raw == "good") & ~detected, "fair").otherwise(raw)


# Weights of the score terms, and the factor of an undetected region.
SCORE_WEIGHTS = {"resolution": 0.15, "light": 0.20, "dynamic": 0.15, "focus": 0.30, "exposure": 0.20}
UNDETECTED_FACTOR = 0.82


def quality_score(terms: dict[str, Column], detected: Column) -> Column:
    """Weighted sum of clamped terms in percent, rounded half up."""
    total = F.lit(0.0)
    for name, weight in SCORE_WEIGHTS.items():
        total = total + weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms[name]))
    return F.floor(100 * total * F.when(detected, 1.0).otherwise(UNDETECTED_FACTOR) + 0.5).cast("bigint")


# Confidence factors by grade, and caps (condition, cap) per view.
GRADE_FACTORS = {"good": 1.0, "fair": 0.72}
POOR_FACTOR = 0.35
TOP_CAPS = [("top_visible = false", 0.2), ("top_grade = 'poor'", 0.25), ("top_grade = 'fair'", 0.62), ("general and root_visible = false", 0.72)]
BOTTOM_CAPS = [("under_visible = false", 0.2), ("vessels_visible = false", 0.35), ("bottom_grade = 'poor'", 0.25), ("bottom_grade = 'fair'", 0.62)]
COMBINED_CAPS = [("top_visible = false", 0.2), ("general and (under_visible = false or vessels_visible = false)", 0.4), ("general and root_visible = false", 0.65)]


def temper_confidence(df: DataFrame) -> DataFrame:
    """Scales three confidences by grade, then applies the caps. Columns: top_confidence,
    bottom_confidence, combined_confidence, top_grade, bottom_grade, general and the
    three-valued visibility flags."""
    factor = lambda g: F.when(F.col(g) == "good", GRADE_FACTORS["good"]).when(F.col(g) == "fair", GRADE_FACTORS["fair"]).otherwise(POOR_FACTOR)

    def tempered(confidence: str, scale: Column, caps: list) -> Column:
        value = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(confidence), F.lit(0.0)))) * scale, 3)
        for condition, cap in caps:
            value = F.when(F.coalesce(F.expr(condition), F.lit(False)), F.least(value, F.lit(cap))).otherwise(value)
        return value

    both = F.when(F.col("general"), F.least(factor("top_grade"), factor("bottom_grade"))).otherwise(factor("top_grade"))
    return df.withColumns(
        {
            "top": tempered("top_confidence", factor("top_grade"), TOP_CAPS),
            "bottom": F.when(F.col("general"), tempered("bottom_confidence", factor("bottom_grade"), BOTTOM_CAPS)),
            "combined": tempered("combined_confidence", both, COMBINED_CAPS),
        }
    )


def quality_dashboard(df: DataFrame, order: list, latest: int | None = 100) -> DataFrame:
    """Counts and shares over the latest rows (general, top_grade, bottom_grade); over all
    rows if ``latest`` is None."""
    recent = df if latest is None else df.orderBy(*order).limit(latest)
    passing = (F.col("top_grade") != "poor") & (~F.col("general") | (F.col("bottom_grade") != "poor"))
    return recent.agg(
        F.count("*").alias("total"), F.count_if("general").alias("general"), F.round(F.avg((F.col("top_grade") == "good").cast("int")), 4).alias("share_good"), F.round(F.avg(passing.cast("int")), 4).alias("share_passing")
    )


# --- feature labels ---------------------------------------------------------

ACTIVE = "quality <> 'poor'"
# Derived inputs of the calibrated rule set.
CALIBRATION_INPUTS = [
    ("qc_base", "case when quality = 'good' then 0.90 else 0.70 end"),
    ("norm_ready", "quality <> 'poor' and norm_applied and norm_bounded and neutral_pixels >= 64"),
    ("cover", "greatest(coat, dark)"),
    ("purple_gate", "case when quality = 'good' then 0.17 else 0.22 end"),
    ("spot_gate", "case when quality = 'good' then 0.065 else 0.080 end"),
    ("dark_gate", "norm_ready and dark >= 0.10 and dark_neutral >= 0.55 and greatest(dark_central, dark_posterior) >= 0.14"),
    ("flash", clamp("overexposed * 3.2 + greatest(0.0, gloss_largest - 0.72) * 1.7 + greatest(0.0, 0.22 - gloss_distributed) * 0.9")),
    ("side_max", "greatest(left_events, right_events)"),
    ("side_min", "least(left_events, right_events)"),
    ("events_total", "left_events + right_events"),
]
_BASE = ("null", "'base-observation'")


def observed(*columns: str) -> str:
    """The first of the columns that is not blank, trimmed, else unknown."""
    return "coalesce(" + ", ".join(f"nullif(trim({c}), '')" for c in columns) + f", '{UNKNOWN}')"


# The calibrated rule set: feature -> (ordered rules, default). A rule is
# (condition, label, confidence, reason).
CALIBRATED_RULES = {
    "body_color": (
        [
            ("norm_ready and purple >= purple_gate and body_sat >= 0.20", "'tím/xanh tím'", f"qc_base * {clamp('0.66 + (purple - purple_gate) * 1.6')}", "'rtb-purple-qc-gated'"),
            ("norm_ready and body_candidate = 'nhợt' and body_luma >= 0.58 and body_sat <= 0.22", "'nhợt'", "qc_base * 0.82", "'normalized-pale-gate'"),
            ("norm_ready and body_candidate = 'đỏ' and body_sat >= case when quality = 'good' then 0.43 else 0.47 end", "'đỏ'", "qc_base * 0.84", "'normalized-red-gate'"),
            ("body_candidate = 'đỏ nhạt'", "'đỏ nhạt'", "qc_base * case when norm_ready then 0.78 else 0.62 end", "case when norm_ready then 'normalized-light-red' else 'light-red-with-limited-color-reference' end"),
        ],
        (observed("base_body_color", "body_candidate"), *_BASE),
    ),
    "coating_color": (
        [
            ("dark_gate", "'nghi xám/đen'", f"qc_base * {clamp('0.66 + (dark - 0.10) * 0.70 + (dark_neutral - 0.55) * 0.20')}", "'dedicated-neutral-dark-coating-contrast-gate'"),
            ("cover < 0.055 and strict < 0.025 and quality = 'good'", "'ít/không rêu rõ'", "0.74", "'low-coating-coverage-gate'"),
            ("coat >= 0.09 and yellow >= 0.18 and white >= 0.18 and yellow <= white * 1.28 and white <= yellow * 1.28", "'trắng-vàng/ngả vàng'", f"qc_base * {clamp('0.66 + least(white, yellow) * 0.30')}", "'r3-balanced-white-yellow-mixture-gate'"),
            ("coat >= 0.09 and yellow >= 0.30 and yellow > white * 1.28", "'vàng'", f"qc_base * {clamp('0.70 + (yellow - 0.30) * 0.55')}", "'yellow-dominance-gate'"),
            ("coat >= 0.075 and white >= 0.14 and yellow < 0.24", "'trắng'", f"qc_base * {clamp('0.68 + (white - 0.14) * 0.35')}", "'white-coating-gate'"),
        ],
        (observed("base_coating_color", "coat_candidate"), *_BASE),
    ),
    "coating_thickness": (
        [
            ("cover < 0.055 and strict < 0.025 and quality = 'good'", "'rất mỏng/ít rêu'", "0.76", "'low-coating-coverage-gate'"),
            ("(coat >= 0.42 and strict >= 0.18) or (dark_gate and dark >= 0.42)", "'dày'", f"qc_base * {clamp('0.72 + (cover - 0.42) * 0.45')}", "case when dark_gate then 'dark-coating-coverage-gate' else 'thick-coating-dual-coverage-gate' end"),
            ("cover >= 0.10", "'mỏng'", "qc_base * 0.74", "case when dark_gate then 'dark-coating-coverage-gate' else 'thin-coating-coverage-gate' end"),
        ],
        (observed("base_coating_thickness", "thickness_candidate"), *_BASE),
    ),
    "shape": (
        [
            ("aspect >= 0.72 and mid >= 0.80 and area_fill >= 0.56", "'rộng/mập tương đối theo ảnh 2D'", f"qc_base * {clamp('0.67 + (aspect - 0.72) * 0.45 + (mid - 0.80) * 0.35')}", "'rtb-broad-2d-conservative'"),
            ("aspect > 0 and aspect <= 0.54 and mid > 0 and mid <= 0.66", "'hẹp/gầy tương đối theo ảnh 2D'", f"qc_base * {clamp('0.67 + (0.54 - aspect) * 0.55 + (0.66 - mid) * 0.35')}", "'rtb-thin-2d-conservative'"),
        ],
        (observed("base_shape"), *_BASE),
    ),
    "toothmarks": (
        [
            ("edge >= 0.60 and tooth >= 0.60 and side_max >= 2 and (side_min >= 1 or tooth_color >= 0.45)", "'Có tín hiệu dấu răng'", f"qc_base * {clamp('0.72 + (tooth - 0.60) * 0.45 + least(0.10, events_total * 0.012) + tooth_color * 0.06')}", "'multiscale-repeated-concavity-with-bilateral-or-color-support'"),
            ("edge >= 0.58 and tooth >= 0.44 and events_total >= 2 and (bilateral >= 0.24 or tooth_color >= 0.30)", "'Nghi dấu răng nhẹ'", f"qc_base * {clamp('0.60 + tooth * 0.12 + tooth_color * 0.06')}", "'multiscale-concavity-suspicion-gate'"),
            ("edge >= 0.68 and tooth < 0.24 and events_total = 0 and tooth_color < 0.18", "'Không thấy dấu răng rõ'", "qc_base * 0.68", "'adequate-edge-negative-gate'"),
        ],
        (observed("base_toothmarks"), *_BASE),
    ),
    "coating_texture": (
        [
            ("coat >= 0.12 and gloss >= 0.022 and gloss_strict <= 0.035 and gloss_distributed >= 0.55 and gloss_largest <= 0.58 and rough <= 0.055 and flash < 0.45", "'nghi nhờn/trơn'", f"qc_base * {clamp('0.67 + (gloss - 0.022) * 2.2 + (gloss_distributed - 0.55) * 0.22')}", "'distributed-gloss-plus-low-roughness-flash-gated'"),
            ("coat >= 0.10 and rough >= 0.078", "'thô/không đều'", "qc_base * 0.69", "'coating-roughness-gate'"),
            ("coat >= 0.10 and rough > 0 and rough <= 0.050", "'khá đều'", "qc_base * 0.68", "'low-roughness-gate'"),
        ],
        (observed("base_coating_texture"), *_BASE),
    ),
    "spots": (
        [("spot >= spot_gate", "'Có tín hiệu điểm đỏ/gai'", f"qc_base * {clamp('0.64 + (spot - spot_gate) * 1.8')}", "'red-spot-ratio-qc-gate'")],
        ("'Không thấy tín hiệu điểm đỏ/gai nổi bật'", "qc_base * 0.62", "'red-spot-ratio-qc-gate'"),
    ),
}


def calibrated_labels(df: DataFrame) -> DataFrame:
    """All features of the calibrated rule set; poor quality leaves every label null."""
    df = derive(df, CALIBRATION_INPUTS)
    for name, (rules, default) in CALIBRATED_RULES.items():
        df = rule_cascade(df, name, rules, default, ACTIVE)
    return df


# Second rule set; confidence = base * (a + b * strength).
FEATURE_BASE = ("base", "case quality when 'good' then 0.88 when 'fair' then 0.68 else 0.32 end")
_blend = lambda a, b, strength: f"base * ({a} + {b} * {strength})"
FEATURE_RULES = {
    "k_shape": (
        [
            ("aspect >= 0.70 and mid >= 0.78 and area_fill >= 0.54", "'bản rộng/mập vừa (hình chiếu 2D)'", _blend(0.72, 0.28, clamp("0.62 + (aspect - 0.70) * 0.55 + (mid - 0.78) * 0.45")), "'broad'"),
            ("aspect > 0 and aspect <= 0.56 and mid > 0 and mid <= 0.68", "'hẹp/gầy theo hình chiếu 2D'", _blend(0.72, 0.28, clamp("0.62 + (0.56 - aspect) * 0.65 + (0.68 - mid) * 0.45")), "'narrow'"),
        ],
        ("'hình thể trung bình/không thấy mập-gầy rõ'", _blend(0.72, 0.28, "0.56"), "'typical'"),
    ),
    "k_toothmarks": (
        [
            ("edge >= 0.58 and tooth >= 0.62 and bilateral >= 0.34", "'Có tín hiệu dấu răng'", _blend(0.64, 0.36, "tooth"), "'present'"),
            ("edge >= 0.58 and tooth >= 0.46", "'Nghi dấu răng nhẹ'", _blend(0.64, 0.36, "(tooth * 0.88)"), "'suspected'"),
            ("edge >= 0.66 and tooth < 0.30", "'Không thấy dấu răng rõ'", _blend(0.64, 0.36, "0.66"), "'absent'"),
        ],
        (f"'{UNKNOWN}'", "null", "'unknown'"),
    ),
    "k_thickness": (
        [
            ("coat >= 0.40 and strict >= 0.18", "'dày'", _blend(0.68, 0.32, clamp("0.68 + (coat - 0.40) * 0.55")), "'thick'"),
            ("coat >= 0.10", "'mỏng'", _blend(0.68, 0.32, clamp("0.62 + (coat - 0.10) * 0.35")), "'thin'"),
            ("coat >= 0.05", "'rất mỏng'", _blend(0.68, 0.32, "0.58"), "'very-thin'"),
        ],
        (observed("thickness_candidate"), f"case when {observed('thickness_candidate')} <> '{UNKNOWN}' then {_blend(0.68, 0.32, '0.50')} end", f"case when {observed('thickness_candidate')} <> '{UNKNOWN}' then 'candidate' else 'unknown' end"),
    ),
    "k_texture": (
        [
            ("coat >= 0.10 and rough > 0 and rough <= 0.052", "'khá đều'", _blend(0.65, 0.35, clamp("0.64 + (0.052 - rough) * 3")), "'even'"),
            ("coat >= 0.10 and rough >= 0.075", "'thô/không đều'", _blend(0.65, 0.35, clamp("0.62 + (rough - 0.075) * 2.5")), "'rough'"),
        ],
        (f"'{UNKNOWN}'", "null", "'unknown'"),
    ),
    "k_body_color": ([("body_candidate in ('đỏ nhạt', 'đỏ', 'nhợt')", "body_candidate", "base * 0.86", "'normalized-body-color-candidate'")], (f"'{UNKNOWN}'", "null", "'unknown'")),
}
FULL_VIEW = "edge >= 0.65 and roi_height >= 0.30 and roi_width >= 0.20 and top_margin > 0.015 and bottom_margin > 0.015"


def feature_labels(df: DataFrame) -> DataFrame:
    """Second rule set plus the two visibility flags (true or unknown)."""
    df = derive(df, [FEATURE_BASE])
    for name, (rules, default) in FEATURE_RULES.items():
        df = rule_cascade(df, name, rules, default, ACTIVE)
    full = F.expr(num(f"({ACTIVE}) and {FULL_VIEW}"))
    return df.withColumns({"whole_visible": F.when(full, True), "root_visible": F.when(full & F.expr(num("root >= 0.42")), True)})


# --- moisture evidence ------------------------------------------------------


def region_definitions(r: str, reliability: str) -> list[tuple[str, str]]:
    """Strengths of one region from its columns <r>_gloss, _strict, _distributed, _rough,
    _pixels."""
    unit = clamp
    return [
        (f"{r}_shine", unit(f"{unit(f'{r}_gloss / 0.018')} * 0.50 + {unit(f'{r}_strict / 0.006')} * 0.25 + {unit(f'{r}_distributed / 0.65')} * 0.25")),
        (f"{r}_rd", unit(f"({r}_rough - 0.030) / 0.040")),
        (f"{r}_dryness", f"case when {r}_gloss <= 0.010 and {r}_rd >= 0.30 then {unit(f'(1 - {r}_shine) * 0.45 + {r}_rd * 0.55')} else 0.0 end"),
        (f"{r}_balance", f"case when {r}_gloss > 0.004 and {r}_gloss < 0.020 and {r}_rough < 0.060 then {unit(f'0.55 + (0.060 - {r}_rough) * 3')} else 0.0 end"),
        (f"{r}_wet", f"{r}_shine * (1 - flash_risk * 0.72)"),
        (f"{r}_dry", f"{r}_dryness * (1 - flash_risk * 0.35)"),
        (f"{r}_rel", reliability),
    ]


# Frame-level inputs of the moisture policy.
MOISTURE_INPUTS = [
    ("flash_risk", clamp(f"{clamp('overexposed / 0.045')} * 0.45 + {clamp('(gloss_largest - 0.62) / 0.38')} * 0.35 + {clamp('(surface_gloss - 0.060) / 0.080')} * 0.20")),
    ("reliability", clamp(f"(case when quality = 'good' then 0.92 else 0.68 end) * (0.55 + 0.25 * {clamp('coverage / 0.18')} + 0.20 * {clamp('surface_pixels / 900.0')}) * (1 - flash_risk * 0.62)")),
]


def moisture_rules(r: str) -> tuple[list, tuple]:
    blend = lambda s: f"least(0.82, {r}_rel * (0.55 + 0.45 * {s}))"
    rules = [
        (f"{r}_pixels < 80", f"'{UNKNOWN}'", "null", "'insufficient-region-pixels'"),
        ("flash_risk >= 0.62", f"'{UNKNOWN}'", "null", "'flash-or-specular-confounded'"),
        (f"{r}_rel < 0.48", f"'{UNKNOWN}'", "null", "'qc-insufficient'"),
        (f"{r}_wet >= 0.62", "'nhuận/ướt'", blend(f"{r}_wet"), "'distributed-specular-signal'"),
        (f"{r}_dry >= 0.64", "'khô'", blend(f"{r}_dry"), "'low-gloss-plus-roughness-signal'"),
        (f"{r}_balance >= 0.62 and {r}_wet < 0.58 and {r}_dry < 0.58", "'khô ướt vừa phải'", blend(f"{r}_balance"), "'intermediate-gloss-low-roughness-signal'"),
    ]
    return rules, (f"'{UNKNOWN}'", "null", "'evidence-below-gate'")


MOISTURE_REGIONS = {"surface": "reliability", "body": "reliability", "coating": "reliability * 0.92"}


def evidence_state(df: DataFrame) -> DataFrame:
    """Moisture state of three regions; the gates come first, poor quality is null."""
    df = derive(df, MOISTURE_INPUTS)
    for region, reliability in MOISTURE_REGIONS.items():
        rules, default = moisture_rules(region)
        df = rule_cascade(derive(df, region_definitions(region, reliability)), f"m_{region}", rules, default, ACTIVE)
    return df


# --- visibility and morphology ----------------------------------------------

# Gates that pass a value on or leave it unknown.
GATES = {
    "sulcus": "sulcus_signal and sulcus_score >= 0.62 and sulcus_continuity >= 0.22 and sulcus_centrality >= 0.35",
    "bilateral": "bilateral_signal and least(left_line, right_line) >= 0.05 and line_balance >= 0.30 and left_run >= 0.60 and right_run >= 0.60",
    "distribution": "greatest(coat, dark) >= 0.09 and distribution_candidate in ('trung tâm–sau', 'lan tỏa')",
    "thickness": "greatest(coat, dark) >= 0.07 and thickness_candidate in ('rất mỏng', 'mỏng', 'dày')",
}


def visibility_gates(df: DataFrame) -> DataFrame:
    gate = {k: F.expr(num(f"({ACTIVE}) and ({v})")) for k, v in GATES.items()}
    return df.withColumns(
        {
            "sulcus_status": F.when(gate["sulcus"], "visible-signal").otherwise("unknown"),
            "sulcus_confidence": F.when(gate["sulcus"], F.round(F.least(F.lit(0.78), F.col("sulcus_score")), 3)),
            "bilateral_visible": F.coalesce(gate["bilateral"], F.lit(False)),
            "coating_distribution": F.when(gate["distribution"], F.col("distribution_candidate")).otherwise(UNKNOWN),
            "coating_thickness_gate": F.when(gate["thickness"], F.col("thickness_candidate")).otherwise(""),
        }
    )


# Ramps (column, soft, hard) of the two shape scores.
BROAD_RAMPS = [("aspect", 0.64, 0.78), ("mid", 0.72, 0.84), ("area_fill", 0.48, 0.62), ("root", 0.58, 0.76), ("mean_width", 0.54, 0.72)]
NARROW_RAMPS = [("aspect", 0.64, 0.50), ("mid", 0.74, 0.60), ("area_fill", 0.50, 0.38), ("root", 0.64, 0.48), ("mean_width", 0.58, 0.44)]


def _ramp(column: str, soft: float, hard: float) -> str:
    if hard > soft:
        return f"(case when {column} <= {soft} then 0.0 else {clamp(f'({column} - {soft}) / {hard - soft!r}')} end)"
    return f"(case when {column} <= 0 or {column} >= {soft} then 0.0 else {clamp(f'({soft} - {column}) / {soft - hard!r}')} end)"


_mean = lambda ramps: "round((" + " + ".join(_ramp(*r) for r in ramps) + ") / 5.0, 3)"
SHAPE_INPUTS = [
    ("broad_score", _mean(BROAD_RAMPS)),
    ("narrow_score", _mean(NARROW_RAMPS)),
    ("stable", "edge >= 0.60 and roi_height >= case when anchored then 0.08 else 0.28 end and roi_width >= case when anchored then 0.12 else 0.18 end and top_margin > 0.012 and bottom_margin > 0.012 and center_deviation <= 0.14 and smoothness <= 0.22"),
]
SHAPE_RULES = [
    ("not stable", "'unknown'", "null", "'geometry-unstable'"),
    ("broad_score >= 0.58 and broad_score >= narrow_score + 0.18", "'broad'", "(case when quality = 'good' then 0.88 else 0.68 end) * (0.70 + 0.30 * broad_score)", "'broad-margin'"),
    ("narrow_score >= 0.58 and narrow_score >= broad_score + 0.18", "'narrow'", "(case when quality = 'good' then 0.88 else 0.68 end) * (0.70 + 0.30 * narrow_score)", "'narrow-margin'"),
]
SHAPE_DEFAULT = ("'typical'", "(case when quality = 'good' then 0.82 else 0.64 end) * (1 - least(0.35, abs(broad_score - narrow_score)))", "'no-margin'")


def dual_score_class(df: DataFrame, current: str = "current_shape") -> DataFrame:
    """Shape class from two averaged ramp scores and its agreement with the current one
    (broad, narrow, typical, unknown). ``anchored`` views, found by the mouth at a source
    height of 320 pixels or more, pass smaller size gates."""
    df = rule_cascade(derive(df, SHAPE_INPUTS), "shape_class", SHAPE_RULES, SHAPE_DEFAULT, ACTIVE)
    now, ref = F.col(current), F.coalesce(F.col("shape_class.label"), F.lit("unknown"))
    near = (now == "typical") | (ref == "typical")
    agreement = F.when((now == "unknown") | (ref == "unknown"), "insufficient").when(now == ref, "aligned").when(near, "partial").otherwise("conflict")
    return df.withColumn("shape_agreement", agreement)


# --- patterns ---------------------------------------------------------------

# Phrases that mean "not observed", and observation flags as
# (flag, column, pattern) on lower-cased text.
NOT_OBSERVED = "(không xác định|chưa đủ căn cứ|chưa xác nhận|chưa thấy rõ|không thấy|không có|unknown|not assessable|chưa thể)"
OBSERVATION_FLAGS = [
    ("white_coat", "coating_color", "trắng"), ("yellow_coat", "coating_color", "vàng"), ("dark_coat", "coating_color", "xám|đen|nâu đen"),
    ("thin_coat", "coating_thickness", "mỏng"), ("thick_coat", "coating_thickness", "dày"), ("greasy", "coating_texture", "nhầy|dính|bẩn|nhớt|nhờn|trơn|greasy"),
    ("purple_body", "body_color", "tím|ám tím|xanh tím"), ("any_red", "body_color", "đỏ"), ("pale_word", "body_color", r"(^|\s)(nhợt|trắng nhợt|trắng nhạt|nhạt trắng|trắng bệch)(\s|$)"),
    ("visible_stasis", "stasis", "ứ|ban|điểm"), ("fissured", "fissures", "nứt|confirmed|visible"),
    ("even_moisture", "moisture", r"khô\s*ướt\s*vừa\s*phải|vừa\s*phải|bình\s*thường"), ("dry_word", "moisture", "khô|thiên khô|táo"), ("moist_word", "moisture", "nhuận|ướt|ẩm"),
    ("toothed", "toothmarks", "hằn răng|dấu răng"), ("puffy", "shape", "mập|bệu|phì|to"), ("thin_body", "shape", "gầy|mỏng"), ("red_spots", "spots", "điểm đỏ|gai"),
    ("under_purple", "under_color", "tím|xanh tím|ám tím"), ("under_wide", "under_dilation", "giãn|phình|căng"),
]
LIGHT_RED = "đỏ nhạt|hồng nhạt"
OBSERVATION_COMBINATIONS = [
    ("pale", "not light_red and pale_word"), ("strong_red", "any_red and not light_red and not pale"),
    ("dry", "not even_moisture and dry_word"), ("moist", "even_moisture or moist_word"),
]
_if = lambda c, v: f"(case when {c} then {v} else 0.0 end)"
# Every rule that holds emits (label, condition, score, may raise a warning).
PATTERN_RULES = [
    ("'Thiệt tượng gần bình thường / chưa nghiêng rõ thể bệnh'", "light_red and white_coat and thin_coat", f"0.76 + {_if('moist', 0.06)}", False),
    ("'Tín hiệu biểu / hàn nhẹ cần đối chiếu thêm'", "white_coat and thin_coat and not strong_red", "case when light_red then 0.50 when pale then 0.58 else 0.46 end", False),
    ("'Tín hiệu tân dịch bề mặt còn tương đối bảo tồn'", "moist and thin_coat and not dry", "0.60", False),
    ("'Rêu trắng dày nhuận — cần đối chiếu thấp/hàn-thấp'", "white_coat and thick_coat and moist", "0.64", False),
    ("'Nền chất lưỡi còn đỏ nhạt, chưa có bằng chứng nhợt'", "light_red and thick_coat", "0.72", False),
    ("'Hình thể bản rộng/mập cần đối chiếu riêng'", "puffy and not pale", "0.56", False),
    ("'Rêu dày nhưng chưa đủ dấu nhầy/dính'", "white_coat and thick_coat and not greasy", "0.58", False),
    ("'Tín hiệu hư hàn'", "pale and white_coat", f"0.66 + {_if('moist', 0.06)} + {_if('toothed', 0.08)} + {_if('puffy', 0.06)}", True),
    ("'Tín hiệu khí huyết bất túc'", "pale and thin_body", "0.70", True),
    ("'Tín hiệu Tỳ khí/Tỳ dương hư kèm thấp'", "(toothed or puffy) and pale", f"0.66 + {_if('moist', 0.06)} + {_if('thick_coat', 0.06)}", True),
    ("case when yellow_coat then 'Tín hiệu thấp nhiệt / đàm nhiệt cần đối chiếu' else 'Tín hiệu thấp trọc / đàm hoặc tích trệ' end", "thick_coat or greasy", f"0.58 + {_if('thick_coat and greasy', 0.10)} + {_if('yellow_coat', 0.07)} + {_if('dark_coat', 0.03)}", True),
    ("'Rêu xám/đen nhuận — cần đối chiếu hàn-thấp/đàm thấp'", "dark_coat and moist and not dry", "0.64", False),
    ("'Rêu xám/đen khô — cần đối chiếu nhiệt thương tân'", "dark_coat and dry and not (moist and not dry)", "0.66", False),
    ("'Tín hiệu nhiệt / thực nhiệt'", "strong_red and yellow_coat", f"0.70 + {_if('dry', 0.07)} + {_if('red_spots', 0.05)} + {_if('thick_coat', 0.04)}", True),
    ("'Tín hiệu âm dịch hao tổn / nhiệt thương tân'", "strong_red and fissured and dry", f"0.74 + {_if('thin_coat', 0.04)}", True),
    ("'Tín hiệu khí huyết ứ trệ'", "purple_body or visible_stasis", f"0.68 + {_if('purple_body and visible_stasis', 0.08)}", True),
    ("case when under_wide then 'Tín hiệu mạch dưới lưỡi ứ trệ cần đối chiếu' else 'Mạch dưới lưỡi tím/xanh tím — tín hiệu đối chiếu' end", "under_purple", "case when under_wide then 0.74 else 0.60 end", True),
]
MAX_PATTERNS = 8


def observation_flags(df: DataFrame) -> DataFrame:
    """Boolean flags from observation texts; a not-observed phrase never asserts."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    seen = lambda c: (low(c) != "") & ~low(c).rlike(NOT_OBSERVED)
    flags = {name: seen(c) & low(c).rlike(pattern) for name, c, pattern in OBSERVATION_FLAGS}
    flags["light_red"] = low("body_color").rlike(LIGHT_RED)
    return derive(df.withColumns(flags), OBSERVATION_COMBINATIONS)


def emit_patterns(df: DataFrame, key: str, rules: list = PATTERN_RULES, k: int = MAX_PATTERNS, by_score: bool = True) -> DataFrame:
    """All satisfied rules of a row as (key, label, score, warning, rank), best first or
    in rule order, at most k. Rules are an array in the row, ranked in the row: no shuffle."""
    first = (lambda s, i: -F.expr(num(s)).cast("double")) if by_score else (lambda s, i: F.lit(float(i)))
    emitted = [
        F.when(F.expr(num(c)), F.struct(first(s, i).alias("sort"), F.lit(i).alias("ord"), F.expr(num(s)).cast("double").alias("score"), F.expr(label).alias("label"), F.lit(w).alias("warning")))
        for i, (label, c, s, w) in enumerate(rules)
    ]
    ranked = F.slice(F.array_sort(F.array_compact(F.array(*emitted))), 1, k)
    rows = df.select(key, F.posexplode(ranked).alias("pos", "p"))
    return rows.select(key, "p.label", F.round("p.score", 6).alias("score"), "p.warning", (F.col("pos") + 1).alias("rank"))


# Fusion weights, limits and caps.
LAYER_WEIGHTS = (0.70, 0.20, 0.10)
FINAL_WEIGHTS = (0.45, 0.35, 0.20)
QUALITY_CAPS = {"good": 0.88, "fair": 0.62}
POOR_CAP, MAX_LIFT, MAX_CANDIDATES = 0.25, 0.08, 6


def fuse_candidates(direct: DataFrame, reasoning: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Per item and label the weighted score of direct (key, label, score, ord), reasoning and
    atlas support (items.atlas), lifted at most 0.08 above the direct score. Accepted:
    direct >= 0.72, or direct >= 0.50 with two layers; the best six per item, ties in the
    order of the direct rows (``ord``)."""
    d = direct.groupBy(key, "label").agg(F.max("score").alias("d"), F.min("ord").alias("ord"))
    r = reasoning.groupBy(key, "label").agg(F.max("score").alias("r"))
    both = d.join(r, [key, "label"], "full_outer").join(items.select(key, "atlas"), key)
    ds, gp = F.coalesce("d", F.lit(0.0)), F.coalesce("r", "d")
    support = F.when(F.col("atlas") >= 0.72, 0.82).when(F.col("atlas") >= 0.60, 0.64).when(F.col("atlas") >= 0.50, 0.48).otherwise(0.25)
    layers = (ds >= 0.50).cast("int") + (support >= 0.55).cast("int") + (gp >= 0.55).cast("int")
    weighted = F.least(F.lit(1.0), LAYER_WEIGHTS[0] * ds + LAYER_WEIGHTS[1] * gp + LAYER_WEIGHTS[2] * support)
    score = F.when(ds > 0, F.least(ds + MAX_LIFT, weighted)).otherwise(weighted)
    rated = both.select(key, "label", "ord", F.round(score, 3).alias("score"), layers.alias("layers"), ((ds >= 0.72) | ((ds >= 0.50) & (layers >= 2))).alias("ok"))
    return top_k(rated.filter("ok").drop("ok"), [key], [F.desc("score"), F.asc_nulls_last("ord"), F.asc("label")], MAX_CANDIDATES)


def fuse_layers(direct: DataFrame, reasoning: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Final confidence and agreement per item (items: key, confidence, atlas, quality,
    reasoning_first)."""
    academic = fuse_candidates(direct, reasoning, items, key).groupBy(key).agg(F.avg("score").alias("a"), F.count("*").alias("candidates"))
    joined = items.join(academic, key, "left")
    acad = F.coalesce("a", F.col("reasoning_first"), F.lit(0.35))
    cap = F.when(F.col("quality") == "good", QUALITY_CAPS["good"]).when(F.col("quality") == "fair", QUALITY_CAPS["fair"]).otherwise(POOR_CAP)
    c, t = F.col("confidence"), F.col("atlas")
    weighted = FINAL_WEIGHTS[0] * c + FINAL_WEIGHTS[1] * t + FINAL_WEIGHTS[2] * acad
    votes = (c >= 0.52).cast("int") + (t >= 0.58).cast("int") + (acad >= 0.52).cast("int")
    agreement = F.when((c >= 0.60) & (t >= 0.68) & (acad >= 0.60), "strong").when(votes >= 2, "moderate").otherwise("weak")
    final = F.greatest(F.lit(0.0), F.least(cap, c + MAX_LIFT, weighted))
    return joined.select(key, F.coalesce("candidates", F.lit(0)).alias("candidates"), F.round(final, 3).alias("confidence"), agreement.alias("agreement"))


# --- claims and reports -----------------------------------------------------

# Folded words of a claim and of its support.
CLAIM_WORDS = {
    "puffy": ["map", "beu", "phu to", "phong to", "cang to", "to map"], "thin": ["gay", "mong", "thon", "teo"],
    "definition": ["cang", "day", "chat day khoang", "lap day khoang", "phu", "sung"], "tooth": ["han rang", "dau rang", "an rang"],
    "tooth_negative": ["khong thay", "chua thay"], "mouth": ["khoang mieng", "day khoang", "lap day"],
}
CLAIM_TEXTS = {
    "puffy-supported": "Nghi mập/bệu theo tiêu chí tài liệu; cần đối chiếu thêm độ dày/thể tích thực",
    "puffy-candidate": "Rộng/mập tương đối; chưa đủ tiêu chí để kết luận mập/bệu",
    "wide-geometry-only": "Rộng tương đối theo hình học ảnh; chưa đủ tiêu chí để kết luận mập/bệu",
    "narrow-geometry-only": "Thon/hẹp tương đối theo ảnh 2D; chưa đủ tiêu chí để kết luận gầy/mỏng",
}


def ground_claim(df: DataFrame, shape: str, features: str) -> DataFrame:
    """Downgrades a shape claim to what its evidence supports: grounded text, class and
    the list of limitation codes. Uses known_scale, mouth_reference, color_reliability."""
    text = X.fold_text(F.concat_ws(" ", shape, features))
    has = {k: text.rlike("|".join(w)) for k, w in CLAIM_WORDS.items()}
    tooth = has["tooth"] & ~has["tooth_negative"]
    mouth = F.coalesce("mouth_reference", F.lit(False)) | has["mouth"]
    scale = F.coalesce("known_scale", F.lit(False))
    kind = (
        F.when(has["puffy"] & has["definition"] & mouth, "puffy-supported").when(has["puffy"] & (has["definition"] | tooth), "puffy-candidate")
        .when(has["puffy"], "wide-geometry-only").when(has["thin"], "narrow-geometry-only").otherwise("descriptive-only")
    )
    limits = F.array_compact(F.array(
        F.when(has["puffy"], "volume-needs-thickness"), F.when(~has["puffy"] & has["thin"], "thickness-not-measured"),
        F.when(~scale, "no-absolute-scale"), F.when(F.col("color_reliability") == "poor", "color-unreliable"),
    ))
    staged = df.withColumns({"classification": kind, "limitations": limits, "confidence_policy": F.when(scale, "calibrated-relative").otherwise("relative-2d")})
    wording = F.coalesce(*[F.when(F.col("classification") == k, v) for k, v in CLAIM_TEXTS.items()], F.nullif(F.trim(F.coalesce(F.col(shape), F.lit(""))), F.lit("")), F.lit(UNKNOWN))
    return staged.withColumn("grounded", wording)


def report_rows(df: DataFrame, key: str, sections: list[tuple[str, list[tuple[str, str]], int]]) -> DataFrame:
    """Section rows (title, [(label, column)], cap): blank and unknown values are left
    out, items are distinct ignoring case and capped per section."""
    value = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    built = []
    for number, (title, fields, cap) in enumerate(sections, 1):
        items = [F.when((value(c) != "") & ~value(c).rlike("(?iu)không xác định|unknown"), F.concat(F.lit(f"{label}: "), value(c))) for label, c in fields]
        built.append(F.struct(F.lit(number).alias("section"), F.lit(title).alias("title"), X.distinct_ci(F.array_compact(F.array(*items)), cap).alias("items")))
    rows = df.select(key, F.explode(F.array(*built)).alias("s")).select(key, "s.section", "s.title", F.posexplode("s.items").alias("item_no", "item"))
    return rows.withColumn("item_no", F.col("item_no") + 1)


# --- further shipped rule sets ----------------------------------------------

# Toothmark reference classes (needs the calibration inputs and
# color_left / color_right).
TOOTH_INPUTS = [("color_support", "greatest(tooth_color, least(color_left, color_right) * 0.9)")]
TOOTH_RULES = [
    ("edge >= 0.60 and tooth >= 0.60 and side_max >= 2 and (side_min >= 1 or color_support >= 0.45)", "'present'", "0.90 * (0.72 + 0.18 * tooth + 0.10 * greatest(bilateral, color_support))", "'strong-contour'"),
    ("edge >= 0.58 and tooth >= 0.44 and events_total >= 2 and (bilateral >= 0.24 or color_support >= 0.30)", "'suspected'", "(case when quality = 'good' then 0.74 else 0.60 end) * (0.72 + 0.18 * tooth + 0.10 * color_support)", "'moderate-contour'"),
    ("quality = 'good' and edge >= 0.68 and tooth < 0.24 and events_total = 0 and color_support < 0.18", "'absent'", "0.72", "'negative-contour'"),
]
TOOTH_DEFAULT = ("'unknown'", "null", "'below-gates'")


def toothmark_class(df: DataFrame, current: str = "current_toothmarks") -> DataFrame:
    """Reference class of the toothmarks and its agreement with the current one."""
    df = rule_cascade(derive(df, CALIBRATION_INPUTS + TOOTH_INPUTS), "tooth_class", TOOTH_RULES, TOOTH_DEFAULT, ACTIVE)
    now, ref = F.col(current), F.coalesce(F.col("tooth_class.label"), F.lit("unknown"))
    agreement = F.when((now == "unknown") | (ref == "unknown"), "insufficient").when(now == ref, "aligned").when(now.isin("present", "suspected") & ref.isin("present", "suspected"), "partial").otherwise("conflict")
    return df.withColumn("tooth_agreement", agreement)


_ratio = lambda *rules: ([(c, f"'{label}'", "null", "'ratio'") for c, label in rules[:-1]], (f"'{rules[-1]}'", "null", "'ratio'"))
# Labels by plain ratio thresholds (mean_r, mean_g, mean_s, mean_v, bbox,
# glare, stasis_ratio, vessel dark and spot ratios, light_ok).
RATIO_RULES = {
    "r_color": _ratio(("purple > 0.13 or stasis_ratio > 0.07", "Tím/ám tím"), ("mean_v < 0.53 and mean_r > mean_g * 1.12", "Đỏ sẫm"), ("mean_r > mean_g * 1.25 and mean_s > 0.34", "Đỏ"), ("mean_s < 0.20 and mean_v > 0.60", "Nhợt/nhạt"), "Đỏ nhạt/hồng"),
    "r_coating": _ratio(("yellow > 0.075 and yellow > white * 0.55", "Vàng"), ("white > 0.10", "Trắng"), "Không thấy màu rêu nổi bật"),
    "r_thickness": _ratio(("greatest(white, yellow) > 0.34", "Dày"), ("greatest(white, yellow) > 0.15", "Mỏng"), "Rất mỏng/khó tách"),
    "r_texture": _ratio(("greatest(white, yellow) > 0.22 and glare > 0.025", "Khá nhuận/ẩm"), ("greatest(white, yellow) > 0.22", "Tương đối đồng nhất"), "Khó đánh giá chắc"),
    "r_moisture": _ratio(("glare > 0.035", "Nhuận/ẩm"), ("glare < 0.008 and light_ok", "Thiên khô tương đối"), "Trung bình/khó xác định"),
    "r_shape": _ratio(("bbox > 0.88", "Khá rộng/bệu"), ("bbox < 0.52", "Khá thon"), "Trung bình"),
    "r_fissures": _ratio(("dark > 0.045", "Có rãnh/nứt nhìn thấy"), ("dark > 0.020", "Có thể có rãnh nứt nhẹ"), "Không thấy nứt nổi bật"),
    "r_toothmarks": _ratio(("bbox > 0.78 and coverage > 0.10 and dark > 0.028", "Bờ lưỡi không đều, cần đối chiếu dấu răng"), "Chưa thấy dấu răng nổi bật"),
    "r_spots": _ratio(("spot > 0.055", "Có điểm đỏ/gai nổi bật"), ("spot > 0.025", "Có một số điểm đỏ"), "Không thấy nổi bật"),
    "r_stasis": _ratio(("stasis_ratio > 0.055", "Có vùng tím/sẫm cần đối chiếu"), "Không thấy ban/điểm ứ nổi bật"),
}


def ratio_labels(df: DataFrame) -> DataFrame:
    for name, (rules, default) in RATIO_RULES.items():
        df = rule_cascade(df, name, rules, default)
    return df


# Fall-back patterns over the joined observation texts; confidences stay
# at or below 0.62, at most four, in rule order.
FALLBACK_FLAGS = [
    ("f_red", "top_text", "đỏ|đo\u0309"), ("f_pale", "top_text", "nhợt|nhạt"), ("f_yellow", "top_text", "vàng"), ("f_white", "top_text", "trắng"), ("f_dry", "top_text", "khô"),
    ("f_little", "top_text", "rất mỏng|ít rêu|khó tách|tróc|mất rêu|không thấy màu rêu nổi bật"), ("f_thick", "top_text", "dày|nhầy|dính|bẩn"), ("f_purple", "top_text", "tím|ám tím|ứ"),
    ("f_tooth", "top_text", "dấu răng|hằn răng"), ("f_broad", "top_text", "bệu|rộng"), ("f_under", "under_text", "tím|xanh tím|giãn|ứ"),
]
FALLBACK_RULES = [
    ("'Tham Vấn: âm dịch/hư nhiệt cần đối chiếu'", "f_red and f_dry and f_little", "0.56", True), ("'Tham Vấn: tín hiệu nhiệt cần đối chiếu'", "f_red and f_yellow", "0.58", True),
    ("'Tham Vấn: tín hiệu hư/hàn cần đối chiếu'", "f_pale and f_white", "0.55", True), ("'Tham Vấn: Tỳ khí/Tỳ dương hư cần đối chiếu'", "f_pale and (f_tooth or f_broad)", "0.54", True),
    ("'Tham Vấn: khí huyết ứ trệ cần đối chiếu'", "f_purple", "0.56", True), ("'Tham Vấn: thấp trọc/đàm hoặc tích trệ cần đối chiếu'", "f_thick", "0.53", True),
    ("'Tham Vấn: mạch dưới lưỡi cần đối chiếu ứ trệ'", "f_under", "0.54", True),
]
FALLBACK_LIMIT = 4


FALLBACK_DEFAULT = ("'Tham Vấn: nguyên tắc đọc thiệt tượng'", "0.42")


def fallback_patterns(df: DataFrame, key: str) -> DataFrame:
    """Fall-back rules over top_text and under_text, the first four in rule order; the
    reading principle where none holds. Both spellings of the red word count."""
    flags = {n: F.lower(F.coalesce(F.col(c), F.lit(""))).rlike(p) for n, c, p in FALLBACK_FLAGS}
    none = " and ".join(f"not ({c})" for _, c, _, _ in FALLBACK_RULES)
    return emit_patterns(df.withColumns(flags), key, [*FALLBACK_RULES, (FALLBACK_DEFAULT[0], none, FALLBACK_DEFAULT[1], True)], FALLBACK_LIMIT, by_score=False)
