"""Raw records in several shapes to one canonical corpus record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundwork.functions import hashing as H, text as X

SCHEMA_VERSION = "case-record-v1"
MIN_CANONICAL = 40
# Role names of the two conversation sides.
USER_ROLES = ["user", "human", "patient", "prompt"]
ASSISTANT_ROLES = ["assistant", "gpt", "doctor", "response"]


def _optional(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.col(name)


def _side(turns: Column, fields: list[str], roles: list[str]) -> Column:
    """Texts of the turns of one side, one per line."""
    role = [f for f in ("role", "from", "speaker") if f in fields]
    body = [f for f in ("content", "value", "text", "message") if f in fields]
    pick = lambda t, names: F.coalesce(*[t[n] for n in names], F.lit(""))
    chosen = F.filter(turns, lambda t: F.lower(pick(t, role)).isin(roles))
    return F.array_join(F.transform(chosen, lambda t: pick(t, body)), "\n")


def normalize_records(raw: DataFrame, order: str = "ord") -> DataFrame:
    """Cleaned ``task, case_text, target, source_record_id`` for every raw row, in the
    priority case context > instruction > question > turns > plain text. ``order``
    is the input order and the last fallback for the record id."""
    c = lambda name: _optional(raw, name)
    filled = lambda name: F.coalesce(c(name), F.lit("")) != ""
    turn_fields, turns = [], F.lit(None)
    for name in ("messages", "conversations"):
        if name in raw.columns:
            turn_fields = raw.schema[name].dataType.elementType.names
            turns = F.col(name)
            break
    has_turns = F.coalesce(F.size(turns) > 0, F.lit(False)) if turn_fields else F.lit(False)
    user = _side(turns, turn_fields, USER_ROLES) if turn_fields else F.lit("")
    assistant = _side(turns, turn_fields, ASSISTANT_ROLES) if turn_fields else F.lit("")

    normal = F.coalesce(c("schemaVersion") == SCHEMA_VERSION, F.lit(False))
    case = filled("case_context") | filled("intervention") | filled("outcome")
    sft = c("instruction").isNotNull() | c("input").isNotNull() | c("output").isNotNull()
    qa = c("question").isNotNull() | c("answer").isNotNull()
    task = F.when(normal, c("task")).when(case, "case_reasoning").when(sft, "sft").when(qa, "qa").when(has_turns, "conversation").otherwise("text")
    case_lines = F.concat_ws(
        "\n",
        F.nullif(c("case_context"), F.lit("")),
        F.when(filled("intervention"), F.concat(F.lit("Intervention: "), c("intervention"))),
        F.when(filled("outcome"), F.concat(F.lit("Outcome: "), c("outcome"))),
    )
    case_text = (
        F.when(normal, c("caseText")).when(case, case_lines).when(sft, F.concat_ws("\n", c("instruction"), c("input")))
        .when(qa, c("question")).when(has_turns, user).otherwise(F.coalesce(c("text"), c("case"), c("prompt"), F.lit("")))
    )
    target = (
        F.when(normal, c("target")).when(case, c("reasoning_use")).when(sft, c("output")).when(qa, c("answer"))
        .when(has_turns, assistant).otherwise(F.coalesce(c("response"), c("completion"), F.lit("")))
    )
    record_id = F.coalesce(*[c(n).cast("string") for n in ("source_record_id", "id", "pmcid", "pmid", "uuid")], F.col(order).cast("string"))
    has_id = any(n in raw.columns for n in ("source_record_id", "id", "pmcid", "pmid", "uuid"))
    has_target = bool(turn_fields) or any(n in raw.columns for n in ("target", "reasoning_use", "output", "answer", "response", "completion"))
    keep = [n for n in ("source", "license", "pmid", "pmcid", "doi", "source_url") if n in raw.columns]
    shaped = raw.select(order, *keep, task.alias("task"), case_text.alias("_case"), target.alias("_target"), record_id.alias("_id"))
    raw_text = ["_case"] + (["_target"] if has_target else []) + (["_id"] if has_id else [])
    cleaned = X.nfkc_columns(shaped, *raw_text).select(
        order, *keep, "task",
        X.clean_text(F.col("_case")).alias("case_text"),
        (X.clean_text(F.col("_target")) if has_target else F.lit("")).alias("target"),
        (F.coalesce(F.nullif(X.clean_text(F.col("_id")), F.lit("")), F.col(order).cast("string")) if has_id else F.col(order).cast("string")).alias("source_record_id"),
    )
    return with_canonical(cleaned)


def with_canonical(records: DataFrame) -> DataFrame:
    """Adds the canonical text, its length, hash and the ``empty`` rejection flag."""
    canonical = F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", "task", "case_text", "target"), "  +", " ")))
    both_empty = (F.col("case_text") == "") & (F.col("target") == "")
    return (
        records.withColumn("canonical", canonical)
        .withColumn("canon_len", X.utf16_length(F.col("canonical")))
        .withColumn("content_sha256", H.sha256(F.col("canonical")))
        .withColumn("empty", both_empty | (F.col("canon_len") < MIN_CANONICAL))
    )


def drop_short(records: DataFrame) -> DataFrame:
    return records.filter(~F.col("empty"))


def fold_conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: the texts of each side in turn order. Roles outside
    the two sides are dropped before the shuffle; the result is by definition one
    value per conversation."""
    sides = (
        X.nfkc_columns(turns, text).withColumn("_side", F.when(F.lower(role).isin(USER_ROLES), "u").when(F.lower(role).isin(ASSISTANT_ROLES), "a"))
        .filter("_side is not null")
        .withColumn("_text", X.clean_text(F.col(text)))
        .filter("_text <> ''")
    )
    ordered = lambda side: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_side") == side, F.struct(order, "_text")))), lambda s: s["_text"]), "\n"
    )
    return sides.groupBy(key).agg(ordered("u").alias("user_text"), ordered("a").alias("assistant_text"), F.count("*").alias("n_turns"))


def attach_provenance(records: DataFrame, registry: DataFrame, source: str = "source") -> DataFrame:
    """Registry columns provider, dataset, license, trust_tier, clinical_gold joined by
    source, beside the record's own pmid, pmcid, doi and source_url (else the registry's
    dataset_card). A record's own license wins; rights are verified when either is present."""
    own = F.nullif(_optional(records, "license"), F.lit(""))
    reg = registry.withColumnRenamed("license", "_source_license")
    base = records.withColumn("_own", own).drop("license")
    lic = F.coalesce("_own", F.nullif(F.col("_source_license"), F.lit("")), F.lit(""))
    return base.join(reg, source, "left").select(
        *[x for x in base.columns if x != "_own"],
        F.struct(
            F.coalesce("provider", F.lit("")).alias("provider"),
            F.coalesce("dataset", F.lit("")).alias("dataset"),
            lic.alias("license"),
            "trust_tier",
            F.coalesce("clinical_gold", F.lit(False)).alias("clinical_gold"),
            (lic != "").alias("rights_verified"),
            *[F.nullif(_optional(records, c), F.lit("")).alias(c) for c in ("pmid", "pmcid", "doi")],
            F.coalesce(F.nullif(_optional(records, "source_url"), F.lit("")), _optional(registry, "dataset_card")).alias("source_url"),
        ).alias("provenance"),
    )


def license_allowlist(records: DataFrame, registry: DataFrame, source: str = "source", license: str = "license") -> DataFrame:
    """Keep records whose license is allow-listed for their source. ``registry`` has
    one row per source with ``license_allowlist``; a null list accepts everything."""
    rules = registry.select(source, "license_allowlist")
    joined = records.join(rules, source)
    allowed = F.col("license_allowlist").isNull() | F.array_contains("license_allowlist", F.col(license))
    return joined.filter(allowed).drop("license_allowlist")
