"""T: text projections and typed predicates over documents, events, orders, customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import hashing as H, jsonpred as J, text as X
from groundwork.functions.dictionaries import CONCEPTS, DEVICE_CLASSES
from groundwork.operators.joins import spread
from groundwork.plans import ansi as A
from groundwork.plans.base import query, table

# The symptom dictionary plus three function-word concepts that occur in the test texts.
TEXT_CONCEPTS = {**CONCEPTS, "english": [r"(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])"], "french": ["ement"], "german": ["keit", "ung"]}


@query("t01_clean_text", f"select doc_id, {A.clean('text')} as clean from documents")
def t01(spark, sf):
    return X.nfkc_columns(spread(table(spark, sf, "documents"), "doc_id"), "text").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query(
    "t02_fold_text",
    f"""select doc_id, {A.fold('text')} as folded, {A.fold('text', dstroke=False)} as folded_corpus,
    strip_accents(lower(text)) as folded_topic from documents""",
)
def t02(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        X.fold_text(text).alias("folded"),
        X.fold_text(text, dstroke=False).alias("folded_corpus"),
        X.strip_accents(text).alias("folded_topic"),
    )


@query(
    "t03_token_set",
    f"""select doc_id, cast(len(t) as bigint) as n_tokens, array_to_string(list_sort(t), ' ') as tokens
    from (select doc_id, {A.tokens('text')} as t from documents)""",
)
def t03(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", X.token_array(F.col("text")).alias("t"))
        .select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join(F.array_sort("t"), " ").alias("tokens"))
    )


SHINGLES_SQL = """case when len(w) < 3 then w else
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end"""


@query(
    "t04_word_shingles",
    f"""select doc_id, cast(len(s) as bigint) as n_shingles, md5(array_to_string(s, '|')) as shingle_md5
    from (select doc_id, {SHINGLES_SQL} as s from (select doc_id, {A.words(A.clean('text'))} as w from documents))""",
)
def t04(spark, sf):
    return (
        X.nfkc_columns(spread(table(spark, sf, "documents"), "doc_id"), "text")
        .select("doc_id", X.shingles(X.clean_text(F.col("text"))).alias("s"))
        .select("doc_id", F.size("s").cast("bigint").alias("n_shingles"), F.md5(F.array_join("s", "|")).alias("shingle_md5"))
    )


@query("t05_truncate_text", f"select doc_id, {A.truncate('text', 120)} as short from documents")
def t05(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate_text(F.col("text"), 120).alias("short"))


SENTENCES_SQL = rf"""list_filter(list_transform(
  string_split_regex(regexp_replace(text, '([.!?;:]){A.WS}+', '\1' || chr(10), 'g'), '\n+'),
  lambda s: {A.squeeze('s')}), lambda s: length(s) between 18 and 520)"""


@query(
    "t06_split_sentences",
    f"""select doc_id, cast(i as bigint) as pos, s[i] as sentence
    from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, {SENTENCES_SQL} as s from documents))""",
)
def t06(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
        .select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "sentence")
    )


@query(
    "t07_distinct_ci",
    f"""select doc_id, string_agg(w, ' ' order by first_pos) as kept from (
      select doc_id, first_pos, w, row_number() over (partition by doc_id order by first_pos) as rn from (
        select doc_id, lower(w) as k, min(i) as first_pos, arg_min(w, i) as w
        from (select doc_id, w[i] as w, i from (select doc_id, w, unnest(range(1, len(w) + 1)) as i
              from (select doc_id, string_split({A.squeeze('text')}, ' ') as w from documents)))
        where w <> '' group by doc_id, lower(w)))
    where rn <= 12 group by doc_id""",
)
def t07(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", X.distinct_ci(F.split(X.squeeze(F.col("text")), " "), 12).alias("kept"))
        .filter(F.size("kept") > 0)
        .select("doc_id", F.array_join("kept", " ").alias("kept"))
    )


@query(
    "t08_asserted",
    f"""select lang, count(*) as n_docs, count(*) filter (where ok) as n_asserted from (
      select lang, case when f = '' or regexp_matches(f, '({X.UNKNOWN_PHRASES}|worthless)') then false
        else regexp_matches(f, '(tion|ung|cion)') end as ok
      from (select lang, {A.fold('text')} as f from documents)) group by lang""",
)
def t08(spark, sf):
    ok = X.asserted(F.col("text"), "(tion|ung|cion)", unknown=X.UNKNOWN_PHRASES + "|worthless")
    return (
        table(spark, sf, "documents")
        .groupBy("lang")
        .agg(F.count("*").alias("n_docs"), F.count_if(ok).alias("n_asserted"))
    )


@query(
    "t09_bounded_number",
    """select event_id, least(100.0::double, greatest(1.0::double, value)) as value_bounded,
    least(50::bigint, greatest(5::bigint, cast(nullif(trim(json_extract_string(props, '$.k')), '') as bigint))) as k_bounded,
    cast(null as double) as blank_bounded from events""",
)
def t09(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        J.bounded_number(F.col("value"), 1, 100).alias("value_bounded"),
        J.bounded_number(F.get_json_object("props", "$.k"), 5, 50, "bigint").alias("k_bounded"),
        J.bounded_number(F.substring("event_type", 1, 0), 0, 1).alias("blank_bounded"),
    )


@query(
    "t10_sane_record",
    """select event_id, value, case when k between 10 and 90 then k end as optional_k,
    case when event_type in ('click', 'view') then event_type else '' end as kind,
    least(20, greatest(0, cast(floor(value / 10 + 0.5) as bigint))) as events_count
    from (select *, cast(json_extract_string(props, '$.k') as double) as k from events)
    where value >= 0.5 and value <= 120 and k >= 0 and k <= 95""",
)
def t10(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    record = J.sane_record(
        {"value": (F.col("value"), 0.5, 120), "k": (k, 0, 95)},
        {"optional_k": (F.when(k.between(10, 90), k), 10, 90)},
        {"kind": (F.col("event_type"), ["click", "view"])},
        {"events_count": (F.col("value") / 10, 0, 20)},
    )
    return (
        table(spark, sf, "events")
        .select("event_id", record.alias("r"))
        .filter("r is not null")
        .select("event_id", "r.value", "r.optional_k", "r.kind", "r.events_count")
    )


@query(
    "t11_json_is",
    """select event_type, count(*) as n, count(*) filter (where json_type(props) = 'OBJECT') as n_object,
    count(*) filter (where json_type(props, '$.k') in ('UBIGINT', 'BIGINT', 'DOUBLE')) as n_number,
    count(*) filter (where coalesce(json_type(props, '$.k') = 'BOOLEAN', false)) as n_boolean,
    count(*) filter (where json_type(props, '$.missing') is null) as n_missing
    from events group by event_type""",
)
def t11(spark, sf):
    v = F.col("v")
    return (
        table(spark, sf, "events")
        .select("event_type", F.try_parse_json("props").alias("v"))
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n"),
            F.count_if(J.json_is(v, "$", "object")).alias("n_object"),
            F.count_if(J.json_is(v, "$.k", "number")).alias("n_number"),
            F.count_if(J.json_is(v, "$.k", "boolean")).alias("n_boolean"),
            F.count_if(J.json_kind(v, "$.missing").isNull()).alias("n_missing"),
        )
    )


def _sql_pattern(p: str) -> str:
    """RE2 has no look-around; the only look-arounds used are ASCII word edges."""
    edge = r"[^A-Za-z0-9_]"
    p = p.replace(r"(?<![A-Za-z0-9_])", rf"(?:^|{edge})").replace(r"(?![A-Za-z0-9_])", rf"(?:$|{edge})")
    return p.replace("'", "''")


def concepts_sql(column: str, concepts: dict) -> str:
    parts = [f"case when regexp_matches({column}, '(?i){'|'.join('(?:' + _sql_pattern(p) + ')' for p in ps)}') then '{k}' end" for k, ps in concepts.items()]
    return f"list_filter([{', '.join(parts)}], lambda c: c is not null)"


@query(
    "t12_concept_flags",
    f"""select doc_id, array_to_string(c, ',') as concepts, cast(len(c) as bigint) as n_concepts
    from (select doc_id, {concepts_sql('text', TEXT_CONCEPTS)} as c from documents)""",
)
def t12(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", X.matched_ids(F.col("text"), TEXT_CONCEPTS).alias("c"))
        .select("doc_id", F.array_join("c", ",").alias("concepts"), F.size("c").cast("bigint").alias("n_concepts"))
    )


@query(
    "t13_hash_key",
    """select c_custkey, sha256(concat_ws(':', 'normal', c_name, c_mktsegment)) as composite,
    sha256('segment|' || c_mktsegment || '|' || c_custkey) as prefixed from customer""",
)
def t13(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        H.hash_key("normal", F.col("c_name"), F.col("c_mktsegment"), sep=":").alias("composite"),
        H.hash_key("segment", F.col("c_mktsegment"), F.col("c_custkey")).alias("prefixed"),
    )


@query(
    "t14_hex_bucket",
    f"""select b100, b256, count(*) as n from (
      select cast({A.hexnum('h', 8)} % 100 as bigint) as b100, cast({A.hexnum('h', 2)} as bigint) as b256
      from (select sha256(cast(o_orderkey as varchar)) as h from orders)) group by b100, b256""",
)
def t14(spark, sf):
    h = H.sha256(F.col("o_orderkey").cast("string"))
    return (
        table(spark, sf, "orders")
        .select(H.hex_bucket(h, 8, 100).alias("b100"), H.hex_bucket(h, 2).alias("b256"))
        .groupBy("b100", "b256")
        .agg(F.count("*").alias("n"))
    )


def device_class(agent):
    out = None
    for pattern, label in DEVICE_CLASSES:
        hit = agent.rlike(f"(?i){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("other")


def hardware_tier(cores, memory, network):
    """Score 1, one step down for small or slow, one step up for large."""
    step = lambda v: F.when(v <= 4, -1).when(v >= 8, 1).otherwise(0)
    score = 1 + F.coalesce(step(cores), F.lit(0)) + F.coalesce(step(memory), F.lit(0)) + F.when(network.isin("save-data", "slow"), -1).otherwise(0)
    return F.when(score <= 0, "constrained").when(score >= 3, "high").otherwise("balanced")


_AGENTS = {"click": "Linux; Android 14", "view": "iPhone OS 17", "purchase": "Windows NT 10.0", "signup": "Macintosh; Mac OS X", "error": "X11; Linux x86_64"}


@query(
    "t15_device_class",
    """select device, tier, count(*) as n from (
      select case event_type when 'click' then 'android' when 'view' then 'ios' when 'purchase' then 'windows'
          when 'signup' then 'macos' when 'error' then 'linux' else 'other' end as device,
        case when s <= 0 then 'constrained' when s >= 3 then 'high' else 'balanced' end as tier
      from (select event_type, 1 + (case when user_id % 16 <= 4 then -1 when user_id % 16 >= 8 then 1 else 0 end)
          + (case when event_id % 12 <= 4 then -1 when event_id % 12 >= 8 then 1 else 0 end)
          + (case when value < 5 then -1 else 0 end) as s from events)) group by device, tier""",
)
def t15(spark, sf):
    events = table(spark, sf, "events")
    agent = F.create_map(*[F.lit(x) for kv in _AGENTS.items() for x in kv])[F.col("event_type")]
    network = F.when(F.col("value") < 5, "slow").otherwise("normal")
    return (
        events.select(
            device_class(F.coalesce(agent, F.lit(""))).alias("device"),
            hardware_tier(F.col("user_id") % 16, F.col("event_id") % 12, network).alias("tier"),
        )
        .groupBy("device", "tier")
        .agg(F.count("*").alias("n"))
    )
