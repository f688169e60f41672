"""R, D, S: record normalization, de-duplication, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import hashing as H, text as X
from groundwork.operators import dedup as D, records as R
from groundwork.operators.joins import spread
from groundwork.plans import ansi as A
from groundwork.plans.base import query, table
from groundwork.plans.text_plans import SENTENCES_SQL
from groundwork.session import materialize


def raw_documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "source", "text")


def records(spark, sf):
    """Normalized records of every document, rejected ones flagged ``empty``."""
    return R.normalize_records(spread(raw_documents(spark, sf), "ord"))


def clean_records(spark, sf):
    """The kept records, written once: every later step reads them back."""
    return R.drop_short(materialize(records(spark, sf), "records"))


def accepted(spark, sf):
    recs = clean_records(spark, sf)
    return D.accepted_records(recs, D.dedup_verdicts(recs))


# --- R: normalization -------------------------------------------------------

_CONV = f"""conv as (select conv_id,
    coalesce(string_agg(case when role = 'user' then c end, chr(10) order by turn), '') as user_text,
    coalesce(string_agg(case when role = 'assistant' then c end, chr(10) order by turn), '') as assistant_text,
    count(*) as n_turns
  from (select conv_id, turn, role, {A.clean('text')} as c from conversations where role in ('user', 'assistant'))
  where c <> '' group by conv_id)"""


@query(
    "r01_normalize_records",
    f"""with {_CONV}, shaped as (
      select 'd' as kind, doc_id as ord, 'text' as task, {A.clean('text')} as case_text, '' as target from documents
      union all select 'b', item_id, 'qa', {A.clean('text')}, '' from benchmark
      union all select 'c', conv_id, 'conversation', {A.clean('user_text')}, {A.clean('assistant_text')} from conv)
    select kind, ord, cast(ord as varchar) as source_record_id, task, case_text, target,
      sha256(canonical) as content_sha256, (case_text = '' and target = '') or length(canonical) < 40 as empty
    from (select *, lower(trim(regexp_replace(task || ' ' || case_text || ' ' || target, ' +', ' ', 'g'))) as canonical from shaped)""",
)
def r01(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("ord"), "text")
    items = table(spark, sf, "benchmark").select(F.lit("b").alias("kind"), F.col("item_id").alias("ord"), F.col("text").alias("question"))
    turns = table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant"))
    talks = (
        turns.groupBy(F.col("conv_id").alias("ord"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
        .withColumn("kind", F.lit("c"))
    )
    raw = docs.unionByName(items, allowMissingColumns=True).unionByName(talks, allowMissingColumns=True)
    raw = raw.withColumn("source", F.col("kind"))
    out = R.normalize_records(raw)
    return out.select(F.col("source").alias("kind"), "ord", "source_record_id", "task", "case_text", "target", "content_sha256", "empty")


@query("r02_fold_conversations", f"with {_CONV} select conv_id, user_text, assistant_text, n_turns from conv")
def r02(spark, sf):
    return R.fold_conversations(table(spark, sf, "conversations"))


@query("r03_drop_short", f"with {A.DOCS} select doc_id, cast(canon_len as bigint) as canon_len from docs")
def r03(spark, sf):
    kept = R.drop_short(records(spark, sf))
    return kept.select(F.col("ord").alias("doc_id"), F.col("canon_len").cast("bigint").alias("canon_len"))


@query("r04_content_hash", f"with {A.DOCS} select doc_id, content_sha256 from docs")
def r04(spark, sf):
    return R.drop_short(records(spark, sf)).select(F.col("ord").alias("doc_id"), "content_sha256")


_LICENSES = ["CC-BY-4.0", "CC0-1.0", "CC-BY-NC-4.0", "", "MIT"]
_REGISTRY_SQL = """registry as (select source, 'provider ' || source as provider, 'set ' || source as dataset,
    ['CC-BY-4.0', 'CC0-1.0', 'CC-BY-NC-4.0', '', 'MIT'][1 + cast(substr(source, 4) as int) % 5] as license,
    case when cast(substr(source, 4) as int) % 2 = 0 then 'published' else 'community' end as trust_tier,
    cast(substr(source, 4) as int) % 7 = 0 as clinical_gold
  from (select distinct source from documents))"""


def source_registry(spark, sf):
    """A registry derived from the sources that occur in the documents."""
    number = F.substring("source", 4, 10).cast("int")
    licenses = F.array(*[F.lit(x) for x in _LICENSES])
    return (
        table(spark, sf, "documents").select("source").distinct()
        .select(
            "source",
            F.concat(F.lit("provider "), "source").alias("provider"),
            F.concat(F.lit("set "), "source").alias("dataset"),
            F.get(licenses, number % 5).alias("license"),
            F.when(number % 2 == 0, "published").otherwise("community").alias("trust_tier"),
            (number % 7 == 0).alias("clinical_gold"),
        )
    )


@query(
    "r05_attach_provenance",
    f"""with {_REGISTRY_SQL} select doc_id, provider, dataset, trust_tier, clinical_gold,
      coalesce(nullif(own, ''), nullif(r.license, ''), '') as license,
      coalesce(nullif(own, ''), nullif(r.license, ''), '') <> '' as rights_verified,
      pmid, cast(null as varchar) as pmcid, doi, source_url
    from (select doc_id, source, case when lang = 'de' then 'CC-BY-3.0' else '' end as own, case when doc_id % 3 = 0 then 'P' || doc_id end as pmid, case when doc_id % 4 = 1 then '10.1/' || doc_id end as doi,
      case when doc_id % 5 = 0 then 'https://' || source || '/' || doc_id end as source_url from documents) d
    left join registry r on r.source = d.source""",
)
def r05(spark, sf):
    own = lambda number, rest, *parts: F.when(F.col("doc_id") % number == rest, F.concat(*parts, F.col("doc_id").cast("string"))).otherwise("")
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", F.when(F.col("lang") == "de", "CC-BY-3.0").otherwise("").alias("license"), own(3, 0, F.lit("P")).alias("pmid"), own(4, 1, F.lit("10.1/")).alias("doi"),
        own(5, 0, F.lit("https://"), F.col("source"), F.lit("/")).alias("source_url"),
    )
    out = R.attach_provenance(docs, source_registry(spark, sf))
    return out.select("doc_id", "provenance.*")


@query(
    "r06_license_allowlist",
    f"""with {_REGISTRY_SQL} select doc_id, license from (select doc_id, r.license, r.trust_tier from documents d join registry r on r.source = d.source)
    where trust_tier <> 'published' or license in ('CC0-1.0', 'CC-BY-3.0', 'CC-BY-4.0', 'CC-BY-SA-3.0', 'CC-BY-SA-4.0')""",
)
def r06(spark, sf):
    from groundwork.functions.dictionaries import LICENSE_ALLOWLIST

    registry = source_registry(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", "source")
    licensed = R.attach_provenance(docs, registry).select("doc_id", "source", F.col("provenance.license").alias("license"))
    allow = F.array(*[F.lit(x) for x in LICENSE_ALLOWLIST])
    rules = registry.select("source", F.when(F.col("trust_tier") == "published", allow).alias("license_allowlist"))
    return R.license_allowlist(licensed, rules).select("doc_id", "license")


# --- D: de-duplication ------------------------------------------------------


@query("d01_exact_dedup", f"with {A.DOCS} select min(doc_id) as doc_id, content_sha256 from docs group by content_sha256")
def d01(spark, sf):
    recs = R.drop_short(records(spark, sf)).select("ord", "content_sha256")
    return D.exact_dedup(recs, "content_sha256", "ord").select(F.col("ord").alias("doc_id"), "content_sha256")


def reps(spark, sf):
    return D.representatives(clean_records(spark, sf))


@query("d02_simhash", f"with recursive {A.SIMHASH} select ord as doc_id, lpad(lower(to_hex(simhash)), 16, '0') as simhash64 from sims")
def d02(spark, sf):
    return reps(spark, sf).select(F.col("ord").alias("doc_id"), H.hex64(F.col("simhash")).alias("simhash64"))


@query(
    "d03_hamming",
    f"""with {A.SIMHASH} select ord as doc_id,
    cast(bit_count(cast(xor(simhash, {A.hexnum('content_sha256', 16)}) as bit)) as bigint) as distance from sims""",
)
def d03(spark, sf):
    d = H.hamming(F.col("simhash"), H.head_long(F.col("content_sha256")))
    return reps(spark, sf).select(F.col("ord").alias("doc_id"), d.cast("bigint").alias("distance"))


@query("d04_band_candidates", f"with {A.EDGES} select src, dst, distance from edges")
def d04(spark, sf):
    classes = materialize(D.similarity_classes(reps(spark, sf)), "classes")
    return D.near_pairs(classes).select("src", "dst", F.col("distance").cast("bigint").alias("distance"))


def verdicts(spark, sf):
    return D.dedup_verdicts(clean_records(spark, sf))


@query("d05_near_dup_greedy", f"with recursive {A.VERDICTS} select ord as doc_id, near, copies from verdicts")
def d05(spark, sf):
    return verdicts(spark, sf).select(F.col("ord").alias("doc_id"), "near", "copies")


_SENTENCE_DOCS = f"""docs as materialized (select doc_id * 100000 + pos as doc_id, sha256(canonical) as content_sha256, length(canonical) as canon_len, canonical from (
      select doc_id, unnest(range(1, len(s) + 1)) as pos, lower(unnest(s)) as canonical from (select doc_id, {SENTENCES_SQL} as s from documents)))"""


def sentence_records(spark, sf):
    """Every sentence of every document as a record: near pairs occur among them."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "s"))
    canonical = F.lower("s")
    return rows.select((F.col("doc_id") * 100000 + F.col("pos") + 1).alias("ord"), F.sha2(canonical, 256).alias("content_sha256"), F.length(canonical).alias("canon_len"), canonical.alias("canonical"))


@query("d04_sentence_pairs", f"with {A.EDGES.replace(A.DOCS, _SENTENCE_DOCS)} select src, dst, distance from edges")
def d04_sentences(spark, sf):
    classes = materialize(D.similarity_classes(D.representatives(sentence_records(spark, sf))), "classes")
    return D.near_pairs(classes).select("src", "dst", F.col("distance").cast("bigint").alias("distance"))


@query("d05_sentence_near", f"with recursive {A.VERDICTS.replace(A.DOCS, _SENTENCE_DOCS)} select ord, near, copies from verdicts")
def d05_sentences(spark, sf):
    return D.dedup_verdicts(sentence_records(spark, sf)).select("ord", "near", "copies")


@query(
    "d07_sentence_stats",
    f"""with recursive {A.VERDICTS.replace(A.DOCS, _SENTENCE_DOCS)} select count(*) filter (where not near) as accepted,
      cast(coalesce(sum(copies - 1) filter (where not near), 0) as bigint) as exact_duplicate,
      cast(coalesce(sum(copies) filter (where near), 0) as bigint) as near_duplicate, 0::bigint as empty from verdicts""",
)
def d07_sentences(spark, sf):
    recs = materialize(sentence_records(spark, sf).withColumn("empty", F.lit(False)), "records")
    return D.ingest_stats(recs, D.dedup_verdicts(recs))


@query(
    "d06_cap_accepted",
    f"""with recursive {A.VERDICTS}, cut as (select case when count(*) = 200 then max(ord) else 9223372036854775807 end as cut
      from (select ord from verdicts where not near order by ord limit 200))
    select source, count(*) as rows_seen from docs, cut where doc_id <= cut group by source""",
)
def d06(spark, sf):
    recs = clean_records(spark, sf)
    seen = D.cap_accepted(recs, D.dedup_verdicts(recs), 200)
    return seen.groupBy("source").agg(F.count("*").alias("rows_seen"))


@query(
    "d07_ingest_stats",
    f"""with recursive {A.VERDICTS} select count(*) filter (where not near) as accepted,
      cast(coalesce(sum(copies - 1) filter (where not near), 0) as bigint) as exact_duplicate,
      cast(coalesce(sum(copies) filter (where near), 0) as bigint) as near_duplicate,
      (select count(*) from documents) - (select count(*) from docs) as empty from verdicts""",
)
def d07(spark, sf):
    recs = materialize(records(spark, sf), "records")
    return D.ingest_stats(recs, D.dedup_verdicts(R.drop_short(recs)))


_MERGE_SQL = f"""with {_CONV}, offered as (
    select 0 as input_ord, doc_id as ord, source, 'text' as task, {A.clean('text')} as case_text, '' as target from documents
    union all select 1, conv_id, 'chat', 'conversation', {A.clean('user_text')}, {A.clean('assistant_text')} from conv
    union all select 2, item_id, 'benchmark', 'text', {A.clean('text')}, '' from benchmark),
  hashed as (select *, sha256(lower(trim(regexp_replace(task || ' ' || case_text || ' ' || target, ' +', ' ', 'g')))) as h
    from offered where case_text <> ''),
  ranked as (select *, row_number() over (partition by h order by input_ord, ord) as rn from hashed)"""


def merge_inputs(spark, sf):
    docs = records(spark, sf).select("ord", "source", "task", "case_text", "target", "content_sha256")
    folded = R.fold_conversations(table(spark, sf, "conversations"))
    chat = R.with_canonical(
        folded.select(
            F.col("conv_id").alias("ord"), F.lit("chat").alias("source"), F.lit("conversation").alias("task"),
            X.squeeze(F.col("user_text")).alias("case_text"), X.squeeze(F.col("assistant_text")).alias("target"),
        )
    )
    items = R.normalize_records(table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), F.lit("benchmark").alias("source"), "text"))
    return [f.select(docs.columns) for f in (docs, chat, items)]


@query(
    "d08_merge_sources",
    _MERGE_SQL + """ select source, task, count(*) filter (where rn = 1) as records, count(*) filter (where rn > 1) as skipped
    from ranked group by source, task""",
)
def d08(spark, sf):
    return D.merge_sources(merge_inputs(spark, sf))[1]




_SIG_SQL = f"""{A.DOCS},
  toks as materialized (select doc_id as ord, canon_len, source, content_sha256, {A.words('canonical')} as w from docs),
  {', '.join(f'''g{n} as (select ord, {A.hexnum('sha256(g)', 16)} as h from (select ord, unnest(case when len(w) < {n} then w else
     list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) end) as g from toks)),
  v{n} as (select ord, count(*) as n, {A._VOTES} from g{n} group by ord),
  h{n} as (select ord, lpad(lower(to_hex({A._BITS})), 16, '0') as x from v{n})''' for n in (1, 2, 3, 4))},
  sigs as materialized (select t.ord, t.source, t.content_sha256, cast(floor(canon_len / 500) as bigint) as bin, h1.x || h2.x || h3.x || h4.x as sig
    from toks t join h1 on h1.ord = t.ord join h2 on h2.ord = t.ord join h3 on h3.ord = t.ord join h4 on h4.ord = t.ord),
  uniq as materialized (select bin, sig, min(ord) as ord from sigs group by bin, sig),
  near as (select a.ord as src, b.ord as dst from uniq a join uniq b on a.bin = b.bin and a.ord < b.ord
    and bit_count(cast(xor({A.hexnum('substr(a.sig, 1, 16)', 16)}, {A.hexnum('substr(b.sig, 1, 16)', 16)}) as bit))
      + bit_count(cast(xor({A.hexnum('substr(a.sig, 17, 16)', 16)}, {A.hexnum('substr(b.sig, 17, 16)', 16)}) as bit))
      + bit_count(cast(xor({A.hexnum('substr(a.sig, 33, 16)', 16)}, {A.hexnum('substr(b.sig, 33, 16)', 16)}) as bit))
      + bit_count(cast(xor({A.hexnum('substr(a.sig, 49, 16)', 16)}, {A.hexnum('substr(b.sig, 49, 16)', 16)}) as bit)) <= 8
    union all select u.ord, s.ord from sigs s join uniq u on u.bin = s.bin and u.sig = s.sig where u.ord <> s.ord)"""


def signatures(spark, sf):
    """256-bit signatures: SimHash over word n-grams of size 1 to 4."""
    recs = materialize(
        R.drop_short(records(spark, sf)).select("ord", "source", "content_sha256", "canonical", F.floor(F.col("canon_len") / 500).alias("bin")), "records"
    )
    keys = ["ord", "source", "content_sha256", "bin"]
    out = D.simhash_widths(recs, keys, "canonical", [1, 2, 3, 4])
    return materialize(out.select(*keys, F.concat(*[H.hex64(F.col(f"h{n}")) for n in (1, 2, 3, 4)]).alias("sig")), "signatures")


_FLIP = "substr({s}, 1, {p}) || lower(to_hex({d})) || substr({s}, {p} + 2, 64)"
_ORDER_SIGS = f"""o as (select o_orderkey as ord, o_orderstatus as bin, sha256(cast(o_custkey as varchar)) as h from orders),
  o1 as (select ord, bin, {_FLIP.format(s='h', p='(ord % 64)', d='ord % 16')} as h from o),
  osig as materialized (select ord, bin, {_FLIP.format(s='h', p='((ord // 64) % 64)', d='(ord // 16) % 16')} as sig from o1)"""


def order_signatures(spark, sf):
    """A signature per order: the digest of its customer with two digits set by its key, so
    orders of one customer lie at distances on both sides of the limit."""
    flip = lambda s, p, d: F.concat(F.substring(s, F.lit(1), p), F.lower(F.hex(d)), F.substring(s, p + 2, F.lit(64)))
    key = F.col("o_orderkey")
    small = lambda c: c.cast("int")
    rows = table(spark, sf, "orders").withColumn("sig", F.sha2(F.col("o_custkey").cast("string"), 256))
    rows = rows.withColumn("sig", flip(F.col("sig"), small(key % 64), key % 16))
    rows = rows.withColumn("sig", flip(F.col("sig"), small(F.floor(key / 64) % 64), F.floor(key / 16) % 16))
    return rows.select(key.alias("ord"), F.col("o_orderstatus").alias("bin"), "sig")


_DISTANCE = " + ".join(f"bit_count(cast(xor({A.hexnum(f'substr(a.sig, {k}, 16)', 16)}, {A.hexnum(f'substr(b.sig, {k}, 16)', 16)}) as bit))" for k in (1, 17, 33, 49))


@query(
    "d09_order_signatures",
    f"""with {_ORDER_SIGS}, u as materialized (select bin, sig, min(ord) as ord from osig group by bin, sig),
    p as (select a.ord as src, b.ord as dst, {_DISTANCE} as distance from u a join u b on a.bin = b.bin and a.ord < b.ord)
    select src, dst, cast(distance as bigint) as distance from p where distance <= 8
    union all select u.ord, s.ord, 0 from osig s join u using (bin, sig) where u.ord <> s.ord""",
)
def d09_orders(spark, sf):
    found = D.signature_pairs(materialize(order_signatures(spark, sf), "signatures"), "sig", "bin", "ord")
    return found.select("src", "dst", F.col("distance").cast("bigint").alias("distance"))


@query("d09_signature_pairs", f"with {_SIG_SQL} select src, dst from near")
def d09(spark, sf):
    return D.signature_pairs(signatures(spark, sf), "sig", "bin", "ord").select("src", "dst")


def groups(spark, sf):
    sigs = signatures(spark, sf)
    sigs = sigs.withColumn("page", F.concat_ws(":", "source", "bin", F.substring("content_sha256", 1, 1)))
    near = D.signature_pairs(sigs, "sig", "bin", "ord")
    edges = [D.star_edges(sigs, "content_sha256", "ord"), D.star_edges(sigs, "page", "ord"), near]
    return D.equivalence_groups(sigs, edges), near


_GROUPS_SQL = f"""with recursive {_SIG_SQL},
  pages_ as (select ord, source || ':' || bin || ':' || substr(content_sha256, 1, 1) as page, content_sha256 from sigs),
  links as materialized (
    select src, dst from near union select min(ord) over (partition by content_sha256), ord from pages_
    union select min(ord) over (partition by page), ord from pages_),
  both_ways as materialized (select src, dst from links where src <> dst union select dst, src from links where src <> dst),
  reach as (select ord as node, ord as seen from sigs union select r.node, b.dst from reach r join both_ways b on b.src = r.seen),
  comps as materialized (select node as ord, min(seen) as component from reach group by node),
  named as materialized (select ord, component, 'g' || printf('%04d', dense_rank() over (order by component) - 1) as group_id from comps)"""


@query("d10_equivalence_groups", _GROUPS_SQL + " select ord as doc_id, component, group_id from named")
def d10(spark, sf):
    return groups(spark, sf)[0].select(F.col("ord").alias("doc_id"), "component", "group_id")


@query(
    "d11_duplicate_report",
    _GROUPS_SQL + """ select n.src, n.dst, a.group_id as src_group, a.group_id = b.group_id as same_group
    from near n left join named a on a.ord = n.src left join named b on b.ord = n.dst""",
)
def d11(spark, sf):
    grouped, near = groups(spark, sf)
    return D.duplicate_report(materialize(grouped, "named"), near)
