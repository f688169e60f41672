"""Registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundwork.llm import align, bpe, decontam, html_extract, langid, lines, manifest, mixing, ngram_join, quality, secrets, sharding, urls
from groundwork.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: How DuckDB spells the blanks, the words and A-Z lower-casing of the contracts.
_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


_LINES_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(raw, {_BLANKS})")} AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE common.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common USING (key) GROUP BY doc_id
"""


@_query("op1_line_dedup", _LINES_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS component_id
FROM w LEFT JOIN c USING (doc_id)
"""


@_query("op2_ngram_join", _NEAR_SQL)
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(table(spark, sf_dir, "documents"), width=5, percent=80)


@_query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


@_query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


#: Fixed values of the contract: verdict and rule.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@_query("op5_url_filter")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@_query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  substr(md5('mix:' || doc_id), 1, 15) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM s),
f AS (SELECT *, cap / weight AS full_at, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS others FROM w),
v AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - capped) / others AS level FROM f),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, full_at) FROM v WHERE level <= full_at)) AS target FROM v),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
p AS (SELECT d.*, source_size, target, budget // greatest(source_size, 1) AS epochs, budget - (budget // greatest(source_size, 1)) * source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""


@_query("op8_mix_sources", _MIX_SQL)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"), share=1.5, weights=(5, 2, 1), max_epochs=2)


@_query("op9_shard")
def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = sharding.sharded(docs, sharding.shard_plan(docs, shards=24), ["doc_id"])
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@_query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@_query("op11_bpe_codec")
def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path).withColumn("ids_sha256", F.sha2("ids", 256))
    return bpe.decode(encoded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


@_query("op12_tokenizer_align")
def op12_tokenizer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    digest = lambda groups: F.when(groups != "", F.sha2(groups, 256)).otherwise(F.lit(""))
    return align.align(table(spark, sf_dir, "documents"), *paths, show=digest).withColumnRenamed("groups", "groups_sha256")


def _merkle_levels(name: str, source: str) -> str:
    """All levels of the trees over the digest lists of ``source`` (grp, ds)."""
    pairs = "list_transform(range(0, len(ds), 2), lambda i: sha256(ds[i + 1] || coalesce(ds[i + 2], '')))"
    return f"{name} AS (SELECT grp, 0 AS lev, ds FROM {source} UNION ALL SELECT grp, lev + 1, {pairs} FROM {name} WHERE len(ds) > 1)"


#: Siblings are kept as (side, digest) per level; DuckDB has no CRC-32, so its table is a
#: list of 256 values that each come from eight steps of the polynomial.
_MERKLE_SQL = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
f AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit FROM documents, crc),
v AS (SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
  coalesce(strlen(text) || ':' || text, '-') AS tail, hit FROM f),
h AS (SELECT doc_id, lang AS grp, sha256(head || n || tail) AS leaf, sha256(head || CASE WHEN hit THEN more ELSE n END || tail) AS shown FROM v),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS slot FROM h),
g AS (SELECT grp, list(leaf ORDER BY slot) AS ds FROM p GROUP BY grp),
{_merkle_levels("t", "g")},
s AS (SELECT grp, ds[1] AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS rk FROM t WHERE len(ds) = 1),
u AS (SELECT 0 AS grp, list(subroot ORDER BY rk) AS ds FROM s),
{_merkle_levels("w", "u")},
way AS (SELECT doc_id, lev, (slot >> lev::BIGINT) AS own, ds FROM p JOIN t ON p.grp IS NOT DISTINCT FROM t.grp WHERE len(ds) > 1
  UNION ALL SELECT doc_id, 1000 + lev, (rk >> lev::BIGINT), ds FROM p JOIN s ON p.grp IS NOT DISTINCT FROM s.grp, w WHERE len(ds) > 1),
steps AS (SELECT doc_id, list(struct_pack(side := own % 2, sib := coalesce(ds[xor(own, 1) + 1], '')) ORDER BY lev) AS st FROM way GROUP BY doc_id),
o AS (SELECT doc_id, grp, leaf, shown, coalesce(st, []) AS st FROM p LEFT JOIN steps USING (doc_id)),
folds AS (SELECT doc_id, 1 AS k, shown AS d, st FROM o UNION ALL
  SELECT doc_id, k + 1, sha256(CASE WHEN st[k].side = 1 THEN st[k].sib || d ELSE d || st[k].sib END), st FROM folds WHERE k <= len(st)),
e AS (SELECT doc_id, d AS folded_root FROM folds WHERE k = len(st) + 1),
r AS (SELECT ds[1] AS root FROM w WHERE len(ds) = 1)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(st, lambda x: x.sib), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM o JOIN s ON o.grp IS NOT DISTINCT FROM s.grp JOIN e USING (doc_id), r
"""


@_query("op13_merkle_manifest", _MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest.manifest(manifest.tampered_documents(table(spark, sf_dir, "documents")))
    return out.withColumn("proof_sha256", manifest.proof_digest()).drop("way")
