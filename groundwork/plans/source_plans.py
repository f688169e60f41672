"""S: readers and writers, exercised on files that Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from groundwork.operators import dedup as D
from groundwork.plans import ansi as A
from groundwork.plans.base import query, table
from groundwork.plans.corpus_plans import _REGISTRY_SQL, clean_records, source_registry
from groundwork.session import scratch_dir
from groundwork.sources import readers as S, writers as O

_DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _folder(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


_GROUP = 200


def mixed_records(spark, sf):
    """A folder of record files of three shapes, 200 documents to a file: an array, an object
    with ``records``, and lines of which the first is damaged."""
    path = _folder(spark, "records")
    group = F.floor(F.col("doc_id") / _GROUP)
    lines = _docs(spark, sf).groupBy(group.alias("g")).agg(F.array_sort(F.collect_list(F.to_json(F.struct("doc_id", "text", "lang")))).alias("l"))
    shape = F.col("g") % 3
    content = (
        F.when(shape == 0, F.concat(F.lit("[\n"), F.array_join("l", ",\n"), F.lit("\n]")))
        .when(shape == 1, F.concat(F.lit('{"made": "today", "records": [\n'), F.array_join("l", ",\n"), F.lit("\n]}")))
        .otherwise(F.concat(F.lit('{"doc_id": 1, "text": "cut off"\n'), F.array_join("l", "\n")))
    )
    lines.select(content.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return S.read_records(spark, path, _DOC_SCHEMA)


@query("s01_read_records", "select doc_id, lang, sha256(text) as digest from documents")
def s01(spark, sf):
    return mixed_records(spark, sf).filter("_corrupt_record is null").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))


@query("s01_damaged_lines", f"""select '{{"doc_id": 1, "text": "cut off"' as line, count(distinct doc_id // {_GROUP}) as n from documents where (doc_id // {_GROUP}) % 3 = 2 having count(*) > 0""")
def s01_damaged(spark, sf):
    return mixed_records(spark, sf).filter("_corrupt_record is not null").groupBy(F.col("_corrupt_record").alias("line")).agg(F.count("*").alias("n"))


@query("s02_read_jsonl_strict", "select lang <> 'es' as good, count(*) as n from documents group by 1")
def s02(spark, sf):
    path = _folder(spark, "lines")
    line = F.to_json(F.struct("doc_id", "text", "lang"))
    _docs(spark, sf).select(F.when(F.col("lang") == "es", F.concat(line, F.lit("{"))).otherwise(line).alias("value")).repartition(4, "value").write.text(path)
    good, bad = S.read_jsonl_strict(spark, path)
    return good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count("*").alias("n"))


@query("s03_read_many", "select case when lang = 'en' then 0 else 1 end as input_ord, doc_id, sha256(text) as digest from documents")
def s03(spark, sf):
    first, second = _folder(spark, "plain"), _folder(spark, "gz")
    docs = _docs(spark, sf)
    docs.filter("lang = 'en'").write.json(first)
    docs.filter("lang <> 'en'").write.option("compression", "gzip").json(second)
    return S.read_many(spark, [first, second], _DOC_SCHEMA).select("input_ord", "doc_id", F.sha2("text", 256).alias("digest"))


@query(
    "s04_verify_inputs",
    """with f as (select source, string_agg(doc_id, chr(10) order by doc_id) || chr(10) as content from documents group by source),
    n as (select content, cast(substr(source, 4) as int) % 5 as k from f)
    select case when k = 4 then 'unpinned' when k = 3 then 'mismatch' else 'ok' end as state, count(*) as n, cast(sum(strlen(content)) as bigint) as bytes, min(sha256(content)) as least from n group by 1
    union all select 'missing', 1, null, null""",
)
def s04(spark, sf):
    """A file per source with its document ids. Pins come from the rows, not from the files:
    one source in five is not pinned, one has another pin, and one pin has no file."""
    path = _folder(spark, "pinned")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), "\n")
    files = table(spark, sf, "documents").groupBy("source").agg(ids.alias("value"))
    files.write.partitionBy("source").text(path)
    names = spark.read.text(path).select("source", F.concat(F.lit("source="), "source", F.lit("/"), "_metadata.file_name").alias("name")).distinct()
    k = F.substring("source", 4, 9).cast("int") % 5
    digest = F.sha2(F.concat("value", F.lit("\n")), 256)
    pins = files.filter(k != 4).select("source", F.when(k == 3, F.sha2("source", 256)).otherwise(F.upper(digest)).alias("sha256")).join(names, "source").select("name", "sha256")
    absent = spark.range(1).select(F.lit("absent.txt").alias("name"), F.lit("0").alias("sha256"))
    states = S.verify_inputs(spark, path, pins.union(absent), "*.txt")
    return states.groupBy("state").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min("actual").alias("least"))


@query("s05_source_registry", f"with {_REGISTRY_SQL} select doc_id, license, trust_tier, clinical_gold from documents join registry using (source) where source <> 'src9'")
def s05(spark, sf):
    registry = source_registry(spark, sf).filter("source <> 'src9'")
    known, _ = S.with_source(table(spark, sf, "documents").select("doc_id", "source"), registry)
    return known.select("doc_id", "license", "trust_tier", "clinical_gold")


def digest_sql(table: str, columns: list[tuple[str, str]]) -> str:
    """Rows, xor and sum of the row digests of a table with (column, type)."""
    def text(c, t):
        six = lambda x: f"cast(cast(cast({x} as double) as decimal(38, 6)) as varchar)"
        value = six(c) if t == "double" else f"cast(epoch_us({c}) as varchar)" if t == "timestamp" else f"'[' || array_to_string(list_transform({c}, lambda x: {six('x')}), ',') || ']'" if t == "floats" else f"cast({c} as varchar)"
        return f"coalesce({value}, '-')"

    row = " || '|' || ".join(text(c, t) for c, t in columns)
    return f"""select count(*) as n, cast(coalesce(bit_xor(h), 0) as varchar) as xor_hash, cast(coalesce(sum(cast(h as hugeint)), 0) as varchar) as sum_hash
      from (select cast('0x' || substr(sha256({row}), 1, 15) as bigint) as h from {table})"""


_WHOLE = lambda name: f"(select sha256(n || ':' || xor_hash || ':' || sum_hash) from {name})"


@query(
    "s06_write_corpus",
    f"""with recursive {A.VERDICTS}, stored as (select d.doc_id as ord, d.source, 'text' as task, d.clean as case_text, '' as target, d.content_sha256 from verdicts v join docs d on d.doc_id = v.ord where not near),
    din as ({digest_sql("documents", [(c, "") for c in ("doc_id", "text", "lang", "source", "n_chars")])}),
    dout as ({digest_sql("stored", [(c, "") for c in ("ord", "source", "task", "case_text", "target", "content_sha256")])})
    select (select count(*) from documents) as offered, count(*) filter (where not near) as accepted, count(*) filter (where not near) as written,
    cast(coalesce(sum(copies - 1) filter (where not near), 0) as bigint) as exact_duplicate, 'documents' as source_id, {_WHOLE('din')} as input_sha256, {_WHOLE('dout')} as output_sha256 from verdicts""",
)
def s06(spark, sf):
    recs = clean_records(spark, sf)
    verdicts = D.dedup_verdicts(recs)
    docs = table(spark, sf, "documents")
    stats = D.ingest_stats(recs, verdicts).withColumn("offered", docs.agg(F.count("*")).scalar())
    path = _folder(spark, "corpus")
    kept = D.accepted_records(recs, verdicts).select("ord", "source", "task", "case_text", "target", "content_sha256")
    state = O.write_corpus(kept, stats, path, source_id="documents", inputs=docs.select("doc_id", "text", "lang", "source", "n_chars"))
    written = spark.read.text(f"{path}/records").agg(F.count("*")).scalar()
    return state.select("offered", "accepted", written.alias("written"), "exact_duplicate", "source_id", "input_sha256", "output_sha256")


@query(
    "s07_export_samples",
    """select o_orderdate, o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '","split":"' || o_orderstatus || '"}' as sample
    from (select * from orders where o_orderstatus = 'F' order by o_orderdate, o_orderkey limit 9999)""",
)
def s07(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("split"), "o_orderdate")
    out = O.export_samples(rows, 9999, ["o_orderdate", "o_orderkey"], "F")
    parts = F.from_json("sample", "o_orderkey long, o_custkey long, o_orderpriority string, split string")
    return out.select("o_orderdate", "o_orderkey", F.to_json(parts).alias("sample"))


@query(
    "s08_inventory",
    " union all ".join(f"select '{t}' as \"table\", (select string_agg(column_name, ',' order by column_index) from duckdb_columns() where table_name = '{t}') as columns, count(*) as rows, count(*) > 0 as covered from {t}" for t in TABLES),
)
def s08(spark, sf):
    return O.inventory({t: table(spark, sf, t) for t in TABLES})


#: Types that the digest writes in a form of its own, by column.
_SPECIAL = {"embedding": "floats"} | dict.fromkeys(("o_orderdate", "l_shipdate", "ts"), "timestamp")
_SPECIAL |= dict.fromkeys(("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"), "double")
_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


@query(
    "s08_inventory_digest",
    " union all ".join(
        f"select '{t}' as \"table\", '{','.join(c.split())}' as columns, n as rows, xor_hash, sum_hash, n > 0 as covered from ({digest_sql(t, [(x, _SPECIAL.get(x, '')) for x in c.split()])})" for t, c in _COLUMNS.items()
    ),
)
def s08_digest(spark, sf):
    return O.inventory({t: table(spark, sf, t) for t in TABLES}, digest=True)


_ROSTER_SQL = """with r as (select c_custkey as ord, upper('sv' || (c_custkey % 700)) as mssv, c_name as full_name, cast(1970 + c_nationkey as varchar) as birth_year, case when c_acctbal < 0 then '' else c_mktsegment end as faculty, 'L' || c_nationkey as class_name, cast(c_custkey as varchar) as stt from customer),
    v as (select *, row_number() over (partition by mssv order by ord desc) as rn from r where faculty <> '')
    select mssv, full_name, birth_year, faculty, class_name, stt from v where rn = 1"""


def s09_roster(spark, sf):
    """A title row and the header row stand above the customers."""
    cells = F.array(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string")), F.concat(F.lit("sv"), F.col("c_custkey") % 700), "c_name", (F.col("c_nationkey") + 1970).cast("string"),
        F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_mktsegment")), F.concat(F.lit("L"), "c_nationkey"),
    )
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), cells.alias("cells"))
    title = [F.struct(F.lit(-2).cast("bigint").alias("ord"), F.array(F.lit("Danh sách"), *[F.lit("")] * 5).alias("cells"))]
    header = F.struct(F.lit(-1).cast("bigint").alias("ord"), F.array(*[F.lit(x) for x in ("STT", "MSSV", "Họ và tên", "Năm sinh", "Khoa", "Lớp")]).alias("cells"))
    above = table(spark, sf, "region").limit(1).select(F.explode(F.array(*title, header)).alias("r")).select("r.*")
    return S.import_roster(above.unionByName(rows))


@query(
    "s09_import_counts",
    """with r as (select upper('sv' || (c_custkey % 700)) as mssv from customer where c_acctbal >= 0)
    select count(*) as valid, count(*) - count(distinct mssv) as duplicates, count(distinct mssv) as kept from r""",
)
def s09_counts(spark, sf):
    return s09_roster(spark, sf)[1]


@query("s09_import_roster", _ROSTER_SQL)
def s09(spark, sf):
    roster, _ = s09_roster(spark, sf)
    return roster.select("mssv", "full_name", "birth_year", "faculty", "class_name", "stt")


_ATLAS = """atlas as (select 'src' || (page_id % 20) || '-page-' || lpad(cast(page_id // 20 as varchar), 3, '0') as id, 'page' as kind, length(html) as chars, length(url) > 40 as eligible from pages
      union all select 'src' || (page_id % 20) || '-p' || lpad(cast(page_id // 20 as varchar), 3, '0') || '-img' || lpad(cast(n as varchar), 2, '0'), 'embedded-image', null, length(url) > 40
      from (select *, unnest(range(1, 3)) as n from pages))"""


@query("s10_atlas_rows", f"with {_ATLAS} select id, kind, eligible, count(*) as n from atlas where eligible group by all")
def s10(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("src"), F.col("page_id") % 20).alias("source"), F.floor(F.col("page_id") / 20).alias("page"), F.length("html").alias("chars"), (F.length("url") > 40).alias("eligible"), F.lit(1).alias("signature")
    )
    assets = pages.drop("chars").withColumn("ordinal", F.explode(F.array(F.lit(1), F.lit(2))))
    return S.positive_atlas(S.atlas_rows(pages, assets)).groupBy("id", "kind", "eligible").agg(F.count("*").alias("n"))


@query(
    "s11_corpus_manifest",
    """with s as (select source, count(*) as pages, count(*) filter (where n_chars > 0) as indexed_pages, count(*) filter (where n_chars > 200) as images, count(*) filter (where n_chars > 300) as indexed_images, sum(n_chars) as text_chars from documents group by source)
    select count(*) as sources, cast(sum(pages) as bigint) as pages, cast(sum(indexed_pages) as bigint) as indexed_pages, cast(sum(images) as bigint) as images, cast(sum(indexed_images) as bigint) as indexed_images, cast(sum(text_chars) as bigint) as text_chars,
      sum(pages) = sum(indexed_pages) as all_pages_indexed, sum(images) = sum(indexed_images) as all_images_indexed from s""",
)
def s11(spark, sf):
    sources = table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("pages"), F.count_if(F.col("n_chars") > 0).alias("indexed_pages"), F.count_if(F.col("n_chars") > 200).alias("images"), F.count_if(F.col("n_chars") > 300).alias("indexed_images"), F.sum("n_chars").alias("text_chars")
    )
    return O.corpus_manifest(sources)
