"""Readers for raw record files, rosters and registries."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from groundwork.functions import text as X
from groundwork.functions.dictionaries import ROSTER_HEADERS
from groundwork.sources.digests import FileDigests


def document_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(files that are one JSON document, files with a record per line) of a path, decided
    for each file by itself: its first line that is not blank opens an array or object
    without being a JSON value of its own, and the whole file parses. What does not parse
    whole is read by lines, so a damaged line never hides the others. The names of the
    files pass the driver, as they do in every file listing of Spark."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.text(path).select(*place, F.trim("value").alias("v")).filter("v <> ''")
    first = lines.groupBy("file").agg(F.min_by("v", F.struct("block", "at")).alias("v"))
    shape = first.select("file", (F.col("v").rlike(r"^[\[{]") & F.try_parse_json("v").isNull()).alias("open")).collect()
    listed = {r["file"]: r["open"] for r in shape}
    opened = [f for f, is_open in listed.items() if is_open]
    whole = set()
    if opened:
        texts = spark.read.text(list(map(_plain_path, opened)), wholetext=True)
        parsed = texts.filter(F.try_parse_json("value").isNotNull()).select(F.col("_metadata.file_path").alias("file"))
        whole = {r["file"] for r in parsed.collect()}
    return sorted(whole), sorted(set(listed) - whole)


def _plain_path(file: str) -> str:
    """A listed file's URI as a path that names this file only."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def read_records(spark: SparkSession, path: str, schema: T.StructType, wrapped: bool | None = None) -> DataFrame:
    """Records of JSON files: one record per line, or files that are one document
    (``wrapped``; found out for every file if None, so a folder may mix them). A document
    or line may be an array, an object with ``records`` or ``data``, or a single object.
    Unreadable rows keep their text in ``_corrupt_record``. Only files of one document each
    are read whole by one task; a path without any record gives no rows."""
    listed = T.ArrayType(schema)
    outer = T.StructType(schema.fields + [T.StructField("records", listed), T.StructField("data", listed), T.StructField("_corrupt_record", T.StringType())])
    single = F.array(F.struct(*[F.col(f.name) for f in schema.fields]))

    def read(paths: str | list[str], whole: bool) -> DataFrame:
        rows = spark.read.schema(outer).option("columnNameOfCorruptRecord", "_corrupt_record").json(paths, multiLine=whole)
        return rows.select(F.explode(F.coalesce("records", "data", single)).alias("r"), "_corrupt_record").select("r.*", "_corrupt_record")

    if wrapped is not None:
        return read(path, wrapped)
    documents, by_line = document_files(spark, path)
    if not documents or not by_line:
        return read(path, bool(documents))
    return read(list(map(_plain_path, documents)), True).unionByName(read(list(map(_plain_path, by_line)), False))


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, blocks): every line with its file, split and running id, and per split the
    number of lines in the splits before it. Files are read in parallel splits."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    sizes = lines.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return lines, sizes.select("file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def read_jsonl_strict(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines that are one JSON value, error report with file and one-based line number).
    Blank lines are skipped but counted."""
    lines, blocks = numbered_lines(spark, path)
    # Inside brackets a line with trailing text is no longer valid JSON.
    boxed = F.try_parse_json(F.concat(F.lit("["), "line", F.lit("]")))
    good = F.try_variant_get(boxed, "$[0]", "variant").isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull()
    filled = lines.filter(F.trim("line") != "").withColumn("_good", good)
    bad = filled.filter(~F.col("_good")).join(blocks, ["file", "block"])
    report = bad.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")
    return filled.filter("_good").select("file", "line"), report


def read_many(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Several plain or compressed JSONL inputs with their argument position."""
    out = None
    for position, path in enumerate(paths):
        part = spark.read.schema(schema).json(path).withColumn("input_ord", F.lit(position))
        out = part if out is None else out.unionByName(part)
    return out


def verify_inputs(spark: SparkSession, path: str, pinned: DataFrame, glob: str = "*") -> DataFrame:
    """SHA-256 of every input file next to its pin (name, sha256): ok, mismatch, unpinned,
    or missing for a pin without a file. Files are hashed by the ``file_digest`` source, in
    one task each but in chunks, so a file of any size takes constant memory."""
    spark.dataSource.register(FileDigests)
    files = spark.read.format("file_digest").option("glob", glob).load(path)
    joined = files.join(pinned, "name", "full")
    state = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("sha256").isNull(), "unpinned")
        .when(F.lower("sha256") == F.col("actual"), "ok").otherwise("mismatch")
    )
    return joined.select("name", "length", "actual", state.alias("state"))


def with_source(records: DataFrame, registry: DataFrame, source: str = "source", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records with registry columns, sources that the registry does not know). With
    ``strict`` an unknown source is an error."""
    unknown = records.select(source).distinct().join(registry, source, "left_anti")
    if strict and (found := unknown.first()):
        raise ValueError(f"unknown source: {found[source]}")
    return records.join(registry, source), unknown


def import_roster(rows: DataFrame, headers: list[str] | None = None, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """``rows``: ``order`` and array ``cells``; ``headers``: the header row's cells. If they
    are not given, the first row with the key column's name is the header, and what comes
    before it is left out. Columns are found by folded alias; rows without a required field are dropped; keys are
    upper-cased; the last row of a key wins. Returns (roster, counts)."""
    import unicodedata

    if headers is None:
        names = F.transform("cells", lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", ""))
        head = rows.filter(F.array_contains(names, "mssv")).orderBy(order).first()
        if head is None:
            raise ValueError("no header row")
        headers, rows = [h or "" for h in head["cells"]], rows.filter(F.col(order) > head[order])

    def fold(value: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFD", value.strip().lower()) if not 0x300 <= ord(c) < 0x370).replace("đ", "d")
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())

    folded = [fold(h) for h in headers]
    places = {}
    for name, aliases in ROSTER_HEADERS.items():
        found = [i for i, h in enumerate(folded) if h in aliases]
        if not found:
            raise ValueError(f"required column missing: {name}")
        places[name] = found[0]
    cell = lambda n: F.trim(F.coalesce(F.get("cells", F.lit(places[n])), F.lit("")))
    shaped = rows.select(order, *[(F.upper(cell(n)) if n == "mssv" else cell(n)).alias(n) for n in ROSTER_HEADERS])
    required = [n for n in ROSTER_HEADERS if n != "stt"]
    valid = shaped
    for name in required:
        valid = valid.filter(F.col(name) != "")
    last = valid.groupBy("mssv").agg(F.max(F.struct(order, *[n for n in ROSTER_HEADERS if n != "mssv"])).alias("r"), F.count("*").alias("_n"))
    roster = last.select("mssv", *[F.col(f"r.{n}").alias(n) for n in ROSTER_HEADERS if n != "mssv"])
    counts = last.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("valid"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("kept"))
    return roster, counts


def atlas_rows(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Page rows (source, page, ...) and image rows (source, page, ordinal, ...) as one
    visual corpus with padded ids."""
    page_id = F.concat(F.col("source"), F.lit("-page-"), F.lpad(F.col("page").cast("string"), 3, "0"))
    image_id = F.concat(F.col("source"), F.lit("-p"), F.lpad(F.col("page").cast("string"), 3, "0"), F.lit("-img"), F.lpad(F.col("ordinal").cast("string"), 2, "0"))
    left = pages.withColumn("id", page_id).withColumn("kind", F.lit("page"))
    right = assets.withColumn("id", image_id).withColumn("kind", F.lit("embedded-image"))
    return left.unionByName(right, allowMissingColumns=True)


def positive_atlas(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.col("signature").isNotNull() & F.col("eligible"))
