"""Line de-duplication over range-partitioned line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundwork.llm.common import BLANKS, ascii_lower, materialize

_DOC = ["doc_id", "sig"]
_LINE = ["h1", "h2"]


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("sig", F.xxhash64("text"))


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Per document, which lines stay: ``doc_id, sig, n_lines, keep``.

    A line's key is the line without blanks at both ends, A-Z lower-cased. A key of at
    least ``min_chars`` code points that occurs in at least ``min_docs`` documents loses
    its lines; with ``keep_first`` its first line (by document and position) stays.

    ``keep`` is the keep bitmap as its runs of ones, ``array<struct<start,len>>``.
    Documents that lose no line have no row. Lines travel as 128-bit hashes, range
    partitioned by hash, document and position, so the lines of one very common key are
    spread over many partitions and each is streamed in order; only counts meet per key.

    Rows that agree in ``doc_id`` and text are one document. A null text is an empty one;
    a null ``doc_id`` is a value like any other. Other columns are ignored.
    """
    split = _documents(docs).select(*_DOC, F.size(F.split("text", "\n")).alias("n_lines"), F.split(ascii_lower(F.col("text")), "\n").alias("lines"))
    key = F.btrim(F.col("raw"), F.lit(BLANKS))
    keyed = split.select(*_DOC, "n_lines", F.posexplode("lines").alias("pos", "raw")).select(*_DOC, "n_lines", "pos", key.alias("key"))
    keyed = keyed.filter(F.char_length("key") >= max(1, min_chars))
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), *_DOC, "pos", "n_lines")
    # stored: the range sampling, the counts and the join read hashes and never the texts again
    dealt = materialize(hashed, "line-hashes").repartitionByRange(*_LINE, *_DOC)
    in_document = F.row_number().over(W.partitionBy(*_LINE, *_DOC).orderBy("pos"))
    heads = dealt.withColumn("_n", in_document).filter(F.col("_n") == 1)
    seen = [F.count("*").alias("n_docs")] + ([F.min(F.struct(*_DOC, "pos")).alias("head")] if keep_first else [])
    common = heads.groupBy(*_LINE).agg(*seen).filter(F.col("n_docs") >= min_docs).drop("n_docs")
    # stored, so that both sides of the join are plain shuffles and a hot line's can be split
    common = materialize(common, "common-lines")
    lost = dealt.join(common, _LINE)
    if keep_first:
        lost = lost.filter(~F.struct(*_DOC, "pos").eqNullSafe(F.col("head")))
    gone = lost.groupBy(*_DOC).agg(F.first("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("gone"))
    return gone.select(*_DOC, "n_lines", _runs(F.col("gone"), F.col("n_lines")).alias("keep"))


def _runs(gone: Column, n: Column) -> Column:
    """Runs between the sorted lost positions: the ones of the bitmap."""
    before = F.concat(F.array(F.lit(-1)), gone)
    after = F.concat(gone, F.array(n))
    runs = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("len")))
    return F.filter(runs, lambda r: r["len"] > 0)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Applies ``line_keep_bitmaps``: ``doc_id, n_lines, n_dropped, kept`` for every row.

    Kept lines are joined by one newline; a document without lines left is empty.
    """
    maps = line_keep_bitmaps(docs, min_docs, min_chars, keep_first).drop("n_lines")
    own = _documents(docs).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.sig") == F.col("m.sig"))
    joined = own.join(maps.alias("m"), same, "left").select("d.doc_id", "d.text", "m.keep")
    joined = joined.withColumn("lines", F.when(F.col("keep").isNotNull(), F.split("text", "\n")))
    left = F.flatten(F.transform(F.col("keep"), lambda r: F.slice("lines", r["start"] + 1, r["len"])))
    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n_kept = F.aggregate(F.col("keep"), F.lit(0), lambda total, r: total + r["len"])
    n_lines = F.size(F.split("text", "\n"))
    return joined.select(
        "doc_id",
        n_lines.cast("bigint").alias("n_lines"),
        F.when(F.col("keep").isNull(), F.lit(0)).otherwise(n_lines - n_kept).cast("bigint").alias("n_dropped"),
        kept.alias("kept"),
    )
