"""Language identification by compression with one raw-content dictionary per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: What is returned for a text without any letter.
UNDETERMINED = "und"


_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """About ``documents`` documents per language, chosen by hash, give the training lines;
    lines, the long ones in pieces of up to ``line_chars`` code points that end at word ends,
    fill ``dictionary_bytes`` per language, again by hash. Texts are compressed in pieces of ``piece`` bytes, each with every dictionary,
    so all parts of a long text weigh alike. ``margin``: least relative lead to accept."""

    documents: int = 600
    line_chars: int = 2_000
    dictionary_bytes: int = 110_000
    piece: int = 4_096
    level: int = 9
    margin: float = 0.02
    seed: str = "langid"


def letters(text: str) -> str:
    """What is compressed: the lower-cased letters, other runs as one space."""
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: CRC-32 of its id as text is 2 modulo 4.
    A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_lines(docs: DataFrame, counts: dict[str, int], s: Settings = Settings()) -> DataFrame:
    """``lang, line`` of the bounded training sample (see ``Settings``) from documents that
    are not held out. ``counts``: such documents per known language."""
    scale = 1 << 30
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(scale, -(-scale * s.documents // n)))])
    drawn = F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(scale)) < F.element_at(limits, F.col("lang"))
    chosen = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & drawn)
    whole = chosen.select("lang", F.explode(F.split("text", "\n")).alias("whole"))
    cut = rf"[\s\S]{{1,{s.line_chars}}}(?!\S)|[\s\S]{{1,{s.line_chars}}}"  # a longer word is cut
    pieces = F.when(F.char_length("whole") <= s.line_chars, F.array("whole")).otherwise(F.regexp_extract_all("whole", F.lit(cut), F.lit(0)))
    lines = whole.select("lang", F.explode(pieces).alias("line")).filter(F.char_length("line") > 0).distinct()
    so_far = F.sum(F.octet_length("line") + 1).over(W.partitionBy("lang").orderBy(F.xxhash64("line"), "line").rowsBetween(W.unboundedPreceding, W.currentRow))
    return lines.withColumn("so_far", so_far).filter(F.col("so_far") <= s.dictionary_bytes).select("lang", "line")


def learn(docs: DataFrame, s: Settings = Settings()) -> dict[str, bytes]:
    """Dictionary content per language, the most frequent language first. Languages are
    counted over all documents; at most ``dictionary_bytes`` of each reach the driver."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rows = training_lines(docs, counts, s).groupBy("lang").agg(F.sort_array(F.collect_list("line")).alias("lines")).collect()
    content = {r["lang"]: "\n".join(map(letters, r["lines"])).encode() for r in rows}
    return {lang: content.get(lang) or lang.encode() for lang in sorted(counts, key=lambda k: (-counts[k], k))}


class Model:
    """Compressors per language, made once per task."""

    def __init__(self, contents: dict[str, bytes], s: Settings = Settings()):
        self.languages, self.settings = list(contents), s
        self.packers = []
        for content in contents.values():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=s.level)
            self.packers.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text per language."""
        raw, step = letters(text).encode(), self.settings.piece
        total = np.zeros(len(self.packers), dtype=np.int64)
        for at in range(0, len(raw), step):
            piece = raw[at : at + step]
            total += [len(p.compress(piece)) for p in self.packers]
        return total

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the lead is wide enough. The score is the lead over
        the second best as a share of its size, from 0 (a tie, which the more frequent
        language gets) to 1."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, False
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        best = int(order[0])
        lead = 1.0 if len(order) == 1 else float(sizes[order[1]] - sizes[best]) / float(sizes[order[1]])
        return self.languages[best], min(1.0, max(0.0, lead)), lead >= self.settings.margin


def predict(docs: DataFrame, contents: dict[str, bytes], s: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` of every row, from the text alone.

    A null text or one without a letter is ``und``, with score 0 and not accepted, and so
    is every text if nothing could be learned. ``accepted`` is false where the margin is
    narrow; the best guess is returned all the same. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, s)
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("held_out"), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    source = docs.select("doc_id", held_out().alias("held_out"), "text")
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
