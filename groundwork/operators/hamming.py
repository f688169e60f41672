"""Pairs within a Hamming distance by keys that are refined where they are crowded.

Two values that differ in at most d bits differ in at most d hex digits, so of d + 1 pieces
of the digits they share one. Rows are grouped by each of their pieces. A group that holds
more than ``limit`` rows is keyed again by d + 1 pieces of the digits outside its key, level
by level, until groups are small, fewer than d + 1 digits are left, or two levels did not pay:
d + 1 groups of n rows cost more than one of m rows when (d + 1) n^2 > m^2. One such level may
come from digits that all rows share; after two, the group is taken for a true cluster, which
would be copied d + 1 times at every further level. A pair is compared in
many groups but kept in one: where every level's piece is the first that the two share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from groundwork.session import materialize

#: Rows of a group that are compared with each other without refining the key.
GROUP_LIMIT = 256


@dataclass(frozen=True)
class Leaves:
    """``small``: rows of groups that are compared whole; ``dense``: rows of groups that stay
    crowded. Columns: _gid, _skip (which piece was the key, a letter per level) and those of the
    input but the digits. ``words``: longs per value; ``digits``: its hex digits; ``parts``:
    pieces of a level."""

    small: DataFrame
    dense: DataFrame
    words: int
    digits: int
    parts: int


def bits_apart(a: Column, b: Column, words: int) -> Column:
    """Bits in which two arrays of ``words`` longs differ. It runs for every pair of a group,
    so it is written out without functions over arrays, which are not compiled."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)), F.lit(0))


def words_of(value: Column, digits: int) -> Column:
    """The hex digits of a value as an array of longs."""
    return F.array(*[F.conv(F.substring(value, at + 1, min(16, digits - at)), 16, -10).cast("bigint") for at in range(0, digits, 16)])


def _cut(n, i, parts: int):
    return F.floor(n * i / parts).cast("int")


def _nibbles(values: np.ndarray, digits: int) -> np.ndarray:
    """A row of hex digits for every row of longs."""
    octets = values.astype(">i8").view(np.uint8).reshape(len(values), -1)
    whole = np.stack([octets >> 4, octets & 15], axis=2).reshape(len(values), values.shape[1], 16)
    return np.concatenate([whole[:, i, 16 - min(16, digits - 16 * i) :] for i in range(values.shape[1])], axis=1)


def _path(skip: str, digits: int, parts: int) -> tuple[list[int], list[list[int]]]:
    """The places of the digits outside a key, and those of every piece before its own."""
    left, earlier = list(range(digits)), []
    for letter in skip:
        i, cuts = ord(letter) - 65, [len(left) * j // parts for j in range(parts + 1)]
        earlier += [left[cuts[j] : cuts[j + 1]] for j in range(i)]
        left = left[: cuts[i]] + left[cuts[i + 1] :]
    return left, earlier


def _outside(words: Column, skip: Column, width: int, digits: int, parts: int) -> Column:
    """The hex digits outside the key of a row, told from its longs and the path of its key."""

    @F.arrow_udf("string")
    def outside(words: pa.Array, skip: pa.Array) -> pa.Array:
        shown = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)[_nibbles(words.flatten().to_numpy().reshape(-1, width), digits)]
        paths, rows, out = skip.dictionary_encode(), np.arange(len(skip)), np.empty(len(skip), dtype=object)
        for n, path in enumerate(paths.dictionary.to_pylist()):
            some, left = rows[paths.indices.to_numpy() == n], _path(path, digits, parts)[0]
            out[some] = np.ascontiguousarray(shown[some][:, left]).view(f"S{len(left)}").ravel().astype(str) if left else ""
        return pa.array(out, pa.string())

    return outside.asNondeterministic()(words, skip)


def refine(rows: DataFrame, value: str, distance: int, scope: list[str] = (), limit: int = GROUP_LIMIT) -> Leaves:
    """Key groups of ``rows`` by the hex string ``value`` (one length for all rows), inside
    equal ``scope`` columns. Every level counts its groups and writes its rows once; groups
    of one row leave at once. A row moves with its longs and the places of its keys: the digits
    outside them are told from these when they are needed."""
    parts = distance + 1
    start = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in scope]) if scope else F.lit("")
    kept = [c for c in rows.columns if c != value]
    level = rows.filter(F.col(value).isNotNull()).withColumns({"_gid": start, "_skip": F.lit(""), "_rest": F.lower(value), "_digits": F.length(value).cast("smallint")}).drop(value)
    level = level.withColumns({"_up": F.lit(None).cast("bigint"), "_slow": F.lit(0).cast("tinyint"), "_left": F.col("_digits")})
    carried = [*kept, "_digits", "_up", "_slow"]
    small, dense, words, digits, levels = [], [], None, 0, 0
    while True:
        at = lambda i: _cut(F.length("_rest"), i, parts)
        pieces = F.array(*[F.expr("_rest").substr(at(i) + 1, at(i + 1) - at(i)) for i in range(parts)])
        keyed = level.select(*carried, "_left", "_gid", "_skip", F.posexplode(pieces).alias("_i", "_key"))
        gid, skip = F.concat_ws("\u0001", "_gid", "_i", "_key"), F.concat("_skip", F.char(F.col("_i") + 65))
        level = keyed.select(*carried, (F.col("_left") - F.length("_key")).cast("smallint").alias("_left"), gid.alias("_gid"), skip.alias("_skip"))
        counts = level.groupBy("_gid").agg(F.count("*").alias("_n")).filter("_n > 1")
        level = materialize(level.join(counts, "_gid"), "refined")
        if words is None:
            words, digits = (x or 0 for x in level.agg(F.max(F.size("_words")), F.max("_digits")).first())
        levels += 1
        spent = ["_n", "_up", "_slow", "_digits", "_left"]
        small.append(level.filter(F.col("_n") <= limit).drop(*spent))
        n, up = (F.col(c).cast("double") for c in ("_n", "_up"))
        slow = (F.col("_slow") + F.when(n * n * parts > up * up, 1).otherwise(0)).cast("tinyint")
        crowded = level.filter(F.col("_n") > limit).withColumn("_slow", slow)
        if crowded.isEmpty():
            break
        fine = (F.col("_left") >= parts) & (F.col("_slow") < 2)
        dense.append(crowded.filter(~fine).drop(*spent))
        rest = _outside(F.col("_words"), F.col("_skip"), words, digits, parts)
        level = crowded.filter(fine).drop("_up").withColumnRenamed("_n", "_up").withColumn("_rest", rest)
    whole = small[0]
    for more in small[1:]:
        whole = whole.unionByName(more)
    rest = whole.limit(0)
    for more in dense:
        rest = rest.unionByName(more)
    return Leaves(whole, rest, words, digits, parts)


def first_shared(leaves: Leaves) -> Column:
    """Whether two rows a and b of a group share no earlier piece at any level of its key."""
    width, digits, parts = max(1, leaves.words), leaves.digits, leaves.parts

    @F.arrow_udf("boolean")
    def first(a: pa.Array, b: pa.Array, skip: pa.Array) -> pa.Array:
        apart = _nibbles((a.flatten().to_numpy() ^ b.flatten().to_numpy()).reshape(-1, width), digits) != 0
        paths, rows, out = skip.dictionary_encode(), np.arange(len(skip)), np.ones(len(skip), dtype=bool)
        for n, path in enumerate(paths.dictionary.to_pylist()):
            some = rows[paths.indices.to_numpy() == n]
            for piece in _path(path, digits, parts)[1]:
                out[some] &= apart[some][:, piece].any(axis=1)
        return pa.array(out)

    return first(F.col("a._words"), F.col("b._words"), F.col("a._skip"))


def tiled_pairs(leaves: Leaves, limit: int = GROUP_LIMIT) -> tuple[DataFrame, list[str]]:
    """Rows with the keys by which all pairs of a group meet exactly once, and the names of
    those keys. Small groups are one tile; rows of a dense group are dealt by hash into tiles
    of about ``limit`` rows, and every two tiles meet in a task of their own."""
    sizes = leaves.dense.groupBy("_gid").agg(F.count("*").alias("_n"))
    dealt = leaves.dense.join(sizes, "_gid").withColumn("_t", F.ceil(F.col("_n") / limit).cast("int"))
    dealt = dealt.withColumn("_mine", F.pmod(F.xxhash64(*[c for c in leaves.dense.columns if c not in ("_gid", "_skip")]), F.col("_t")).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    tiles = met.select("*", F.least("_mine", "_other").alias("_lo"), F.greatest("_mine", "_other").alias("_hi")).drop("_n", "_t", "_other")
    zero = F.lit(0)
    small = leaves.small.withColumns({"_mine": zero, "_lo": zero, "_hi": zero})
    return small.unionByName(tiles.select(small.columns)), ["_gid", "_lo", "_hi"]


def pairs_within(leaves: Leaves, keys: Column, distance: int, limit: int = GROUP_LIMIT) -> DataFrame:
    """Joined rows ``a`` and ``b`` of all pairs within ``distance`` (column _distance), each
    once; ``keys`` is the further condition on a and b, which must order them. ``_words`` are
    the values as longs."""
    rows, by = tiled_pairs(leaves, limit)
    a, b = rows.alias("a"), rows.alias("b")
    same = keys
    for name in by:
        same = same & (F.col(f"a.{name}") == F.col(f"b.{name}"))
    # in a tile of two halves, only pairs across the halves
    across = (F.col("a._lo") == F.col("a._hi")) | (F.col("a._mine") != F.col("b._mine"))
    apart = bits_apart(F.col("a._words"), F.col("b._words"), leaves.words)
    near = a.join(b, same & across).withColumn("_distance", apart).filter(F.col("_distance") <= distance)
    return near.filter(first_shared(leaves))
