"""Merkle manifest of a dataset: leaf coordinates by bitmap ranks, levels by slot arrays."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundwork.llm.common import materialize
from groundwork.operators.joins import with_dense_index
from groundwork.session import discard

#: Ids that agree above the low 16 bits share a container.
_BITS = 16
_SPAN = 1 << _BITS
#: Where null ids go: before the container of the least long.
_NULL_HIGH = -(1 << 48)
#: A slot array reduces ``2 ** _LEVELS`` nodes to one.
_LEVELS = 10
_SLOTS = 1 << _LEVELS


def field(column: str, value: Column | None = None) -> Column:
    """One value of a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = (F.col(f"`{column}`") if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[str], changed: dict[str, Column] | None = None) -> Column:
    """Lower-case hex SHA-256 of the fields of ``columns``; ``changed`` replaces values."""
    return F.sha2(F.concat(*[field(c, (changed or {}).get(c)) for c in columns]), 256)


def group_key(column: str) -> Column:
    """A string that sorts like the column bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`")), F.lit(""))


def compress(lows: np.ndarray) -> bytes:
    """Distinct low halves as a container: up to 4,095 as an array, more as a bitmap."""
    if len(lows) < _SPAN // 16:
        return np.sort(lows).astype("<u2").tobytes()
    bits = np.zeros(_SPAN, dtype=np.uint8)
    bits[lows] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def words_of(container: bytes) -> np.ndarray:
    """The container as a bitmap of 1,024 words."""
    if len(container) == _SPAN // 8:
        return np.frombuffer(container, dtype="<u8")
    bits = np.zeros(_SPAN, dtype=np.uint8)
    bits[np.frombuffer(container, dtype="<u2")] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def rank(container: bytes, again: bytes, extra: bytes, lows: np.ndarray) -> np.ndarray:
    """How many entries of a container come before each low half: the popcount directory of
    its words, the bits below in the own word, and the repeats of ids below."""
    words = words_of(container)
    ones = np.bitwise_count(words).astype(np.int64)
    directory = np.cumsum(ones) - ones
    own, below = lows >> 6, (np.uint64(1) << (lows & 63).astype(np.uint64)) - np.uint64(1)
    repeats = np.concatenate([[0], np.cumsum(np.frombuffer(extra, dtype="<i8"))])
    return directory[own] + np.bitwise_count(words[own] & below) + repeats[np.searchsorted(np.frombuffer(again, dtype="<u2"), lows)]


_PARTIAL = "grp string, high long, lows binary, again binary, extra binary"


def bitmaps(ids: DataFrame) -> DataFrame:
    """Per ``grp`` and ``high`` one container of the ids of ``ids`` (grp, high, low):
    ``lows`` compressed, the repeated ids ``again`` with the number of further rows ``extra``,
    and ``n`` rows. Tasks compress their batches first, so about two bytes per id travel."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas().groupby(["grp", "high", "low"], sort=True).size().rename("n").reset_index()
            found = {k: [] for k in ("grp", "high", "lows", "again", "extra")}
            for (grp, high), part in frame.groupby(["grp", "high"], sort=False):
                low, n = part["low"].to_numpy(), part["n"].to_numpy()
                for name, value in zip(found, (grp, high, compress(low), *_repeats(low, n)), strict=True):
                    found[name].append(value)
            yield pa.RecordBatch.from_pydict(found, pa.schema([("grp", pa.string()), ("high", pa.int64()), *[(c, pa.binary()) for c in ("lows", "again", "extra")]]))

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        counts = np.zeros(_SPAN, dtype=np.int64)
        for lows, again, extra in zip(*[parts.column(c).to_pylist() for c in ("lows", "again", "extra")], strict=True):
            here = np.unpackbits(words_of(lows).view(np.uint8), bitorder="little")
            counts += here
            counts[np.frombuffer(again, dtype="<u2")] += np.frombuffer(extra, dtype="<i8")
        low = np.flatnonzero(counts)
        again, extra = _repeats(low, counts[low])
        return pa.table({"grp": [key[0].as_py()], "high": [key[1].as_py()], "lows": [compress(low)], "again": [again], "extra": [extra], "n": [int(counts.sum())]})

    return ids.mapInArrow(partial, _PARTIAL).groupBy("grp", "high").applyInArrow(merge, _PARTIAL + ", n long")


def _repeats(low: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    more = n > 1
    return low[more].astype("<u2").tobytes(), (n[more] - 1).astype("<i8").tobytes()


def directory(containers: DataFrame) -> DataFrame:
    """Adds ``base`` (rows of the group in the containers before) and ``total`` (rows of the
    group). Range partitions are summed apart and shifted, so no group is in one task."""
    parts = materialize(containers.repartitionByRange("grp", "high").withColumn("_pid", F.spark_partition_id()), "manifest-bitmaps")
    sums = parts.groupBy("grp", "_pid").agg(F.sum("n").alias("_n"))
    of_group = W.partitionBy("grp")
    earlier = F.coalesce(F.sum("_n").over(of_group.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sums.select("grp", "_pid", earlier.alias("_before"), F.sum("_n").over(of_group).alias("total"))
    inside = F.sum("n").over(W.partitionBy("grp", "_pid").orderBy("high")) - F.col("n")
    return parts.withColumn("_inside", inside).join(shifts, ["grp", "_pid"]).withColumn("base", F.col("_before") + F.col("_inside")).drop("_pid", "_inside", "_before")


_LEAF = "grp string, slot long, total long, doc_id long, leaf string, shown string"


def coordinates(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, doc_id, leaf, shown) with ``slot``, their place in their group by
    doc_id, and ``total``. Ids that come once are ranked in their container, so a task gets
    at most 65,536 of them; rows of repeated ids are numbered among each other by leaf."""
    high = F.coalesce(F.shiftright("doc_id", _BITS), F.lit(_NULL_HIGH))
    low = F.coalesce(F.col("doc_id").bitwiseAND(_SPAN - 1), F.lit(0)).cast("int")
    leaves = leaves.withColumns({"high": high, "low": low})
    found = materialize(directory(bitmaps(leaves.select("grp", "high", "low"))), "manifest-directory")

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lows = np.frombuffer(row["again"], dtype="<u2").astype(np.int64)
                first = row["base"] + rank(row["lows"], row["again"], row["extra"], lows)
                n = len(lows)
                yield pa.RecordBatch.from_pydict({"grp": [row["grp"]] * n, "high": [row["high"]] * n, "low": pa.array(lows, pa.int32()), "first": pa.array(first, pa.int64()), "total": [row["total"]] * n})

    again = found.filter(F.octet_length("again") > 0).mapInArrow(repeated, "grp string, high long, low int, first long, total long")
    again = materialize(again, "manifest-repeats")
    key = ["grp", "high", "low"]
    singles = leaves.join(again.select(key), key, "left_anti")
    several = with_dense_index(leaves.join(again, key), [*key, "leaf"], "_k")
    starts = several.groupBy(*key).agg(F.min("_k").alias("_first"))
    several = several.join(starts, key).withColumn("slot", F.col("first") + F.col("_k") - F.col("_first"))

    def ranks(key: tuple, mine: pa.Table, container: pa.Table) -> pa.Table:
        own = container.slice(0, 1).to_pylist()
        lows = mine.column("low").to_numpy().astype(np.int64)
        slot = own[0]["base"] + rank(own[0]["lows"], own[0]["again"], own[0]["extra"], lows) if own else lows[:0]
        total = np.full(len(slot), own[0]["total"] if own else 0, dtype=np.int64)
        columns = [mine.column("grp"), pa.array(slot, pa.int64()), pa.array(total), *[mine.column(c) for c in ("doc_id", "leaf", "shown")]]
        return pa.table(columns, ["grp", "slot", "total", "doc_id", "leaf", "shown"])

    placed = singles.groupBy("grp", "high").cogroup(found.groupBy("grp", "high")).applyInArrow(ranks, _LEAF)
    return placed.unionByName(several.select(*[c.split()[0] for c in _LEAF.split(", ")]))


def _hash(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def reduce_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and ``levels`` levels above them; two neighbours become their hash, and so
    does a last node alone."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_hash(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def siblings(levels: list[list[str]], slot: int) -> list[str]:
    """The way up from a slot: per level ``L`` or ``R`` and the sibling on that side, or an
    empty string where a node is alone."""
    way = []
    for nodes in levels[:-1]:
        other = slot ^ 1
        way.append(("L" if other < slot else "R") + nodes[other] if other < len(nodes) else "")
        slot >>= 1
    return way


def fold(digest: str, way: list[str]) -> str:
    """What a node and its siblings come to at the end of the way."""
    for step in way:
        digest = _hash(step[1:], digest) if step[:1] == "L" else _hash(digest, step[1:])
    return digest


def _depth(total: int) -> int:
    """Levels above a slot array of a group of ``total`` nodes: all, or those of a full array."""
    return min(_LEVELS, (total - 1).bit_length())


_ARRAY = "grp string, chunk long, total long, digests array<string>, digest string"


def _slot_arrays(nodes: DataFrame, carried: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """``nodes`` (grp, slot, total, digest, carried columns) by group and 1,024 slots: the
    digests in slot order, what they reduce to, and the carried columns as arrays."""

    def collect(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(np.argsort(rows.column("slot").to_numpy()))
        digests, total = rows.column("digest").to_pylist(), rows.column("total")[0].as_py()
        top = reduce_levels(digests, _depth(total))[-1][0]
        columns = {"grp": [key[0].as_py()], "chunk": [key[1].as_py()], "total": [total], "digests": [digests], "digest": [top]}
        for name, kind, _ in carried:
            columns[name] = pa.array([rows.column(name).to_pylist()], pa.list_(kind))
        return pa.table(columns)

    schema = _ARRAY + "".join(f", {name} array<{sql}>" for name, _, sql in carried)
    return nodes.withColumn("chunk", F.shiftright("slot", _LEVELS)).groupBy("grp", "chunk").applyInArrow(collect, schema)


def _up(arrays: DataFrame) -> DataFrame:
    """The nodes that arrays of groups with more than one array stand for."""
    n = F.shiftright(F.col("total") + F.lit(_SLOTS - 1), _LEVELS)
    return arrays.filter(F.col("total") > _SLOTS).select("grp", F.col("chunk").alias("slot"), n.alias("total"), "digest")


def _levels(nodes: DataFrame, carried: list, name: str) -> list[DataFrame]:
    """Stored slot arrays, level by level, until every group has come to one array."""
    out = [materialize(_slot_arrays(nodes, carried), f"{name}-0")]
    while not out[-1].filter(F.col("total") > _SLOTS).isEmpty():
        out.append(materialize(_slot_arrays(_up(out[-1]), []), f"{name}-{len(out)}"))
    return out


def _tops(levels: list[DataFrame]) -> DataFrame:
    """``grp, digest, level`` of the one array that each group ends in."""
    ends = [x.filter(F.col("total") <= _SLOTS).select("grp", "digest", F.lit(k).alias("level")) for k, x in enumerate(levels)]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


_WAY = "grp string, chunk long, way array<string>, subroot string, root string"


def _down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``_WAY`` for every array of the lowest level: the siblings from its digest up to the
    root. ``tops``: grp, level, way, subroot, root of the array a group ends in."""

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stairs = reduce_levels(row["digests"], _depth(row["total"]))
                n, first = len(row["digests"]), row["chunk"] << _LEVELS
                found = [siblings(stairs, k) + row["way"] for k in range(n)]
                yield pa.RecordBatch.from_pydict(
                    {"grp": [row["grp"]] * n, "chunk": list(range(first, first + n)), "way": found, "subroot": [row["subroot"]] * n, "root": [row["root"]] * n},
                    pa.schema([("grp", pa.string()), ("chunk", pa.int64()), ("way", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]),
                )

    above = None
    for level in range(len(levels) - 1, -1, -1):
        ended = tops.filter(F.col("level") == level).select("grp", F.lit(0).cast("bigint").alias("chunk"), "way", "subroot", "root")
        above = ended if above is None else above.unionByName(ended)
        if level:
            above = levels[level].join(above, ["grp", "chunk"]).mapInArrow(ways, _WAY)
    return above


def manifest(leaves: DataFrame) -> DataFrame:
    """The Merkle tree over ``leaves`` (grp, doc_id, leaf, shown) and the check of what is
    shown: ``doc_id, leaf, subroot, root, way, folded_root, verified`` per row.

    Leaves of a group ascend by doc_id (null first); rows with one id follow each other by
    leaf, and rows that agree in both are alike. Two neighbours become the hash of both, a
    last node alone that of itself, until one is left: the subroot. Subroots in the order of
    ``grp`` give the root in the same way. ``way`` lists the siblings from leaf to root
    (see ``siblings``); ``folded_root`` is what ``shown`` comes to along it.

    Groups, containers and slot arrays are the units of all shuffles, none larger than
    65,536 ids or 1,024 nodes, whatever the size of a group. An empty table gives no rows.
    """
    stored = materialize(leaves.select("grp", "doc_id", "leaf", "shown"), "manifest-leaves")
    placed = coordinates(stored).withColumnRenamed("leaf", "digest")
    lower = _levels(placed, [("doc_id", pa.int64(), "bigint"), ("shown", pa.string(), "string")], "manifest-level")
    discard(stored)
    tops = materialize(_tops(lower), "manifest-subroots")
    roots = with_dense_index(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"], "slot")
    roots = roots.withColumn("total", F.lit(tops.count()).cast("bigint"))
    upper = _levels(roots, [("name", pa.string(), "string")], "manifest-roots")
    root = _tops(upper).select("grp", "level", F.array().cast("array<string>").alias("way"), F.lit("").alias("subroot"), F.col("digest").alias("root"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stairs = reduce_levels(row["digests"], _depth(row["total"]))
                found, known = [], {}
                for k, (doc_id, shown) in enumerate(zip(row["doc_id"], row["shown"], strict=True)):
                    own = siblings(stairs, k)
                    here = fold(shown, own)
                    if here not in known:
                        known[here] = fold(here, row["way"])
                    found.append({"doc_id": doc_id, "leaf": row["digests"][k], "subroot": row["subroot"], "root": row["root"], "way": own + row["way"], "folded_root": known[here], "verified": known[here] == row["root"]})
                text = ["leaf", "subroot", "root", "folded_root"]
                kinds = {c: pa.string() for c in text} | {"doc_id": pa.int64(), "way": pa.list_(pa.string()), "verified": pa.bool_()}
                order = ["doc_id", "leaf", "subroot", "root", "way", "folded_root", "verified"]
                yield pa.RecordBatch.from_pylist(found, pa.schema([(c, kinds[c]) for c in order]))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stairs = reduce_levels(row["digests"], _depth(row["total"]))
                found = [{"grp": name, "subroot": row["digests"][k], "way": siblings(stairs, k) + row["way"], "root": row["root"]} for k, name in enumerate(row["name"])]
                yield pa.RecordBatch.from_pylist(found, pa.schema([("grp", pa.string()), ("subroot", pa.string()), ("way", pa.list_(pa.string())), ("root", pa.string())]))

    above = upper[0].join(_down(upper, root).select("grp", "chunk", "way", "root"), ["grp", "chunk"]).mapInArrow(named, "grp string, subroot string, way array<string>, root string")
    per_group = tops.select("grp", "level").join(above, "grp")
    whole = lower[0].join(_down(lower, per_group), ["grp", "chunk"])
    return whole.mapInArrow(finish, "doc_id long, leaf string, subroot string, root string, way array<string>, folded_root string, verified boolean")


def proof_digest(way: str = "way") -> Column:
    """Hash of a way's siblings, level by level."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.substring(s, 2, 64)), ""), 256)


#: What a leaf of a document covers, in this order.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered_documents(docs: DataFrame, every: int = 7) -> DataFrame:
    """Leaves of ``docs`` by ``lang`` for ``manifest``. Where ``every`` divides the CRC-32 of
    the decimal doc_id, what is shown is the leaf of the row with 1 added to ``n_chars``;
    a null ``n_chars`` stays, and rows without an id are left as they are."""
    own = leaf(LEAF_COLUMNS)
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    shown = F.when(hit & F.col("n_chars").isNotNull(), leaf(LEAF_COLUMNS, {"n_chars": more})).otherwise(own)
    return docs.select(group_key("lang").alias("grp"), F.col("doc_id").cast("bigint").alias("doc_id"), own.alias("leaf"), shown.alias("shown"))
