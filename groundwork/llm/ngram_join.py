"""N-gram Jaccard join: grouped prefix join over word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from groundwork.llm.common import materialize
from groundwork.llm.graph import components

#: Cells of the table that tells which texts are candidates.
_FILTER_BITS = 22
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A-Z are lower-cased, words are runs without space or code points 9 to 13. A text
    with fewer than ``width`` words is one shingle; one without words has none."""
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    out = hashed[:n].copy()
    for k in range(1, width):
        out *= _FOLD
        out += hashed[k : k + n]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def needed_overlap(a, b, percent: int):
    """Least number of common members of sets of a and b members with that Jaccard similarity."""
    return -(-percent * (a + b) // (100 + percent))


def _gathered(df: DataFrame, fill: Callable[[np.ndarray, pd.DataFrame], None], bits: int) -> np.ndarray:
    """One table of ``2**bits`` counters over all rows of ``df``: each task fills its own
    (``fill`` adds a batch), and the tables are summed block by block. A group that is
    summed has at most 256 tasks, then at most one row per 256 tasks."""
    block = min(1 << 12, 1 << bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, task = np.zeros(1 << bits, dtype=np.int64), None
        for pdf in batches:
            if len(pdf):
                fill(total, pdf)
                task = int(pdf["pid"].iloc[0])
        if task is not None:
            own = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(-1, block)
            used = np.flatnonzero(own.any(axis=1))
            for at in range(0, len(used), 64):
                rows = used[at : at + 64]
                yield pd.DataFrame({"block": rows, "wave": task // 256, "counts": [own[r].tobytes() for r in rows]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.minimum(np.sum([np.frombuffer(c, dtype=np.int32) for c in pdf["counts"]], axis=0, dtype=np.int64), 2**31 - 1)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "wave": pdf["wave"].iloc[:1], "counts": [total.astype(np.int32).tobytes()]})

    schema = "block long, wave long, counts binary"
    parts = df.withColumn("pid", F.spark_partition_id()).mapInPandas(count, schema)
    summed = parts.groupBy("block", "wave").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    out = np.zeros(((1 << bits) // block, block), dtype=np.int32)
    for r in summed.select("block", "counts").collect():  # 4 * 2**bits bytes at most, whatever the input
        out[r["block"]] = np.frombuffer(r["counts"], dtype=np.int32)
    return out.reshape(-1)


def rarity_sketch(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """Occurrences of all shingles of all documents in ``2**bits`` counters by hash. It only
    decides the order of shingles, so collisions cost time and never links."""

    def fill(total: np.ndarray, pdf: pd.DataFrame) -> None:
        for start in range(0, len(pdf), 2000):
            part = [shingle_set(t, width) for t in pdf["text"].iloc[start : start + 2000]]
            total += np.bincount(_cell(np.concatenate(part), bits), minlength=1 << bits)

    return _gathered(docs.select("text"), fill, bits)


def _cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def document_prefixes(docs: DataFrame, width: int, percent: int, bits: int) -> DataFrame:
    """``rid, doc_id, thash, n, sig, psig, prefix``, stored: per row the size of its shingle
    set, a 128-bit signature of the set, and its prefix: its rarest shingles, as many as
    any set that is similar enough must meet, with a 128-bit signature. ``rid`` is a row id."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(rarity_sketch(docs, width, bits))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            sizes, sigs, psigs, heads = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, width)
                n = len(own)
                keep = n - (percent * n + 99) // 100 + 1 if n else 0
                order = np.lexsort((own, counts[_cell(own, bits)]))[:keep]
                head = own[order]
                sizes.append(n)
                sigs.append(xxhash.xxh3_128_digest(own.tobytes()))
                psigs.append(xxhash.xxh3_128_digest(head.tobytes()))
                heads.append(head)
            columns = [batch.column("doc_id"), batch.column("thash"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(psigs, pa.binary()), _lists(heads)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "thash", "n", "sig", "psig", "prefix"])

    source = docs.select("doc_id", F.xxhash64("text").alias("thash"), "text")
    schema = "doc_id long, thash long, n long, sig binary, psig binary, prefix array<long>"
    out = source.mapInArrow(prefixes, schema)
    return materialize(out.select(F.monotonically_increasing_id().alias("rid"), "*"), "prefixes")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow column of long arrays from arrays of unsigned hashes."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _posted(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Prefix postings ``token, gid, n, pos`` of one set per group, for tokens that two or
    more groups have: with their number ``df`` and the group ``head`` that has the token
    earliest in its prefix. Size and position travel as one number."""
    leaders = sets.join(groups.select(F.col("gid").alias("rid")).hint("merge"), "rid", "left_semi")
    postings = leaders.select("rid", "n", F.posexplode("prefix").alias("pos", "token"))
    packed = postings.select("token", F.col("rid").alias("gid"), F.shiftleft(F.col("pos").cast("bigint"), 32).bitwiseOR(F.col("n")).alias("place"))
    dealt = packed.repartition("token")
    lists = dealt.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct("place", "gid")).alias("head")).filter("df > 1")
    joined = dealt.join(lists, "token")

    def parts(c: str) -> list:
        return [F.col(c).bitwiseAND((1 << 32) - 1).cast("int").alias("n"), F.shiftright(c, 32).cast("int").alias("pos")]

    return joined.select("token", "gid", *parts("place"), "df", F.struct("head.gid", *parts("head.place")).alias("head"))


def _may_link(a: str, b: str, percent: int):
    """Size and position filter for two postings of one token."""
    na, nb, pa, pb = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    sizes = (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    return sizes & ((100 + percent) * F.least(na - pa, nb - pb) >= percent * (na + nb))


def _pairs(a: str, b: str):
    left, right = F.col(f"{a}.gid"), F.col(f"{b}.gid")
    return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")


def _starred(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Member pairs (x, y) of a first look at group pairs (a, b): the members of each group
    with the leader of the other, and those of every group with its own leader."""
    others = members.filter("cid <> gid").select("gid", "cid")
    left = pairs.join(others, F.col("a") == F.col("gid")).select(F.col("cid").alias("x"), F.col("b").alias("y"))
    right = pairs.join(others, F.col("b") == F.col("gid")).select(F.col("a").alias("x"), F.col("cid").alias("y"))
    return pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(left).union(right).union(others.select("gid", "cid"))


def _tiled(pairs: DataFrame, rooted: DataFrame, tile: int) -> DataFrame:
    """Member pairs (x, y) of group pairs (a, b) whose classes are not connected yet.

    ``rooted`` (gid, cid, root) are all classes. Members of a group with its most frequent
    root are left out against others with that root as a whole, so a cluster with a few
    strangers costs only the strangers times its size. What is compared is cut into tiles
    of about ``tile`` members a side, so no task gets a group."""
    counts = rooted.groupBy("gid", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("gid").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    kept = materialize(rooted.join(main, "gid").select("gid", "cid", "root", "main", (F.col("root") == F.col("main")).alias("in_main")), "rooted")
    parts = kept.groupBy("gid", "in_main", "main").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = kept.join(parts.select("gid", "in_main", "tiles"), ["gid", "in_main"]).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    side = lambda df, g, names: df.select(F.col("gid").alias(g), *[F.col(c).alias(f"{c}_{g}") for c in names])
    wanted = pairs.join(side(parts, "a", ["in_main", "main", "tiles"]), "a").join(side(parts, "b", ["in_main", "main", "tiles"]), "b")
    wanted = wanted.filter("NOT (in_main_a AND in_main_b AND main_a = main_b) AND (a <> b OR in_main_a <= in_main_b)")
    for g in "ab":
        wanted = wanted.withColumn(f"i_{g}", F.explode(F.sequence(F.lit(0), F.col(f"tiles_{g}") - 1)))
    wanted = wanted.filter("a <> b OR in_main_a <> in_main_b OR i_a <= i_b").select("a", "b", "in_main_a", "in_main_b", "i_a", "i_b")
    left = side(placed, "a", ["in_main", "i", "cid", "root"])
    right = side(placed, "b", ["in_main", "i", "cid", "root"])
    met = wanted.join(left, ["a", "in_main_a", "i_a"]).join(right, ["b", "in_main_b", "i_b"])
    same = (F.col("a") == F.col("b")) & (F.col("in_main_a") == F.col("in_main_b")) & (F.col("i_a") == F.col("i_b"))
    return met.filter((F.col("root_a") != F.col("root_b")) & (~same | (F.col("cid_a") < F.col("cid_b")))).select(F.col("cid_a").alias("x"), F.col("cid_b").alias("y"))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (a, b) among pairs of member sets (x, y). The sets of candidates are made
    again from the texts where those are read: a table of fixed size tells which texts may
    be candidates, so neither the texts nor all sets are shuffled or stored."""
    expanded = materialize(pairs, "member-pairs")
    wanted = expanded.select(F.col("x").alias("rid")).union(expanded.select("y")).distinct()
    where = sets.select("rid", "doc_id", "thash").join(wanted, "rid", "left_semi")
    where = materialize(where.select(F.col("rid").alias("cid"), F.col("doc_id").alias("_id"), "thash", F.xxhash64("doc_id", "thash").alias("key")), "candidates")

    def mark(total: np.ndarray, pdf: pd.DataFrame) -> None:
        total[_cell(pdf["key"].to_numpy(dtype=np.int64), _FILTER_BITS)] = 1

    cells = docs.sparkSession.sparkContext.broadcast(_gathered(where.select("key"), mark, _FILTER_BITS) > 0)

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            rows = pa.array(np.flatnonzero(cells.value[_cell(key, _FILTER_BITS)]), pa.int64())
            sets = [shingle_set(t, width) for t in batch.column("text").take(rows).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("thash").take(rows), _lists(sets)], ["doc_id", "thash", "members"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("thash"), "text").withColumn("key", F.xxhash64("doc_id", "thash"))
    own = texts.mapInArrow(rebuilt, "doc_id long, thash long, members array<long>")
    wanted_rows = where.select("cid", "_id", F.col("thash").alias("_thash")).hint("merge")
    found = own.join(wanted_rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("thash") == F.col("_thash")))
    full = materialize(found.select("cid", "members"), "candidate-sets").dropDuplicates(["cid"])
    both = expanded.join(full.select(F.col("cid").alias("x"), F.col("members").alias("mx")).hint("merge"), "x").join(full.select(F.col("cid").alias("y"), F.col("members").alias("my")).hint("merge"), "y")
    common, sizes = F.size(F.array_intersect("mx", "my")), F.size("mx") + F.size("my")
    return both.filter((100 + percent) * common >= percent * sizes).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicate_links(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = 20, hot: int = 64, tile: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``sets`` (rows), ``members`` (sig, cid, gid, first_id: one row per distinct set) and
    ``links`` (a, b: cids that connect every component).

    Rows with equal shingle sets are one class, classes with equal prefix and size one
    group. Groups that share a prefix shingle, and pass the size and position filters,
    are candidates. In a list of more than ``hot`` groups each is first compared with the
    list's leader only, and members of a group meet their own leader and those of its
    candidates only. After that, groups of the list and members of groups that are not yet
    connected are compared pair by pair in tiles of about ``tile`` of them. So a large
    cluster of near copies costs a star, and no pair that could connect two components is
    left out.

    Joins of prefixes and sets are sort-merge joins by hint: both sides grow with the
    table, so neither is ever broadcast, and the plan is the same at every size.
    """
    sets = document_prefixes(docs, width, percent, bits)
    classes = sets.filter("n > 0").groupBy("sig", "psig", "n").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("first_id"))
    classes = materialize(classes, "classes")
    groups = materialize(classes.groupBy("psig", "n").agg(F.min("cid").alias("gid"), F.count("*").alias("n_members")), "groups")
    members = materialize(classes.join(groups, ["psig", "n"]).select("sig", "cid", "gid", "first_id"), "members")
    shared = materialize(_posted(sets, groups), "postings")
    few, many = shared.filter(F.col("df") <= hot), shared.filter(F.col("df") > hot)
    before = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.gid") < F.col("r.gid")))
    close = few.alias("l").join(few.alias("r"), (F.col("l.token") == F.col("r.token")) & before & _may_link("l", "r", percent)).select(*_pairs("l", "r"))
    star = many.select(F.struct("gid", "n", "pos").alias("l"), F.col("head").alias("r")).filter(F.col("l.gid") != F.col("r.gid")).filter(_may_link("l", "r", percent)).select(*_pairs("l", "r"))
    pairs = materialize(close.union(star).distinct(), "group-pairs")
    first = materialize(_verified(_starred(pairs, members), sets, docs, width, percent), "links")
    large = groups.filter("n_members > 1").select("gid")
    no_list = many.isEmpty()
    if no_list and large.isEmpty():
        return sets, members, first
    # a group counts as connected to another if all their classes are
    roots = components(first)
    rooted = members.join(roots, members["cid"] == roots["node"], "left").select("gid", "cid", F.coalesce("root", "cid").alias("root"))
    rooted = materialize(rooted, "roots")
    state = materialize(rooted.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")), "states")
    # pairs of groups whose leaders have met, with members that have not
    left, right = (state.select(F.col("gid").alias(g), F.col("low").alias(f"low_{g}"), F.col("high").alias(f"high_{g}")) for g in "ab")
    met = pairs.join(large.select(F.col("gid").alias("a")), "a", "left_semi").union(pairs.join(large.select(F.col("gid").alias("b")), "b", "left_semi").select("a", "b"))
    met = met.union(large.select(F.col("gid").alias("a"), F.col("gid").alias("b"))).distinct()
    rest = met.join(left, "a").join(right, "b").filter("low_a <> high_a OR low_b <> high_b OR low_a <> low_b").select("a", "b")
    if not no_list:
        rest = rest.union(_open_lists(many, state, percent, tile)).distinct()
    second = materialize(_verified(_tiled(rest, rooted, tile), sets, docs, width, percent), "links")
    return sets, members, first.union(second)


def _open_lists(many: DataFrame, state: DataFrame, percent: int, tile: int) -> DataFrame:
    """Pairs (a, b) of groups of the long lists ``many`` that are not yet connected."""
    before = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.gid") < F.col("r.gid")))
    open_ = many.join(state, "gid").withColumn("tiles", F.ceil(F.col("df") / tile).cast("int"))
    own = F.pmod(F.xxhash64("gid"), F.col("tiles")).cast("int")
    placed = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("token", "gid", "n", "pos", "low", "high", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    apart = (F.col("l.low") != F.col("r.low")) | (F.col("l.low") != F.col("l.high")) | (F.col("r.low") != F.col("r.high"))
    same_tile = (F.col("l.token") == F.col("r.token")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
    once = (F.col("l.i") == F.col("l.j")) | (F.col("l.own") != F.col("r.own"))
    return placed.alias("l").join(placed.alias("r"), same_tile & once & before & apart & _may_link("l", "r", percent)).select(*_pairs("l", "r")).distinct()


def near_duplicate_components(docs: DataFrame, width: int = 5, percent: int = 80, **options) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id``: documents are linked if
    ``100 * intersection >= percent * union`` of their sets of distinct word shingles, and
    ``component_id`` is the smallest ``doc_id`` reachable.

    Rows without words have the empty set and are linked with nothing; a null text is such
    a row. Null ids are never a component's id unless all its ids are null. Repeated rows
    stay repeated. Other columns are ignored.
    """
    sets, members, links = near_duplicate_links(docs, width, percent, **options)
    roots = components(links)
    rooted = members.join(roots, members["cid"] == roots["node"], "left").select("sig", "first_id", F.coalesce("root", "cid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("sig", "component_id")
    return sets.join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame, width: int = 5, percent: int = 80, **options) -> DataFrame:
    """One row of ``docs``, all columns, per component: the one with its smallest ``doc_id``
    (null ids last), the first of its repeats. Rows without words are linked with nothing
    and stay. Which row it is does not depend on the partitioning."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    sets, members, links = near_duplicate_links(whole, width, percent, **options)
    roots = components(links)
    rooted = members.join(roots, members["cid"] == roots["node"], "left").select("sig", "first_id", F.coalesce("root", "cid").alias("root"))
    heads = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "sig")).alias("head")).select("head.sig", "head.first_id")
    found = sets.join(heads, (sets["sig"] == heads["sig"]) & sets["doc_id"].eqNullSafe(heads["first_id"]), "left_semi")
    kept = found.groupBy("sig").agg(F.min(F.struct("thash", "rid")).alias("m")).select("m.rid")
    key = [F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2")]
    chosen = sets.filter("n > 0").join(kept, "rid", "left_semi").select(*key, "thash")
    own = whole.select("row", *key, F.xxhash64("text").alias("thash"), (~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).alias("blank"))
    found = own.filter(~F.col("blank")).join(chosen, ["k1", "k2", "thash"], "left_semi")
    repeat = F.row_number().over(W.partitionBy("k1", "k2", "thash").orderBy(F.xxhash64("row")))
    found = found.withColumn("repeat", repeat).filter("repeat = 1").drop("repeat")
    return found.select("row").union(own.filter("blank").select("row")).select("row.*")
