import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from groundwork.operators import dedup as D, hamming as M
from groundwork.session import materialize


def sequential(rows, limit=3, ratio=0.90):
    accepted, near = [], {}
    for order, length, value in sorted(rows):
        hit = any(min(length, l) / max(length, l) >= ratio and bin((value ^ v) & (2**64 - 1)).count("1") <= limit for _, l, v in accepted)
        near[order] = hit
        if not hit:
            accepted.append((order, length, value))
    return near


def crowd(seed, n):
    rng, rows = random.Random(seed), []
    centers = [rng.getrandbits(64) for _ in range(6)]
    for i in range(n):
        value = rng.choice(centers)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            value ^= 1 << rng.randrange(64)
        rows.append((i, rng.choice([90, 95, 99, 100, 101, 110, 111, 200]), value if value < 2**63 else value - 2**64))
    return rows


@pytest.mark.parametrize("seed,group_limit", [(1, 1024), (2, 1024), (3, 40)])
def test_greedy_equals_sequential_scan(spark, seed, group_limit):
    rows = crowd(seed, 250)
    df = spark.createDataFrame(rows, "ord long, canon_len int, simhash long").repartition(seed + 1)
    got = {r["ord"]: r["near"] for r in D.near_dup_greedy(df, group_limit=group_limit).collect()}
    assert got == sequential(rows)


def test_pairs_are_complete_and_unique(spark):
    rows = crowd(9, 200)
    df = spark.createDataFrame(rows, "ord long, canon_len int, simhash long")
    classes = D.similarity_classes(df)
    nodes = [(r["ord"], r["canon_len"], r["simhash"]) for r in classes.collect()]
    want = {(a[0], b[0]) for a in nodes for b in nodes if a[0] < b[0] and min(a[1], b[1]) / max(a[1], b[1]) >= 0.9 and bin((a[2] ^ b[2]) & (2**64 - 1)).count("1") <= 3}
    got = [(r["src"], r["dst"]) for r in D.near_pairs(classes).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("limit", [16, 1000])
def test_pairs_do_not_depend_on_refinement(spark, limit):
    classes = D.similarity_classes(spark.createDataFrame(crowd(4, 260), "ord long, canon_len int, simhash long"))
    want = {tuple(r) for r in D.near_pairs(classes).collect()}
    got = [tuple(r) for r in D.near_pairs(classes, group_limit=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_distant_classes_with_one_key_are_told_apart_by_refined_keys(spark):
    # a number twice and check bits that change in two places with every bit: four bits apart
    checks = [v for v in range(64) if bin(v).count("1") >= 2][:15]

    def tail(i):
        check = 0
        for b in range(15):
            check ^= checks[b] if i >> b & 1 else 0
        return i << 21 | i << 6 | check

    rows = [(i, 100, (0x5A5A5A5 << 36 | tail(i)) - (1 << 64 if 0x5A5A5A5 >> 27 else 0)) for i in range(20_000)]
    assert D._leaves(spark.createDataFrame(rows, "ord long, canon_len int, simhash long"), 3, 256).dense.isEmpty()
    got = D.near_dup_greedy(spark.createDataFrame(rows, "ord long, canon_len int, simhash long"))
    assert got.count() == 20_000 and got.filter("near").count() == 0


def test_true_clusters_equal_the_scan(spark):
    rng = random.Random(12)
    rows = [(i, 100, 0x123456789ABC0000 | v) for i, v in enumerate(rng.sample(range(1 << 12), 500))]
    df = spark.createDataFrame(rows, "ord long, canon_len int, simhash long")
    assert {r["ord"]: r["near"] for r in D.near_dup_greedy(df, group_limit=32).collect()} == sequential(rows)


def test_widths_in_one_pass(spark):
    texts = ["", "one", "one two", "the quick brown fox jumps over", "a b c d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, canonical string")
    got = {r["ord"]: r for r in D.simhash_widths(df, ["ord"], "canonical", [1, 3]).collect()}
    for n in (1, 3):
        one = {r["ord"]: r["simhash"] for r in D.simhash64(df, ["ord"], "canonical", n).collect()}
        assert {i: r[f"h{n}"] for i, r in got.items()} == one


def python_simhash(text):
    words = re.findall(r"[^\W_]+", text.lower())
    grams = words if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    votes = [0] * 64
    for g in grams:
        n = int.from_bytes(hashlib.sha256(g.encode()).digest()[:8], "big")
        for b in range(64):
            votes[b] += 1 if n >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] >= 0)


def test_simhash_definition(spark):
    texts = ["", "one", "one two", "The quick brown fox jumps over the lazy dog", "Lưỡi đỏ rêu vàng, chóng mặt"]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, canonical string")
    got = {r["ord"]: r["simhash"] & (2**64 - 1) for r in D.simhash64(df, ["ord"], "canonical").collect()}
    assert got == {i: python_simhash(t) for i, t in enumerate(texts)}


def test_ingest_counts(spark):
    text = "a long enough text about one patient with many words in it"
    rows = [(0, text, False), (1, text, False), (2, text.replace("patient", "doctor and nurse"), False), (3, "", True)]
    df = spark.createDataFrame(rows, "ord long, canonical string, empty boolean").selectExpr("*", "length(canonical) as canon_len", "sha2(canonical, 256) as content_sha256")
    stats = D.ingest_stats(df, D.dedup_verdicts(df.filter("not empty"))).first().asDict()
    assert stats == {"accepted": 2, "exact_duplicate": 1, "near_duplicate": 0, "empty": 1}


def test_copy_of_a_near_rejected_row_counts_as_near(spark):
    records = spark.createDataFrame([(0, False), (1, False), (2, False)], "ord long, empty boolean")
    verdicts = spark.createDataFrame([(0, False, 1), (1, True, 2)], "ord long, near boolean, copies long")
    assert D.ingest_stats(records, verdicts).first().asDict() == {"accepted": 1, "exact_duplicate": 0, "near_duplicate": 2, "empty": 0}


def test_cap_stops_after_n_accepted(spark):
    rows = spark.range(10).withColumnRenamed("id", "ord")
    verdicts = spark.createDataFrame([(i, i in (1, 4)) for i in range(10)], "ord long, near boolean")
    assert D.cap_accepted(rows, verdicts, 3).count() == 4
    assert D.cap_accepted(rows, verdicts, 99).count() == 10


def test_merge_keeps_first_input(spark):
    schema = "ord long, source string, task string, case_text string, content_sha256 string"
    a = spark.createDataFrame([(0, "a", "t", "x", "h1"), (1, "a", "t", "", "h9")], schema)
    b = spark.createDataFrame([(0, "b", "t", "x", "h1"), (1, "b", "t", "y", "h2")], schema)
    kept, counts = D.merge_sources([a, b])
    assert {(r["source"], r["content_sha256"]) for r in kept.collect()} == {("a", "h1"), ("b", "h2")}
    assert {r["source"]: (r["records"], r["skipped"]) for r in counts.collect()} == {"a": (1, 0), "b": (1, 1)}


def test_merge_counts_make_each_text_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def digest(text):
        made.add(1)
        return text and text.upper()

    frames = [spark.createDataFrame([(i, f"s{k}", "text", "t%d" % (i % 7) if i % 5 else "") for i in range(40)], "ord long, source string, task string, case_text string") for k in range(2)]
    kept, counts = D.merge_sources([f.withColumn("content_sha256", digest("case_text")) for f in frames])
    assert sorted(map(tuple, counts.collect())) == [("s0", "text", 7, 25), ("s1", "text", 0, 32)]
    assert made.value == 80
    assert sorted((r["input_ord"], r["ord"]) for r in kept.collect()) == [(0, i) for i in (1, 2, 3, 4, 6, 7, 12)]


def test_votes_of_long_lists_equal_a_count(spark):
    import numpy as np
    import pyarrow as pa

    from groundwork.functions import hashing as H

    rng = np.random.default_rng(4)
    sizes = [0, 1, 254, 255, 256, 510, 511, 70_000, 3, 0]
    lists = [[int(x) for x in rng.integers(-(2**63), 2**63 - 1, n) | (0xF0F if n > 255 else 0)] for n in sizes]
    want = [-1 if not l else sum(1 << b for b in range(64) if 2 * int(((np.array(l) >> b) & 1).sum()) >= len(l)) for l in lists]
    got = H._majority(pa.array([l + [None] for l in lists], pa.list_(pa.int64())))
    assert [int(x) & (2**64 - 1) for x in got] == [w & (2**64 - 1) for w in want]


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in D.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_signature_pairs_brute_force(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(256) for _ in range(4)]
    rows = []
    for i in range(60):
        value = rng.choice(base)
        for _ in range(rng.randrange(12)):
            value ^= 1 << rng.randrange(256)
        rows.append((i, f"{value:064x}", rng.choice(["p", "q"])))
    df = spark.createDataFrame(rows, "ord long, sig string, bin string")
    got = {tuple(sorted((r["src"], r["dst"]))) for r in D.signature_pairs(df, "sig", "bin", "ord").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and bin(int(a[1], 16) ^ int(b[1], 16)).count("1") <= 8}
    assert want >= got
    crowded = D.signature_pairs(df, "sig", "bin", "ord", group_limit=3).collect()
    assert {tuple(sorted((r["src"], r["dst"]))) for r in crowded} == got and len(crowded) == len(got)
    parts = lambda pairs: {frozenset(c) for c in _groups(pairs)}
    assert parts(got) == parts(want)


def _groups(pairs):
    groups = []
    for a, b in pairs:
        hit = [g for g in groups if a in g or b in g]
        merged = set().union({a, b}, *hit)
        groups = [g for g in groups if g not in hit] + [merged]
    return groups


def test_refined_rows_do_not_carry_the_digits(spark):
    rows = spark.createDataFrame([(i, f"{i:016x}") for i in range(20)], "ord long, _hex string").select("ord", "_hex", M.words_of(F.col("_hex"), 16).alias("_words"))
    leaves = M.refine(rows, "_hex", 3)
    assert sorted(leaves.small.columns) == ["_gid", "_skip", "_words", "ord"]
    got = {(r[0], r[1]) for r in M.pairs_within(leaves, F.col("a.ord") < F.col("b.ord"), 3).select("a.ord", "b.ord").collect()}
    assert got == {(a, b) for a in range(20) for b in range(a + 1, 20) if bin(a ^ b).count("1") <= 3}


def test_keys_of_refined_rows_are_told_from_their_longs(spark, monkeypatch):
    rng, written = random.Random(11), []
    monkeypatch.setattr(M, "materialize", lambda df, name: written.append(materialize(df, name)) or written[-1])
    for digits, distance in ((16, 3), (20, 2), (64, 8)):
        base = rng.getrandbits(4 * digits)
        values = [base ^ sum(1 << b for b in {rng.randrange(4 * digits) for _ in range(rng.randrange(1, 5))}) for _ in range(50)]
        df = spark.createDataFrame([(i, f"{v:0{digits}x}") for i, v in enumerate(values)] + [(99, None)], "ord long, _hex string")
        leaves = M.refine(df.withColumn("_words", M.words_of(F.col("_hex"), digits)), "_hex", distance, limit=6)
        got = [tuple(r) for r in M.pairs_within(leaves, F.col("a.ord") < F.col("b.ord"), distance, 6).select("a.ord", "b.ord").collect()]
        want = [(i, j) for i in range(50) for j in range(i + 1, 50) if (values[i] ^ values[j]).bit_count() <= distance]
        assert sorted(got) == want
    # no digits and no lists of pieces are written: a letter per level
    assert all("_rest" not in df.columns and dict(df.dtypes)["_skip"] == "string" for df in written) and len(written) > 3
    assert {len(r["_skip"]) for r in written[0].collect()} == {1}


def test_written_tables_leave_no_shuffle_files(spark):
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    stored = lambda: {f for f in map(str, files().toString().split(", ")) if "shuffle_" in f}
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    before = stored()
    counted = materialize(spark.range(5000).selectExpr("id % 700 as k").groupBy("k").count().repartition(3, "k"), "counted")
    assert not stored() - before and counted.count() == 700


def test_simhash_is_computed_without_a_shuffle(spark):
    words = [f"w{i % 977}" for i in range(70_000)]  # more votes than are laid out at a time
    texts = ["", None, "one", "a b c d", " ".join(words), "the quick brown fox", " ".join(words[:9])]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, canonical string").coalesce(1)
    out = D.simhash64(df, ["ord"], "canonical")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["ord"]: r["simhash"] & (2**64 - 1) for r in out.collect()} == {i: python_simhash(t or "") for i, t in enumerate(texts)}


def test_clusters_are_not_copied_at_every_level(spark):
    # 40 rows that differ in their last digit only: no key tells them apart
    rows = spark.createDataFrame([(i, "ab" * 30 + f"{i:04x}") for i in range(40)], "ord long, _hex string")
    leaves = M.refine(rows.select("*", M.words_of(F.col("_hex"), 64).alias("_words")), "_hex", 8, limit=8)
    assert leaves.small.count() + leaves.dense.count() < 40 * 9**3 * 2
    got = [tuple(r) for r in M.pairs_within(leaves, F.col("a.ord") < F.col("b.ord"), 8, 8).select("a.ord", "b.ord").collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2
