"""Quality rules, source mixing and sharding against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from groundwork.llm import mixing, quality, queries, sharding
from tests.llm.helpers import WORD, documents

SF = "/root/testdata/sf0.01"


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def quality_rows():
    rng = random.Random(5)
    pool = ["a", "b", "É#", "d|e", "x%%"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))) for k in range(40)]
    rows += [(100 + k, "\n".join(rng.choice(["one line", "two lines", "", " ", "\t", "three lines here"]) for _ in range(8))) for k in range(20)]
    block = " ".join(f"w{k}" for k in range(9))
    return rows + [(200, None), (201, ""), (202, " \n\x0b"), (203, f"{block} x {block} y " + " ".join(f"u{k}" for k in range(90))), (None, "word " * 30), (204, "long " * 30_000), (1, rows[1][1]), (1, "again 1")]


def test_statistics_against_brute_force(spark):
    rows = quality_rows()
    docs = documents(spark, rows, clash=True)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(1, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(docs, quality.fit(docs, labels, buckets=64))
    names = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed".split(", ")
    got = [(r["row"]["doc_id"], *[r[n] for n in names]) for r in judged.collect()]
    assert sorted(got, key=str) == sorted([(i, *statistics(t)) for i, t in rows], key=str)
    assert judged.select("row.*").columns == docs.columns
    assert judged.filter("kept AND base_failed").count() == 0
    assert quality.judge(documents(spark, []), ([0.0] * 8, 0.0)).count() == 0


def test_score_is_the_mean_log_ratio(spark):
    rows = [(k, "good clean words here " * 6) for k in range(5)] + [(10 + k, "junk junk bad junk " * 6) for k in range(9)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(4)] + [(10, 0, 0), (11, 1, 1)], "doc_id long, quality int, toxic int")
    ratios, threshold = quality.fit(docs, labels, buckets=512)
    tests = {r["doc_id"] for r in labels.filter("pmod(xxhash64(doc_id, 'fold'), 5) = 0").collect()}
    from pyspark.sql import functions as F

    words = sorted({w for _, t in rows for w in t.split()} | {"x"})
    buckets = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(512)).alias("b")).collect()}
    pairs = sorted({p for _, t in rows for p in zip(t.split(), t.split()[1:], strict=False)})
    pair_buckets = {(r["a"], r["c"]): r["b"] for r in spark.createDataFrame(pairs, "a string, c string").select("a", "c", F.pmod(F.xxhash64(F.xxhash64("a"), F.xxhash64("c")), F.lit(512)).alias("b")).collect()}
    raw, target = Counter(), Counter()
    for i, t in rows:
        w = t.split()
        found = [buckets[x] for x in w] + [pair_buckets[p] for p in zip(w, w[1:], strict=False)]
        raw.update(found)
        target.update(found if i < 4 and i not in tests else [])
    total = [sum(c.values()) + 512 for c in (raw, target)]
    expected = [math.log((target[b] + 1) / total[1]) - math.log((raw[b] + 1) / total[0]) for b in range(512)]
    assert np.allclose(ratios, expected, atol=1e-8)
    scores = {r["row"]["doc_id"]: (r["score"], r["kept"]) for r in quality.judge(docs, (ratios, threshold)).collect()}
    w = rows[0][1].split()
    own = [expected[buckets[x]] for x in w] + [expected[pair_buckets[p]] for p in zip(w, w[1:], strict=False)]
    assert math.isclose(scores[0][0], sum(own) / len(own), abs_tol=1e-8) and scores[0][0] > 0 > scores[12][0]


def test_clean_labelled_documents_stay(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op7_quality_rules"](spark, SF).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good = [r["kept"] for r in rows if labels[r["doc_id"]]["quality"] == 1]
    bad = [r["kept"] for r in rows if labels[r["doc_id"]]["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def targets(sizes, share=1.5, weights=(5, 2, 1)):
    """Resharing the excess until no target is above twice its source."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def mix_rows():
    rng = random.Random(8)
    rows = [(k, "w " * rng.randrange(0, 40), "en", rng.choice(["a", "a", "a", "b", "é", "Z", None])) for k in range(300)]
    return rows + [(500, None, "en", "a"), (501, "", "en", "empty"), (None, "x y", "en", "b"), (None, "x y z", "en", "b"), (7, rows[7][1], "en", rows[7][3]), (9, "other text", "en", "b"), (502, "w " * 20_000, "en", "huge")]


@pytest.mark.parametrize("bits", [12, 2])
def test_mix_meets_its_targets(spark, bits):
    rows = mix_rows()
    got = [tuple(r) for r in mixing.taken_words(documents(spark, rows, clash=True), bucket_bits=bits).collect()]
    assert sorted((r[0], r[1]) for r in got if r[0] is not None) == sorted((r[0], len((r[1] or "").split())) for r in rows if r[0] is not None)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    wanted = targets(sizes)
    assert {(r[2], round(r[3], 6)) for r in got} == {(sizes[s], round(t, 6)) for s, t in wanted.items()}
    assert all(0 <= r[4] <= 2 * r[1] for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r[3]] += r[4]
    for t, n in taken.items():
        assert abs(n - t * len([s for s in wanted if wanted[s] == t])) <= 3  # equal rows share a cut evenly
    again = documents(spark, rows).repartition(7)
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in mixing.taken_words(again, bucket_bits=bits).collect())
    assert mixing.taken_words(documents(spark, [])).count() == 0


def test_mixed_documents_stay_whole(spark):
    rows = mix_rows()
    docs = documents(spark, rows, clash=True)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    assert set(got) <= {(r[0], r[1], r[3]) for r in rows} and max(got.values()) <= 4
    taken = defaultdict(int)
    for (_, text, source), n in got.items():
        taken[source] += n * len((text or "").split())
    sizes, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len((r[1] or "").split())
        sizes[r[3]] += n
        longest[r[3]] = max(longest[r[3]], 2 * n)
    for s, t in targets(sizes).items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1


def shard_rows():
    rng = random.Random(2)
    rows = [(k, "t%d " % k * rng.randrange(1, 60)) for k in range(900)]
    rows += [(5000 + k, "the same text in a third of all rows") for k in range(450)]
    return rows + [(9000, None), (9001, ""), (None, "null id"), (None, "null id"), (3, rows[3][1]), (9002, "ö" * 40_000)]


def test_shards_balance_and_slots_are_gapless(spark):
    rows = shard_rows()
    docs = documents(spark, rows, clash=True)
    plan = sharding.shard_plan(docs, shards=8, pieces=64)
    got = sharding.sharded(docs, plan, ["doc_id"], pieces=64).collect()
    assert len(got) == len(rows)
    slots, size, count = defaultdict(list), Counter(), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        count[r["shard"]] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(8))
    assert sum(size.values()) == sum(len((t or "").encode()) + 8 for _, t in rows)
    most = max(len((t or "").encode()) for _, t in rows)
    mean = sum(size.values()) / 8
    assert max(size.values()) <= 1.1 * max(mean, most + 8)
    small = defaultdict(set)
    for r in got:
        small[r["text_crc32"], r["doc_id"] == 9000].add(r["shard"])  # null and empty texts have one checksum
    assert sum(len(v) > 1 for v in small.values()) <= 1  # only the hot group is split


def test_shards_of_the_whole_table(spark):
    got = queries.QUERIES["op9_shard"](spark, SF).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(size) == 24 and max(size.values()) <= 1.1 * min(size.values())
    docs = documents(spark, [])
    assert sharding.shard_documents(docs).count() == 0
    out = sharding.shard_documents(documents(spark, [(1, "a"), (1, "a"), (2, None)], clash=True), shards=3)
    assert out.count() == 3 and out.columns.count("shard") == out.columns.count("slot") == 1


def test_packing_takes_the_best_dot_product():
    items = np.array([[0.5, 0.1], [0.1, 0.5], [0.4, 0.4]])
    assert sorted(np.bincount(sharding.pack(items, 3))) == [1, 1, 1]
