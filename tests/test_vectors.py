import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.operators import vectors as V
from groundwork.operators.joins import top_k


def signed(spark, n=400):
    rnd = random.Random(5)
    centres = [[rnd.choice((rnd.random(), rnd.random() * 0.1)) for _ in V.NAMES] for _ in range(12)]
    base = [[abs(c + rnd.gauss(0, 0.02)) for c in rnd.choice(centres)] for _ in range(n)]
    base[7] = base[8] = base[9]  # copies
    rows = [(i, rnd.randrange(5), *d) for i, d in enumerate(base)]
    df = spark.createDataFrame(rows, "query_id long, label int, " + ", ".join(f"{n} double" for n in V.NAMES))
    hashed = df.withColumns({"top_hash": F.concat(F.lit("t"), "query_id"), "bottom_hash": F.when(F.col("label") < 2, F.concat(F.lit("b"), "label")).otherwise(F.concat(F.lit("q"), "query_id"))})
    return hashed.cache()


def pairs(df):
    side = lambda name: df.select(F.struct("*").alias(name))
    return side("q").crossJoin(side("r")).withColumn("sim", V.mixed_similarity("q", "r"))


def picked(monkeypatch, run):
    """The block function of a search, and how many pairs it compares on given frames."""
    held = {}
    monkeypatch.setattr(V, "_block_topk", lambda q, r, schema, pick: held.update(q=V.with_categories(q).toPandas(), r=V.with_categories(r).toPandas(), pick=pick) or q.sparkSession.createDataFrame([], schema))
    run()
    compared, rough = [], V._Block.rough
    monkeypatch.setattr(V._Block, "rough", lambda self, rows, cols: compared.append(len(rows) * len(cols)) or rough(self, rows, cols))
    held["pick"](held["q"], held["r"])
    return sum(compared) / (len(held["q"]) * len(held["r"]))


def test_vector_topk_equals_all_pairs_and_leaves_most_out(spark, monkeypatch):
    df = signed(spark)
    refs = df.withColumnRenamed("query_id", "ref_id").withColumn("key", F.concat_ws(":", "label", F.floor(F.col("r") * 20)))
    monkeypatch.setattr(V, "QUERY_BLOCK", 150)
    monkeypatch.setattr(V, "REF_BLOCK", 130)
    got = {(r["query"], r["ref"], r["similarity"], r["rank"]) for r in V.vector_topk(df, refs).collect()}
    s = pairs(df).select(F.col("q.query_id").alias("query"), F.col("r.query_id").alias("ref"), F.concat_ws(":", "r.label", F.floor(F.col("r.r") * 20)).alias("key"), (F.floor(F.col("sim") * 1000 + 0.5) / 1000).alias("similarity"))
    best = top_k(s, ["query", "key"], [F.desc("similarity"), F.asc("ref")], 1, "_d")
    want = {(r["query"], r["ref"], r["similarity"], r["rank"]) for r in top_k(best, ["query"], [F.desc("similarity"), F.asc("ref")], 3).collect()}
    assert got == want
    one_key = refs.withColumn("key", F.lit("k"))
    assert V.vector_topk(df, one_key).count() == 400
    assert picked(monkeypatch, lambda: V.vector_topk(df, refs)) < 0.6


def test_learned_topk_equals_all_pairs_and_leaves_most_out(spark, monkeypatch):
    df = signed(spark)
    known = df.withColumnRenamed("query_id", "knowledge_id").withColumn("approved_at", F.col("knowledge_id") % 50)
    monkeypatch.setattr(V, "QUERY_BLOCK", 150)
    monkeypatch.setattr(V, "REF_BLOCK", 130)
    got = {(r["query"], r["knowledge_id"], r["exact"], r["similarity"], r["rank"]) for r in V.learned_topk(df, known.filter("label < 3"), known.filter("label >= 3"), 4).collect()}
    t, b = F.col("q.top_hash") == F.col("r.top_hash"), F.col("q.bottom_hash") == F.col("r.bottom_hash")
    raw = F.least(F.lit(1.0), F.when(t, 0.35).otherwise(0.0) + F.when(b, 0.10).otherwise(0.0) + F.when(t, 0.55).otherwise(1.0) * F.col("sim"))
    s = pairs(df).select(F.col("q.query_id").alias("query"), F.col("r.query_id").alias("id"), (t | b).alias("exact"), raw.alias("raw"), (F.col("r.query_id") % 50).alias("at"), "sim").filter("exact or sim >= 0.45")
    best = top_k(s, ["query"], [F.desc("exact"), F.desc("raw"), F.desc("at"), F.asc("id")], 4)
    want = {(r["query"], r["id"], r["exact"], r["similarity"], r["rank"]) for r in best.withColumn("similarity", F.round("raw", 4)).collect()}
    assert got == want
    assert picked(monkeypatch, lambda: V.learned_topk(df, known.filter("label < 3"), known.filter("label >= 3"), 4)) < 0.6


@pytest.mark.parametrize("size", [1.0, 1e6])
def test_rough_similarity_stays_within_its_error(spark, size):
    df = V.with_categories(signed(spark, 60).withColumns({n: F.col(n) * size for n in V.NAMES})).toPandas()
    block = V._Block(df, df)
    for row in range(60):
        exact = block.exact(np.full(60, row), np.arange(60))
        assert np.abs(np.clip(block.rough(np.array([row]), np.arange(60))[0], 0, 1) - exact).max() <= V.ERROR
