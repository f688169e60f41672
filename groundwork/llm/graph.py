"""Connected components by alternating stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundwork.llm.common import materialize
from groundwork.session import discard


def _star(edges: DataFrame) -> DataFrame:
    """``u, v`` with the least of u and its neighbours v as ``m``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the least node of the component) for every node of ``edges`` (a, b).

    Large and small stars alternate until nothing changes, which takes a number of rounds
    that is logarithmic in practice. Minima are combined before the shuffle and the joins
    leave a hub's edges splittable, so no hub is gathered in one task. Self-links keep
    their node; null ends are ignored.
    """
    links = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    current = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = materialize(current, "stars"), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        small = _star(large)
        hooked = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        last, current = current, materialize(hooked.distinct(), "stars")
        discard(last, large)
    return nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
