"""Which needles are contained in which texts, by equality joins only.

A needle that is cut at its blanks into k parts is contained in a text iff k neighbouring
parts of the text match: the first ends with the needle's first part, the last starts with
its last part, and those between are equal; a needle without a blank is a substring of one
part. So every candidate is written out as a string of the exact lengths that needles have
(their length classes), and strings are joined by equality. There is no prefix key that many
needles share, and nothing is checked afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundwork.session import materialize

#: Parts longer than this are cut into overlapping pieces before substrings are taken,
#: because a substring by position walks the characters from the start.
PIECE = 64


def length_classes(needles: DataFrame, needle: str) -> dict[int, tuple[list[int], list[int]]]:
    """Per number of parts the lengths of first and of last parts. There are at most as
    many classes as the longest needle has characters."""
    parts = needles.filter(F.length(needle) > 0).select(F.split(needle, " ", -1).alias("p"))
    shape = parts.select(F.size("p").alias("k"), F.length(F.col("p")[0]).alias("a"), F.length(F.element_at("p", -1)).alias("b"))
    rows = shape.groupBy("k").agg(F.collect_set("a").alias("a"), F.collect_set("b").alias("b")).collect()
    return {r["k"]: (sorted(r["a"]), sorted(r["b"])) for r in rows}


def _ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<int>")


def _substrings(parts: DataFrame, lengths: list[int]) -> DataFrame:
    """``part, sub`` for every substring of ``part`` with one of the lengths."""
    step = max(PIECE, lengths[-1])
    starts = F.sequence(F.lit(0), F.floor((F.length("part") - 1) / step).cast("int"))
    pieces = F.when(F.length("part") <= step, F.array("part")).otherwise(F.transform(starts, lambda j: F.substring(F.col("part"), j * step + 1, F.lit(step + lengths[-1] - 1))))
    cut = parts.select("part", F.explode(pieces).alias("piece"))
    sized = cut.withColumn("n", F.explode(F.filter(_ints(lengths), lambda n: n <= F.length("piece"))))
    spans = F.sequence(F.lit(1), F.length("piece") - F.col("n") + 1)
    return sized.select("part", F.explode(F.transform(spans, lambda i: F.substring(F.col("piece"), i, F.col("n")))).alias("sub"))


def _borders(windows: DataFrame, first: list[int], last: list[int]) -> DataFrame:
    """``part, sub`` for every end of the first and start of the last part of a window of
    parts, the parts between left whole."""
    ends = F.filter(_ints(first), lambda n: n <= F.length(F.col("w")[0]))
    heads = F.filter(_ints(last), lambda n: n <= F.length(F.element_at("w", -1)))
    left = windows.select("part", "w", F.explode(F.transform(ends, lambda n: F.when(n == 0, F.lit("")).otherwise(F.right(F.col("w")[0], n)))).alias("l"))
    both = left.select("part", "w", "l", F.explode(F.transform(heads, lambda n: F.substring(F.element_at("w", -1), F.lit(1), n))).alias("r"))
    middle = F.slice("w", 2, F.size("w") - 2)
    return both.select("part", F.array_join(F.concat(F.array("l"), middle, F.array("r")), " ").alias("sub"))


def _windows(k: int) -> Column:
    """The distinct runs of ``k`` neighbouring parts, joined by blanks."""
    starts = F.when(F.size("parts") >= k, F.sequence(F.lit(1), F.size("parts") - (k - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("parts", i, k), " ")))


def contained(hay: DataFrame, key: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """``key, needle``: the distinct pairs of a text and a non-empty needle that it contains.

    The parts and part windows of all texts form a vocabulary; each entry of it is matched
    once, and the texts join what was matched in their entries. A null text contains nothing.
    """
    classes = length_classes(needles, needle)
    sought = needles.select(F.col(needle).alias("sub"))
    out = hay.select(key, F.lit(None).cast("string").alias(needle)).limit(0)
    for k, (first, last) in sorted(classes.items()):
        parts = F.split(text, " ", -1)
        if k == 1:
            own = hay.select(key, F.explode(F.array_distinct(parts)).alias("part"))
            found = _substrings(own.select("part").distinct().filter("part <> ''"), first)
        else:
            own = hay.select(key, parts.alias("parts")).select(key, F.explode(_windows(k)).alias("part"))
            found = _borders(own.select("part").distinct().withColumn("w", F.split("part", " ", -1)), first, last)
        match = found.distinct().join(sought, "sub").distinct().select("part", F.col("sub").alias(needle))
        out = out.unionByName(own.join(match, "part").select(key, needle).distinct())
    return out


def _openings(hay: DataFrame, key: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """``_sub, _keys``: every string that a needle contained in a text can have up to its second
    blank, with the texts that hold it: substrings of one part, and an end of a part with a
    start of the next. Lengths are taken from the needles only where a part of a text is long."""
    parts = F.split(text, " ", -1)
    longest = hay.agg(F.max(F.array_max(F.transform(parts, F.length)))).first()[0] or 0
    inside, first, last = list(range(1, longest + 1)), list(range(longest + 1)), list(range(longest + 1))
    if longest > PIECE:
        classes = length_classes(needles, needle)
        inside = classes.get(1, ([], []))[0]
        first = sorted({n for k, (a, _) in classes.items() if k > 1 for n in a})
        last = classes.get(2, ([], []))[1]
    words = hay.select(key, F.explode(F.array_distinct(parts)).alias("part")).filter("part <> ''")
    within = _substrings(words.select("part").distinct(), inside) if inside else words.select("part", F.col("part").alias("sub"))
    runs = hay.select(key, parts.alias("parts")).select(key, F.explode(_windows(2)).alias("part"))
    pairs = runs.select("part").distinct().withColumn("w", F.split("part", " ", -1))
    # a needle of three and more parts has its second one whole
    across = _borders(pairs, first, last) if last else None
    whole = _borders(pairs.withColumn("w", F.array(F.col("w")[0], F.lit(""))), first, [0]).join(pairs, "part").select("part", F.concat("sub", F.col("w")[1]).alias("sub")) if first and longest > PIECE else None
    out = words.join(within.distinct(), "part")
    for more in (across, whole):
        if more is not None:
            out = out.unionByName(runs.join(more.distinct(), "part"))
    return out.groupBy(F.col("sub").alias("_sub")).agg(F.collect_set(key).alias("_keys"))


def found_in(needles: DataFrame, needle: str, hay: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``needles`` (many, any columns), once per text of ``hay`` (few) that contains
    their non-empty needle, with its ``key``. A needle meets the texts by equality of what
    stands before its second blank; only one with more parts is looked for in the texts that
    it met. What the texts offer is small and written first, so the planner can broadcast it
    and the needles then stay where they are."""
    offered = materialize(_openings(hay, key, text, needles, needle), "offered")
    texts = materialize(hay.groupBy(key).agg(F.collect_set(text).alias("_texts")), "texts")
    met = needles.withColumn("_sub", F.substring_index(needle, " ", 2)).join(offered, "_sub").withColumn(key, F.explode("_keys")).drop("_keys")
    sure = (F.col("_sub") == F.col(needle)) | F.exists("_texts", lambda t: F.contains(t, F.col(needle)))
    return met.join(texts, key).filter(sure).drop("_sub", "_texts")
