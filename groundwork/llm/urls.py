"""URL filters: longest-match rules, else a character Markov likelihood ratio, on SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundwork.llm.common import ascii_lower, materialize

_PAD = "\x01"


@dataclass(frozen=True)
class Settings:
    """Contexts of 0 to ``order`` characters; ``prior`` is the weight of the shorter
    context; one in ``folds`` of the distinct labelled URLs calibrates the threshold, in
    steps of ``step``. Log ratios are summed in units of 1/``unit``, so that a score does
    not depend on the order of its terms."""

    order: int = 3
    prior: float = 2.0
    folds: int = 5
    step: float = 0.01
    unit: int = 1 << 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or lacks ``://``."""
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return ascii_lower(part(1)), part(2)


def longest_rule(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """Rule and verdict of the longest of ``rules`` (verdict, host with path) that fits: its
    host is the URL's or a parent domain of it, and the URL's path starts with its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((F.col(host) == own) | F.col(host).endswith("." + own)) & F.col(path).startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _key(url: Column) -> dict[str, Column]:
    return {"h1": F.xxhash64(url), "h2": F.xxhash64(F.lit(1), url)}


def distinct_urls(labelled: DataFrame) -> DataFrame:
    """``h1, h2, url, n_allow, n_block``: each non-empty URL once, with its rows per verdict."""
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    known = labelled.filter("url <> ''").select("url", "verdict")
    return known.groupBy("url").agg(count("allow").alias("n_allow"), count("block").alias("n_block")).withColumns(_key(F.col("url")))


def _held_out(s: Settings) -> Column:
    return F.pmod("h1", F.lit(s.folds)) == 0


def _with_gram(urls: DataFrame, s: Settings, *keep: str) -> DataFrame:
    """One row per character: the columns ``keep`` and ``gram``, the ``order`` characters
    before it with itself. It holds the shorter n-grams as its ends."""
    text = F.concat(F.lit(_PAD * s.order), ascii_lower(F.col("url")))
    at = lambda i: F.concat(*[F.get(F.col("_chars"), i + k) for k in range(s.order + 1)])
    chars = urls.select(*keep, F.split(text, "").alias("_chars"))
    return chars.select(*keep, F.explode(F.transform(F.sequence(F.lit(0), F.size("_chars") - s.order - 1), at)).alias("gram"))


def gram_weights(urls: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``gram, weight``: for every n-gram of full length in ``distinct_urls`` the log ratio of
    its last character's probabilities after accepted and after rejected contexts.

    The probabilities come from exact counts per class over all labelled URLs that are not
    held out. From the shortest context on, p = (count + prior * p of the shorter context)
    / (count of the context + prior), starting from 1/256. All tables are aggregates whose
    sizes follow the number of distinct n-grams; a window holds the next characters of
    one context only.
    """
    seen = lambda n: F.when(_held_out(s), 0).otherwise(F.col(n)).alias(n)
    taught = _with_gram(urls.select("url", seen("n_allow"), seen("n_block")), s, "n_allow", "n_block")
    sums = [F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")]
    full = materialize(taught.groupBy("gram").agg(*sums), "url-grams")
    below = None
    for k in range(1, s.order + 2):
        context = W.partitionBy(F.left("gram", F.lit(k - 1)))
        level = full.groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(*sums)
        for n in ("allow", "block"):
            level = level.withColumn(f"all_{n}", F.sum(f"n_{n}").over(context))
        if below is not None:
            level = level.withColumn("end", F.right("gram", F.lit(k - 1))).join(below, "end")
        p = {n: (F.col(f"n_{n}") + s.prior * (F.lit(1.0 / 256) if below is None else F.col(f"p_{n}"))) / (F.col(f"all_{n}") + s.prior) for n in ("allow", "block")}
        level = level.select("gram", *[c.alias(f"p_{n}") for n, c in p.items()])
        below = level.withColumnRenamed("gram", "end")
    ratio = F.ln("p_allow") - F.ln("p_block")
    return materialize(level.select("gram", F.round(ratio * s.unit).cast("bigint").alias("weight")), "url-weights")


def url_scores(urls: DataFrame, weights: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``h1, h2, score``: mean log ratio of accepted to rejected over a URL's characters.

    Characters meet their weights by an equality join; a frequent n-gram such as a
    scheme's is split by the skew join, or the weights are broadcast while they are small.
    """
    met = _with_gram(urls, s, "h1", "h2").join(weights, "gram")
    return met.groupBy("h1", "h2").agg((F.sum("weight") / F.lit(float(s.unit)) / F.count("*")).alias("score"))


def calibrated(urls: DataFrame, scores: DataFrame, s: Settings = Settings()) -> float:
    """The threshold with the best mean of both classes' accuracy on the held-out URLs, the
    nearest to 0 of equals; without both classes it is 0. Scores are counted in at most
    4,001 steps."""
    step = F.greatest(F.least(F.floor(F.col("score") / s.step), F.lit(2000)), F.lit(-2000)).cast("int")
    held = urls.filter(_held_out(s) & (F.col("n_allow") + F.col("n_block") > 0)).join(scores, ["h1", "h2"])
    bins = held.groupBy(step.alias("bin")).agg(F.sum("n_allow").alias("allow"), F.sum("n_block").alias("block")).collect()
    n = {v: sum(r[v] for r in bins) for v in ("allow", "block")}
    if not all(n.values()):
        return 0.0
    passed = lambda v, t: sum(r[v] for r in bins if r["bin"] >= t) / n[v]
    best = max(sorted({0, *(r["bin"] for r in bins)}), key=lambda t: (passed("allow", t) - passed("block", t), -abs(t)))
    return best * s.step


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], s: Settings = Settings()) -> DataFrame:
    """Per row ``page_id, host, path, rule, verdict, score``.

    Where a rule fits, the longest decides. The URLs that rules decide teach the model
    which decides the others: ``allow`` if the score reaches the calibrated threshold. A
    null or empty URL has no score and is blocked. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(rules)
    ruled = parsed.withColumns({"rule": rule, "verdict": verdict})
    urls = materialize(distinct_urls(ruled), "urls")
    scores = materialize(url_scores(urls, gram_weights(urls, s), s), "url-scores")
    own = F.when(F.col("score") >= calibrated(urls, scores, s), F.lit("allow")).otherwise(F.lit("block"))
    scored = ruled.withColumns(_key(F.col("url"))).join(scores, ["h1", "h2"], "left")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
