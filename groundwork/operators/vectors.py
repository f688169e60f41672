"""Feature-vector similarity, class profiles, top-k search and batch scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from groundwork.operators.joins import top_k

# Signature dimensions with weight and scale.
DIMENSIONS = [
    ("r", 0.06, 1.0), ("g", 0.05, 1.0), ("b", 0.05, 1.0), ("s", 0.07, 1.0), ("v", 0.06, 1.0), ("purple", 0.13, 0.35),
    ("white", 0.13, 0.55), ("yellow", 0.12, 0.40), ("dark", 0.08, 0.12), ("spot", 0.08, 0.55), ("aspect", 0.08, 1.4), ("coverage", 0.09, 0.75),
]
NAMES = [n for n, _, _ in DIMENSIONS]
# Weights of the five categories and of the two similarity parts.
CATEGORY_WEIGHTS = [("tongue", 0.3), ("coat", 0.3), ("thick", 0.2), ("fissure", 0.1), ("spots", 0.1)]
NUMERIC_SHARE, CATEGORY_SHARE = 0.82, 0.18
#: Queries and references of one task, pairs compared at once, references of which only the
#: best value is looked at first, and the error allowed to single precision.
QUERY_BLOCK, REF_BLOCK, PAIRS, CHUNK, ERROR = 8192, 16384, 2**18, 128, 1e-4


def validate_vector(vector: Column, low: float, high: float) -> Column:
    """The vector when every component is finite and in range, else null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= low) & (x <= high))
    return F.when(F.coalesce(fine, F.lit(False)), vector)


def coarse_category(c=F.col) -> dict[str, Column]:
    """Five categories by ordered thresholds. ``c`` maps a dimension name to a column."""
    r, g, s, v = c("r"), c("g"), c("s"), c("v")
    white, yellow = c("white"), c("yellow")
    tongue = F.when(c("purple") > 0.13, "tím").when((r > g * 1.24) & (s > 0.34), "đỏ").when((s < 0.22) & (v > 0.60), "nhợt").otherwise("đỏ nhạt")
    coat = F.when((yellow > 0.075) & (yellow > white * 0.55), "vàng").when(white > 0.10, "trắng").otherwise("ít rêu")
    cover = F.greatest(white, yellow)
    thick = F.when(cover > 0.34, "dày").when(cover > 0.15, "mỏng").otherwise("rất mỏng")
    return {"tongue": tongue, "coat": coat, "thick": thick, "fissure": c("dark") > 0.025, "spots": c("spot") > 0.055}


def mixed_similarity(a: str, b: str) -> Column:
    """Similarity of two signature structs: weighted clipped differences and agreement
    of the coarse categories."""
    left, right = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    distance, total = F.lit(0.0), 0.0
    for name, weight, scale in DIMENSIONS:
        distance = distance + weight * F.least(F.lit(1.0), F.abs(left(name) - right(name)) / scale)
        total += weight
    ca, cb = coarse_category(left), coarse_category(right)
    category = F.lit(0.0)
    for name, weight in CATEGORY_WEIGHTS:
        category = category + F.when(ca[name] == cb[name], weight).otherwise(0.0)
    value = (1 - distance / total) * NUMERIC_SHARE + category * CATEGORY_SHARE
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def with_categories(df: DataFrame) -> DataFrame:
    """The five categories as one string."""
    values = coarse_category()
    return df.withColumn("_cats", F.concat_ws("|", *[F.coalesce(values[n].cast("string"), F.lit("")) for n, _ in CATEGORY_WEIGHTS]))


class _Block:
    """Queries and references of one task. ``rough`` has similarities in single precision,
    ``exact`` those of chosen pairs by the formula of ``mixed_similarity``. ``bound[c]`` is the
    most that a query of category c can have in common with each reference."""

    def __init__(self, queries: pd.DataFrame, refs: pd.DataFrame):
        cats, codes = np.unique(np.concatenate([queries["_cats"].to_numpy(dtype=str), refs["_cats"].to_numpy(dtype=str)]), return_inverse=True)
        parts = [c.split("|") for c in cats]
        self.agreement = np.zeros((len(cats), len(cats)))
        for i, (_, weight) in enumerate(CATEGORY_WEIGHTS):
            values = np.array([p[i] for p in parts])
            self.agreement += np.where(values[:, None] == values[None, :], weight, 0.0)
        self.q_cat, self.r_cat = codes[: len(queries)], codes[len(queries) :]
        self.q, self.r = (x[NAMES].to_numpy(dtype=float) for x in (queries, refs))
        self.total = sum(w for _, w, _ in DIMENSIONS)
        weight, scale = (np.array([d[i] for d in DIMENSIONS]) for i in (1, 2))
        share = NUMERIC_SHARE * weight / self.total
        small = [x * (share / scale) for x in (self.q, self.r)]
        # single precision holds ERROR for values of this size only
        kind = np.float32 if all((np.abs(x) < 16).all() for x in small) else np.float64
        self.most, self.q_small, self.r_small = share.astype(kind), small[0].astype(kind), np.ascontiguousarray(small[1].astype(kind).T)
        self.bound = (NUMERIC_SHARE + CATEGORY_SHARE * self.agreement).astype(kind)[:, self.r_cat]
        self.numbers = np.isfinite(self.q).all() and np.isfinite(self.r).all()

    def groups(self, chosen: np.ndarray, codes: np.ndarray, width):
        """The chosen queries in slices of one category and one code each, which make about
        PAIRS pairs with ``width(query)`` references."""
        chosen = chosen[np.lexsort((codes[chosen], self.q_cat[chosen]))]
        edges = np.flatnonzero((np.diff(self.q_cat[chosen]) != 0) | (np.diff(codes[chosen]) != 0)) + 1
        for one in np.split(chosen, edges) if len(chosen) else []:
            step = max(1, PAIRS // max(1, width(one[0])))
            yield from (one[i : i + step] for i in range(0, len(one), step))

    def rough(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Rough similarities of queries of one category (rows) to references (columns)."""
        sims = np.repeat(self.bound[self.q_cat[rows[0]], cols][None, :], len(rows), axis=0)
        refs, gap = self.r_small[:, cols], np.empty_like(sims)
        for i, most in enumerate(self.most):
            np.subtract(self.q_small[rows, i, None], refs[i], out=gap)
            np.abs(gap, out=gap)
            np.minimum(gap, most, out=gap)
            np.subtract(sims, gap, out=sims)
        return sims if self.numbers else np.nan_to_num(sims, copy=False, nan=-1.0)

    def exact(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        distance = np.zeros(len(rows))
        for i, (_, weight, scale) in enumerate(DIMENSIONS):
            distance += weight * np.minimum(1.0, np.abs(self.q[rows, i] - self.r[cols, i]) / scale)
        value = (1 - distance / self.total) * NUMERIC_SHARE + self.agreement[self.q_cat[rows], self.r_cat[cols]] * CATEGORY_SHARE
        return np.clip(value, 0.0, 1.0)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, minus infinity if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf, dtype=values.dtype)
    return -np.partition(-values, k - 1, axis=1)[:, k - 1]


def _ranks(rows: np.ndarray) -> np.ndarray:
    """Place of each element in its run of equal, sorted ``rows``."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, dtype=int)
    return np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))


def _block_topk(queries: DataFrame, refs: DataFrame, schema: str, pick) -> DataFrame:
    """Compares every query with every reference in blocks: queries and references are
    dealt by hash, and each task gets one block of both. A task emits
    ``pick(queries, references)``, a few rows per query, never the pairs.
    The number of blocks follows the row counts, so a task's share stays the same."""
    q, r = with_categories(queries), with_categories(refs)
    blocks, slices = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-r.count() // REF_BLOCK))
    dealt = lambda names, n: F.pmod(F.xxhash64(*names), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("_block", dealt(queries.columns, blocks)).withColumn("_slice", every(slices))
    right = r.withColumn("_slice", dealt(refs.columns, slices)).withColumn("_block", every(blocks))
    # one partition per pair of blocks: AQE would put small ones together in one task
    keys = ["_block", "_slice"]
    left, right = (x.repartition(max(blocks * slices, 1), *keys) for x in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pick, schema)


def _codes(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Two columns as numbers that are equal where the values are."""
    codes = pd.factorize(pd.concat([left, right], ignore_index=True))[0].astype(np.int32)
    return codes[: len(left)], codes[len(left) :]


def _frame(block: pd.DataFrame, query: str, found: list[tuple], names: list[str]) -> pd.DataFrame:
    """The rows found in the passes: query number first, then the columns ``names``."""
    rows, *columns = [np.concatenate(c) for c in zip(*found)]
    return pd.DataFrame({"query": block[query].to_numpy()[rows]} | dict(zip(names, columns)))


def vector_topk(queries: DataFrame, refs: DataFrame, k: int = 3, query: str = "query_id", ref: str = "ref_id", key: str = "key") -> DataFrame:
    """Exact top-k references per query by similarity rounded to three digits, distinct
    on ``key``, ties in ``ref`` order. Columns query, ref, key, similarity, rank.

    Pairs are compared in single precision, those of equal categories first; pairs whose
    categories alone keep them below what was found are left out. What rounding or the error
    could bring among the first is computed again in double precision."""
    types = dict(refs.dtypes)
    schema = f"query {dict(queries.dtypes)[query]}, ref {types[ref]}, key {types[key]}, similarity double"

    def pick(block, batch):
        if block.empty or batch.empty:
            return pd.DataFrame({"query": block[query][:0], "ref": batch[ref][:0], "key": batch[key][:0], "similarity": np.zeros(0)})
        codes = pd.factorize(batch[key], use_na_sentinel=False)[0]
        order = np.argsort(codes, kind="stable")
        batch, codes = batch.iloc[order].reset_index(drop=True), codes[order]
        ids, keys, pairs, found = batch[ref].to_numpy(), batch[key].to_numpy(), _Block(block, batch), []
        margin = np.float32(0.001 + 2 * ERROR)

        def scan(rows, cols, least):
            """Pairs of rows and cols that can be among the first, and what others must reach."""
            if not len(cols):
                return rows[:0], cols[:0], least
            sims = pairs.rough(rows, cols)
            starts = np.flatnonzero(np.r_[True, np.diff(codes[cols]) > 0])
            sizes = np.diff(np.r_[starts, len(cols)])
            best = np.maximum.reduceat(sims, starts, axis=1)
            least = np.maximum(least, _kth(best, k) - margin)
            near = np.maximum(best - margin, least[:, None])  # of its key a pair must be the best, too
            at, of = np.nonzero(sims >= (np.repeat(near, sizes, axis=1) if len(starts) < k else near.min(axis=1)[:, None]))
            fine = sims[at, of] >= near[at, np.repeat(np.arange(len(starts)), sizes)[of]]
            return rows[at[fine]], cols[of[fine]], least

        alike = np.bincount(pairs.r_cat, minlength=len(pairs.agreement))
        for rows in pairs.groups(np.arange(len(block)), pairs.q_cat, lambda q: alike[pairs.q_cat[q]]):
            bound, none = pairs.bound[pairs.q_cat[rows[0]]], np.full(len(rows), -np.inf, dtype=np.float32)
            own = pairs.r_cat == pairs.q_cat[rows[0]]
            rows_1, cols_1, least = scan(rows, np.flatnonzero(own), none)
            rows_2, cols_2, _ = scan(rows, np.flatnonzero(~own & (bound >= least.min())), least)
            rows, cols = np.r_[rows_1, rows_2], np.r_[cols_1, cols_2]
            value = np.floor(pairs.exact(rows, cols) * 1000 + 0.5) / 1000
            turn = np.lexsort((ids[cols], -value, codes[cols], rows))
            rows, cols, value = rows[turn], cols[turn], value[turn]
            first = np.r_[True, (rows[1:] != rows[:-1]) | (codes[cols[1:]] != codes[cols[:-1]])]
            rows, cols, value = rows[first], cols[first], value[first]
            turn = np.lexsort((ids[cols], -value, rows))
            turn = turn[_ranks(rows[turn]) < k]
            found.append((rows[turn], ids[cols[turn]], keys[cols[turn]], value[turn]))
        return _frame(block, query, found, ["ref", "key", "similarity"])

    found = _block_topk(queries.select(query, *NAMES), refs.select(ref, key, *NAMES), schema, pick)
    distinct = top_k(found, ["query", "key"], [F.desc("similarity"), F.asc("ref")], 1, "_d").drop("_d")
    return top_k(distinct, ["query"], [F.desc("similarity"), F.asc("ref")], k)


def learned_topk(queries: DataFrame, legacy: DataFrame, verified: DataFrame, limit: int = 3, query: str = "query_id") -> DataFrame:
    """Union of two knowledge sets (knowledge_id, top_hash, bottom_hash, approved_at,
    signature) ranked per query: exact hash matches first, then the blended score,
    then the newest. Kept: exact matches or similarity >= 0.45; ``limit`` as given.

    Pairs are compared as in ``vector_topk``; a query that has ``limit`` exact matches in a
    block meets these only. Of the pairs whose score is cut off at 1 for certain, the newest
    ``limit`` are enough."""
    columns = ["knowledge_id", "top_hash", "bottom_hash", "approved_at", *NAMES]
    knowledge = legacy.select(columns).unionByName(verified.select(columns))
    types = dict(knowledge.dtypes)
    schema = f"query {dict(queries.dtypes)[query]}, knowledge_id {types['knowledge_id']}, exact boolean, raw double, approved_at {types['approved_at']}"
    names = ["knowledge_id", "exact", "raw", "approved_at"]

    def pick(block, batch):
        if block.empty or batch.empty:
            return pd.DataFrame({"query": block[query][:0], "knowledge_id": batch["knowledge_id"][:0], "exact": np.zeros(0, bool), "raw": np.zeros(0), "approved_at": batch["approved_at"][:0]})
        batch = batch.sort_values(["approved_at", "knowledge_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        (q_top, r_top), (q_bottom, r_bottom) = (_codes(block[n], batch[n]) for n in ("top_hash", "bottom_hash"))
        ids, at_, pairs, found = batch["knowledge_id"].to_numpy(), batch["approved_at"].to_numpy(), _Block(block, batch), []

        def scan(rows, cols, least):
            """Pairs of rows and cols that can be among the first, and what others must reach."""
            if not len(cols):
                return rows[:0], cols[:0], least
            sims = pairs.rough(rows, cols)
            top, bottom = q_top[rows, None] == r_top[cols], q_bottom[rows, None] == r_bottom[cols]
            raw = np.where(top, np.float32(0.55) * sims + np.float32(0.35), sims) if top.any() else sims.copy()
            raw += bottom * np.float32(0.10)
            sure = raw >= 1 + ERROR
            same = top | bottom
            np.minimum(raw, 1, out=raw)
            raw += same * np.float32(2)
            raw[~same & (sims < 0.45 - ERROR)] = -1
            chunks = np.arange(0, len(cols), max(1, min(CHUNK, len(cols) // (limit + 1))))
            least = np.maximum(least, _kth(np.maximum.reduceat(raw, chunks, axis=1), limit) - np.float32(4 * ERROR))
            hit = (raw >= least[:, None]) & (raw >= 0)
            at, of = np.nonzero(hit & ~sure)
            for some in (sure & hit & same, sure & hit & ~same):
                more, where = np.nonzero(some)
                few = _ranks(more) < limit
                at, of = np.r_[at, more[few]], np.r_[of, where[few]]
            return rows[at], cols[of], least

        def keep(rows, cols):
            is_top, is_bottom, value = q_top[rows] == r_top[cols], q_bottom[rows] == r_bottom[cols], pairs.exact(rows, cols)
            score = np.minimum(1.0, np.where(is_top, 0.35, 0.0) + np.where(is_bottom, 0.10, 0.0) + np.where(is_top, 0.55, 1.0) * value)
            same = is_top | is_bottom
            usable = same | (value >= 0.45)
            rows, cols, score, same = rows[usable], cols[usable], score[usable], same[usable]
            turn = np.lexsort((cols, -score, ~same, rows))  # columns stand newest first
            turn = turn[_ranks(rows[turn]) < limit]
            found.append((rows[turn], ids[cols[turn]], same[turn], score[turn], at_[cols[turn]]))

        matches = np.bincount(r_bottom[r_bottom >= 0], minlength=max(q_bottom.max(), r_bottom.max(), 0) + 1)
        full = (q_bottom >= 0) & (matches[q_bottom] >= limit)
        nothing = lambda rows: np.full(len(rows), -np.inf, dtype=np.float32)
        for rows in pairs.groups(np.flatnonzero(full), q_bottom, lambda q: matches[q_bottom[q]]):
            # exact matches fill the list
            keep(*scan(rows, np.flatnonzero(np.isin(r_top, q_top[rows]) | (r_bottom == q_bottom[rows[0]])), nothing(rows))[:2])
        alike = np.bincount(pairs.r_cat, minlength=len(pairs.agreement))
        for rows in pairs.groups(np.flatnonzero(~full), pairs.q_cat, lambda q: alike[pairs.q_cat[q]]):
            own = pairs.r_cat == pairs.q_cat[rows[0]]
            rows_1, cols_1, least = scan(rows, np.flatnonzero(own), nothing(rows))
            more = (pairs.bound[pairs.q_cat[rows[0]]] >= least.min() - ERROR) | np.isin(r_top, q_top[rows]) | np.isin(r_bottom, q_bottom[rows])
            rows_2, cols_2, _ = scan(rows, np.flatnonzero(more & ~own), least)
            keep(np.r_[rows_1, rows_2], np.r_[cols_1, cols_2])
        return _frame(block, query, found, names)

    found = _block_topk(queries.select(query, "top_hash", "bottom_hash", *NAMES), knowledge, schema, pick)
    order = [F.desc("exact"), F.desc("raw"), F.desc("approved_at"), F.asc("knowledge_id")]
    return top_k(found, ["query"], order, limit).withColumn("similarity", F.round("raw", 4)).drop("raw")


def class_centroids(df: DataFrame, label: str, dims: list[str]) -> DataFrame:
    """Mean of each dimension per class, with the class size."""
    return df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(d).alias(f"mean_{d}") for d in dims])


def centroid_similarity(df: DataFrame, centroids: DataFrame, label: str, dims: list[str]) -> DataFrame:
    """1 - mean clipped difference to the centroid of the row's class."""
    joined = df.join(centroids, label)
    distance = sum((F.least(F.lit(1.0), F.abs(F.col(d) - F.col(f"mean_{d}"))) for d in dims), F.lit(0.0))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - distance / len(dims)))
    return joined.select(*df.columns, F.round(value, 3).alias("similarity"))


def class_profiles(df: DataFrame, label: str, dims: list[str]) -> DataFrame:
    stats = [x for d in dims for x in (F.avg(d).alias(f"mean_{d}"), F.stddev_pop(d).alias(f"std_{d}"))]
    return df.groupBy(label).agg(*stats)


def z_distance(dims: list[str], profile: str) -> Column:
    """Root mean square z-score against a profile struct (mean_*, std_*)."""
    total = F.lit(0.0)
    for d in dims:
        z = (F.col(d) - F.col(f"{profile}.mean_{d}")) / F.greatest(F.lit(1e-6), F.col(f"{profile}.std_{d}"))
        total = total + z * z
    return F.round(F.sqrt(total / len(dims)), 4)


def profile_margin(df: DataFrame, profiles: DataFrame, label: str, inside: str, outside: str, dims: list[str]) -> DataFrame:
    """Distances to two class profiles, their margin and the nearer region. Each profile
    is one row, read as a scalar sub-query."""
    fields = [c for c in profiles.columns if c != label]
    one = lambda value: profiles.filter(F.col(label) == value).select(F.struct(*fields)).scalar()
    staged = df.withColumn("_in", one(inside)).withColumn("_out", one(outside))
    scored = staged.withColumn("inside_distance", z_distance(dims, "_in")).withColumn("outside_distance", z_distance(dims, "_out"))
    margin = F.round(F.col("outside_distance") - F.col("inside_distance"), 4)
    return (
        scored.withColumn("margin", margin)
        .withColumn("region", F.when(F.col("margin") >= 0, "diagnostic-reference-like").otherwise("context-background-like"))
        .drop("_in", "_out")
    )


def mlp_score(df: DataFrame, weights: list[tuple[list[list[float]], list[float]]], inputs: list[str], keep: list[str]) -> DataFrame:
    """Batch scoring of a dense network: ReLU between layers, sigmoid at the end. Each
    layer is (matrix inputs x outputs, bias); tasks score whole Arrow batches."""
    layers = df.sparkSession.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float)) for w, b in weights])

    def score(batches):
        for batch in batches:
            x = batch[inputs].to_numpy(dtype=float)
            for i, (w, b) in enumerate(layers.value):
                x = x @ w + b
                x = np.maximum(x, 0.0) if i < len(layers.value) - 1 else 1.0 / (1.0 + np.exp(-x))
            yield batch[keep].assign(score=x[:, 0])

    types = dict(df.dtypes)
    return df.select(*keep, *inputs).mapInPandas(score, ", ".join(f"{k} {types[k]}" for k in keep) + ", score double")
