"""Evidence ranking by contained tokens and topics.

"Contains" is a substring test. Topics and tokens are found by equality joins (see
``containment``); the vocabulary matches of X12 and X13 look every token up by its first
three characters among the trigrams of the words. Nothing is compared all against all."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from groundwork.functions import text as X
from groundwork.operators.containment import contained, found_in
from groundwork.operators.joins import top_k, with_dense_index
from groundwork.session import materialize

# Fixed values of the score.
EXACT_POINTS, PARTIAL_POINTS = 3, 1
CORE_POINTS, TOPIC_POINTS, TOPIC_TOKEN_POINTS, SOURCE_POINTS = 0.2, 3.0, 0.45, 0.5
#: Documents of one block at most, and cells of its table of tokens and documents.
BLOCK_DOCS, BLOCK_CELLS = 1024, 1 << 26
SNIPPET_MIN_SIMILARITY, SNIPPET_MATCHES, SNIPPETS, SNIPPET_CHARS = 0.85, 3, 3, 980


def _grams(text: Column, sizes: list[int]) -> Column:
    """Distinct substrings of the given lengths, cut from an array of characters: a
    substring by position would walk the UTF-8 text from its start every time."""
    def cut(chars, n):
        spans = F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1)))
        pieces = F.transform(spans, lambda i: F.array_join(F.slice(chars, i, n), ""))
        return F.when(F.size(chars) >= n, pieces).otherwise(F.array().cast("array<string>"))

    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.array_distinct(X.bind(characters, lambda chars: F.concat(*[cut(chars, n) for n in sizes])))


def word_join(words: DataFrame, word: str, needles: DataFrame, needle: str) -> DataFrame:
    """All (word row, needle row) pairs where a distinct word contains the needle."""
    sizes = [r[0] for r in needles.select(F.least(F.length(needle), F.lit(3)).alias("n")).distinct().filter("n > 0").collect()]
    keyed_words = words.withColumn("_g", F.explode(_grams(F.col(word), sizes or [3])))
    keyed_needles = needles.filter(F.length(needle) > 0).withColumn("_g", F.substring(F.col(needle), 1, 3))
    return keyed_words.join(keyed_needles, "_g").filter(F.contains(F.col(word), F.col(needle))).drop("_g")


def _doc_terms(docs: DataFrame, doc: str, text: str, **fold) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.explode(X.token_array(F.col(text), **fold)).alias("term"))


def _query_tokens(queries: DataFrame, query: str, text: str, **fold) -> DataFrame:
    return queries.select(F.col(query).alias("query"), F.explode(X.token_array(F.col(text), **fold)).alias("token"))


def _best_in_blocks(terms: DataFrame, pairs: DataFrame, asked: DataFrame, facts: DataFrame, asks: DataFrame, limit: int, ties: list[str], bonuses: list = (), blocks: int = 0) -> DataFrame:
    """``query, doc, score`` and ``ties``: the ``limit`` best documents per query and block of
    documents. ``pairs``: term, token, points (1 to 3); a token gives a document the most points
    of its terms. ``facts`` (doc, ties, _d<i>, _bd<j>) and ``asks`` (query, _q<i>, _bq<j>) hold
    the conditions of bonuses and exclusions. Documents are dealt by hash and every block meets
    all queries, so neither tokens nor scores of single pairs are shuffled: a document sends its
    matched words, each with its list of tokens."""
    tokens = materialize(with_dense_index(asked.select("token").distinct(), ["token"], "_id").select("token", F.col("_id").cast("int").alias("_id")), "tokens")
    n_tokens = tokens.count()
    n_blocks = max(1, -(-facts.count() // max(16, min(BLOCK_DOCS, BLOCK_CELLS // max(1, n_tokens)))))
    listed = materialize(pairs.join(tokens, "token").groupBy("term").agg(F.collect_list((F.col("_id") * 4 + F.col("points")).cast("bigint")).alias("hits")), "listed")
    found = terms.join(listed, "term").select("doc", "hits").unionByName(facts, allowMissingColumns=True)
    left = found.withColumn("_block", F.pmod(F.xxhash64("doc"), F.lit(n_blocks)).cast("int"))
    wanted = asked.join(tokens, "token").groupBy("query").agg(F.collect_list("_id").alias("tokens")).join(asks, "query")
    right = wanted.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def best(docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        known = docs[docs["hits"].isna()].sort_values([*ties, "doc"], na_position="first", kind="stable").reset_index(drop=True)
        rows = docs[docs["hits"].notna()]
        ids = pd.Index(known["doc"].unique())
        points, place = np.zeros((n_tokens, len(ids)), dtype=np.uint8), ids.get_indexer(known["doc"])
        if len(rows):
            flat = np.concatenate(rows["hits"].to_numpy())
            at = np.repeat(ids.get_indexer(rows["doc"]), rows["hits"].map(len))
            for p in (1, 2, 3):  # the most points are written last
                own = (flat & 3) == p
                points[flat[own] >> 2, at[own]] = p
        facts_of = {c: known[c].to_numpy() for c in known.columns if c.startswith(("_d", "_bd"))}
        out = [(np.zeros(0, dtype=int), np.zeros(0), [])]
        for q in queries.to_dict("records") if len(ids) else ():
            score = points[q["tokens"]].sum(axis=0, dtype=np.int64)[place]
            usable = score > 0
            for i, bonus in enumerate(bonuses):
                if q[f"_q{i}"]:
                    score = score + np.where(facts_of[f"_d{i}"].astype(bool), bonus, 0)
            for j in range(blocks):
                if q[f"_bq{j}"]:
                    usable &= ~facts_of[f"_bd{j}"].astype(bool)
            some = np.flatnonzero(usable & (score > 0))
            some = some[np.argsort(-score[some], kind="stable")[:limit]]
            out.append((some, score[some], [q["query"]] * len(some)))
        some = np.concatenate([o[0] for o in out])
        return pd.DataFrame({"query": [q for o in out for q in o[2]], "score": np.concatenate([o[1] for o in out])} | {c: known[c].to_numpy()[some] for c in ["doc", *ties]})

    types = dict(facts.dtypes)
    number = "double" if any(isinstance(b, float) for b in bonuses) else "bigint"
    schema = f"query {dict(asked.dtypes)['query']}, score {number}, doc {types['doc']}" + "".join(f", {t} {types[t]}" for t in ties)
    return left.groupBy("_block").cogroup(right.groupBy("_block")).applyInPandas(best, schema)


def token_overlap_search(docs: DataFrame, queries: DataFrame, k: int = 6, doc: str = "doc_id", query: str = "query_id", text: str = "text", max_chars: int = 1600) -> DataFrame:
    """Top-k documents by the number of query tokens contained in the folded text. A
    token holds no blank, so it is contained in the text iff it is contained in one
    of its words; the substring test runs on the vocabulary, not on the texts."""
    terms = _doc_terms(docs, doc, text, dstroke=False)
    asked = materialize(_query_tokens(queries, query, text, dstroke=False), "asked")
    vocabulary = materialize(terms.select("term").distinct(), "vocabulary")
    pairs = materialize(word_join(vocabulary, "term", asked.select("token").distinct(), "token"), "pairs")
    ids = materialize(docs.select(F.col(doc).alias("doc")).distinct(), "docs")
    scores = _best_in_blocks(terms, pairs.withColumn("points", F.lit(1)), asked, ids, asked.select("query").distinct(), max(1, k), [])
    best = top_k(scores, ["query"], [F.desc("score"), F.asc("doc")], max(1, k))
    texts = docs.select(F.col(doc).alias("doc"), F.substring(text, 1, max_chars).alias("excerpt"))
    return texts.join(best, "doc").select("query", "doc", "score", "rank", "excerpt")


def evidence_rank(
    docs: DataFrame, queries: DataFrame, limit: int = 18, bonuses: list[tuple] = (), blocks: list[tuple[str, str]] = (),
    doc: str = "doc_id", query: str = "query_id", text: str = "text", source: str = "source", page: str = "page",
) -> DataFrame:
    """Per query token 3 points for a document with that token, else 1 point when one
    contains the other. ``bonuses``: (pattern on the folded query, SQL condition on the
    document d, points, optional SQL condition on the query q). ``blocks``: (condition on
    d, condition on q) that exclude a pair. Every condition is tested once per document or
    once per query; pairs join booleans. Order: score desc, source, page; the first
    ``limit``. The texts are scanned twice: for their vocabulary, which is matched with
    the tokens, and for the matched words only."""
    terms = _doc_terms(docs, doc, text)
    asked = materialize(_query_tokens(queries, query, text), "asked")
    vocabulary, tokens = materialize(terms.select("term").distinct(), "vocabulary"), asked.select("token").distinct()
    wider = word_join(vocabulary, "term", tokens, "token").select("term", "token")
    narrower = word_join(tokens, "token", vocabulary, "term").select("term", "token")
    points = F.when(F.col("term") == F.col("token"), EXACT_POINTS).otherwise(PARTIAL_POINTS)
    pairs = materialize(wider.unionByName(narrower).distinct().withColumn("points", points), "pairs")
    yes = lambda sql: F.coalesce(F.expr(sql), F.lit(False))
    folded = X.fold_text(F.col(f"q.{text}"))
    wants = [(folded.rlike(b[0]) & yes(b[3] if len(b) > 3 else "true")).alias(f"_q{i}") for i, b in enumerate(bonuses)]
    bars = [yes(q).alias(f"_bq{j}") for j, (_, q) in enumerate(blocks)]
    asks = materialize(queries.alias("q").select(F.col(f"q.{query}").alias("query"), *wants, *bars), "queries")
    has = [yes(b[1]).alias(f"_d{i}") for i, b in enumerate(bonuses)]
    barred = [yes(d).alias(f"_bd{j}") for j, (d, _) in enumerate(blocks)]
    facts = materialize(docs.alias("d").select(F.col(f"d.{doc}").alias("doc"), F.col(f"d.{source}").alias("source"), F.col(f"d.{page}").alias("page"), *has, *barred), "facts")
    scored = _best_in_blocks(terms, pairs, asked, facts, asks, limit, ["source", "page"], [b[2] for b in bonuses], len(blocks)).select("query", "doc", "source", "page", "score")
    return top_k(scored, ["query"], [F.desc("score"), F.asc("source"), F.asc("page"), F.asc("doc")], limit)


def topic_rank_with_backfill(entries: DataFrame, queries: DataFrame, n: int = 12, query: str = "query_id", text: str = "text", core: DataFrame | None = None) -> DataFrame:
    """``entries``: entry_id (its order), source, topics and core, unless ``core`` (entry_id,
    core) has it: then entries are not joined whole, only their scores are. Scores topics
    contained in the query, keeps > 0.2, at most n; if fewer than min(8, n) are found, core
    entries in order fill up to that number."""
    fold = lambda c: X.squeeze(X.strip_accents(c))
    marks = entries.select("entry_id", "core") if core is None else core
    q = materialize(queries.select(F.col(query).alias("query"), fold(F.col(text)).alias("q")), "queries")
    # explode_outer, since a filter on the topics that explode implies would compute them again;
    # null needles meet nothing.
    topics = entries.select("entry_id", F.explode_outer("topics").alias("_t")).select("entry_id", fold(F.col("_t")).alias("topic"))
    # Hundredths keep the sums exact: 20, 300, 45 and 50 points. Every token of a contained
    # topic is contained too, so its token points are taken back from the topic's.
    piece = lambda needle, points: F.struct(needle.alias("needle"), points.cast("bigint").alias("p"))
    long_tokens = F.filter(F.split("topic", r"\s+"), lambda t: F.length(t) >= 4)
    worth = topics.select("entry_id", "topic", long_tokens.alias("tokens")).select(
        "entry_id", F.concat(F.array(piece(F.col("topic"), 300 - 45 * F.size("tokens"))), F.transform("tokens", lambda t: piece(t, F.lit(45)))).alias("w")
    )
    named = entries.select("entry_id", F.array(piece(fold(F.col("source")), F.lit(50))).alias("w"))
    needles = worth.unionByName(named).select("entry_id", F.explode_outer(F.filter("w", lambda w: w["needle"] != "")).alias("w")).select("entry_id", "w.needle", "w.p")
    summed = found_in(needles, "needle", q, "query", "q").groupBy("query", "entry_id").agg(F.sum("p").alias("p"))
    extra = marks.filter("core").select("entry_id", F.lit(20).alias("_core"))
    scored = summed.join(extra, "entry_id", "left").select("query", "entry_id", (F.col("p") + F.coalesce("_core", F.lit(0))).alias("score"))
    ranked = materialize(top_k(scored.filter("score > 20"), ["query"], [F.desc("score"), F.asc("entry_id")], n), "ranked")
    floor_ = min(8, n)
    short = ranked.groupBy("query").agg(F.count("*").alias("have"))
    need = q.select("query").join(short, "query", "left").select("query", F.coalesce("have", F.lit(0)).alias("have")).filter(F.col("have") < floor_)
    # A query can already hold at most floor_ - 1 core entries, so twice floor_ core
    # entries are always enough to fill it up.
    pool = [r["entry_id"] for r in marks.filter("core").select("entry_id").orderBy("entry_id").limit(2 * floor_).collect()]
    offered = need.withColumn("entry_id", F.explode(F.array(*[F.lit(i) for i in pool]).cast(f"array<{dict(entries.dtypes)['entry_id']}>")))
    fresh = offered.join(ranked.select("query", "entry_id"), ["query", "entry_id"], "left_anti")
    filled = top_k(fresh, ["query"], [F.asc("entry_id")], floor_, "_r").filter(F.col("_r") + F.col("have") <= floor_)
    return ranked.select("query", "entry_id", "rank", (F.col("score") / 100).alias("score")).unionByName(
        filled.select("query", "entry_id", (F.col("have") + F.col("_r")).cast("int").alias("rank"), F.lit(None).cast("double").alias("score"))
    )


def ontology_expand(queries: DataFrame, ontology: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """``ontology``: node_id, label, aliases. When an alias occurs in the query, every
    token of at least three characters of the node's id, label and aliases is added."""
    fold = lambda c: X.fold_text(c, dstroke=False, keep="-")
    q = queries.select(F.col(query).alias("query"), fold(F.col(text)).alias("q")).filter("q <> ''")
    aliases = ontology.select("node_id", F.explode("aliases").alias("_a")).select("node_id", fold(F.col("_a")).alias("alias")).filter("alias <> ''")
    hits = contained(q, "query", "q", aliases, "alias").join(aliases, "alias").select("query", "node_id").distinct()
    words = F.filter(F.split(fold(F.concat_ws(" ", "node_id", "label", F.array_join("aliases", " "))), " "), lambda t: F.length(t) >= 3)
    tokens = ontology.select("node_id", F.explode(words).alias("token")).distinct()
    return hits.join(tokens, "node_id").select("query", "token").distinct()


def snippet_rank(
    matches: DataFrame, texts: DataFrame, queries: DataFrame, query: str = "query_id", text: str = "text",
    least: float = SNIPPET_MIN_SIMILARITY, n_matches: int = SNIPPET_MATCHES, n_snippets: int = SNIPPETS, chars: int | None = SNIPPET_CHARS,
) -> DataFrame:
    """``matches``: query, source, page, similarity, quality. Sentences of the ``n_matches``
    best matches that contain query tokens: the ``n_snippets`` best distinct ones per query,
    joined and cut to ``chars`` characters (None: whole)."""
    usable = matches.filter((F.col("quality") != "poor") & (F.col("similarity") >= least))
    strong = top_k(usable, ["query"], [F.desc("similarity"), F.asc("page")], n_matches, "_m")
    asked = queries.select(F.col(query).alias("query"), X.token_array(F.col(text)).alias("tokens"))
    pieces = (
        texts.join(strong.select("query", "source", "page", "similarity"), ["source", "page"])
        .select("query", "source", "page", "similarity", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
        .withColumn("folded", X.fold_text(F.col("sentence")))
    )
    hay = F.col("folded")
    scored = pieces.join(asked, "query").withColumn("score", F.size(F.filter("tokens", lambda t: F.contains(hay, t)))).filter("score > 0")
    order = [F.desc("score"), F.desc("similarity"), F.asc("page"), F.asc("pos")]
    distinct = top_k(scored, ["query", "folded"], order, 1, "_d")
    best = top_k(distinct, ["query"], order, n_snippets)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda s: s["sentence"]), " ")
    wording = joined if chars is None else F.substring(joined, 1, chars)
    return best.groupBy("query").agg(wording.alias("wording"), F.count("*").alias("n_snippets"))


def topic_hits(entries: DataFrame, labels: DataFrame, k: int = 10, query: str = "query_id", text: str = "text") -> DataFrame:
    """Entries (entry_id, source, page, topics) by the number of topics contained in the
    label text; top k by score, source, page."""
    q = materialize(labels.select(F.col(query).alias("query"), F.lower(text).alias("q")), "labels")
    topics = entries.select("entry_id", "source", "page", F.explode_outer("topics").alias("_t")).select("entry_id", "source", "page", F.lower("_t").alias("topic"))
    counts = found_in(topics, "topic", q, "query", "q").groupBy("query", "entry_id", "source", "page").agg(F.count("*").alias("score"))
    return top_k(counts, ["query"], [F.desc("score"), F.asc("source"), F.asc("page"), F.asc("entry_id")], k)


def _holders(docs: pa.Table, tokens: dict[str, int]) -> np.ndarray:
    """Which token (row) stands in a word of which document (column) of a block. Every distinct
    word of the block is cut once, at the lengths that tokens have."""
    lists = docs["words"].combine_chunks()
    parents = pc.list_parent_indices(lists).to_numpy()
    words = pc.list_flatten(lists).dictionary_encode()
    codes = words.indices.to_numpy()
    lengths = sorted(set(map(len, tokens)))
    at_word, at_token = [], []
    for w, word in enumerate(words.dictionary.to_pylist()):
        size = len(word)
        hits = {tokens[s] for n in lengths if n <= size for i in range(size - n + 1) if (s := word[i : i + n]) in tokens}
        at_word.extend([w] * len(hits))
        at_token.extend(hits)
    held = np.zeros((len(tokens), docs.num_rows), dtype=np.uint8)
    order = np.argsort(codes, kind="stable")
    owners, counts = parents[order], np.bincount(codes, minlength=len(words.dictionary))
    starts = np.cumsum(counts) - counts
    for at in range(0, len(at_word), 1 << 16):
        w, t = np.array(at_word[at : at + (1 << 16)]), np.array(at_token[at : at + (1 << 16)])
        many = counts[w]
        place = np.arange(many.sum()) + np.repeat(starts[w] - (np.cumsum(many) - many), many)
        held[np.repeat(t, many), owners[place]] = 1
    return held


def best_rule(entries: DataFrame, wanted: DataFrame, query: str = "query_id", topics: str = "wanted") -> DataFrame:
    """For each wanted topic list the entry whose topics and text contain most of them;
    the first entry wins a tie; none when nothing is contained. Entries without a column
    ``topics`` are judged by their text alone.

    Texts are cut into the smallest pieces that no wanted topic can cross. A document sends
    its distinct pieces to its block, blocks meet all lists, and a block sends one entry per list."""
    hay = F.concat_ws(" ", F.array_join("topics", " "), "text") if "topics" in entries.columns else F.col("text")
    asked = wanted.select(F.col(query).alias("query"), F.transform(topics, F.lower).alias("tokens"))
    tokens = materialize(asked.select(F.explode("tokens").alias("token")).filter("token <> ''").distinct(), "tokens")
    n_tokens, plain, solid = tokens.agg(F.count("*"), F.every(F.col("token").rlike(r"^[\p{L}\p{N}]+$")), F.every(~F.contains("token", F.lit(" ")))).first()
    pieces = F.split(F.lower(hay), r"[^\p{L}\p{N}]+" if plain else " ", -1) if plain or solid else F.array(F.lower(hay))
    docs = entries.select("entry_id", F.filter(F.array_distinct(pieces), lambda w: w != "").alias("words"))
    n_blocks = max(1, -(-entries.count() // max(16, min(BLOCK_DOCS, BLOCK_CELLS // max(1, n_tokens)))))
    left = docs.withColumn("_block", F.pmod(F.xxhash64("entry_id"), F.lit(n_blocks)).cast("int"))
    right = materialize(asked, "wanted").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    types, query_type = dict(entries.dtypes), dict(asked.dtypes)["query"]

    def best(docs: pa.Table, lists: pa.Table) -> pa.Table:
        docs = docs.take(pc.sort_indices(docs["entry_id"], null_placement="at_start"))
        owned = [[t for t in ts or () if t] for ts in lists["tokens"].to_pylist()]
        ids = {t: i for i, t in enumerate(dict.fromkeys(t for ts in owned for t in ts))}
        place, found, score = [], [], []
        if docs.num_rows and ids:
            held = _holders(docs, ids)
            for at, ts in enumerate(owned):
                sums = held[[ids[t] for t in ts]].sum(axis=0, dtype=np.int64)
                first = int(sums.argmax())
                if sums[first]:
                    place.append(at), found.append(first), score.append(int(sums[first]))
        rows = lambda column, at: column.take(pa.array(at, pa.int64()))
        return pa.table({"query": rows(lists["query"], place), "entry_id": rows(docs["entry_id"], found), "score": pa.array(score, pa.int64())})

    per_block = left.groupBy("_block").cogroup(right.groupBy("_block")).applyInArrow(best, f"query {query_type}, entry_id {types['entry_id']}, score bigint")
    return top_k(per_block, ["query"], [F.desc("score"), F.asc("entry_id")], 1).drop("rank")


def merge_signals(signals: DataFrame, owner: str, label: str, confidence: str, order: str, k: int = 8) -> DataFrame:
    """Per owner and case-insensitive label the most confident signal (the earliest on
    a tie), then the k most confident labels."""
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(confidence)))
    best = signals.filter(F.trim(label) != "").groupBy(owner, F.lower(F.trim(F.col(label))).alias("key")).agg(
        F.max(F.struct(bounded.alias("c"), (-F.col(order)).alias("o"), F.col(label).alias("label"))).alias("m")
    )
    flat = best.select(owner, F.col("m.label").alias("label"), F.col("m.c").alias("confidence"), (-F.col("m.o")).alias("event"))
    return top_k(flat, [owner], [F.desc("confidence"), F.asc("event")], k)


def cite(evidence: DataFrame, documents: DataFrame, source: str = "source") -> DataFrame:
    """Evidence with its document title and a locator: page, else locator, else PMID."""
    joined = evidence.join(documents.select(source, "title", "pmid"), source, "left")
    locator = F.coalesce(
        F.when(F.col("page").isNotNull(), F.concat(F.lit("p. "), F.col("page"))), F.nullif(F.col("locator"), F.lit("")),
        F.when(F.col("pmid").isNotNull(), F.concat(F.lit("PMID "), F.col("pmid"))), F.lit("academic source"),
    )
    return joined.select(*evidence.columns, "title", locator.alias("cited"))


# --- shipped evidence rules -------------------------------------------------

# Query patterns (folded), document conditions and points.
EVIDENCE_BONUSES = [
    ("(tam ly|tam than|stress|lo au|tram cam|cam xuc|buon|hoang|mat ngu|tu hai|hanh vi|cang thang)", "d.source = 'PSY1'", 12),
    ("(do am|kho|uot|nhuan|tron|gloss|bong be mat|nuoc bot|moisture|wet|dry)", "d.source = 'TCATLAS1'", 16),
    ("(do am|kho|uot|nhuan|tron|gloss|bong be mat|nuoc bot|moisture|wet|dry)", "d.source in ('OA17', 'OA18')", 4),
    ("(phan khu|dau luoi|ria luoi|hai ben luoi|giua luoi|goc luoi|tam phe|can dom|ty vi|than|bang quang|tongue region|topograph)", "d.source = 'OA19'", 6),
    ("(hinh the|kich thuoc|map|beu|gay|mong|thon|dau rang|han rang|tooth|shape|morpholog)", "d.source like 'MR%'", 7),
    ("(mat duoi|tinh mach|mach duoi luoi|sublingual|vein)", "d.source = 'AT1' and d.page = 22", 30),
    ("(mat duoi|tinh mach|mach duoi luoi|sublingual|vein)", "d.source = 'TC1' and d.page in (47, 48)", 14),
]
# Observation flags as (flag, column, pattern on the folded value).
PROFILE_FLAGS = [
    ("top_purple", "top_color", "(tim|xanh tim|am tim)"), ("any_red", "top_color", "(do|do sam|do giang)"), ("any_pale", "top_color", "(nhot|nhat)"), ("top_pale", "top_color", "(nhot|nhat|trang nhot)"),
    ("white_coat", "coating_color", "trang"), ("yellow_coat", "coating_color", "vang"), ("thick_coat", "coating_thickness", "day"), ("thin_coat", "coating_thickness", "(mong|rat mong)"),
    ("toothmarks", "toothmarks_text", "(han rang|dau rang)"), ("fissure", "fissures", "nut"), ("dry", "moisture", "(kho|thien kho)"), ("moist", "moisture", "(nhuan|uot|am)"),
    ("under_purple", "under_color", "(tim|xanh tim|am tim|toi)"), ("under_dilated", "under_dilation", "(gian|phinh|cang)"),
]
_ATLAS = "d.source in ('AT1', 'TCATLAS1')"
_VENTRAL = "d.hay rlike '(mat duoi|tinh mach duoi luoi|mach duoi luoi)'"
# Contradictions that exclude an atlas entry: (surface, entry pattern,
# condition on the query's flags).
_CONTRADICTIONS = [
    (_VENTRAL, ".*", "not q.under_present or not q.under_visible"), (_VENTRAL, "tim|xanh tim|am tim", "not q.under_purple"),
    (_VENTRAL, "gian|phinh", "not q.under_dilated and not q.vessel_visible"),
    (f"not {_VENTRAL}", "xanh tim|am tim|mau tim|luoi tim", "not q.top_purple"), (f"not {_VENTRAL}", "dau rang|han rang", "not q.toothmarks"),
    (f"not {_VENTRAL}", "reu vang", "q.white_coat and not q.yellow_coat"), (f"not {_VENTRAL}", "reu trang", "q.yellow_coat and not q.white_coat"),
    (f"not {_VENTRAL}", "reu day", "q.thin_coat and not q.thick_coat"), (f"not {_VENTRAL}", "nhot|trang nhot", "q.top_red and not q.top_pale"),
    (f"not {_VENTRAL}", "do sam|do giang|luoi do", "q.top_pale and not q.top_red"),
]
ATLAS_BLOCKS = [(f"{_ATLAS} and {side} and d.hay rlike '({pattern})'", f"q.has_profile and ({condition})") for side, pattern, condition in _CONTRADICTIONS]
# Points of agreeing observations on atlas entries.
_AGREEMENTS = [
    (_VENTRAL, ".*", "q.under_purple", 4), (_VENTRAL, ".*", "q.vessel_visible", 2), (f"not {_VENTRAL}", "tim|xanh tim|am tim", "q.top_purple", 4), (f"not {_VENTRAL}", "reu trang", "q.white_coat", 2),
    (f"not {_VENTRAL}", "reu vang", "q.yellow_coat", 2), (f"not {_VENTRAL}", "dau rang|han rang", "q.toothmarks", 2), (f"not {_VENTRAL}", "nut", "q.fissure", 2), (f"not {_VENTRAL}", "kho", "q.dry", 1), (f"not {_VENTRAL}", "nhuan|uot|am", "q.moist", 1),
]
ATLAS_BONUSES = [("", f"{_ATLAS} and {side} and d.hay rlike '({pattern})'", points, f"q.has_profile and {condition}") for side, pattern, condition, points in _AGREEMENTS]


def observation_profile(queries: DataFrame) -> DataFrame:
    """Adds the profile flags of the observation columns to the queries. Further inputs:
    has_profile, under_present, under_visible, vessel_visible (booleans)."""
    value = lambda c: F.coalesce(F.col(c), F.lit("")) if c in queries.columns else F.lit("")
    flags = {name: X.asserted(value(c), pattern) for name, c, pattern in PROFILE_FLAGS}
    flags["top_red"] = flags["any_red"] & ~flags["any_pale"]
    present = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in queries.columns else F.lit(default)
    given = {"has_profile": present("has_profile", False), "under_present": present("under_present", False), "under_visible": present("under_visible", True), "vessel_visible": present("vessel_visible", False)}
    return queries.withColumns({**flags, **given})


def knowledge_rank(docs: DataFrame, queries: DataFrame, limit: int = 18, **columns) -> DataFrame:
    """evidence_rank with the shipped bonuses, contradictions and the rule that context-only
    entries (source PSY1) need a query that asks for them. ``queries`` may carry the
    observation columns of ``PROFILE_FLAGS``."""
    text = columns.get("text", "text")
    hay = docs.withColumn("hay", X.fold_text(F.col(text)))
    psych = EVIDENCE_BONUSES[0][0]
    profiled = observation_profile(queries).withColumn("wants_context", X.fold_text(F.col(text)).rlike(psych))
    blocks = [("d.source = 'PSY1'", "not q.wants_context"), *ATLAS_BLOCKS]
    return evidence_rank(hay, profiled, limit, EVIDENCE_BONUSES + ATLAS_BONUSES, blocks, **columns)
