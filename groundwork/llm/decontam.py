"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

_WORDS = re.compile(r"\w+")
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """``max_edit``: share of an item's words that edits may touch. ``repeats`` walks of
    ``steps`` steps, of which ``sampled`` symbols make a key, start at every ``stride``-th
    word of a document and at every word of an item that has ``tail`` words from there on.
    Items with fewer than ``short`` words have too few starts for that and are searched by
    exact pieces instead, which miss nothing. ``block``: items searched in one pass."""

    max_edit: float = 0.2
    repeats: int = 4
    steps: int = 16
    sampled: int = 5
    stride: int = 3
    tail: int = 12
    short: int = 18
    block: int = 20_000
    seed: int = 7


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words (runs of letters, digits, underscores)."""
    found = _WORDS.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def walk_keys(symbols: np.ndarray, starts: np.ndarray, s: Settings, repeat: int) -> np.ndarray:
    """One key per start: the CGK walk reads the symbol under its pointer in each step and
    moves on if the symbol's random bit for that step is set, so two strings at a small
    edit distance read the same symbols in most steps; ``sampled`` of the steps are hashed.
    ``symbols`` must end with at least ``steps`` zeros."""
    rng = np.random.default_rng(s.seed + repeat)
    chosen = set(rng.choice(s.steps, size=min(s.sampled, s.steps), replace=False).tolist())
    bits = rng.permutation(64)[: s.steps].astype(np.uint64)
    at, key = starts.astype(np.int64), np.full(len(starts), repeat + 1, dtype=np.uint64)
    last = max(chosen)
    for j in range(last + 1):
        read = symbols[at]
        if j in chosen:
            key = (key ^ read) * _MIX
            key ^= key >> np.uint64(31)
        at += ((read >> bits[j]) & np.uint64(1)).astype(np.int64)
    return key


@dataclass
class Index:
    """What a task needs of one block of items."""

    ids: list
    words: list[np.ndarray]
    keys: np.ndarray = field(default=None)  # sorted, per repeat mixed into the key
    item: np.ndarray = field(default=None)
    offset: np.ndarray = field(default=None)
    seen: np.ndarray = field(default=None)
    pieces: dict = field(default=None)  # width -> sorted keys, items and offsets


def build_index(items: list[tuple], s: Settings) -> Index:
    kept = [(i, w) for i, t in items if len(w := word_hashes(t))]
    index = Index([i for i, _ in kept], [w for _, w in kept])
    keys, item, offset, pieces = [], [], [], {}
    for k, words in enumerate(index.words):
        if len(words) < s.short:
            edits = int(s.max_edit * len(words))
            for a, b in _cuts(len(words), edits + 1):
                pieces.setdefault(b - a, []).append((piece_keys(words[a:b], b - a)[0], k, a))
            continue
        starts = np.arange(max(1, len(words) - s.tail + 1))
        padded = np.concatenate([words, np.zeros(s.steps + 1, dtype=np.uint64)])
        for r in range(s.repeats):
            keys.append(walk_keys(padded, starts, s, r))
            item.append(np.full(len(starts), k))
            offset.append(starts)
    keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    index.keys = keys[order]
    index.item = np.concatenate(item)[order] if item else np.zeros(0, dtype=np.int64)
    index.offset = np.concatenate(offset)[order] if offset else np.zeros(0, dtype=np.int64)
    index.pieces = {}
    index.seen = np.zeros(1 << 20, dtype=bool)
    index.seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    for width, rows in pieces.items():
        rows.sort()
        index.pieces[width] = (np.array([r[0] for r in rows], dtype=np.uint64), [r[1] for r in rows], [r[2] for r in rows])
    return index


def _cuts(n: int, parts: int) -> list[tuple[int, int]]:
    """An item within e edits keeps one of its e + 1 pieces whole."""
    edges = [n * k // parts for k in range(parts + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def piece_keys(symbols: np.ndarray, width: int) -> np.ndarray:
    """One key per run of ``width`` symbols."""
    n = max(0, len(symbols) - width + 1)
    key = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        key = (key ^ symbols[j : j + n]) * _MIX
        key ^= key >> np.uint64(31)
    return key


def infix_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any part of the region, and where that part ends."""
    place = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, dtype=np.int64)
    for k, word in enumerate(item):
        moved = np.empty_like(row)
        moved[0] = k + 1
        moved[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != word))
        row = np.minimum.accumulate(moved - place) + place
    end = int(np.argmin(row))
    return int(row[end]), end


def document_matches(words: np.ndarray, hits: list[tuple[int, int]], index: Index, s: Settings) -> Iterator[tuple]:
    """Verifies candidates (item, place where it would start): ``item_id, distance, n_words, end``."""
    best: dict[int, tuple[int, int]] = {}
    done: set[tuple[int, int]] = set()
    for k, start in sorted(set(hits)):
        item = index.words[k]
        edits = int(s.max_edit * len(item))
        slack = 2 * edits + s.steps
        cell = (k, start // max(1, s.steps // 2))
        if cell in done:
            continue
        done.add(cell)
        low, high = max(0, start - slack), min(len(words), start + len(item) + slack)
        region = words[low:high]
        if len(item) - np.isin(item, region).sum() > edits:
            continue
        distance, end = infix_distance(item, region)
        if distance <= edits and (k not in best or (distance, low + end) < best[k]):
            best[k] = (distance, low + end)
    for k, (distance, end) in sorted(best.items()):
        yield index.ids[k], distance, len(index.words[k]), end


def candidates(texts: list[np.ndarray], index: Index, s: Settings) -> dict[int, list[tuple[int, int]]]:
    """Candidates per text of a batch. The walks of all texts advance together."""
    found: dict[int, list[tuple[int, int]]] = {}
    gap = np.zeros(s.steps + 1, dtype=np.uint64)
    symbols = np.concatenate([x for t in texts for x in (t, gap)] or [gap])
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(sizes + len(gap))])[: len(texts)]
    if len(index.keys):
        n = -(-sizes // s.stride)
        doc = np.repeat(np.arange(len(texts)), n)
        local = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * s.stride
        starts = base[doc] + local
        for r in range(s.repeats):
            keys = walk_keys(symbols, starts, s, r)
            maybe = np.flatnonzero(index.seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
            low, high = np.searchsorted(index.keys, keys[maybe], "left"), np.searchsorted(index.keys, keys[maybe], "right")
            for at, a, b in zip(maybe[high > low], low[high > low], high[high > low], strict=True):
                for e in range(a, b):
                    found.setdefault(int(doc[at]), []).append((int(index.item[e]), int(local[at] - index.offset[e])))
    for width, (known, item, offset) in index.pieces.items():
        keys = piece_keys(symbols, width)
        low = np.searchsorted(known, keys, "left")
        maybe = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == keys)
        high = np.searchsorted(known, keys[maybe], "right")
        doc = np.searchsorted(base, maybe, "right") - 1
        for d, at, a, b in zip(doc.tolist(), (maybe - base[doc]).tolist(), low[maybe].tolist(), high.tolist(), strict=True):
            if at + width <= sizes[d]:
                found.setdefault(d, []).extend((item[e], at - offset[e]) for e in range(a, b))
    return found


def _indexes(spark: SparkSession, items: DataFrame, s: Settings) -> list:
    """Broadcast indexes of blocks of items. A block holds about ``block`` items, so what a
    task holds is bounded; more items make more blocks."""
    own = items.select("item_id", "text").filter("text IS NOT NULL")
    blocks = max(1, -(-own.count() // s.block))
    out = []
    for b in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        out.append(spark.sparkContext.broadcast(build_index([(r["item_id"], r["text"]) for r in rows], s)))
    return out


def _searched(texts: list, index: Index, s: Settings, step: int = 256) -> Iterator[tuple[int, tuple]]:
    """(place in the list, match) of every verified match."""
    for at in range(0, len(texts), step):
        words = [word_hashes(t) for t in texts[at : at + step]]
        for d, hits in candidates(words, index, s).items():
            for match in document_matches(words[d], hits, index, s):
                yield at + d, match


def benchmark_matches(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, distance, item_words, end_word``: items of which a document holds a
    passage within ``max_edit`` times the item's words of word edits, at its best place.

    Whole texts are searched where they are read; nothing is shuffled. Null and blank
    texts and items match nothing. Repeated rows give repeated matches. Every pair that
    is returned is verified exactly; which pairs are found is a matter of recall, see
    ``Settings``.
    """
    source = docs.select("doc_id", "text")

    def search(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_searched(batch.column("text").to_pylist(), index.value, settings))
                ids = batch.column("doc_id").take(pa.array([at for at, _ in found], pa.int64()))
                rest = [pa.array([m[k] for _, m in found], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "item_id", "distance", "item_words", "end_word"])

        return run

    schema = "doc_id long, item_id long, distance long, item_words long, end_word long"
    found = [source.mapInArrow(search(index), schema) for index in _indexes(docs.sparkSession, items, settings)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of any item."""
    columns = docs.columns
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").alias("text"))
    for index in _indexes(docs.sparkSession, items, settings):
        out = out.filter(~_holds_item(index, settings)(F.col("text")))
    return out.select("row.*")


def _holds_item(index, settings: Settings):
    def flagged(text: pd.Series) -> pd.Series:
        hit = np.zeros(len(text), dtype=bool)
        for at, _ in _searched(text.tolist(), index.value, settings):
            hit[at] = True
        return pd.Series(hit)

    return F.pandas_udf(flagged, "boolean")
