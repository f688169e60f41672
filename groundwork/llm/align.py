"""Alignment of two tokenizers over the bytes of the same text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from groundwork.llm.bpe import WORDS, WordTrie, byte_letters, slices, unknown_letters, vocabulary
from groundwork.llm.common import materialize

#: Ids of one pair travel as a * 2^32 + b.
_SHIFT = 32
_LINK = "struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups: string, links: array<int>, uses: array<int>>"
_LINKS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "uses"]
STORED = f"block long, docs array<{_LINK}>, pairs array<long>, n_docs array<int>"


class ByteLevel:
    """Side A: a byte-level BPE file whose ids follow its merges, encoded by tiktoken;
    strings of added tokens are plain text. Texts with characters that Python's tables do
    not know yet go through ``WordTrie``, which cuts them as the file's own library does."""

    def __init__(self, path: str):
        self.path, letter = path, byte_letters()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        merged = [ids[left + right] for left, right in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids must follow the merges")
        self.bytes = [b""] * (1 + max(ids.values()))
        for text, i in ids.items():
            self.bytes[i] = bytes(letter[c] for c in text)
        ranks = {data: i for i, data in enumerate(self.bytes)}
        self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.trie: WordTrie | None = None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._one(" " + t) for t in texts]

    def _one(self, text: str) -> np.ndarray:
        if unknown_letters(text):
            self.trie = self.trie or WordTrie(vocabulary(self.path))
            return np.frombuffer(self.trie.encode([text], special=False)[0], dtype="<u4").astype(np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class Pieces:
    """Side B: a piece model; U+2581 is a space and ``<0xHH>`` the byte HH."""

    def __init__(self, path: str):
        self.model = _pieces(path)
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.model.vocab_size())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int64) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=4)
def _pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@dataclass
class Side:
    """Tokens of a slice of documents, one row each: ``doc`` (number in the slice),
    ``start`` and ``end`` in bytes of the slice, ``id``. Documents follow each other."""

    table: pd.DataFrame
    counts: np.ndarray


def _side(ids: list[np.ndarray], lengths: np.ndarray) -> Side:
    counts = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    end = np.cumsum(lengths[flat])
    doc = np.repeat(np.arange(len(ids)), counts)
    table = pd.DataFrame({"doc": doc, "start": end - lengths[flat], "end": end, "id": flat})
    return Side(table, counts)


def covering(these: pd.DataFrame, those: pd.DataFrame) -> np.ndarray:
    """For each token of ``these`` the row of the token of ``those`` that covers its start:
    the last one of the same document that starts there or before."""
    other = pd.DataFrame({"doc": those["doc"], "start": those["start"], "row": np.arange(len(those))})
    found = pd.merge_asof(these[["doc", "start"]], other, on="start", by="doc", direction="backward")
    return found["row"].to_numpy(dtype=np.int64)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all overlapping tokens of both sides. Of two ranges that overlap, one holds
    the other's start; a pair with equal starts comes from both directions and counts once."""
    over_a, over_b = covering(a, b), covering(b, a)
    later = b["start"].to_numpy() != a["start"].to_numpy()[over_b]
    return np.concatenate([np.arange(len(a)), over_b[later]]), np.concatenate([over_a, np.flatnonzero(later)])


class _Words:
    """Decimal ids with the separator that follows them, looked up as whole arrays."""

    def __init__(self, size: int):
        text = [str(k) for k in range(size)]
        self.by_separator = np.array([[t + s for t in text] for s in ",|;"] + [text], dtype=object)


def groups(a: Side, b: Side, words: _Words) -> tuple[np.ndarray, list[str]]:
    """Number of groups and their text ``a1,a2|b1;a3|b2,b3`` per document of a slice.
    A group ends where tokens of both sides end."""
    ta, tb = a.table, b.table
    end_a, end_b = ta["end"].to_numpy(), tb["end"].to_numpy()
    # ends rise on both sides, so what they share is found by search
    cuts = end_a[np.append(end_b, -1)[np.searchsorted(end_b, end_a)] == end_a]
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    group = np.concatenate([group_a, group_b])
    side = np.concatenate([np.zeros(len(ta), dtype=np.int64), np.ones(len(tb), dtype=np.int64)])
    order = np.argsort(2 * group + side, kind="stable")
    ids, doc = np.concatenate([ta["id"], tb["id"]])[order], np.concatenate([ta["doc"], tb["doc"]])[order]
    group, side = group[order], side[order]
    n = len(a.counts)
    n_groups = np.bincount(doc[np.flatnonzero(np.diff(group, prepend=-1))], minlength=n) if len(doc) else np.zeros(n, dtype=np.int64)
    after = np.append(group[1:], -1)
    mark = np.where(after != group, 2, np.where(np.append(side[1:], 0) != side, 1, 0))
    ends = np.cumsum(a.counts + b.counts)
    mark[ends[(a.counts + b.counts) > 0] - 1] = 3
    parts = words.by_separator[mark, ids].tolist()
    return n_groups, ["".join(parts[e - k : e]) for e, k in zip(ends, a.counts + b.counts, strict=True)]


def _kept(texts: list[str], ids: list[np.ndarray], sides: tuple, lengths: tuple) -> None:
    """Takes all tokens from texts whose bytes a side does not give back."""
    for k, text in enumerate(texts):
        want = b" " + text.encode() if text else b""
        # byte-level tokens spell any text, so for A the length tells
        same = int(lengths[0][ids[0][k]].sum()) == len(want) and b"".join(map(sides[1].bytes.__getitem__, ids[1][k].tolist())) == want
        if not same:
            ids[0][k] = ids[1][k] = np.zeros(0, dtype=np.int64)


def _aligned(texts: list[str], doc_ids: pa.Array, block: int, sides: tuple, lengths: tuple, words: _Words) -> pa.RecordBatch:
    """One row of ``STORED`` for a slice of documents."""
    n = len(texts)
    ids = [s.encode(texts) for s in sides]
    _kept(texts, ids, sides, lengths)
    a, b = (_side(x, size) for x, size in zip(ids, lengths, strict=True))
    n_groups, text = groups(a, b, words)
    left, right = overlaps(a.table, b.table)
    doc = a.table["doc"].to_numpy()[left]
    at, pairs = pd.factorize((a.table["id"].to_numpy()[left] << _SHIFT) | b.table["id"].to_numpy()[right])
    base = max(1, len(pairs))
    held = np.sort(doc * base + at)
    first = np.flatnonzero(np.diff(held, prepend=-1))
    held_doc, held_at = np.divmod(held[first], base)
    uses = np.diff(np.append(first, len(held)))
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(held_doc, minlength=n))), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (held_at, uses)]
    counts = [pa.array(x, pa.int64()) for x in (a.counts, b.counts, n_groups, np.bincount(doc, minlength=n))]
    docs = pa.StructArray.from_arrays([doc_ids.cast(pa.int64()), *counts, pa.array(text, pa.string()), *lists], _LINKS)
    whole = lambda values, size: pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), values)
    columns = [pa.array([block], pa.int64()), whole(docs, n), whole(pa.array(pairs, pa.int64()), len(pairs)), whole(pa.array(np.bincount(held_at, minlength=len(pairs)), pa.int32()), len(pairs))]
    return pa.RecordBatch.from_arrays(columns, ["block", "docs", "pairs", "n_docs"])


def link_blocks(docs: DataFrame, sides: Callable[[], tuple], block_bytes: int = 1 << 19) -> DataFrame:
    """One row per block of about ``block_bytes`` bytes of text (see ``STORED``): its
    documents with counts, groups and links, and its distinct id pairs with the number of
    its documents that hold them. A document's links are rows of the block's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides()
        lengths = tuple(np.array([len(x) for x in s.bytes], dtype=np.int64) for s in both)
        words, block = _Words(max(map(len, lengths))), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", block_bytes):
                yield _aligned(batch.column("text").to_pylist(), batch.column("doc_id"), block, both, lengths, words)
                block += 1

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, STORED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, n, best``: in how many documents of the corpus a pair is linked, and whether
    no pair with the same A id is in more. One row per A id is the most that is sent to all
    tasks, which the vocabulary bounds."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_docs").alias("n"))
    held = materialize(held, "align-pairs").withColumn("a", F.shiftright("pair", _SHIFT))
    most = held.groupBy("a").agg(F.max("n").alias("most"))
    return held.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = 1 << 19, show: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """Aligns byte-level tokens (A, file ``a_path``) with pieces (B, model ``b_path``):
    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for every row.

    A encodes a space and the text, B the text, to which it adds the space. All pairs of
    tokens whose byte ranges overlap are links. ``groups`` are the id sequences between
    byte offsets at which tokens of both sides end; ``show`` is what is kept of them, since
    the whole sequences are longer than the texts. The count of an id pair is the number
    of rows of ``docs`` that hold it linked; ``n_best`` links have the highest count of
    their A id (ties included), ``count_sum`` adds the counts over links.

    Null and empty texts, and texts whose joined token bytes are not the space and the text
    (such as texts with U+2581), have no tokens: zeros and empty ``groups``. Each row counts
    as a document of its own, also one that repeats another; a null ``doc_id`` is a value
    like any other. Other columns are ignored. Whole texts are aligned, whatever their
    length. Counts meet per block of documents, so a pair that every document holds is one
    row per block, not per document.
    """
    blocks = link_blocks(docs, lambda: (ByteLevel(a_path), Pieces(b_path)), block_bytes)
    shown = F.transform("docs", lambda d: d.withField("groups", show(d["groups"])))
    blocks = materialize(blocks.withColumn("docs", shown), "align-blocks")
    counts = pair_counts(blocks)
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").select("of", "at", "n", "best")

    def finish(key: tuple, mine: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("at").to_numpy())
        n, best = found.column("n").to_numpy()[order], found.column("best").to_numpy(zero_copy_only=False)[order]
        docs = mine.column("docs").combine_chunks().flatten()
        links, uses = docs.field("links"), docs.field("uses")
        counts = np.diff(links.offsets.to_numpy())
        owner = np.repeat(np.arange(len(docs)), counts)
        at, used = links.flatten().to_numpy(), uses.flatten().to_numpy().astype(np.int64)
        n_best, count_sum = np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs), dtype=np.int64)
        np.add.at(n_best, owner, used * best[at])
        np.add.at(count_sum, owner, used * n[at])
        kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*[docs.field(c) for c in kept], pa.array(n_best), pa.array(count_sum), docs.field("groups")], [*kept, "n_best", "count_sum", "groups"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return blocks.select("block", "docs").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(finish, schema)
