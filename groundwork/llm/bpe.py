"""Byte-level BPE by a trie of words: shared prefixes are encoded once."""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

#: Fixed value: how byte-level tokenizers of this family cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that vocabulary files write for bytes: printable Latin-1 characters
    stand for themselves, the other bytes follow from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def unknown_letters(text: str) -> bool:
    """Whether a text has characters that Python's Unicode tables do not know yet."""
    return not text.isascii() and max(text) > "ͷ" and any(unicodedata.category(c) == "Cn" for c in set(text))


class Vocabulary:
    """Tokens, merges and added tokens of a tokenizer file (JSON, byte-level BPE).

    A merge of rank r joins two tokens. Ranks rise from parts to whole, so a token's merges
    form a tree; its right spine is the chain of parts at its end, each with the rank at
    which it is merged away, and its left spine the same at its start.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        ids = content["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes = _spelled(content)
        self.rank, parts = {}, {}
        for rank, (left, right) in enumerate(content["model"]["merges"]):
            pair = (ids[left], ids[right])
            self.rank.setdefault(pair, rank)
            parts.setdefault(ids[left + right], pair)
        self.right, self.left = {}, {}
        usable = []
        for i in sorted(ids.values(), key=lambda t: (t in parts, self.rank[parts[t]] if t in parts else 0)):
            if i in parts:
                a, b = parts[i]
                r = self.rank[a, b]
                self.right[i] = [(i, _NEVER)] + [(x, min(at, r)) for x, at in self.right[b]]
                self.left[i] = [(i, _NEVER)] + [(y, min(at, r)) for y, at in self.left[a]]
                if self._meets(a, b, r):
                    continue  # its bytes merge in another way, so it never comes up
            else:
                self.right[i] = self.left[i] = [(i, _NEVER)]
            usable.append(i)
        self.ends, self.token_at = {}, [-1]
        for i in usable:
            at = 0
            for byte in reversed(self.bytes[i]):
                at = self.ends.setdefault(at << 8 | byte, len(self.token_at))
                if at == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[at] = i
        self.lengths = [len(b) for b in self.bytes]
        self.apart: dict[int, bool] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(WORDS)
        self.library = Tokenizer.from_file(path).pre_tokenizer

    def _meets(self, a: int, b: int, before: int) -> bool:
        """Whether a merge across the border of tokens a and b comes up before rank
        ``before`` while both its sides are there. Of equal merges the left one goes first."""
        rank = self.rank
        for x, x_gone in self.right[a]:
            for y, y_gone in self.left[b]:
                r = rank.get((x, y))
                if r is not None and r < before and r < x_gone and r <= y_gone:
                    return True
        return False

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, one after the other, encode to exactly a, b."""
        if len(self.apart) > 500_000:
            self.apart.clear()
        known = self.apart[a << 32 | b] = not self._meets(a, b, _NEVER)
        return known

    def cut(self, text: str) -> list[str]:
        """The words of a text. A character that Python's tables do not know yet may be a
        letter in newer tables, so texts with one are cut by the tokenizer library itself."""
        if unknown_letters(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.words.findall(text)


def _spelled(content: dict) -> list[bytes]:
    letter, ids = byte_letters(), content["model"]["vocab"]
    added = {t["content"]: t["id"] for t in content["added_tokens"]}
    out = [b""] * (1 + max([*ids.values(), *added.values()]))
    for text, i in ids.items():
        out[i] = bytes(letter[c] for c in text)
    for text, i in added.items():
        out[i] = text.encode()
    return out


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """What each id spells; all that decoding needs."""
    with open(path, encoding="utf-8") as file:
        return _spelled(json.load(file))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per file and Python worker."""
    return Vocabulary(path)


class WordTrie:
    """A trie of the distinct words seen, with the last token of every prefix as its state.

    The encoding of a prefix that ends with token t is the encoding of the prefix without
    t, then t, and there is one token that fits: it ends where the prefix ends and stays
    apart from the last token before it. So a state follows from the states above it, a
    depth-first walk computes each shared prefix once, and a word's tokens are read by
    stepping back from its end. Beyond ``max_nodes`` the trie starts anew, which costs time only.
    """

    def __init__(self, vocab: Vocabulary, max_nodes: int = 500_000):
        self.vocab, self.max_nodes = vocab, max_nodes
        self._clear()

    def _clear(self) -> None:
        self._clear_nodes()
        self.packed: dict[str, bytes] = {}

    def _clear_nodes(self) -> None:
        self.child: dict[int, int] = {}
        self.last = [-1]

    def add(self, words: Iterable[str]) -> None:
        """Inserts words in depth-first (byte) order and stores their tokens."""
        vocab, lengths = self.vocab, self.vocab.lengths
        ends, token_at, known, apart = vocab.ends, vocab.token_at, vocab.apart, vocab.stay_apart
        child, last = self.child, self.last
        path, states, before = [0], [-1], b""
        for word in sorted(w.encode() for w in words):
            if len(last) > self.max_nodes:
                self._clear_nodes()
                child, last = self.child, self.last
                path, states, before = [0], [-1], b""
            same = len(commonprefix((before, word)))
            del path[same + 1 :], states[same + 1 :]
            node = path[-1]
            for depth in range(same, len(word)):
                edge = node << 8 | word[depth]
                node = child.get(edge)
                if node is None:
                    # the state of a new node: the one token that ends here and fits before
                    at, k = 0, depth
                    while True:
                        at = ends[at << 8 | word[k]]
                        token = token_at[at]
                        if token >= 0:
                            if k == 0:
                                break
                            fits = known.get(states[k] << 32 | token)
                            if fits or (fits is None and apart(states[k], token)):
                                break
                        k -= 1
                    node = child[edge] = len(last)
                    last.append(token)
                path.append(node)
                states.append(last[node])
            tokens, end = [], len(word)
            while end:
                tokens.append(states[end])
                end -= lengths[states[end]]
            tokens.reverse()
            self.packed[word.decode()] = array("I", tokens).tobytes()
            before = word

    def encode(self, texts: list[str], special: bool = True) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. With ``special``, strings of
        added tokens inside a text are those tokens, else they are ordinary text."""
        vocab, cut = self.vocab, []
        for text in texts:
            if special and vocab.split is not None and any(a in text for a in vocab.added):
                parts = vocab.split.split(text)
                cut.append([w for k, part in enumerate(parts) for w in ([(part,)] if k % 2 else vocab.cut(part))])
            else:
                cut.append(vocab.cut(text))
        if len(self.packed) > self.max_nodes:
            self._clear()
        new = {w for words in cut for w in words if w not in self.packed}
        marks = {w for w in new if isinstance(w, tuple)}
        self.add(new - marks)
        for mark in marks:
            self.packed[mark] = vocab.added[mark[0]].to_bytes(4, "little")
        return [b"".join(map(self.packed.__getitem__, words)) for words in cut]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes in ``column`` each, at least a row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def encode(docs: DataFrame, path: str, special: bool = True, max_nodes: int = 500_000, slice_bytes: int = 2 << 20) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row: the ids of the whole text as little-endian
    unsigned 32-bit integers, as the tokenizers library gives them for the file ``path``
    without special tokens around the text.

    ``special``: strings of added tokens inside a text become those tokens, as the library
    does by default. A null text is an empty one and has no tokens; a null ``doc_id`` is a
    value like any other, repeated rows stay. Other columns are ignored. Each task keeps one
    trie of words; nothing is shuffled and no text is cut, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(vocabulary(path), max_nodes)
        for whole in batches:
            for batch in slices(whole, "text", slice_bytes):
                ids = trie.encode(batch.column("text").to_pylist(), special)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """Replaces the column ``ids`` by the decoded ``text``; all other columns stay.

    Bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary give nothing, added
    tokens give their strings; null ids give a null text.
    """
    kept = [c for c in encoded.columns if c not in (ids, text)]
    schema = encoded.select(*[F.col(f"`{c}`") for c in kept]).schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for whole in batches:
            for batch in slices(whole, ids, slice_bytes):
                found = []
                for packed in batch.column(ids).to_pylist():
                    if packed is None:
                        found.append(None)
                        continue
                    tokens = memoryview(packed).cast("I").tolist()
                    try:
                        found.append(b"".join(map(table.__getitem__, tokens)).decode("utf-8", "replace"))
                    except IndexError:
                        found.append(b"".join(table[t] for t in tokens if t < len(table)).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.string())], [*kept, text])

    return encoded.select(*[F.col(f"`{c}`") for c in [*kept, ids]]).mapInArrow(run, schema)
