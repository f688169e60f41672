"""BPE, tokenizer alignment and the Merkle manifest against the libraries and brute force."""

import json
import random
import struct
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundwork.llm import align, bpe, manifest, queries
from tests.llm.helpers import SCHEMA, documents

SF = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BYTES)
AWKWARD = ["", " ", "a", " a", "a ", "\n\n\tx", "'s 't", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext", "▁x", "x ▁", "</s> <s> <unk> <0x0A>", "é é ﬁ 日本語 مرحبا", "͸ a", "\U0001e6c0b", "a\x00b\x1c\x85　c", "1234567890 ²³", "🙂👩‍👩‍👧", "=" * 70 + "-" * 130, "the The THE", "�"]


def hexdigest(data):
    return sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "a", "the", "'s", "-", "==", "9", "\n", "é", "日", "<|endoftext|>", "aa", "͸", " th", "ing"]), st.text(max_size=6)), max_size=30).map("".join))
def test_trie_encodes_like_the_library(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = bpe.WordTrie(bpe.vocabulary(BYTES)).encode([text])[0]
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library_ids(text)


def test_unknown_letters_are_what_the_libraries_disagree_on():
    vocab = bpe.vocabulary(BYTES)
    for start in range(0, 0x30000, 0x1000):
        codes = [chr(c) for c in range(start, start + 0x1000, 7) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}a" for c in codes)
        assert vocab.cut(text) == [text[a:b] for _, (a, b) in vocab.library.pre_tokenize_str(text)]


def test_small_tries_start_anew():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde ") for _ in range(200)) for _ in range(40)] + ["q" * 20_000, "ab" * 9_000]
    small = bpe.WordTrie(bpe.vocabulary(BYTES), max_nodes=50)
    got = [x for t in texts for x in small.encode([t])]
    assert [list(np.frombuffer(g, "<u4")) for g in got] == [library_ids(t) for t in texts]


def test_shared_prefixes_are_one_node():
    trie = bpe.WordTrie(bpe.vocabulary(BYTES))
    trie.encode(["prefixes"])
    before = len(trie.last)
    trie.encode(["prefix", "prefixing"])
    assert len(trie.last) == before + len("ing") and before == len("prefixes") + 1


def test_codec_round_trip_on_awkward_rows(spark):
    rows = [(k, t) for k, t in enumerate(AWKWARD)] + [(None, "null id"), (7, None), (7, None), (1, "again"), (2, "long words " * 40_000)]
    encoded = bpe.encode(documents(spark, rows, clash=True), BYTES)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    got = sorted(((r["doc_id"], r["n_tokens"], list(np.frombuffer(r["ids"], "<u4"))) for r in encoded.collect()), key=str)
    assert got == sorted(((i, len(library_ids(t)), library_ids(t)) for i, t in rows), key=str)
    back = bpe.decode(encoded, BYTES)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    plain = bpe.encode(documents(spark, [(1, "<|endoftext|>")]), BYTES, special=False).first()
    other = Tokenizer.from_file(BYTES)
    other.encode_special_tokens = True
    assert list(np.frombuffer(plain["ids"], "<u4")) == other.encode("<|endoftext|>", add_special_tokens=False).ids
    assert bpe.encode(documents(spark, []), BYTES).count() == 0


def test_decode_of_any_ids(spark):
    ids = [[], [50256], [222], [222, 15496, 255], [15496, 60_000], None]
    rows = [(k, None if x is None else struct.pack(f"<{len(x)}I", *x)) for k, x in enumerate(ids)]
    got = [r["text"] for r in bpe.decode(spark.createDataFrame(rows, "k int, ids binary"), BYTES).orderBy("k").collect()]
    assert got == [None if x is None else LIBRARY.decode(x, skip_special_tokens=False) for x in ids]


def test_op11_against_the_library(spark):
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library_ids(r["text"])
        want[r["doc_id"], len(ids), hexdigest(np.array(ids, "<u4").tobytes()), hexdigest(LIBRARY.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in queries.QUERIES["op11_bpe_codec"](spark, SF).collect()) == want


def aligned(rows):
    """Brute force over all token pairs of each text."""
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(BYTES, encoding="utf-8") as file:
        names = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    letters, docs = bpe.byte_letters(), []

    def ranges(tokens):
        out, at = [], 0
        for i, data in tokens:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    for doc_id, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(letters[c] for c in names[i])) for i in plain.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(text)]
            if any(b"".join(d for _, d in side) != (" " + text).encode() for side in (a, b)):
                a = b = []
        ra, rb = ranges(a), ranges(b)
        links = [(x[0], y[0]) for x in ra for y in rb if x[1] < y[2] and y[1] < x[2]]
        ends, groups, begin = sorted({x[2] for x in ra} & {y[2] for y in rb}), [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if begin < x[2] <= end) for side in (ra, rb)))
            begin = end
        docs.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(p for d in docs for p in set(d[4]))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    return Counter((d[0], d[1], d[2], d[3], len(d[4]), sum(counts[p] == most[p[0]] for p in d[4]), sum(counts[p] for p in d[4]), d[5]) for d in docs)


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_alignment_against_brute_force(spark, block):
    rng = random.Random(8)
    parts = ["token", "ization", " un", "known", "é", "日本", " ", "\n", "🙂", "th", "e", "1", "ß", "--", "</s>", "<|endoftext|>"]
    rows = [(k, t) for k, t in enumerate(AWKWARD)] + [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))) for k in range(60)]
    rows += [(None, "null id"), (200, None), (100, rows[40][1]), (100, rows[40][1])]
    got = align.align(documents(spark, rows, clash=True), BYTES, PIECES, block_bytes=block)
    assert Counter(tuple(r) for r in got.collect()) == aligned(rows)


def test_alignment_of_an_empty_table_and_a_long_text(spark):
    assert align.align(documents(spark, []), BYTES, PIECES).count() == 0
    row = align.align(documents(spark, [(1, "tokenization of unknown words " * 30_000)]), BYTES, PIECES).first()
    assert row["n_links"] >= max(row["n_a"], row["n_b"]) > 100_000 and row["n_best"] <= row["count_sum"] == row["n_links"]


def test_op12_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op12_tokenizer_align"](spark, SF).collect()}
    short = [r for r in rows if len(r[1] or "") < 1500]
    whole = align.align(spark.createDataFrame(short, "doc_id long, text string"), BYTES, PIECES)
    assert Counter(tuple(r) for r in whole.collect()) == aligned(short)
    want = {w[0]: w for w in aligned(short)}
    for i, _ in short:  # what does not hang on the other documents
        w, g = want[i], got[i]
        assert (g["n_a"], g["n_b"], g["n_groups"], g["n_links"]) == w[1:5] and g["groups_sha256"] == (hexdigest(w[7]) if w[1] else "")
    assert len(got) == len(rows)


def field(value):
    text = None if value is None else str(value)
    return "-" if text is None else f"{len(text.encode())}:{text}"


def merkle(rows):
    """Brute force: (doc_id, leaf, subroot, root, proof digest, folded root, verified) per row."""

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([hexdigest("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, k):
        out = []
        for nodes in levels[:-1]:
            out.append((k % 2, nodes[k ^ 1] if k ^ 1 < len(nodes) else ""))
            k //= 2
        return out

    by_lang = {}
    for i, text, lang, source, n in rows:
        leaf, shown = (hexdigest("".join(map(field, (i, source, lang, m, text)))) for m in (n, n + 1 if n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n))
        by_lang.setdefault(lang, []).append((i is not None, i or 0, leaf, shown))
    order = sorted(by_lang, key=lambda k: (k is not None, (k or "").encode()))
    trees = [up([x[2] for x in sorted(by_lang[k])]) for k in order]
    top, out = up([t[-1][0] for t in trees]), []
    for g, k in enumerate(order):
        for slot, (known, i, leaf, shown) in enumerate(sorted(by_lang[k])):
            way = path(trees[g], slot) + path(top, g)
            for side, sib in way:
                shown = hexdigest(sib + shown if side else shown + sib)
            out.append((i if known else None, leaf, trees[g][-1][0], top[-1][0], hexdigest("".join(s for _, s in way)), shown, shown == top[-1][0]))
    return Counter(out)


def manifest_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.withColumns({"slot": F.lit("x"), "grp": F.lit(1), "leaf": F.lit(2), "total": F.lit(3), "high": F.lit(0)})
    out = manifest.manifest(manifest.tampered_documents(docs)).withColumn("proof_sha256", manifest.proof_digest())
    return Counter(tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest_against_brute_force(spark):
    rng = random.Random(4)
    ids = [*range(2500), *range(65_530, 65_545), *rng.sample(range(-(10**6), 10**6), 300), 2**62, -(2**62), 2**63 - 1, -(2**63)]
    rows = [(i, f"text {i}", "en", "s", i % 50) for i in dict.fromkeys(ids)]
    rows += [(i, "é\n", "de", None, None) for i in range(1025)] + [(5, None, None, "x", 2**63 - 1), (9, "", "", "x", 1), (3, "one", "Ωmega", "", 0)]
    assert manifest_rows(spark, rows) == merkle(rows)


def test_manifest_of_repeated_null_and_single_rows(spark):
    rows = [(7, f"t{k % 3}", "en", "s", 1) for k in range(40)] + [(k % 10, "same", "en", "s", 1) for k in range(30)] + [(None, t, "en", None, None) for t in ("a", "a", None)]
    rows += [(None, "b", None, "s", 2), (None, "b", None, "s", 2)]
    assert manifest_rows(spark, rows) == merkle(rows)
    assert manifest_rows(spark, [(14, "only", "en", "s", 4)]) == merkle([(14, "only", "en", "s", 4)])
    assert manifest_rows(spark, []) == Counter()


def test_containers_rank_like_sorting():
    rng = np.random.default_rng(2)
    for n in (1, 100, 4095, 4096, 30_000, 65_536):
        low = np.sort(rng.choice(65_536, n, replace=False))
        again = rng.choice(low, n // 10, replace=False)
        counts = np.ones(n, dtype=np.int64)
        counts[np.isin(low, again)] += rng.integers(1, 5, len(np.unique(again)))
        got = manifest.rank(manifest.compress(low), *manifest._repeats(low, counts), low)
        assert (got == np.cumsum(counts) - counts).all()
        assert len(manifest.compress(low)) <= 8192
