import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from groundwork.functions.dictionaries import CONCEPTS
from groundwork.operators import evidence as E, index as N, retrieval as V
from groundwork.operators.containment import contained
from groundwork.operators.joins import sized
from groundwork.session import materialize


def test_query_expansion(spark):
    q = spark.createDataFrame([(1, "Lưỡi đỏ rêu vàng, chóng mặt và đau đầu"), (2, "hình ảnh tongue 舌苔厚腻 của structured")], "query_id long, text string")
    terms = {r["query_id"]: r["terms"] for r in V.expand_query(q).collect()}
    assert terms[1][:6] == ["舌红", "red tongue", "苔黄", "yellow coating", "头痛", "headache"]
    assert {"头晕", "chóng"} <= set(terms[1]) and len(terms[1]) <= 14
    assert terms[2][:3] == ["舌", "tongue", "舌苔厚腻"] and "structured" not in terms[2] and "hình" in terms[2]


def test_sanitize_terms(spark):
    df = spark.createDataFrame([(['"A (b)"', "a b", " ", "x" * 49, "C:*"],)], "t array<string>")
    assert df.select(V.sanitize_terms(F.col("t")).alias("o")).first()["o"] == ["A b", "C"]


def corpus(spark):
    rows = [(1, "舌红 苔黄 头痛 case", "red tongue", "s", "sft"), (2, "red and tongue apart", "", "s", "sft"), (3, "nothing here", "", "t", "qa")]
    return spark.createDataFrame(rows, "doc_id long, case_text string, target string, source string, task string")


def stored(spark, tmp_path, rows=None, **settings):
    rows = corpus(spark) if rows is None else rows
    return N.write_index(rows, str(tmp_path / "index"), **settings)


def test_phrase_needs_adjacent_words_in_one_field(spark, tmp_path):
    index = stored(spark, tmp_path)
    q = spark.createDataFrame([(9, ["red tongue", "舌红"]), (8, ["tongue apart"]), (7, ["apart red", "none", "tongue s"]), (6, [])], "query_id long, terms array<string>")
    assert sorted((r["query"], r["doc"]) for r in N.match_any_phrase(index, q).collect()) == [(8, 2), (9, 1)]
    assert N.index_probe(index, ["tongue", "nothing"]).first()["n_docs"] == 3
    assert N.index_probe(index, ["absent"]).first()["n_docs"] == 0


def test_bm25_value(spark, tmp_path):
    q = spark.createDataFrame([(9, ["nothing"])], "query_id long, terms array<string>")
    row = N.bm25_topk(stored(spark, tmp_path), q).first()
    lengths = [4 + 2 + 1 + 1, 4 + 0 + 1 + 1, 2 + 0 + 1 + 1]
    idf = math.log((3 - 1 + 0.5) / (1 + 0.5))
    want = -idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[2] / (sum(lengths) / 3)))
    assert row["doc"] == 3 and abs(float(row["score"]) - want) < 1e-6


def ranked(texts, terms, k):
    """BM25 by its formula over all documents."""
    words = {d: t.split() for d, t in texts.items()}
    avgdl = sum(map(len, words.values())) / len(words)
    scores = Counter()
    for phrase in {tuple(t.split()) for t in terms if t.split()}:
        tf = {d: n for d, w in words.items() if (n := sum(tuple(w[i : i + len(phrase)]) == phrase for i in range(len(w))))}
        raw = math.log((len(words) - len(tf) + 0.5) / (len(tf) + 0.5)) if tf else 0
        for d, n in tf.items():
            scores[d] += round((raw if raw > 0 else 1e-6) * (n * 2.2) / (n + 1.2 * (0.25 + 0.75 * len(words[d]) / avgdl)), 9)
    return sorted(scores, key=lambda d: (-round(scores[d], 7), d))[:k], scores


@pytest.mark.parametrize("k", [1, 3, 10, 40])
def test_ranking_with_skipped_blocks_against_the_formula(spark, tmp_path, k):
    rng = random.Random(k)
    pool = [f"w{j}" for j in range(60)]
    texts = {d: " ".join(rng.choices(pool, weights=[1 / (1 + j) for j in range(60)], k=rng.randrange(1, 40))) for d in range(0, 900, 3)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, case_text string")
    index = stored(spark, tmp_path, rows, fields=["case_text"], bits=4, kept=5, buckets=8)
    asked = {q: [" ".join(rng.choices(pool, k=rng.choice([1, 1, 1, 2, 3]))) for _ in range(rng.randrange(1, 7))] for q in range(30)} | {98: ["w0 w0", "w1 w0 w0"], 99: ["zzz"], 100: ["w0", "w59"]}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    got = {}
    for r in N.bm25_topk(index, queries, k).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["doc"], round(float(-r["score"]), 7)))
    for q, terms in asked.items():
        order, scores = ranked(texts, terms, k)
        mine = got.get(q, [])
        assert len(mine) == len(order)
        for (doc, score), want in zip(mine, order, strict=True):
            assert abs(score - scores[doc]) < 1e-6 and abs(scores[doc] - scores[want]) < 1e-6


def test_fewer_candidates_than_matches(spark, tmp_path):
    texts = [(d, "common " * (1 + d % 3) + ("rare " * 3 if d % 100 == 0 else f"x{d}")) for d in range(2000)]
    index = stored(spark, tmp_path, spark.createDataFrame(texts, "doc_id long, case_text string"), fields=["case_text"], bits=5)
    units = materialize(N.query_units(spark.createDataFrame([(1, ["common", "rare"])], "query_id long, terms array<string>")), "units")
    none = spark.createDataFrame([], "phrase string, doc bigint, tf bigint, length bigint")
    asked = N._asked(index, units, none, 4)
    assert 4 <= N.candidates(index, asked, none).count() <= 20  # of 2,000, some of those with the rare word
    found = index.lookup("postings", units.select(F.col("phrase").alias("term")))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:200]
    assert "GreaterThanOrEqual(term,common)" in plan


def test_next_concept(spark):
    cases = ["头痛 头晕 dizziness", "chóng mặt mất ngủ", "hoa mắt", "dizziness insomnia"]
    hits = spark.createDataFrame([(1, c) for c in cases], "query long, case_text string")
    q = spark.createDataFrame([(1, "Tôi đau đầu"), (2, "none")], "query_id long, text string")
    out = {r["query"]: r for r in V.next_concept(hits, q, CONCEPTS).collect()}
    assert (out[1]["concept"], out[1]["support"], out[1]["considered"]) == ("dizziness", 4, 4)
    assert out[2]["concept"] is None and out[2]["considered"] == 0
    skipped = V.next_concept(hits, q, CONCEPTS, excluded=["dizziness"]).filter("query = 1").first()
    assert skipped["concept"] == "sleep"


def test_concepts_of_a_case_are_sought_once(spark, monkeypatch):
    found = spark.createDataFrame([(q, d) for q in range(40) for d in ((1, 2) if q % 2 else (2, 3))], "query long, doc long")
    cases = spark.createDataFrame([(1, "头痛 dizziness"), (2, "dizziness"), (3, "mất ngủ")], "doc long, case_text string")
    q = spark.createDataFrame([(i, "none" if i % 3 else "chóng mặt") for i in range(41)], "query_id long, text string")
    written = {}
    monkeypatch.setattr(V, "materialize", lambda df, name: written.setdefault(name, materialize(df, name)))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    once = rows(V.next_concept(found, q, CONCEPTS, cases=cases))
    assert once == rows(V.next_concept(found.join(cases, "doc"), q, CONCEPTS)) and len(once) == 41
    assert written["held"].count() == 3  # not the 80 hits


def test_contained_against_a_plain_search(spark):
    rng = random.Random(6)
    texts = ["lưỡi đỏ nhạt", "ab", "qc", "", " lead  two ", "x" * 500 + "needle" + "y" * 300, "a b c d", "tail \n next", None, "日本語のテキスト" * 40]
    texts += ["".join(rng.choice("ab  c") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    needles = ["đỏ nhạt", "b", "qc", "zz", "ỡi", "needle", "xneedley", " ", "  ", " b", "b ", "a b", "b c d", "  two", "l \n n", "", "本語", "x" * 70, "i đ"]
    needles += ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    hay = spark.createDataFrame(list(enumerate(texts)), "h long, t string")
    got = [(r["h"], r["n"]) for r in contained(hay, "h", "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n").collect()]
    want = {(k, n) for k, t in enumerate(texts) for n in needles if t is not None and n and n in t}
    assert len(got) == len(set(got)) and set(got) == want
    assert contained(hay, "h", "t", spark.createDataFrame([], "n string"), "n").count() == 0


def test_many_needles_in_few_texts(spark):
    from groundwork.operators.containment import found_in

    rng = random.Random(8)
    needles = ["a b", "b c d", "c d ab", " b", "b ", "  ", " ", "", "ab", "x y z", "tail", "ail \n ne", "日本語", "本語の", "y" * 70, "x y", "a b", "d  e", None]
    needles += ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    rows = list(enumerate(needles))
    short = ["ab b c d ab", "tail \n next", "", None, "d  e", " b "] + ["".join(rng.choice("ab  c") for _ in range(rng.randrange(1, 30))) for _ in range(20)]
    for texts in (short, short + ["日本語のテキスト" * 40 + " x", "q" + "x" * 90 + " " + "y" * 80 + " z", "w" * 80 + "x y zz"]):
        hay = spark.createDataFrame(list(enumerate(texts)), "h long, t string")
        got = [(r["i"], r["h"]) for r in found_in(spark.createDataFrame(rows, "i long, n string"), "n", hay, "h", "t").select("i", "h").collect()]
        want = {(i, h) for i, n in rows for h, t in enumerate(texts) if n and t is not None and n in t}
        assert len(got) == len(set(got)) and set(got) == want


def test_topics_stay_where_they_are(spark):
    """Topics meet the few texts without being shuffled, and a generated topic list is made once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def pairs(text):
        made.add(1)
        words = text.split(" ")
        return [" ".join(p) for p in zip(words, words[1:])]

    docs = spark.createDataFrame([(i, f"src{i % 3}", i % 97, f"common words w{i} here") for i in range(50)], "entry_id long, source string, page long, text string")
    q = spark.createDataFrame([(1, "uncommon words w7 hereby"), (2, "w8 here")], "query_id long, text string")
    out = E.topic_hits(docs.withColumn("topics", pairs("text")), q)
    assert sorted((r["query"], r["entry_id"], r["score"]) for r in out.collect() if r["score"] > 1 or r["query"] == 2) == [(1, 7, 3), (2, 8, 1)]
    assert made.value == 50


def test_best_rule_against_a_plain_search(spark):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abñ") for _ in range(rng.randrange(1, 5))) + rng.choice(["", ",", ".\n"]) for _ in range(rng.randrange(0, 7))) for _ in range(60)] + [None, "Straße No-7 a b", "no 7 topic"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    entries = spark.createDataFrame(rows, "entry_id long, text string")
    plain = [["ab", "ñ", "zz"], ["bb", "aab", "ñb", "a"], ["zz"], [], ["straße", "no", "7"], ["A", "a"]]
    for wanted in (plain, plain + [["no-7", ","], ["b,"]], plain + [["a b", "no 7"], ["\n"]]):
        lists = spark.createDataFrame(list(enumerate(wanted)), "query_id long, wanted array<string>")
        got = {r["query"]: (r["entry_id"], r["score"]) for r in E.best_rule(entries, lists).collect()}
        want = {}
        for k, ts in enumerate(wanted):
            scored = [(-sum(t.lower() in text.lower() for t in ts), i) for i, text in enumerate(texts) if text is not None]
            least = min(scored)
            if least[0]:
                want[k] = (least[1], -least[0])
        assert got == want


def test_core_flags_may_come_apart_from_the_entries(spark):
    entries = spark.createDataFrame([(1, "s", ["long word"]), (2, "s", ["long"]), (3, "s", ["zz"])], "entry_id long, source string, topics array<string>")
    core = spark.createDataFrame([(1, False), (2, True), (3, True)], "entry_id long, core boolean")
    q = spark.createDataFrame([(1, "a long word")], "query_id long, text string")
    both = [sorted(map(tuple, E.topic_rank_with_backfill(*a, **k).collect()), key=str) for a, k in (((entries, q), {"core": core}), ((entries.join(core, "entry_id"), q), {}))]
    assert both[0] == both[1] and (1, 1, 2, 3.0) in both[0] and (1, 2, 1, 3.2) in both[0]


def test_topic_scores_count_tokens_and_whole_topics(spark):
    entries = spark.createDataFrame(
        [(1, "src", False, 1, ["long word", "LONG Word", "other thing"], "t"), (2, "none", True, 1, ["thing longer"], "t"), (3, "x", True, 2, ["zzzz"], "t"), (4, "x", False, 2, [], "t")],
        "entry_id long, source string, core boolean, page long, topics array<string>, text string",
    )
    q = spark.createDataFrame([(1, "a very long wording from src"), (2, "nothing"), (3, "")], "query_id long, text string")
    got = sorted((r["query"], r["rank"], r["entry_id"], r["score"]) for r in E.topic_rank_with_backfill(entries, q).collect())
    # entry 1: two topics whole, 'src' named; entry 2 shares 'thing' with query 2 only
    assert got == [(1, 1, 1, 6.5), (1, 2, 2, None), (1, 3, 3, None), (2, 1, 2, 0.65), (2, 2, 1, 0.45), (2, 3, 3, None), (3, 1, 2, None), (3, 2, 3, None)]
    assert [(r["query"], r["entry_id"], r["score"]) for r in E.topic_hits(entries, q).collect()] == [(1, 1, 2)]


def test_knowledge_rank_blocks_contradictions(spark):
    docs = spark.createDataFrame(
        [(1, "lưỡi tím rêu trắng", "AT1", 3), (2, "lưỡi đỏ rêu dày", "AT1", 4), (3, "stress lưỡi", "PSY1", 1), (4, "lưỡi rêu trắng", "TC1", 5)], "doc_id long, text string, source string, page long"
    )
    q = spark.createDataFrame([(1, "lưỡi rêu trắng", True, "đỏ", "trắng", "mỏng"), (2, "lưỡi stress", False, None, None, None)], "query_id long, text string, has_profile boolean, top_color string, coating_color string, coating_thickness string")
    out = E.knowledge_rank(docs, q).collect()
    assert [r["doc"] for r in out if r["query"] == 1] == [4]
    assert {r["doc"]: r["score"] for r in out if r["query"] == 2}[3] == 6 + 12


def test_every_word_of_a_conversation_is_a_term(spark, tmp_path):
    from groundwork.plans import retrieval_plans as P

    said = [f"w{i} the {'x' * (i % 3 + 1)}" for i in range(40)]
    rows = [(1, i, "user", t) for i, t in enumerate(said)] + [(1, 99, "assistant", "unsaid"), (2, 0, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["query_id"]: r for r in P.chat_queries(spark, str(tmp_path)).collect()}
    assert set(got[1]["terms"]) == {w for t in said for w in t.split()} and len(got[1]["terms"]) == 44
    assert got[2]["terms"] == [] and got[1]["text"] == " ".join(said)


def test_sums_per_query_and_document_move_no_pairs(spark, tmp_path):
    rows = spark.range(300).selectExpr("id as doc_id", "concat('common red tongue w', id % 7) as case_text", "'' as target", "'s' as source", "'t' as task")
    index = N.write_index(rows, str(tmp_path / "index"), bits=4)
    best = {r["term"]: r for r in index.table("terms").collect()}
    assert (best["w3"]["df"], best["common"]["cf"], len(best["common"]["best"])) == (43, 300, 64) and best["w3"]["best"][0] >= best["w3"]["best"][-1]
    queries = spark.createDataFrame([(q, ["common", f"w{q}", "red tongue"]) for q in range(5)], "query_id long, terms array<string>")
    units = materialize(N.query_units(queries), "units")
    phrases = materialize(N.phrase_postings(index, units).join(index.table("doc_stats"), "doc"), "phrases")
    found = N.candidates(index, materialize(N._asked(index, units, phrases, 4), "asked"), phrases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and not re.search(r"hashpartitioning\(query#\d+L?, doc#", plan)
    assert found.count() >= 20


def test_no_pair_of_query_and_document_is_written(spark, tmp_path, monkeypatch):
    rows = spark.range(600).selectExpr("id as doc_id", "concat('common usual w', id % 7) as case_text", "'' as target", "'s' as source", "'t' as task")
    index = N.write_index(rows, str(tmp_path / "index"), bits=8)
    queries = spark.createDataFrame([(q, ["common", "usual", "text", f"w{q % 7}"]) for q in range(30)], "query_id long, terms array<string>")
    written = {}
    keep = lambda df, name: written.setdefault(name, materialize(df, name))
    monkeypatch.setattr(N, "materialize", keep)
    got = {(r["query"], r["doc"]) for r in N.bm25_topk(index, queries, 2).collect()}
    assert got == {(q, d) for q in range(30) for d in (q % 7, q % 7 + 7)}
    assert max(df.count() for df in written.values()) <= 30 * 4  # the pairs were 18,000


def test_points_are_rounded_as_a_cast_rounds(spark):
    rng = np.random.default_rng(3)
    parts = np.concatenate([rng.random(2000) * 40, np.round(rng.random(2000) * 40, 9) + 5e-10, [0.0, 5e-10, 1e-12]])
    rows = spark.createDataFrame(list(enumerate(parts.tolist())), "i long, part double")
    want = [int(r[0]) for r in rows.orderBy("i").selectExpr("cast(part as decimal(38,9)) * 1000000000").collect()]
    assert N._billionths(parts).tolist() == want


def test_places_do_not_run_from_field_to_field(spark, tmp_path):
    rows = [(7, "a b a", "b c", "", ""), (7, "c a", "", "", ""), (9, "", "a b", "c", "")]
    index = stored(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, case_text string, target string, source string, task string"))
    got = {(r["term"], d): t for r in index.table("postings").collect() for d, t in zip(r["docs"], r["tfs"])}
    assert got == {("a", 7): 3, ("b", 7): 2, ("c", 7): 2, ("a", 9): 1, ("b", 9): 1, ("c", 9): 1}
    units = N.query_units(spark.createDataFrame([(1, ["a b", "b c", "a c", "b a", "b a b", "c a"])], "query_id long, terms array<string>"))
    found = {(r["phrase"], r["doc"]): r["tf"] for r in N.phrase_postings(index, units).collect()}
    assert found == {("a b", 7): 1, ("b c", 7): 1, ("b a", 7): 1, ("c a", 7): 1, ("a b", 9): 1}


def test_large_tables_in_small_files_are_not_broadcast(spark):
    many = materialize(spark.range(3000).selectExpr("id", "0 as x"), "many")
    plan = lambda few: spark.range(9).join(sized(many, few), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" in plan(3000) and "Broadcast" not in plan(2999).split("\n")[1] and "SortMergeJoin" in plan(2999)


def test_many_phrases_are_found_in_one_pass(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 12))) for i in range(60)}
    rows = [(i, t, "", "s", "t") for i, t in texts.items()]
    index = N.write_index(spark.createDataFrame(rows, "doc_id long, case_text string, target string, source string, task string"), str(tmp_path / "index"))
    asked = {q: [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 2, 3]))) for _ in range(30)] for q in range(8)}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    monkeypatch.setattr(N, "phrase_postings", None)  # the positions of all words would be read many times over
    got = [(r["query"], r["doc"]) for r in N.match_any_phrase(index, queries).collect()]
    want = {(q, d) for q, phrases in asked.items() for d, t in texts.items() if any(f" {p} " in f" {t} " for p in phrases)}
    assert sorted(got) == sorted(want)


def test_token_scores_are_summed_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    words = [a + b for a in ("ab", "abc", "xyz", "bcd") for b in ("", "e", "efg", "abc")]
    docs = spark.createDataFrame([(i, rng.choice(["s", "t", None]), i % 3, " ".join(rng.choices(words, k=rng.randrange(6)))) for i in range(90)], "doc_id long, source string, page long, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(7)], "query_id long, text string")
    bonuses, blocks = [("ab", "d.source = 's'", 2), ("xyz", "d.page = 1", 5, "q.query_id > 2")], [("d.page = 2", "q.query_id = 3")]
    run = lambda: ([tuple(r) for r in E.evidence_rank(docs, queries, 5, bonuses, blocks).orderBy("query", "rank").collect()], [tuple(r) for r in E.token_overlap_search(docs, queries, 4).orderBy("query", "rank").collect()])
    whole = run()
    monkeypatch.setattr(E, "BLOCK_CELLS", 1)  # 16 documents a block
    assert run() == whole
    tokens = {r["query_id"]: {w for w in r["text"].split() if len(w) >= 3} for r in queries.collect()}
    want = []
    for q, text in [(r["query_id"], r["text"]) for r in queries.collect()]:
        scored = []
        for d in docs.collect():
            terms = {w for w in d["text"].split() if len(w) >= 3}
            base = sum(3 if t in terms else any(t in w or w in t for w in terms) for t in tokens[q])
            if base and not (d["page"] == 2 and q == 3):
                base += 2 * ("ab" in text and d["source"] == "s") + 5 * ("xyz" in text and d["page"] == 1 and q > 2)
                scored.append((-base, d["source"] or "", d["page"], d["doc_id"]))
        want += [(q, s[3], s[1] or None, s[2], -s[0], i + 1) for i, s in enumerate(sorted(scored)[:5])]
    assert [tuple(r) for r in E.evidence_rank(docs, queries, 5, bonuses, blocks).select("query", "doc", "source", "page", "score", "rank").orderBy("query", "rank").collect()] == want
