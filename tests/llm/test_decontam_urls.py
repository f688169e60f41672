"""Benchmark decontamination and URL filters against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from groundwork.llm import decontam, queries, urls
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.01"
ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def infix(item, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item):
        new = [k + 1]
        for j, x in enumerate(text):
            new.append(min(row[j + 1] + 1, row[j] + (x != w), new[j] + 1))
        row = new
    return min(row)


def test_infix_distance_is_exact():
    rng = random.Random(1)
    for _ in range(60):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 14))]
        assert decontam.infix_distance(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))[0] == infix(a, b)


def planted(rng, edits):
    vocabulary = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 15, 30, 60])))) for k in range(40)]
    rows = []
    for k in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        if k % 2:
            item = items[rng.randrange(len(items))][1].split()
            for _ in range(int(edits * len(item))):
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], ["zz"], [item[at], "yy"]])
            text[len(text) // 2 : len(text) // 2] = item
        rows.append((k, " ".join(text)))
    return items, rows


def test_recall_and_exactness_against_brute_force(spark):
    for edits, least in ((0.0, 1.0), (0.1, 0.97), (0.2, 0.9)):
        items, rows = planted(random.Random(int(edits * 10)), edits)
        truth = {}
        for i, text in rows:
            for j, item in items:
                w = words(item)
                if len(set(w) & set(words(text))) >= 0.4 * len(set(w)) and (d := infix(w, words(text))) <= int(0.2 * len(w)):
                    truth[i, j] = d
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.benchmark_matches(documents(spark, rows, clash=True), spark.createDataFrame(items, ITEMS)).collect()}
        assert set(got) <= set(truth) and all(got[k] == truth[k] for k in got)
        assert len(got) >= least * len(truth) and len(truth) >= 40


def test_recall_per_item_length():
    rng, s = random.Random(5), decontam.Settings()
    for n in range(12, 21):
        for share, least in ((0.0, 1.0), (0.1, 0.97), (0.2, 0.9)):
            items, texts = [], []
            for k in range(150):
                item = [f"i{k}v{rng.randrange(40)}" for _ in range(n)]
                items.append((k, " ".join(item)))
                for at in sorted(rng.sample(range(n), int(share * n)), reverse=True):
                    item[at : at + 1] = rng.choice([[], ["zz"], [item[at], "yy"]])
                texts.append(" ".join([f"w{rng.randrange(300)}" for _ in range(rng.randrange(60))] + item + ["end"] * rng.randrange(30)))
            found = {(at, m[0]) for at, m in decontam._searched(texts, decontam.build_index(items, s), s)}
            assert len(found & {(k, k) for k in range(150)}) >= (1.0 if n < s.short else least) * 150, (n, share)


def test_short_items_are_found_exactly(spark):
    rows = [(1, "x one two three four five y"), (2, "one two tree four five"), (3, "one five"), (4, "ONE, two three four five!")]
    got = decontam.benchmark_matches(documents(spark, rows), spark.createDataFrame([(1, "One two three four five"), (2, "")], ITEMS))
    assert {(r["doc_id"], r["distance"]) for r in got.collect()} == {(1, 0), (2, 1), (4, 0)}


def test_awkward_rows_and_blocks(spark):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(None, item), (None, item), (1, None), (2, ""), (3, "word " * 60_000 + item), (4, "clean text"), (3, "again clean")]
    items = spark.createDataFrame([(5, item), (5, item), (None, item), (6, None), (7, " ")], ITEMS)
    docs = documents(spark, rows, clash=True)
    got = [(r["doc_id"], r["item_id"]) for r in decontam.benchmark_matches(docs, items, decontam.Settings(block=1)).collect()]
    assert Counter(got) == Counter({(None, 5): 4, (None, None): 2, (3, 5): 2, (3, None): 1})
    kept = decontam.clean_documents(docs, items, decontam.Settings(block=2))
    assert sorted((r["doc_id"] for r in kept.collect())) == [1, 2, 3, 4] and kept.columns == docs.columns
    assert decontam.benchmark_matches(documents(spark, []), items).count() == 0
    assert decontam.clean_documents(docs, items.limit(0)).count() == len(rows)


def test_table_leaks_are_the_verbatim_ones(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op6_decontaminate"](spark, SF).collect()}
    assert {(i, j) for i, t in docs.items() for j, x in items.items() if x in t} <= got


RULES = queries.URL_RULES
URLS = [
    None,
    "",
    "no scheme",
    "http://A.Example.COM/en/x?y#z",
    "https://www.example.com/en/1",
    "https://www.example.com/EN/1",
    "ftp://notexample.com",
    "http://example.com",
    "http://example.com/",
    "http://x.net/es/a",
    "http://net/fr/",
    "http://x.net/fr",
    "http://x.internet/fr/",
    "http://com?a/b://c.com/",
    "http://É.org/en/#://x.com/",
    "a://b://c.com/",
]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :])[0]


def ruled(host, path):
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, URLS[3]), (3, URLS[3])]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, host string, score string, _text int")
    got = urls.judge_urls(pages, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[3] if r["page_id"] is None else URLS[r["page_id"]]
        host, path = parsed(url)
        rule, verdict = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert {r["verdict"] for r in got if r["page_id"] in (0, 1)} == {"block"}
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0


def brute_force_scores(rows, held, s):
    """Scores of (url, allow or block or None) rows from exact counts; ``held`` teaches nothing."""
    lowered = lambda u: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u)
    sides = {v: Counter() for v in ("allow", "block")}
    contexts = {v: Counter() for v in ("allow", "block")}
    for url, verdict in rows:
        if url and verdict and url not in held:
            text = "\x01" * s.order + lowered(url)
            for i in range(s.order, len(text)):
                for k in range(s.order + 1):
                    sides[verdict][text[i - k : i + 1]] += 1
                    contexts[verdict][text[i - k : i], k] += 1

    def p(verdict, text, i):
        out = 1 / 256
        for k in range(s.order + 1):
            out = (sides[verdict][text[i - k : i + 1]] + s.prior * out) / (contexts[verdict][text[i - k : i], k] + s.prior)
        return out

    scores = {}
    for url in {u for u, _ in rows if u}:
        text = "\x01" * s.order + lowered(url)
        scores[url] = sum(math.log(p("allow", text, i)) - math.log(p("block", text, i)) for i in range(s.order, len(text))) / len(url)
    return scores


def best_threshold(rows, scores, held, s):
    known = [(min(2000, max(-2000, math.floor(scores[u] / s.step))), v) for u, v in rows if u in held and v]
    n = Counter(v for _, v in known)
    if len(n) < 2:
        return 0.0
    gain = lambda t: sum((1 if v == "allow" else -1) / n[v] for b, v in known if b >= t)
    return max(sorted({0, *(b for b, _ in known)}), key=lambda t: (round(gain(t), 12), -abs(t))) * s.step


def test_scores_and_verdicts_against_brute_force(spark):
    rng, s = random.Random(5), urls.Settings()
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    made = [f"https://{word('abcde')}.com/{word('abcxyz')}" for _ in range(150)] + [f"http://{word('defg')}.net/fr/{word('klmé')}" for _ in range(120)]
    made += [f"http://{word('abcdefg')}.org/{word('abklm')}" for _ in range(60)] + ["HTTP://Q.org/😀" + "é" * 40, "x" * 5_000, "", None] + [made[0]] * 50 + [made[160]] * 30
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    folds = {r["url"] for r in pages.filter(F.pmod(F.xxhash64("url"), F.lit(s.folds)) == 0).collect()}
    rows = [(u, ruled(*parsed(u))[1]) for u in made]
    assert {v for u, v in rows if u in folds} == {"allow", "block", None}
    scores = brute_force_scores(rows, folds, s)
    threshold = best_threshold(rows, scores, folds, s)
    got = urls.judge_urls(pages, RULES).collect()
    assert len(got) == len(made)
    for r in got:
        url, verdict = rows[r["page_id"]]
        assert r["score"] is None if not url else math.isclose(r["score"], scores[url], rel_tol=1e-7, abs_tol=1e-8), url
        assert r["verdict"] == (verdict or ("allow" if url and scores[url] >= threshold else "block")), url


def test_verdicts_of_the_table_against_brute_force(spark):
    s, pages = urls.Settings(), spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r["url"], ruled(*parsed(r["url"]))[1]) for r in pages.collect()]
    folds = {r["url"] for r in pages.filter(F.pmod(F.xxhash64("url"), F.lit(s.folds)) == 0).collect()}
    scores = brute_force_scores(rows, folds, s)
    for r in queries.QUERIES["op5_url_filter"](spark, SF).select("score", "rule", "host", "path", "verdict").collect():
        assert any(math.isclose(r["score"], x, rel_tol=1e-7, abs_tol=1e-8) for x in scores.values())
    threshold = best_threshold(rows, scores, folds, s)
    expected = Counter(v or ("allow" if u and scores[u] >= threshold else "block") for u, v in rows)
    assert Counter(r["verdict"] for r in queries.QUERIES["op5_url_filter"](spark, SF).collect()) == expected
