"""Line de-duplication and the shingle join against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from groundwork.llm import graph, lines, ngram_join
from tests.llm.helpers import component_ids, documents, lower

BLANK = " \t\n\x0b\x0c\r"


def dropped_lines(rows, min_docs, keep_first=False):
    texts = {(i, t or "") for i, t in rows}
    seen = defaultdict(set)
    for i, t in texts:
        for line in t.split("\n"):
            if key := lower(line.strip(BLANK)):
                seen[key].add((i, t))
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if len(seen[lower(x.strip(BLANK))]) < min_docs]
        out.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(3)
    pool = ["Common Line", "  common line\t", "ÉTÉ", "été", "", " ", "x"] + [f"own {k}" for k in range(40)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for k in range(60)]
    return rows + [(100, None), (101, ""), (None, "Common Line\nz"), (None, "other\nCommon Line"), (5, "Common Line\nnew text for a repeated id"), (7, "\n" * 3000 + "x")]


@pytest.mark.parametrize("clash", [False, True])
def test_lines_against_brute_force(spark, clash):
    rows = line_rows() + line_rows()[:5]
    got = lines.drop_common_lines(documents(spark, rows, clash), min_docs=10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == dropped_lines(rows, 10)


def test_bitmaps_are_runs_of_kept_lines(spark):
    rows = [(k, f"a{k}\nshared\nb{k}\nc{k}\nshared") for k in range(4)]
    for r in lines.line_keep_bitmaps(documents(spark, rows), min_docs=4).collect():
        assert [tuple(x) for x in r["keep"]] == [(0, 1), (2, 2)] and r["n_lines"] == 5


def test_first_line_can_stay(spark):
    rows = [(k, f"shared\nown{k}\nshared") for k in range(3)]
    got = {r["doc_id"]: r["kept"] for r in lines.drop_common_lines(documents(spark, rows), min_docs=2, keep_first=True).collect()}
    assert got == {0: "shared\nown0", 1: "own1", 2: "own2"}


def test_lines_of_an_empty_table(spark):
    assert lines.drop_common_lines(documents(spark, [])).count() == 0


def near_rows(seed, copies=30):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for k in range(copies):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k + 1, " ".join(words)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    for k in range(copies):
        rows.append((1000 + k, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))))
    rows += [(2000 + k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12)))) for k in range(40)]
    rows += [(3000, "one two"), (3001, "One  TWO\n"), (3002, None), (3003, ""), (3004, " \n"), (3005, "É é"), (3006, "é é"), (None, rows[0][1]), (None, "lonely null id row here ok")]
    rows += [(1, rows[0][1]), (1, "a second text under the id of the first one"), (4000, "long " * 5000), (4001, "long " * 4000 + "end")]
    return rows


@pytest.mark.parametrize("hot,tile,seed", [(64, 256, 1), (4, 4, 2), (1, 2, 3)])
def test_join_against_brute_force(spark, hot, tile, seed):
    """Small ``hot`` and ``tile`` put every list through stars and tiles."""
    rows = near_rows(seed)
    got = ngram_join.near_duplicate_components(documents(spark, rows, clash=seed == 2), bits=10, hot=hot, tile=tile)
    assert sorted((tuple(r) for r in got.collect()), key=str) == component_ids(rows)


def grouped_rows(phrases, variants):
    """Rows that share their rarest shingles and their size but not the rest: a rare opening
    with one of ``phrases`` bodies whose last word varies. Fillers make the bodies frequent."""
    rng = random.Random(phrases)
    often = 2 * phrases * variants + 10
    opening = [f"r{k}" for k in range(40)]
    rows, fill = [], []
    for j in range(phrases):
        body = [f"p{j}x{k}" for k in range(100)]
        fill.append(" ".join(opening[-4:] + body[:-1]))
        for v in range(variants):
            rows.append(" ".join(opening + body[:-1] + [f"v{v}"]))
            fill.append(" ".join(body[-5:-1] + [f"v{v}"]))
    rng.shuffle(rows)
    return list(enumerate(rows)), [(10_000 + k, t) for k, t in enumerate(fill * often)]


@pytest.mark.parametrize("phrases,variants,tile", [(5, 6, 4), (1, 40, 256), (12, 1, 5)])
def test_groups_of_different_members(spark, monkeypatch, phrases, variants, tile):
    rows, fill = grouped_rows(phrases, variants)
    pairs, stored = [], ngram_join.materialize

    def counted(df, name):
        out = stored(df, name)
        if name == "member-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    _, members, _ = ngram_join.near_duplicate_links(documents(spark, rows + fill), tile=tile)
    assert max(r["count"] for r in members.groupBy("gid").count().collect()) == len(rows)
    # the star, then pairs with a member that is not in the leader's cluster
    apart = math.comb(len(rows), 2) - math.comb(variants, 2)
    assert pairs[0] == len(rows) - 1 and sum(pairs[1:]) <= apart
    got = ngram_join.near_duplicate_components(documents(spark, rows + fill), tile=tile)
    assert sorted((tuple(r) for r in got.filter("doc_id < 10000").collect()), key=str) == component_ids(rows)


def test_one_row_per_component(spark):
    rows = near_rows(4, copies=12)
    kept = [tuple(r) for r in ngram_join.one_per_component(documents(spark, rows, clash=True)).select("doc_id", "text").collect()]
    blank = [r for r in rows if not (r[1] or "").strip()]
    assert set(kept) <= set(rows)
    texts = [(k, t) for k, (i, t) in enumerate(rows) if (t or "").strip()]
    groups = {c for _, _, c in component_ids(texts)}
    assert len(kept) == len(groups) + len(blank)


def test_join_of_an_empty_table(spark):
    assert ngram_join.near_duplicate_components(documents(spark, [])).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_shingle_sets_follow_the_contract():
    assert len(ngram_join.shingle_set("a b c d e f", 5)) == 2
    assert len(ngram_join.shingle_set("a\x1cb", 5)) == 1
    assert list(ngram_join.shingle_set("A b", 5)) == list(ngram_join.shingle_set("a\tB", 5))
    assert len(ngram_join.shingle_set(None, 5)) == 0


def test_digest_of_kept_text(spark):
    r = lines.drop_common_lines(documents(spark, [(1, "é\nb")])).select(F.sha2("kept", 256).alias("h")).first()
    assert r["h"] == hashlib.sha256("é\nb".encode()).hexdigest() and re.fullmatch("[0-9a-f]{64}", r["h"])
