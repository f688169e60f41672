"""Every stage of the pipeline against a brute-force version on its own input."""

import importlib
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from groundwork.llm import decontam
from tests.llm.helpers import component_ids
from tests.llm.test_decontam_urls import infix
from tests.llm.test_quality_mix_shard import statistics, targets

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before and after each stage, each stage's output written and read again."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"file:{tmp_path_factory.mktemp(name)}/out"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return out


def test_stages_and_columns(steps):
    assert [s[0] for s in steps] == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "sharding"]
    assert all(list(after[0].asDict()) == COLUMNS for _, _, after in steps[:-1])
    assert all(set(after) <= set(before) for _, before, after in steps[:-1])


def test_quality_stage(spark, steps):
    _, before, after = steps[0]
    kept = {r["doc_id"] for r in after}
    fine = {r["doc_id"] for r in before if not statistics(r["text"])[5]}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 AND toxic = 0").collect()} & fine
    assert kept <= fine and len(good & kept) >= 0.97 * len(good)
    assert any(r["doc_id"] in fine for r in before if r["doc_id"] not in kept)


def test_near_duplicate_stage(steps):
    _, before, after = steps[1]
    component = {i: c for i, _, c in component_ids([(r["doc_id"], r["text"]) for r in before])}
    assert len(after) == len({component[r["doc_id"]] for r in after}) == len(set(component.values()))


def test_decontamination_stage(spark, steps):
    _, before, after = steps[2]
    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        words = re.findall(r"\w+", text.lower())
        return any(len(set(w) & set(words)) >= 0.6 * len(set(w)) and infix(w, words) <= int(decontam.Settings().max_edit * len(w)) for w in items)

    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not leaks(r["text"])}


def test_mix_stage(steps):
    _, before, after = steps[3]
    n = {r["doc_id"]: len(r["text"].split()) for r in before}
    sizes, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r["source"]] += n[r["doc_id"]]
        longest[r["source"]] = max(longest[r["source"]], n[r["doc_id"]])
    for r in after:
        taken[r["source"]] += n[r["doc_id"]]
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2
    assert all(abs(taken[s] - t) <= longest[s] / 2 + 1 for s, t in targets(sizes).items())


def test_shard_stage(steps):
    _, before, after = steps[4]
    assert Counter(r[:5] for r in map(tuple, after)) == Counter(map(tuple, before))
    slots = defaultdict(list)
    for r in after:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(24))


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, steps[-1][2]))


def test_entry_point_works_without_the_subpackage(tmp_path):
    """A copy without the operators and the pipeline still registers the other queries."""
    root = Path(__file__).resolve().parents[2]
    import shutil

    shutil.copytree(root / "groundwork", tmp_path / "groundwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'd01_exact_dedup' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run
