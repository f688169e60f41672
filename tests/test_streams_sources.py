import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from groundwork.operators import governance as G, telemetry as L
from groundwork.operators.joins import salted_lookup, with_dense_index
from groundwork.sources import digests, readers as S
from groundwork.streaming import ingest, stateful
from groundwork.streaming.keystore import KeyStore

WINDOW, LIMIT = 60, 3


def events(seed, n=300, keys=4, span=2500):
    rng = random.Random(seed)
    return sorted((rng.randrange(keys), rng.randrange(span), i, f"fp{rng.randrange(3)}") for i in range(n))


def frame(spark, rows):
    df = spark.createDataFrame(rows, "k long, s long, id long, fp string")
    return df.withColumn("ts", F.timestamp_seconds("s"))


def limit_by_hand(rows):
    state, out = {}, {}
    for k, s, i, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        start, n = state.get(k, (None, 0))
        if start is None or s - start >= WINDOW:
            start, n = s, 0
        n += 1
        state[k] = (start, n)
        out[i] = (n <= LIMIT, None if n <= LIMIT else max(1, start + WINDOW - s))
    return out


def throttle_by_hand(rows):
    state, last, out = {}, {}, set()
    for k, s, i, fp in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        start, n = state.get(k, (None, 0))
        if start is None or s - start >= WINDOW:
            start, n = s, 0
        seen = last.get((k, fp))
        if n < LIMIT and (seen is None or s - seen >= WINDOW):
            last[(k, fp)] = s
            n += 1
            out.add(i)
        state[k] = (start, n)
    return out


@pytest.mark.parametrize("seed,span", [(1, 2500), (2, 400), (3, 60_000)])
def test_batch_windows_equal_sequential(spark, seed, span):
    rows = events(seed, span=span)
    df = frame(spark, rows)
    got = {r["id"]: (r["allowed"], r["retry_after"]) for r in L.anchored_rate_limit(df, "k", "ts", "id", WINDOW, LIMIT).collect()}
    assert got == limit_by_hand(rows)
    kept = {r["id"] for r in L.throttle_faults(df, "k", "ts", "id", "fp", WINDOW, LIMIT).collect()}
    assert kept == throttle_by_hand(rows)


def test_only_changed_windows_are_decided_again(spark):
    rng = random.Random(4)
    rows = [(k % 3, w * WINDOW + rng.randrange(WINDOW), i, f"fp{rng.randrange(6)}") for i, (k, w) in enumerate((k, w) for k in range(3) for w in range(340) for _ in range(4))]
    passes = []
    kept = {r["id"] for r in L.throttle_faults(frame(spark, rows), "k", "ts", "id", "fp", WINDOW, LIMIT, passes).collect()}
    assert kept == throttle_by_hand(rows)
    # 1,000 windows in chains: after two full passes the rows decided fall away
    assert passes[0] == len(rows) and passes[2] < passes[0] and passes[-1] < passes[0] / 10 and len(passes) < 40


def run_stream(spark, tmp_path, parts, build, schema="key long, s long, id long, fp string"):
    """Runs the parts one after the other; the last one should hold a far later event, which
    moves the watermark past all others."""
    source = str(tmp_path / "in")
    for part in parts:
        df = spark.createDataFrame(part, schema).withColumn("t", F.col("s") * 1_000_000)
        df.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(f"{schema}, t long").option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    query = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).collect(), query.recentProgress


def waves(rows, late=120):
    """Three waves by time with some events of each one wave late, and a closing event."""
    ordered = sorted(rows, key=lambda r: r[1])
    third = -(-len(ordered) // 3)
    out, held = [], []
    for k in range(3):
        part = ordered[k * third : (k + 1) * third]
        end = part[-1][1]
        kept = [r for r in part if not (r[2] % 4 == 0 and r[1] > end - late)]
        out.append(kept + held)
        held = [r for r in part if r not in kept]
    return [*out, [*held, (-1, 10**7, -1, "end")]]


def state_rows(progress):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress if p["stateOperators"]]


def test_streaming_rate_limit_equals_batch(spark, tmp_path):
    rows = events(5, n=160, span=3000)
    got, progress = run_stream(spark, tmp_path, waves(rows), lambda s: stateful.stream_rate_limit(s.select("key", "t", "id"), WINDOW, LIMIT, delay="150 seconds"))
    assert {r["id"]: (r["allowed"], r["retry_after"]) for r in got if r["id"] >= 0} == limit_by_hand(rows)
    df = frame(spark, rows)
    assert {r["id"]: (r["allowed"], r["retry_after"]) for r in L.anchored_rate_limit(df, "k", "ts", "id", WINDOW, LIMIT).collect()} == limit_by_hand(rows)
    # nothing is left of the keys that rest but the closing event
    assert state_rows(progress)[-1] <= 4 < max(state_rows(progress))


def test_streaming_throttle_equals_batch(spark, tmp_path):
    rows = events(6, n=160, span=3000)
    got, progress = run_stream(spark, tmp_path, waves(rows), lambda s: stateful.stream_throttle(s.select("key", "t", "id", "fp"), WINDOW, LIMIT, delay="150 seconds"))
    assert {r["id"] for r in got if r["id"] >= 0} == throttle_by_hand(rows)
    assert state_rows(progress)[-1] <= 4


def test_streaming_learning_events_equal_batch(spark, tmp_path):
    rng = random.Random(9)
    group = lambda s: hashlib.sha256(str(s).encode()).hexdigest()
    rows = []
    for i in range(150):
        kind = rng.choice(["contribution", "sample"])
        sample = rng.randrange(12)
        rows.append((kind, sample * 10 + rng.randrange(3), sample, group(sample), rng.randrange(2000), i, rng.choice(["approved", "adjudicated", "open"])))
    schema = "kind string, ref_id long, sample_id long, group_hash string, s long, id long, status string"
    ordered = sorted(rows, key=lambda r: r[4])
    parts = [ordered[:70], [*ordered[75:], *ordered[70:75]], [("sample", 0, -1, group(-1), 10**7, -1, "open"), ("sample", 0, -1, group(-1), 10**7, -2, "adjudicated")]]
    pool = spark.createDataFrame([(s, group(s)) for s in range(12) if s % 5], "sample_id long, group_hash string")
    got, _ = run_stream(spark, tmp_path, parts, lambda s: stateful.stream_learning_events(s, pool, delay="200 seconds"), schema)
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).withColumnRenamed("id", "event_id")
    contributions = df.filter("kind = 'contribution'").withColumnRenamed("ref_id", "contribution_id")
    want = G.learning_events(contributions, df.filter("kind = 'sample'"), pool)
    key = lambda r: tuple(r[c] for c in ("event_key", "event_type", "sample_id", "event_id", "state", "rebuild"))
    assert sorted(key(r) for r in got if r["sample_id"] >= 0) == sorted(key(r) for r in want.collect())


def test_key_store_answers_like_a_set_and_reads_few_files(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "keys"), buckets=4, fanout=3)
    key = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    frame_of = lambda ids: spark.createDataFrame([(key(i),) for i in ids], "key string")
    rng, seen, files = random.Random(1), set(), []
    for batch in range(12):
        ids = {rng.randrange(400) for _ in range(30)}
        store.merge(batch)
        got = {r["key"] for r in store.known(frame_of(ids), batch).collect()}
        assert got == {key(i) for i in ids & seen}
        fresh = ids - seen
        store.add(batch, frame_of(fresh))
        again = {r["key"] for r in store.known(frame_of(ids), batch).collect()}
        assert again == got  # a repeated batch does not meet its own keys
        seen |= ids
        new = frame_of([10_000 + batch])  # one new key: its filter rows, and hardly any keys
        asked = new.select("key", store._bucket().alias("bucket"))
        files.append((len(store.runs()), sum(len(store.suspects(asked, r)) for r in store.runs())))
    assert max(n for n, _ in files) <= 2 * 3 + 1 and len(store.runs()) <= 6
    assert sum(n for _, n in files) <= 3
    assert {r["key"] for r in store.keys(store.runs()).collect()} == {key(i) for i in seen}


def test_ingest_is_unique_over_many_batches(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "events")
    for wave in range(7):
        rows = [(i, json.dumps({"mode": "general", "k": i % 5}), i) for i in range(wave * 5, wave * 5 + 12)]
        spark.createDataFrame(rows, "event_id long, props string, ts long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("event_id long, props string, ts long").option("maxFilesPerTrigger", 1).parquet(source)
    ingest.stream_ingest(stream, target, str(tmp_path / "cp"), buckets=2, fanout=3)
    stored = ingest.read_events(spark, target)
    assert sorted(r["event_id"] for r in stored.collect()) == list(range(42))
    assert len([p for p in (tmp_path / "events").iterdir() if p.name.startswith("batch=")]) <= 4
    # a merge that was cut short after its rows were written is finished by the next batch
    left = sorted(int(p.name[6:]) for p in (tmp_path / "events").iterdir() if p.name.startswith("batch="))
    spark.read.parquet(*[f"{target}/batch={b}" for b in left]).write.parquet(f"{target}/_merged-" + "-".join(map(str, left)))
    ingest.compact_batches(spark, target, 99, 3)
    assert sorted(r["event_id"] for r in ingest.read_events(spark, target).collect()) == list(range(42))


def test_salted_lookup_and_dense_index(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 5).alias("k"))
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    salted = salted_lookup(left, right, "k", "id", min_rows=100)
    assert sorted(map(tuple, salted.select("id", "k", "v").collect())) == sorted(map(tuple, left.join(right, "k").select("id", "k", "v").collect()))
    numbered = with_dense_index(left.select("id").repartition(9), ["id"], "n")
    assert numbered.filter("n <> id").count() == 0


def test_record_files(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, text string").schema
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "text": "x"}, {"id": "2"}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"id": "3"}]}, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"id": "4", "text": "y"}, indent=1))
    (tmp_path / "d.jsonl").write_text('{"id": "5"}\n{"id": "6"}\n{oops\n')
    wrapped = [r["id"] for n in "abc" for r in S.read_records(spark, str(tmp_path / f"{n}.json"), schema, wrapped=True).collect()]
    assert sorted(wrapped) == ["1", "2", "3", "4"]
    lines = S.read_records(spark, str(tmp_path / "d.jsonl"), schema).collect()
    assert [r["id"] for r in lines if r["_corrupt_record"] is None] == ["5", "6"] and sum(r["_corrupt_record"] is not None for r in lines) == 1
    with gzip.open(tmp_path / "e.jsonl.gz", "wt") as f:
        f.write('{"id": "7"}\n\n')
    both = S.read_many(spark, [str(tmp_path / "e.jsonl.gz"), str(tmp_path / "c.json")], spark.createDataFrame([], "id string").schema)
    assert (0, "7") in {(r["input_ord"], r["id"]) for r in both.collect()}


def test_shape_is_decided_file_by_file(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, t string").schema
    folder = tmp_path / "mixed [1]"
    folder.mkdir()
    (folder / "damaged first.jsonl").write_text('\n{"id": "1", "t": "x"\n{"id": "2"}\n[{"id": "3"}, {"id": "4"}]\n')
    (folder / "array{a}.json").write_text(json.dumps([{"id": "5"}, {"id": "6"}], indent=1))
    (folder / "records%20.json").write_text("\n" + json.dumps({"records": [{"id": "7"}], "x": 1}, indent=1))
    (folder / "single.json").write_text(json.dumps({"id": "8", "t": "a\nb"}, indent=1))
    (folder / "broken.json").write_text('[\n{"id": "9"},\n')
    (folder / "blank.json").write_text(" \n\n")
    rows = S.read_records(spark, str(folder).replace("[", "\\[").replace("]", "\\]"), schema).collect()
    assert sorted(r["id"] for r in rows if r["id"]) == ["2", "3", "4", "5", "6", "7", "8", "9"]
    damaged = {r["_corrupt_record"] for r in rows if r["_corrupt_record"] is not None}
    assert '{"id": "1", "t": "x"' in damaged and "[" in damaged
    only = tmp_path / "only.jsonl"
    only.write_text('{"id": 1, "t": "x"\n{"id": 2}\n{"id": 3}\n')
    assert [r["id"] for r in S.read_records(spark, str(only), schema).collect() if r["_corrupt_record"] is None] == ["2", "3"]


def test_strict_lines_report_numbers(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}{\n{"a": 3}\n1,2\n')
    good, bad = S.read_jsonl_strict(spark, str(path))
    assert good.count() == 2 and sorted(r["line_no"] for r in bad.collect()) == [3, 5]


def test_pins(spark, tmp_path, monkeypatch):
    (tmp_path / "deep").mkdir()
    for name, text in {"one.txt": "x", "two.txt": "y", "deep/three.txt": "z" * 100_000, "_hidden.txt": "h", "four.csv": ""}.items():
        (tmp_path / name).write_text(text)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    pins = spark.createDataFrame([("one.txt", digest("x").upper()), ("two.txt", "0" * 64), ("gone.txt", "1" * 64)], "name string, sha256 string")
    got = {r["name"]: (r["state"], r["length"], r["actual"]) for r in S.verify_inputs(spark, f"file:{tmp_path}", pins, "*.txt").collect()}
    assert got == {
        "one.txt": ("ok", 1, digest("x")), "two.txt": ("mismatch", 1, digest("y")), "gone.txt": ("missing", None, None),
        "deep/three.txt": ("unpinned", 100_000, digest("z" * 100_000)),
    }
    assert [r["name"] for r in S.verify_inputs(spark, str(tmp_path / "one.txt"), pins).filter("state = 'ok'").collect()] == ["one.txt"]
    assert {r["state"] for r in S.verify_inputs(spark, str(tmp_path / "nowhere"), pins).collect()} == {"missing"}
    reader = digests._Reader(str(tmp_path), "*")
    monkeypatch.setattr(digests, "CHUNK", 7)  # a file is folded chunk by chunk
    assert [list(reader.read(p))[0][2] for p in reader.partitions() if p.name == "deep/three.txt"] == [digest("z" * 100_000)]


def test_roster(spark):
    rows = [(1, ["1", "Lan", "2000", "sv1", "Y", "A"]), (2, ["2", "Minh", "2001", "SV1 ", "Y", "B"]), (3, ["3", "", "2001", "sv2", "Y", "B"])]
    roster, counts = S.import_roster(spark.createDataFrame(rows, "ord long, cells array<string>"), ["STT", "Họ và tên", "Năm sinh", "MSSV", "Khoa", "Lớp"])
    assert [(r["mssv"], r["full_name"]) for r in roster.collect()] == [("SV1", "Minh")]
    assert counts.first().asDict() == {"valid": 2, "duplicates": 1, "kept": 1}
    with pytest.raises(ValueError):
        S.import_roster(spark.createDataFrame(rows, "ord long, cells array<string>"), ["STT"])
