from pyspark.sql import functions as F

from groundwork.functions import hashing as H, text as X
from groundwork.operators import records as R


def one(spark, value, expr, prepare=lambda d: d):
    df = prepare(spark.createDataFrame([(value,)], "v string"))
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


def test_clean_text(spark):
    nfkc = lambda d: X.nfkc_columns(d, "v")
    assert one(spark, "  ﬁne\x01 ｗord x\n", X.clean_text, nfkc) == "fine word x"
    assert one(spark, "mail A.b+c@ex-am.org, now", X.clean_text) == "mail [redacted-email], now"
    assert one(spark, "éa@b.co", X.clean_text) == "é[redacted-email]"
    assert one(spark, None, X.clean_text) == ""


def test_fold_variants(spark):
    assert one(spark, "Đỏ nhạt, RÊU-vàng", X.fold_text) == "do nhat reu vang"
    assert one(spark, "Đỏ", lambda c: X.fold_text(c, dstroke=False)) == "o"
    assert one(spark, "Lưỡi: ÂM", X.strip_accents) == "luoi: am"


def test_shingles_short_and_long(spark):
    assert one(spark, "Một hai", X.shingles) == ["một", "hai"]
    assert one(spark, "a b c d", X.shingles) == ["a b c", "b c d"]


def test_asserted_rejects_not_seen(spark):
    assert one(spark, "không thấy dấu răng", lambda c: X.asserted(c, "rang")) is False
    assert one(spark, "dấu răng", lambda c: X.asserted(c, "rang")) is True


def test_hex_bucket_is_unsigned(spark):
    assert one(spark, "ffffffff00", lambda c: H.hex_bucket(c, 8)) == 0xFFFFFFFF
    assert one(spark, "ffffffffffffffff", H.head_long) == -1


def test_all_record_shapes(spark):
    schema = "ord long, schemaVersion string, caseText string, target string, task string, case_context string, intervention string, outcome string, reasoning_use string, pmid string, instruction string, input string, output string, question string, answer string, messages array<struct<role:string,content:string>>, text string"
    blank = {k.split()[0]: None for k in schema.split(", ")}
    rows = [
        {"ord": 0, "schemaVersion": R.SCHEMA_VERSION, "task": "kept", "caseText": "already normal", "target": "t"},
        {"ord": 1, "case_context": "ctx", "intervention": "iv", "reasoning_use": "why", "pmid": "77"},
        {"ord": 2, "instruction": "do", "input": "in", "output": "out"},
        {"ord": 3, "question": "q", "answer": "a"},
        {"ord": 4, "messages": [("Human", "one"), ("system", "skip"), ("gpt", "two"), ("user", "three")]},
        {"ord": 5, "text": "plain"},
        {"ord": 6, "text": "  "},
    ]
    out = R.normalize_records(spark.createDataFrame([{**blank, **r} for r in rows], schema)).orderBy("ord").collect()
    assert [r["task"] for r in out] == ["kept", "case_reasoning", "sft", "qa", "conversation", "text", "text"]
    assert [r["case_text"] for r in out] == ["already normal", "ctx Intervention: iv", "do in", "q", "one three", "plain", ""]
    assert [r["target"] for r in out] == ["t", "why", "out", "a", "two", "", ""]
    assert out[1]["source_record_id"] == "77" and out[2]["source_record_id"] == "2"
    assert all(r["empty"] for r in out)  # all canonical texts are shorter than 40


def test_squeeze_collapses_every_run_of_white_space(spark):
    import re

    blanks = "\t\n\x0b\f\r \u00a0\u1680\u2003\u2028\u202f\u3000\ufeff"
    texts = ["", " ", "a b", "a  b", " a\tb ", "a \tb", "a\t b"] + [f"x{p}{q}y{q} {p}z{p}" for p in blanks for q in blanks]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", X.squeeze(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: re.sub(f"[{blanks}]+", " ", t).strip(" ") for i, t in enumerate(texts)}
