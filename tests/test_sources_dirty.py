"""Files as users have them: nothing is lost or changed without a reject."""

import json

from pyspark.sql import functions as F

from jobframe.functions.json import compact_json, float_text
from jobframe.operators.merge import correlation_value
from jobframe.sources.files import read_csv, read_json_array, read_jsonl
from jobframe.sources.tables import claim_pending


def test_csv_files_of_different_headers(spark, tmp_path):
    d = tmp_path / "c"
    d.mkdir()
    (d / "a.csv").write_text("name,score\nAl,\n,\nBo,1,2\nonly\n\n\"x, \"\"y\"\"\nz\",3\n")
    (d / "b.csv").write_text("﻿a,b,a\r\n1,2,3\r\n")
    (d / "c.csv").write_text("")
    (d / "d.csv").write_text("head,only\n")
    jobs, bad = read_csv(spark, str(d), "s")
    got = sorted((json.loads(r.payload) for r in jobs.collect()), key=str)
    assert got == sorted([{"name": "Al", "score": ""}, {"name": "", "score": ""}, {"name": 'x, "y"\nz', "score": "3"},
                          {"a": "3", "b": "2"}], key=str)
    assert sorted(r.record for r in bad.collect()) == ["Bo,1,2", "only"]
    assert len({r.id for r in jobs.collect()}) == 4


def test_json_array_over_many_lines_and_of_any_kind(spark, tmp_path):
    d = tmp_path / "j"
    d.mkdir()
    (d / "a.json").write_text('[\n {"id": "x", "id": "y", "f": 1.0},\n "s [1]", 2, null, [1.5, "a  b"]\n]\n')
    (d / "b.json").write_text("[1, 2")
    jobs, bad = read_json_array(spark, str(d), "s")
    assert sorted(r.payload for r in jobs.collect()) == sorted(
        ['{"id":"x","id":"y","f":1.0}', '"s [1]"', "2", "null", '[1.5,"a  b"]'])
    assert "y" in {r.id for r in jobs.collect()} and bad.count() == 1


def test_large_json_array_keeps_every_record(spark, tmp_path):
    d = tmp_path / "big"
    d.mkdir()
    n, pad = 40_000, "p" * 900  # 37 MB, more than one VARIANT value holds
    (d / "a.json").write_text("[" + ",".join(f'{{"id":"i{k}","p":"{pad}"}}' for k in range(n)) + "]")
    jobs, bad = read_json_array(spark, str(d), "s")
    assert jobs.select("id").distinct().count() == n and bad.count() == 0


def test_jsonl_with_repeated_keys(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"x","id":"y"}\n')
    jobs, bad = read_jsonl(spark, str(tmp_path), "s")
    assert [r.id for r in jobs.collect()] == ["y"] and bad.count() == 0


def test_numbers_keep_their_form(spark):
    cases = {'{"k":1.0}': "1.0", '{"k":1}': "1", '{"k":1e300}': "1e300", '{"k":"1.50"}': "1.50", '{"k":2.50}': "2.5",
             '{"k":12345678.0}': "12345678.0", '{"k":1E-7}': "1e-7", '{"k":true}': "true", '{"k":null}': None, '{"k":{}}': None,
             '{"k":[]}': None, "x": None, '{"k":1,"k":2.0}': "2.0", '{"k":18446744073709551615}': "18446744073709551615"}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: r.v for r in df.select("p", correlation_value(F.col("p"), "k").alias("v")).collect()}
    assert got == cases


def test_float_text(spark):
    cases = {1e15: "1000000000000000.0", 1e16: "1e16", 1.5e-7: "1.5e-7", 1e-5: "0.00001", -2.5e20: "-2.5e20", 0.1: "0.1",
             12345678.5: "12345678.5", 100.0: "100.0", -1e7: "-10000000.0"}
    df = spark.createDataFrame([(d,) for d in cases], "d double")
    assert {r.d: r.t for r in df.select("d", float_text(F.col("d")).alias("t")).collect()} == cases


def test_compact_json(spark):
    df = spark.createDataFrame([('{ "a b" : [ 1.0 ,\n"x \\" y"] }',)], "t string")
    assert df.select(compact_json(F.col("t")).alias("c")).first().c == '{"a b":[1.0,"x \\" y"]}'


def test_claim_with_own_status_values(spark):
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "working"), ("c", 3, "finished"), ("d", 4, "processing")],
                                 "id string, created_at int, status string")
    claimed, after = claim_pending(rows, 10, processing="working", done="finished", failed="broken")
    assert sorted(r.id for r in claimed.collect()) == ["a", "d"]
    assert {r.id: r.status for r in after.collect()} == {"a": "working", "b": "working", "c": "finished", "d": "working"}
