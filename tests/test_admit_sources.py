import hashlib
import hmac
import json

from pyspark.sql import functions as F

from jobframe.functions.hmac import hmac_sha256_hex
from jobframe.operators.admit import cancel_target, correlation_key
from jobframe.operators.envelope import envelope, overlay_labels
from jobframe.sources.files import read_csv, read_directory, read_json_array, read_jsonl


def test_native_hmac_equals_python(spark):
    bodies = ["", "hello", "wörld ✓", "x" * 5000]
    for secret in ["k", "s" * 64, "long-" * 30]:
        df = spark.createDataFrame([(b,) for b in bodies], "b string")
        got = [r.h for r in df.select(hmac_sha256_hex(F.col("b"), secret).alias("h")).collect()]
        want = [hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]
        assert got == want


def test_cancel_target_rules(spark):
    cases = {
        '{"target_job_id":"t1","job_id":"j1"}': "t1",
        '{"job_id":"j1","id":"i1"}': "j1",
        '{"target_job_id":42,"id":"i1"}': None,       # first present key decides; not a string
        '{"target_job_id":null,"id":"i1"}': None,
        '{"id":""}': None,
        '  plain-id  ': "plain-id",
        '"quoted"': '"quoted"',
        "two words": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "body string")
    got = {r.body: r.t for r in df.select("body", cancel_target(F.col("body")).alias("t")).collect()}
    assert got == cases


def test_correlation_headers(spark):
    rows = [("k1", None), (None, " k2 "), ("a", "b"), ("x" * 513, None), ("bad key", None), (None, None)]
    df = spark.createDataFrame(rows, "i string, c string")
    got = [tuple(r) for r in df.select(correlation_key(F.col("i"), F.col("c")).alias("r")).select("r.*").collect()]
    assert got[0] == ("k1", None) and got[1] == ("k2", None)
    assert got[2][0] is None and "must match" in got[2][1]
    assert "512" in got[3][1]
    assert "visible ASCII" in got[4][1]
    assert got[5] == (None, None)


def test_id_rule(spark):
    df = spark.createDataFrame([('{"name":"test"}',), ('{"job_id":"my-id-123"}',), ('{"num_id":42,"job_id":7}',),
                                ('{"job_id":""}',)], "p string")
    ids = [r.id for r in envelope(df, "s", F.col("p"), F.col("p"), id_field="job_id").collect()]
    assert ids[1] == "my-id-123" and ids[3] == ""
    assert len(ids[0]) == 64 and len(ids[2]) == 64


def test_label_overlay(spark):
    df = spark.createDataFrame([({"env": "dev", "team": "x"},)], "l map<string,string>")
    out = df.select(overlay_labels(F.col("l"), {"env": "prod"}).alias("o")).first().o
    assert out == {"team": "x", "env": "prod"}


def test_file_sources(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.json").write_text(json.dumps([{"id": "a", "v": 1}, {"id": "b", "v": 2}]))
    (d / "b.csv").write_text("name,score\nAlice,100\nBob,85\nbad,1,extra\n")
    (d / "c.jsonl").write_text('{"id":"one","value":1}\n\n  not json\n[1,2]\n')
    (d / "readme.txt").write_text("ignored")
    j, rej = read_json_array(spark, str(d), "src")
    assert sorted(r.id for r in j.collect()) == ["a", "b"]
    c, crej = read_csv(spark, str(d), "src", schema="name string, score string")
    assert sorted(r.payload for r in c.collect()) == ['{"name":"Alice","score":"100"}', '{"name":"Bob","score":"85"}']
    assert crej.count() == 1
    l, lrej = read_jsonl(spark, str(d), "src")
    assert sorted(r.payload for r in l.collect()) == ['[1,2]', '{"id":"one","value":1}']
    assert lrej.count() == 1
    alljobs, _ = read_directory(spark, str(d), "src")
    assert alljobs.count() == 6


def test_unknown_extension_yields_nothing(spark, tmp_path):
    d = tmp_path / "only_txt"
    d.mkdir()
    (d / "readme.txt").write_text("hello")
    jobs, _ = read_directory(spark, str(d), "src")
    assert jobs.count() == 0


def test_request_verdict_order_and_accepted_jobs(spark):
    from jobframe.functions.hmac import hmac_sha256_hex  # noqa: F401
    from jobframe.operators.admit import HttpSource, accepted_jobs, request_verdict

    srcs = [HttpSource(id="hook", path="/h", kind="webhook", hmac_secret="s", max_body_bytes=20, id_field="id",
                       labels=(("env", "t"),)),
            HttpSource(id="api", path="/a", kind="http")]
    good = '{"id":"x1"}'
    sig = hmac.new(b"s", good.encode(), hashlib.sha256).hexdigest()
    big = '{"id":"' + "y" * 30 + '"}'
    big_sig = hmac.new(b"s", big.encode(), hashlib.sha256).hexdigest()
    rows = [
        (1, "/nope", {}, good),                                   # 404
        (2, "/h", {}, good),                                      # 401 missing header
        (3, "/h", {"x-signature": sig.upper()}, good),            # 401 upper-case hex
        (4, "/h", {"x-signature": big_sig}, big),                 # 413 after signature
        (5, "/a", {}, "not json"),                                # 400
        (6, "/a", {"idempotency-key": "a", "x-correlation-id": "b"}, good),  # 400 mismatch
        (7, "/h", {"x-signature": "sha256=" + sig, "x-correlation-id": " k "}, good),  # 202
        (8, "/a", {}, "[1]"),                                     # 201, generated id
    ]
    df = spark.createDataFrame(rows, "request_seq long, path string, headers map<string,string>, body string")
    v = {r.request_seq: r for r in request_verdict(df, srcs).collect()}
    assert [v[i].code for i in range(1, 9)] == [404, 401, 401, 413, 400, 400, 202, 201]
    assert v[7].job_id == "x1" and v[7].correlation_key == "k"
    assert len(v[8].job_id) == 64
    jobs = {r.id: r for r in accepted_jobs(request_verdict(df, srcs), srcs).collect()}
    assert set(jobs) == {"x1", v[8].job_id}
    assert jobs["x1"].labels == {"env": "t"} and jobs["x1"].source == "hook"


def test_json_file_that_is_not_an_array(spark, tmp_path):
    d = tmp_path / "obj"
    d.mkdir()
    (d / "a.json").write_text('{"id": "x"}')
    (d / "b.json").write_text('[{"id": "y"}, 42, "s"]')  # any JSON value is a job
    jobs, rejects = read_json_array(spark, str(d), "src")
    assert sorted(r.payload for r in jobs.collect()) == ['"s"', '42', '{"id":"y"}']
    assert rejects.count() == 1


def test_two_claim_polls(spark):
    from jobframe.sources.tables import claim_pending

    rows = spark.createDataFrame([(f"r{i:03d}", i, None if i % 7 else "done") for i in range(250)],
                                 "id string, created_at int, status string")
    first, after = claim_pending(rows, 100)
    ids1 = [r.id for r in first.orderBy("created_at").collect()]
    assert len(ids1) == 100 and all(r.status == "processing" for r in first.collect())
    second, after2 = claim_pending(after, 100)
    ids2 = {r.id for r in second.collect()}
    assert not ids2 & set(ids1) and len(ids2) == 100
    assert after2.where("status = 'processing'").count() == 200
    assert after2.where("status = 'done'").count() == len([i for i in range(250) if i % 7 == 0])
