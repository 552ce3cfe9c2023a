"""A bad record fails its step, never the job, and steps run on due rows only."""

import pandas as pd
from pyspark.sql import functions as F

from jobframe.operators.dispatch import deliveries
from jobframe.plans.pipeline import run_pipeline
from jobframe.spec import ConditionStep, MapStep, PipelineSpec, Route, TransformStep

SCHEMA = "id string, source string, payload string, correlation_key string, labels map<string,string>"


def jobs(spark, *payloads):
    return spark.createDataFrame([(str(i), "s", p, None, {}) for i, p in enumerate(payloads)], SCHEMA)


def statuses(df):
    return [r["status"] for r in df.orderBy("id").collect()]


ROWS = ('{"a": 4, "b": 2}', '{"a": 1, "b": 0}', '{"a": 1}', '{"a": null, "b": 1}', "[1]", "not json")


def test_failed_map_value_fails_the_step_whatever_is_selected(spark):
    spec = PipelineSpec(id="p", payload_schema="a int, b int", steps=(MapStep(id="m", set=(("job.payload.c", "job.payload.a / job.payload.b"),)),))
    res = run_pipeline(jobs(spark, *ROWS), spec)
    want = ["success"] + ["failure"] * 5
    assert statuses(res) == statuses(res.select("id", "status")) == want
    rows = res.orderBy("id").collect()
    assert rows[1]["steps"]["m"]["exit_code"] == -1 and "has no value" in rows[1]["steps"]["m"]["stderr"]
    assert '"c":2.0' in rows[0]["work_payload"]


def test_payload_that_is_no_object(spark):
    spec = PipelineSpec(id="p", payload_schema="a int", steps=(MapStep(id="m", set=(("job.payload.c", "1"),)),))
    rows = run_pipeline(jobs(spark, "[1]", "{}"), spec).orderBy("id").collect()
    assert rows[0]["steps"]["m"]["stderr"] == "Pipeline error: job.payload is not an object"
    assert rows[1]["status"] == "success"


def test_failed_condition_and_guarded_condition(spark):
    check = ConditionStep(id="c", expr="job.payload.a / job.payload.b > 1")
    spec = PipelineSpec(id="p", payload_schema="a int, b int", steps=(check,))
    assert statuses(run_pipeline(jobs(spark, *ROWS[:3]), spec)) == ["success", "failure", "failure"]
    gate = ConditionStep(id="g", expr="job.payload.b <> 0", action="emit")
    spec = PipelineSpec(id="p", payload_schema="a int, b int", steps=(gate, check))
    rows = run_pipeline(jobs(spark, *ROWS[:2]), spec).orderBy("id").collect()
    assert [r["status"] for r in rows] == ["success", "success"] and rows[1]["steps"]["c"] is None


def test_casts_and_indexes_do_not_throw(spark):
    spec = PipelineSpec(id="p", payload_schema="a string, l array<int>", steps=(
        ConditionStep(id="c", expr="CAST(job.payload.a AS INT) > 1 AND job.payload.l[3] > 0"),))
    assert statuses(run_pipeline(jobs(spark, '{"a": "x", "l": [1]}', '{"a": "2", "l": [1, 1, 1, 1]}'), spec)) == ["failure", "success"]


def test_failed_route_is_no_match_and_the_session_setting_is_kept(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spec = PipelineSpec(id="p", payload_schema="a int, b int", sinks=("rest",), steps=(
        TransformStep(id="t", expr="'x'", routing=(Route("job.payload.a / job.payload.b > 1", ("hit",)),)),))
    out = deliveries(run_pipeline(jobs(spark, *ROWS[:3]), spec), spec).orderBy("job_id").collect()
    assert [(r["job_id"], r["sink_id"]) for r in out] == [("0", "hit"), ("1", "rest"), ("2", "rest")]
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_python_transform_sees_due_rows_only(spark):
    def count(stdin):
        return pd.DataFrame({"stdout": [str(len(stdin))] * len(stdin)})

    spec = PipelineSpec(id="due", payload_schema="a int, b int", steps=(
        ConditionStep(id="g", expr="job.payload.b <> 0", action="emit"), TransformStep(id="t", fn=count, stdin="payload")))
    res = run_pipeline(jobs(spark, *ROWS[:2]).coalesce(1), spec).select("id", F.col("steps.t.stdout").alias("n"))
    assert {r["id"]: r["n"] for r in res.collect()} == {"0": "1", "1": None}


def test_repeated_json_key_keeps_the_last_value(spark):
    from jobframe.functions.json import top_level_string

    df = spark.createDataFrame([('{"id":"x","id":"y"}',)], "p string").select(top_level_string(F.col("p"), "id").alias("i"))
    assert df.first()["i"] == "y"
