"""Pipeline shapes of the reference's integration tests, on inline fixtures."""

from pyspark.sql import functions as F

from helpers import jobs, ran
from jobframe.operators.dispatch import deliveries
from jobframe.plans.pipeline import run_pipeline
from jobframe.spec import (
    ConditionStep,
    FailurePolicy,
    MapStep,
    OutputField,
    Outputs,
    PipelineSpec,
    Route,
    TransformStep,
)


def test_skip_to_jumps_over_steps(spark):
    spec = PipelineSpec(id="p", payload_schema="v int", steps=(
        ConditionStep(id="guard", expr="false", action="skip_to", skip_to="target"),
        MapStep(id="skipped", set=(("job.payload.x", "1"),)),
        MapStep(id="target", set=(("job.payload.y", "2"),)),
    ))
    r = run_pipeline(jobs(spark, ['{"v":1}']), spec)
    row = r.first()
    assert row.status == "success"
    assert ran(r, spec) == ["guard,target"]
    assert row.steps.guard.stdout == "skipped_to: target"


def test_emit_ends_with_success(spark):
    spec = PipelineSpec(id="p", payload_schema="v int", steps=(
        ConditionStep(id="gate", expr="false", action="emit"),
        MapStep(id="after", set=(("job.payload.x", "1"),)),
    ))
    r = run_pipeline(jobs(spark, ['{"v":1}']), spec)
    assert r.first().status == "success"
    assert ran(r, spec) == ["gate"]
    assert r.first().steps.gate.stdout == "emitted"


def test_diamond_runs_all(spark):
    spec = PipelineSpec(id="p", payload_schema="v int", steps=(
        TransformStep(id="root", expr="'r'"),
        TransformStep(id="left", expr="'l'", depends_on=("root",)),
        TransformStep(id="right", expr="'r'", depends_on=("root",)),
        TransformStep(id="join", expr="concat(steps.left.stdout, steps.right.stdout)", depends_on=("left", "right")),
    ))
    r = run_pipeline(jobs(spark, ['{"v":1}']), spec)
    assert ran(r, spec) == ["root,left,right,join"]
    assert r.first().steps.join.stdout == "lr"


def test_sibling_failure_keeps_sibling_result(spark):
    spec = PipelineSpec(id="p", payload_schema="v int", steps=(
        TransformStep(id="root", expr="'r'"),
        TransformStep(id="left", expr="named_struct('exit_code', 13)", depends_on=("root",)),
        TransformStep(id="right", expr="'ok'", depends_on=("root",)),
        TransformStep(id="after", expr="'x'", depends_on=("left", "right")),
    ))
    row = run_pipeline(jobs(spark, ['{"v":1}']), spec).first()
    assert row.status == "failure"
    assert row.steps.right.exit_code == 0
    assert row.steps.left.exit_code == -1
    assert row.steps.left.attempt == 0
    assert "Exit code 13 is not in success_exit_codes [0]" in row.steps.left.stderr
    assert row.steps.after is None


def test_backward_skip_goes_to_next_level(spark):
    spec = PipelineSpec(id="p", payload_schema="v int", steps=(
        MapStep(id="a", set=(("job.payload.x", "1"),)),
        ConditionStep(id="back", expr="false", action="skip_to", skip_to="a"),
        MapStep(id="c", set=(("job.payload.y", "1"),)),
    ))
    r = run_pipeline(jobs(spark, ['{"v":1}']), spec)
    assert ran(r, spec) == ["a,back,c"]


def test_output_extraction_cases(spark):
    out = Outputs("json", (OutputField("nested", "a.b"), OutputField("missing", "zz"), OutputField("whole", "")))
    spec = PipelineSpec(id="p", payload_schema="s string", steps=(
        TransformStep(id="t", expr="job.payload.s", outputs=out),
        TransformStep(id="txt", expr="job.payload.s", outputs=Outputs("text", (OutputField("all"),))),
    ))
    payloads = ['{"s":"{\\"a\\":{\\"b\\":[1,2]}}"}', '{"s":"not json"}', '{}']
    rows = {r.id: r for r in run_pipeline(jobs(spark, payloads), spec).collect()}
    assert rows["j0"].steps.t.outputs == {"nested": "[1,2]", "missing": "null", "whole": '{"a":{"b":[1,2]}}'}
    assert rows["j1"].steps.t.outputs == {}
    assert rows["j1"].steps.txt.outputs == {"all": '"not json"'}
    assert rows["j2"].steps.t.outputs == {}  # no stdout captured → no outputs


def test_map_nested_target(spark):
    spec = PipelineSpec(id="p", payload_schema="bucket string, key string", steps=(
        MapStep(id="m", set=(("job.payload.s3.location.url",
                              "concat('s3://', job.payload.bucket, '/', job.payload.key)"),)),
    ))
    row = run_pipeline(jobs(spark, ['{"bucket":"assets","key":"image.jpg"}']), spec).first()
    assert '"url":"s3://assets/image.jpg"' in row.work_payload
    assert row.payload == '{"bucket":"assets","key":"image.jpg"}'  # P7: the job keeps the original payload


def test_map_on_non_object_payload_fails(spark):
    spec = PipelineSpec(id="p", payload_schema="v int", steps=(MapStep(id="m", set=(("job.payload.x", "1"),)),))
    row = run_pipeline(jobs(spark, ["42"]), spec).first()
    assert row.status == "failure"
    assert row.steps.m.stderr == "Pipeline error: job.payload is not an object"


def test_null_condition_is_a_failure(spark):
    spec = PipelineSpec(id="p", payload_schema="v int", steps=(ConditionStep(id="c", expr="job.payload.v > 1"),))
    row = run_pipeline(jobs(spark, ['{"w":1}']), spec).first()
    assert row.status == "failure"
    assert row.steps.c.stderr.startswith("Expression evaluation error")


def test_null_stdout_reads_as_empty_string(spark):
    spec = PipelineSpec(id="p", payload_schema="v int", steps=(
        MapStep(id="m", set=(("job.payload.x", "1"),)),
        TransformStep(id="t", expr="concat('[', steps.m.stdout, ']')"),
    ))
    assert run_pipeline(jobs(spark, ['{"v":1}']), spec).first().steps.t.stdout == "[]"


def test_routing_precedence_and_dead_letter(spark):
    spec = PipelineSpec(id="p", payload_schema="code int", steps=(
        TransformStep(id="step", expr="named_struct('exit_code', job.payload.code)",
                      routing=(Route("steps.step.exit_code = 0", ("ok_sink",)),)),
    ), sinks=("dlq_sink",), failure=FailurePolicy("dead_letter", "dlq_sink"))
    res = run_pipeline(jobs(spark, ['{"code":0}', '{"code":99}']), spec)
    d = {(r.job_id, r.sink_id, r.scope) for r in deliveries(res, spec).collect()}
    assert d == {("j0", "ok_sink", "route"),
                 ("j1", "dlq_sink", "pipeline"), ("j1", "dlq_sink", "dead_letter")}


def test_disabled_sink_is_skipped(spark):
    spec = PipelineSpec(id="p", payload_schema="v int", steps=(TransformStep(id="t", expr="'x'"),),
                        sinks=("on", "off"))
    res = run_pipeline(jobs(spark, ['{"v":1}']), spec)
    assert [r.sink_id for r in deliveries(res, spec, {"on"}).collect()] == ["on"]


def test_stop_policy_marks_held(spark):
    spec = PipelineSpec(id="p", payload_schema="v int", steps=(
        ConditionStep(id="c", expr="job.payload.v > 1", failure=FailurePolicy("stop")),
    ))
    rows = {r.id: r for r in run_pipeline(jobs(spark, ['{"v":1}', '{"v":2}']), spec).collect()}
    assert rows["j0"].held and not rows["j1"].held


def test_file_sink_lines_partitioned_by_sink(spark, tmp_path):
    from jobframe.operators.sinks import result_json, write_lines

    spec = PipelineSpec(id="p", payload_schema="v int", steps=(TransformStep(id="t", expr="'x'"),),
                        sinks=("a", "b"))
    d = deliveries(run_pipeline(jobs(spark, ['{"v":1}', '{"v":2}']), spec), spec)
    out = str(tmp_path / "lines")
    write_lines(d, out, result_json(d, "2026-01-01T00:00:00Z"))
    back = spark.read.text(out)
    assert sorted((r.sink_id, r.n) for r in back.groupBy("sink_id").agg(F.count("*").alias("n")).collect()) == \
        [("a", 2), ("b", 2)]
    import json

    line = json.loads(back.first().value)
    assert line["pipeline_id"] == "p" and line["steps"]["t"]["stdout"] == "x" and "correlation_key" not in line["job"]


def test_python_transform_with_stdin_modes(spark):
    def _shout(stdin):  # defined here so the workers receive it by value
        import pandas as pd

        return pd.DataFrame({"stdout": stdin.str.upper(),
                             "exit_code": stdin.str.len().fillna(0).astype(int).map(lambda n: 0 if n < 12 else 4)})

    spec = PipelineSpec(id="py", payload_schema="name string, n int", steps=(
        TransformStep(id="tpl", fn=_shout, stdin="template", template="hi {{ job.payload.name }}",
                      outputs=Outputs("text", (OutputField("said"),))),
        TransformStep(id="pay", fn=_shout, stdin="payload", depends_on=(), success_exit_codes=()),
        TransformStep(id="nothing", fn=lambda s: s.fillna("empty"), stdin="none", depends_on=()),
    ))
    rows = {r.id: r for r in run_pipeline(jobs(spark, ['{"name":"ann","n":1}', '{"n":2}',
                                                        '{"name":"bartholomew","n":3}']), spec).collect()}
    assert rows["j0"].steps.tpl.stdout == "HI ANN" and rows["j0"].steps.tpl.outputs == {"said": '"HI ANN"'}
    assert rows["j0"].steps.pay.stdout == '{"NAME":"ANN","N":1}' and rows["j0"].steps.pay.exit_code == 4
    assert rows["j0"].steps.nothing.stdout == "empty"
    assert rows["j1"].status == "failure" and rows["j1"].steps.tpl.stderr.startswith("Template render error")
    assert rows["j2"].steps.tpl.exit_code == -1 and "Exit code 4" in rows["j2"].steps.tpl.stderr
