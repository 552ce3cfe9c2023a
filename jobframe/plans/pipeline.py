"""Compile a ``PipelineSpec`` into DataFrame projections (D-1 … D-4, P7, E1).

Each DAG level becomes three projections generated as SQL text: the user
expressions (each evaluated once), the per-step results and signal flags, and the
fold of the level's signals (failure > emit > last skip_to) into the row's state.
Every step of a level reads the same entry row. A per-row ``_level`` column is
the gate, so rows that jumped or stopped pass through untouched. There is no
shuffle anywhere in a pipeline run; the plan is a chain of projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobframe.operators import steps as S
from jobframe.session import lenient
from jobframe.spec import ConditionStep, MapStep, PipelineSpec, SpecError, TransformStep

JOB_COLS = ["id", "source", "payload", "correlation_key", "labels"]
# Cut the lineage of very deep DAGs so the expression tree stays small.
LEVELS_PER_CHECKPOINT = 20


def _step_col(sid: str) -> str:
    return f"_s_{sid}"


def _raw_struct(spec: PipelineSpec) -> Column:
    """All step results as one struct (assembled once, at the end)."""
    return F.struct(*[F.col(_step_col(s.id)).alias(s.id) for s in spec.steps])


def _needs_view(spec: PipelineSpec) -> bool:
    """Step expressions that read ``steps.<id>`` need the E1 view column."""
    texts = []
    for st in spec.steps:
        if isinstance(st, MapStep):
            texts += [e for _, e in st.set]
        elif isinstance(st, (ConditionStep, TransformStep)):
            texts.append(st.expr)
    return any("steps" in t for t in texts)


def _view_sql(spec: PipelineSpec) -> str:
    parts = []
    for s in spec.steps:
        c = S.ident(_step_col(s.id))
        parts.append(f"{S.lit(s.id)}, CASE WHEN {c} IS NULL THEN NULL ELSE named_struct("
                     f"'stdout', coalesce({c}.stdout, ''), 'stderr', coalesce({c}.stderr, ''), "
                     f"'exit_code', {c}.exit_code, 'duration_ms', {c}.duration_ms, 'attempt', {c}.attempt, "
                     f"'outputs', {c}.outputs) END")
    return f"named_struct({', '.join(parts)})"


def _with_view(df: DataFrame, spec: PipelineSpec) -> DataFrame:
    if _needs_view(spec):
        cols = [S.ident(c) for c in df.columns if c != "steps"]
        return df.selectExpr(*cols, f"{_view_sql(spec)} AS steps")
    return df


def _probe(df: DataFrame) -> DataFrame:
    """An empty relation with the same columns: resolving expression types on it
    costs nothing, unlike re-analysing the full plan of ``df``."""
    return df.sparkSession.createDataFrame([], df.schema)


JOB_STRUCT = ("named_struct('id', id, 'source', source, 'payload', {payload}, 'labels', labels, "
              "'correlation_key', correlation_key)")


def prepare(jobs: DataFrame, spec: PipelineSpec) -> DataFrame:
    """Add the execution context columns to a job DataFrame."""
    for c in JOB_COLS:
        if c not in jobs.columns:
            raise SpecError(f"job DataFrame lacks column {c}")
    if spec.payload_schema and "payload_struct" in jobs.columns:
        # columnar sources hand the payload over as a struct: project it onto the
        # declared schema by field name instead of parsing the JSON text again
        target = jobs.sparkSession.createDataFrame([], f"p struct<{_ddl_fields(spec.payload_schema)}>") \
            .schema["p"].dataType
        have = {f.name: f.dataType for f in jobs.schema["payload_struct"].dataType.fields}
        items = []
        for f in target.fields:
            if f.name in have:
                items.append(f"{S.lit(f.name)}, CAST(payload_struct.{S.ident(f.name)} AS {f.dataType.simpleString()})")
            else:
                items.append(f"{S.lit(f.name)}, CAST(NULL AS {f.dataType.simpleString()})")
        work = f"CASE WHEN payload_struct IS NULL THEN NULL ELSE named_struct({', '.join(items)}) END"
    elif spec.payload_schema:
        # only a JSON object maps onto the payload struct; anything else is NULL
        # (a map step then fails with "job.payload is not an object")
        work = (f"CASE WHEN startswith(ltrim(payload), '{{') THEN from_json(payload, "
                f"{S.lit(spec.payload_schema)}) END")
    else:
        work = "try_parse_json(payload)"
    empty = f"CAST(NULL AS {S.STEP_RESULT_DDL})"
    df = jobs.selectExpr(
        *[S.ident(c) for c in jobs.columns],
        f"{S.lit(spec.id)} AS pipeline_id",
        JOB_STRUCT.format(payload=work) + " AS job",
        *[f"{empty} AS {S.ident(_step_col(s.id))}" for s in spec.steps],
        f"named_struct('id', {S.lit(spec.id)}) AS pipeline",
        "0 AS _level", "false AS _done", "'success' AS _status", "false AS _held",
    )
    return _with_view(df, spec)


def _ddl_fields(ddl: str) -> str:
    """``a int, b string`` → ``a: int, b: string`` for a struct type literal."""
    out = []
    depth = 0
    cur = ""
    for ch in ddl:
        if ch in "<(":
            depth += 1
        elif ch in ">)":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    out.append(cur)
    fields = []
    for part in out:
        name, typ = part.strip().split(None, 1)
        fields.append(f"{name}: {typ}")
    return ", ".join(fields)


def _payload_type(df: DataFrame) -> T.DataType:
    return df.schema["job"].dataType["payload"].dataType


def run_level(df: DataFrame, spec: PipelineSpec, level_idx: int, level: list[str]) -> DataFrame:
    """One DAG level = three projections: user expressions, per-step results and
    flags, then the fold into the row's level state. Each user expression is
    evaluated once and gives NULL where it fails, so what it does on a row that is
    not due has no effect; a Python transform gets the due rows only. Later
    projections only reference columns."""
    probe = _probe(df)
    run = f"(NOT _done AND _level = {level_idx})"  # rows that are due at this level
    pre0: list[str] = []
    pre: list[str] = []
    pre2: list[str] = []
    tmp: list[str] = []
    for sid in level:
        step = spec.step(sid)
        if isinstance(step, MapStep):
            if not isinstance(_payload_type(df), T.StructType):
                raise SpecError(f"map step {sid}: declare payload_schema to update the payload")
            for i, (_, e) in enumerate(step.set):
                pre.append(f"({e}) AS `_m_{sid}_{i}`")
                tmp.append(f"_m_{sid}_{i}")
        elif isinstance(step, ConditionStep):
            with lenient(df.sparkSession):
                t = probe.selectExpr(f"({step.expr}) AS c").schema["c"].dataType
            if not isinstance(t, (T.BooleanType, T.NullType)):  # A12 at plan time
                raise SpecError(f"condition {sid}: expression type {t.simpleString()} is not boolean")
            pre.append(f"CAST(({step.expr}) AS BOOLEAN) AS `_c_{sid}`")
            tmp.append(f"_c_{sid}")
        elif isinstance(step, TransformStep) and step.fn is not None:
            # Python transform: input column first, then the Arrow-batched UDF over it
            name = f"jobframe_{spec.id}_{sid}"
            df.sparkSession.udf.register(name, S.python_transform_udf(step.fn))
            pre0.append(f"{S.stdin_sql(step)} AS `_in_{sid}`")
            pre.append(f"{S.udf_raw(name, f'`_in_{sid}`', run)} AS `_t_{sid}`")
            tmp += [f"_in_{sid}", f"_t_{sid}"]
            if step.outputs is not None and step.outputs.format == "json" and step.outputs.fields:
                pre2.append(f"try_parse_json(`_t_{sid}`.stdout) AS `_d_{sid}`")
                tmp.append(f"_d_{sid}")
        elif isinstance(step, TransformStep):
            with lenient(df.sparkSession):
                t = probe.selectExpr(f"({step.expr}) AS r").schema["r"].dataType
            pre.append(f"{S.transform_raw(f'({step.expr})', t)} AS `_t_{sid}`")
            tmp.append(f"_t_{sid}")
            if step.outputs is not None and step.outputs.format == "json" and step.outputs.fields:
                pre2.append(f"try_parse_json(`_t_{sid}`.stdout) AS `_d_{sid}`")
                tmp.append(f"_d_{sid}")
        else:
            raise SpecError(f"unknown step type {type(step)}")
    with lenient(df.sparkSession):  # A12: an operation that fails on a record gives NULL
        if pre0:
            df = df.selectExpr("*", *pre0)
        df = df.selectExpr("*", *pre)
    if pre2:
        df = df.selectExpr("*", *pre2)

    flags: list[str] = []
    compiled: list[tuple[str, S.StepSQL]] = []
    for sid in level:
        step = spec.step(sid)
        if isinstance(step, MapStep):
            sc = S.compile_map(step, [f"`_m_{sid}_{i}`" for i in range(len(step.set))])
        elif isinstance(step, ConditionStep):
            target = spec.level_of(step.skip_to) if step.action == "skip_to" else None
            sc = S.compile_condition(step, target, f"`_c_{sid}`")
        else:
            doc = f"`_d_{sid}`" if f"_d_{sid}" in tmp else None
            stdin = f"`_in_{sid}`" if f"_in_{sid}" in tmp else None
            sc = S.compile_transform(step, f"`_t_{sid}`", doc, stdin)
        compiled.append((sid, sc))
        flags += [f"{sc.result} AS `_r_{sid}`", f"{sc.failed} AS `_f_{sid}`", f"{sc.emit} AS `_e_{sid}`",
                  f"{sc.skip_level} AS `_k_{sid}`", f"{sc.held} AS `_h_{sid}`"]
        tmp += [f"_r_{sid}", f"_f_{sid}", f"_e_{sid}", f"_k_{sid}", f"_h_{sid}"]
    df = df.selectExpr("*", *flags)

    ids = [sid for sid, _ in compiled]
    any_failed = "(" + " OR ".join(f"`_f_{i}`" for i in ids) + ")"
    any_emit = "(" + " OR ".join(f"`_e_{i}`" for i in ids) + ")"
    any_held = "(" + " OR ".join(f"`_h_{i}`" for i in ids) + ")"
    last_skip = "coalesce(" + ", ".join(f"`_k_{i}`" for i in reversed(ids)) + ", CAST(NULL AS INT))"
    results = [f"CASE WHEN {run} THEN `_r_{sid}` ELSE {S.ident(_step_col(sid))} END AS {S.ident(_step_col(sid))}"
               for sid in ids]
    written = {_step_col(sid) for sid in ids}

    # D-3: map targets of the level applied in declared order onto the entry payload
    updates = [u for _, sc in compiled for u in sc.updates]
    job_col = "job"
    if updates:
        payload = S.apply_updates("job.payload", _payload_type(df), updates, f"({run} AND NOT {any_failed})")
        job_col = JOB_STRUCT.format(payload=payload) + " AS job"

    next_level = (f"CASE WHEN NOT {run} THEN _level WHEN {any_failed} OR {any_emit} THEN _level "
                  f"WHEN {last_skip} > {level_idx} THEN {last_skip} ELSE {level_idx + 1} END AS _level")
    keep = [S.ident(c) for c in df.columns
            if c not in ("job", "_level", "_done", "_status", "_held", "steps", *tmp, *written)]
    out = df.selectExpr(
        *keep,
        job_col,
        *results,
        next_level,
        f"(_done OR ({run} AND ({any_failed} OR {any_emit}))) AS _done",
        f"CASE WHEN {run} AND {any_failed} THEN 'failure' ELSE _status END AS _status",
        f"(_held OR ({run} AND {any_failed} AND ({'true' if spec.failure.action == 'stop' else 'false'} "
        f"OR {any_held}))) AS _held",
    )
    return _with_view(out, spec)


def finish(df: DataFrame, spec: PipelineSpec) -> DataFrame:
    """PipelineResult rows: the original job (P7), status, held flag and steps."""
    work = F.col("job.payload")
    work_json = F.to_json(work) if not isinstance(_payload_type(df), T.VariantType) else F.to_json(work)
    internal = {"pipeline_id", "job", "pipeline", "_level", "_done", "_status", "_held", "steps", "payload_struct",
                *[_step_col(s.id) for s in spec.steps]}
    extra = [c for c in df.columns if c not in set(JOB_COLS) | internal]
    return df.select(
        "pipeline_id", *JOB_COLS, *extra,
        F.col("_status").alias("status"),
        F.col("_held").alias("held"),
        _raw_struct(spec).alias("steps"),
        work_json.alias("work_payload"),
    )


def run_pipeline(jobs: DataFrame, spec: PipelineSpec, checkpoint_every: int = LEVELS_PER_CHECKPOINT) -> DataFrame:
    """Run every job row through ``spec``; pure DataFrame → DataFrame, no shuffle."""
    df = prepare(jobs, spec)
    for i, level in enumerate(spec.levels()):
        df = run_level(df, spec, i, level)
        if checkpoint_every and (i + 1) % checkpoint_every == 0:
            from jobframe.session import checkpoint_dir

            checkpoint_dir(df.sparkSession)
            df = df.checkpoint(eager=True)
    return finish(df, spec)
