"""Step operators (P4–P6, A7–A12, T1–T6, T8, F1) as SQL expressions.

Every function returns Spark SQL expression text evaluated against the
step-entry row, so a whole DAG level compiles into a single projection (no
shuffle, one code-generated stage). Building the level as SQL text and handing it
to the JVM once (``selectExpr``) keeps driver-side planning cheap even for wide
pipelines.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import types as T

from jobframe import messages as M
from jobframe.spec import ConditionStep, MapStep, Outputs, SpecError, TransformStep

STEP_RESULT_DDL = (
    "struct<stdout:string,stderr:string,exit_code:int,duration_ms:bigint,attempt:int,"
    "outputs:map<string,string>>"
)
STEP_RESULT_TYPE = T.StructType([
    T.StructField("stdout", T.StringType()),
    T.StructField("stderr", T.StringType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("outputs", T.MapType(T.StringType(), T.StringType())),
])

PIPELINE_ERROR = M.PIPELINE_ERROR
TASK_ERROR = M.TASK_ERROR
TIMEOUT_ERROR = M.TIMEOUT_ERROR
EXPRESSION_ERROR = M.EXPRESSION_ERROR

NULL_STR = "CAST(NULL AS STRING)"
EMPTY_MAP = "CAST(map() AS MAP<STRING,STRING>)"


def lit(s: str) -> str:
    """SQL string literal (backslash escapes are processed by the Spark parser)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def step_result(stdout: str, stderr: str, exit_code: str, duration_ms: str, attempt: str, outputs: str) -> str:
    return (f"named_struct('stdout', CAST({stdout} AS STRING), 'stderr', CAST({stderr} AS STRING), "
            f"'exit_code', CAST({exit_code} AS INT), 'duration_ms', CAST({duration_ms} AS BIGINT), "
            f"'attempt', CAST({attempt} AS INT), 'outputs', {outputs})")


def ok_result(stdout: str = NULL_STR) -> str:
    """map/condition result – exit 0, attempt 1, no stderr, empty outputs."""
    return step_result(stdout, NULL_STR, "0", "0", "1", EMPTY_MAP)


def failure_result(error: str) -> str:
    """a failed step keeps only the error text; exit -1, attempt 0, duration 0."""
    return step_result(NULL_STR, error, "-1", "0", "0", EMPTY_MAP)


@dataclass
class StepSQL:
    """What one step contributes to its level (all SQL text)."""

    result: str               # STEP_RESULT struct
    failed: str               # boolean, never NULL
    emit: str                 # boolean, never NULL
    skip_level: str           # int level index or NULL
    held: str                 # failed and the step's failure action is stop
    updates: list[tuple[str, str]]  # map-step (payload path, value)


def _stop(step, failed: str) -> str:
    return f"({failed})" if step.failure.action == "stop" else "false"


def compile_map(step: MapStep, values: list[str]) -> StepSQL:
    """An entry without a value (absent or NULL operand, failed operation) fails the step, in the order
    of the entries; the payload is checked when the first value is set."""
    updates = [(target[len("job.payload."):], values[i]) for i, (target, _) in enumerate(step.set)]
    checks = [(f"{values[i]} IS NULL", lit(EXPRESSION_ERROR + M.NO_VALUE.format(expr=e)))
              for i, (_, e) in enumerate(step.set)]
    checks.insert(1, ("job.payload IS NULL", lit(PIPELINE_ERROR + M.NOT_AN_OBJECT)))
    failed = "(" + " OR ".join(c for c, _ in checks) + ")"
    error = "CASE " + " ".join(f"WHEN {c} THEN {m}" for c, m in checks) + " END"
    result = f"CASE WHEN {failed} THEN {failure_result(error)} ELSE {ok_result()} END"
    return StepSQL(result, failed, "false", "CAST(NULL AS INT)", _stop(step, failed), updates)


def compile_condition(step: ConditionStep, skip_level: int | None, c: str) -> StepSQL:
    # NULL (missing key / null operand) is an evaluation error, not false.
    err_null = lit(EXPRESSION_ERROR + M.NOT_BOOLEAN.format(expr=step.expr))
    if step.action == "fail":
        reason = step.reason if step.reason is not None else M.CONDITION_FALSE.format(expr=step.expr)
        failed = f"({c} IS NULL OR NOT {c})"
        error = f"CASE WHEN {c} IS NULL THEN {err_null} ELSE {lit(PIPELINE_ERROR + reason)} END"
        result = f"CASE WHEN {failed} THEN {failure_result(error)} ELSE {ok_result()} END"
        return StepSQL(result, failed, "false", "CAST(NULL AS INT)", _stop(step, failed), [])
    failed = f"({c} IS NULL)"
    if step.action == "emit":
        stdout = f"CASE WHEN NOT {c} THEN {lit(M.EMITTED)} END"
        emit = f"(coalesce(NOT {c}, false))"
        skip = "CAST(NULL AS INT)"
    else:  # skip_to
        stdout = f"CASE WHEN NOT {c} THEN {lit(M.SKIPPED_TO.format(target=step.skip_to))} END"
        emit = "false"
        skip = f"CASE WHEN {c} IS NOT NULL AND NOT {c} THEN {int(skip_level)} END"
    result = f"CASE WHEN {failed} THEN {failure_result(err_null)} ELSE {ok_result(stdout)} END"
    return StepSQL(result, failed, emit, skip, _stop(step, failed), [])


def json_path(key: str) -> str:
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in key.split("."))


def extract_outputs(stdout: str, outputs: Outputs | None, doc: str | None = None) -> str:
    """The outputs map (values as JSON text) from captured stdout."""
    if outputs is None or not outputs.fields:
        return EMPTY_MAP
    if outputs.format == "text":
        j = f"to_json(array({stdout}))"
        as_json = f"substring({j}, 2, length({j}) - 2)"  # JSON text of the string value
        entries = ", ".join(f"{lit(f.name)}, {as_json}" for f in outputs.fields)
        return f"CASE WHEN {stdout} IS NULL THEN {EMPTY_MAP} ELSE map({entries}) END"
    if outputs.format != "json":
        raise SpecError(f"unknown outputs format {outputs.format!r}")
    doc = doc or f"try_parse_json({stdout})"
    entries = []
    for f in outputs.fields:
        if f.key == "":
            val = f"to_json({doc})"
        else:
            val = f"coalesce(to_json(try_variant_get({doc}, {lit(json_path(f.key))}, 'variant')), 'null')"
        entries.append(f"{lit(f.name)}, {val}")
    return f"CASE WHEN {doc} IS NULL THEN {EMPTY_MAP} ELSE map({', '.join(entries)}) END"


def transform_raw(r: str, expr_type: T.DataType) -> str:
    """Normalise the transform's value ``r`` to struct(stdout, stderr, exit_code, duration_ms)."""
    if isinstance(expr_type, T.StructType):
        names = set(expr_type.fieldNames())
        stdout = f"CAST({r}.stdout AS STRING)" if "stdout" in names else NULL_STR
        stderr = f"CAST({r}.stderr AS STRING)" if "stderr" in names else NULL_STR
        exit_code = f"CAST({r}.exit_code AS INT)" if "exit_code" in names else "0"
        duration = f"CAST({r}.duration_ms AS BIGINT)" if "duration_ms" in names else "CAST(0 AS BIGINT)"
    else:
        stdout, stderr, exit_code, duration = f"CAST({r} AS STRING)", NULL_STR, "0", "CAST(0 AS BIGINT)"
    return (f"named_struct('stdout', {stdout}, 'stderr', {stderr}, 'exit_code', coalesce({exit_code}, -1), "
            f"'duration_ms', coalesce({duration}, CAST(0 AS BIGINT)))")


UDF_SCHEMA = "stdout string, stderr string, exit_code int, duration_ms bigint"


def python_transform_udf(fn):
    """Wrap a user function (Series of inputs → DataFrame) as a pandas UDF of (input, due); the function sees the
    due rows only."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(UDF_SCHEMA)
    def run(stdin: pd.Series, due: pd.Series) -> pd.DataFrame:
        due = due.to_numpy(dtype=bool)
        n = int(due.sum())
        out = fn(stdin[due].reset_index(drop=True)) if n else pd.DataFrame()
        if isinstance(out, pd.Series):
            out = pd.DataFrame({"stdout": out})
        out = out.reset_index(drop=True)
        found = pd.DataFrame({
            "stdout": out["stdout"] if "stdout" in out else pd.Series([None] * n, dtype=object),
            "stderr": out["stderr"] if "stderr" in out else pd.Series([None] * n, dtype=object),
            "exit_code": (out["exit_code"] if "exit_code" in out else pd.Series([0] * n)).astype("int32"),
            "duration_ms": (out["duration_ms"] if "duration_ms" in out else pd.Series([0] * n)).astype("int64"),
        })
        if n == len(due):
            return found
        every = pd.DataFrame({"stdout": pd.Series([None] * len(due), dtype=object),
                              "stderr": pd.Series([None] * len(due), dtype=object),
                              "exit_code": pd.Series([0] * len(due), dtype="int32"),
                              "duration_ms": pd.Series([0] * len(due), dtype="int64")})
        for c in every.columns:
            every.loc[due, c] = found[c].to_numpy()
        return every

    return run


def stdin_sql(step: TransformStep) -> str:
    """The step input as SQL text."""
    if step.stdin == "payload":
        return "to_json(job.payload)"
    if step.stdin == "template":
        from jobframe.functions.render import parts

        pieces = [lit(v) if kind == "text" else f"CAST(({v}) AS STRING)" for kind, v in parts(step.template)]
        return f"concat({', '.join(pieces)})" if pieces else "''"
    return NULL_STR


def udf_raw(udf_name: str, stdin_col: str, due: str) -> str:
    r = f"{udf_name}({stdin_col}, {due})"
    return (f"named_struct('stdout', {r}.stdout, 'stderr', {r}.stderr, 'exit_code', coalesce({r}.exit_code, -1), "
            f"'duration_ms', coalesce({r}.duration_ms, CAST(0 AS BIGINT)))")


def _list_text(codes) -> str:
    """A list of codes as the orchestrator prints it: ``[0, 2]``."""
    return "[" + ", ".join(str(c) for c in codes) + "]"


def compile_transform(step: TransformStep, raw: str, doc: str | None = None, stdin: str | None = None) -> StepSQL:
    """T3–T6, T8 on the normalised transform result column ``raw``."""
    stdout, stderr, exit_code, duration = f"{raw}.stdout", f"{raw}.stderr", f"{raw}.exit_code", f"{raw}.duration_ms"
    checks: list[tuple[str, str]] = []
    if stdin is not None and step.stdin == "template":  # E3: strict rendering, before the task runs
        checks.append((f"{stdin} IS NULL",
                       lit(M.TEMPLATE_ERROR + M.UNDEFINED_IN_TEMPLATE.format(template=step.template))))
    if step.timeout_secs > 0:
        checks.append((f"{duration} > {step.timeout_secs * 1000}",
                       lit(TIMEOUT_ERROR + M.TIMED_OUT.format(secs=step.timeout_secs))))
    if step.stdout_max_bytes > 0:
        checks.append((f"coalesce(octet_length({stdout}), 0) > {step.stdout_max_bytes}",
                       lit(TASK_ERROR + M.STDOUT_CAP.format(limit=step.stdout_max_bytes))))
    if step.stderr_max_bytes > 0:
        checks.append((f"coalesce(octet_length({stderr}), 0) > {step.stderr_max_bytes}",
                       lit(TASK_ERROR + M.STDERR_CAP.format(limit=step.stderr_max_bytes))))
    if step.success_exit_codes:
        codes = list(step.success_exit_codes)
        before, after = M.split(M.EXIT_CODE, "code", codes=_list_text(codes))
        checks.append((f"NOT ({exit_code} IN ({', '.join(str(c) for c in codes)}))",
                       f"concat({lit(TASK_ERROR + before)}, CAST({exit_code} AS STRING), {lit(after)})"))
    if checks:
        error = "CASE " + " ".join(f"WHEN {c} THEN {m}" for c, m in checks) + " END"
    else:
        error = NULL_STR
    failed = f"({error} IS NOT NULL)"
    good = step_result(stdout, stderr, exit_code, duration, "1", extract_outputs(stdout, step.outputs, doc))
    result = f"CASE WHEN {failed} THEN {failure_result(error)} ELSE {good} END"
    return StepSQL(result, failed, "false", "CAST(NULL AS INT)", _stop(step, failed), [])


def apply_updates(payload: str, payload_type: T.StructType, updates: list[tuple[str, str]], cond: str) -> str:
    """P4 + P5: all map targets of a level applied to the payload struct in one rebuild.

    Targets are dotted paths; later targets win (declared order). A missing
    parent is created; a non-object parent is replaced by a new object, as when
    setting a path in a JSON document. Rows where ``cond`` is false keep their
    values (new fields are NULL there, which JSON output omits). A NULL payload
    stays NULL. Each value expression appears once in the result.
    """
    tree: dict = {}
    for path, value in updates:
        node = tree
        parts = path.split(".")
        for p in parts[:-1]:
            if not isinstance(node.get(p), dict):
                node[p] = {}
            node = node[p]
        node[parts[-1]] = value
    body = _rebuild(payload, payload_type, tree, cond)
    return f"CASE WHEN {payload} IS NULL THEN NULL ELSE {body} END"


def _rebuild(base: str, base_type: T.StructType, tree: dict, cond: str) -> str:
    items = []
    names = [f.name for f in base_type.fields]
    for f in base_type.fields:
        ref = f"{base}.{ident(f.name)}"
        node = tree.get(f.name)
        if node is None:
            items.append(f"{lit(f.name)}, {ref}")
        elif not isinstance(node, dict):
            items.append(f"{lit(f.name)}, CASE WHEN {cond} THEN {node} ELSE {ref} END")
        elif isinstance(f.dataType, T.StructType):
            child = _rebuild(ref, f.dataType, node, cond)  # a NULL parent becomes an object
            items.append(f"{lit(f.name)}, CASE WHEN {cond} OR {ref} IS NOT NULL THEN {child} END")
        else:
            items.append(f"{lit(f.name)}, CASE WHEN {cond} THEN {_fresh(node)} END")
    for name, node in tree.items():
        if name in names:
            continue
        val = _fresh(node) if isinstance(node, dict) else node
        items.append(f"{lit(name)}, CASE WHEN {cond} THEN {val} END")
    return f"named_struct({', '.join(items)})"


def _fresh(tree: dict) -> str:
    return "named_struct(" + ", ".join(
        f"{lit(k)}, {_fresh(v) if isinstance(v, dict) else v}" for k, v in tree.items()) + ")"
