"""Pipeline specifications.

A pipeline is a small DAG of steps declared in Python. Expressions are Spark SQL
expression strings evaluated against the record context:

* ``job``      struct(id, source, payload, labels, correlation_key) – ``payload`` is the
               *working* payload (map steps update it for later steps);
* ``steps``    struct with one field per step id: struct(stdout, stderr, exit_code,
               duration_ms, attempt, outputs) or NULL when the step has not run;
* ``pipeline`` struct(id).

The spec is validated on the driver (ids, references, cycles) and compiled by
``jobframe.plans.pipeline`` into one projection per DAG level.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Sequence

IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")

# Fixed values that must match the orchestrator being re-expressed.
DEFAULT_SUCCESS_EXIT_CODES = (0,)
DEFAULT_STDOUT_MAX_BYTES = 10 * 1024 * 1024
DEFAULT_STDERR_MAX_BYTES = 1024 * 1024
DEFAULT_SOURCE_MAX_BODY_BYTES = 1_048_576
DEFAULT_GLOBAL_MAX_PAYLOAD_BYTES = 10 * 1024 * 1024
DEFAULT_MERGE_TIMEOUT_SECS = 60
DEFAULT_CANCEL_TTL_SECS = 3600


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Route:
    """Step routing rule: every matching rule fires; NULL counts as no match."""

    condition: str
    sinks: tuple[str, ...]


@dataclass(frozen=True)
class FailurePolicy:
    action: str = "discard"  # discard | dead_letter | stop
    sink: str | None = None

    def __post_init__(self):
        if self.action not in ("discard", "dead_letter", "stop"):
            raise SpecError(f"unknown failure action {self.action!r}")


@dataclass(frozen=True)
class OutputField:
    name: str
    key: str = ""  # "" = whole document; dotted path through objects


@dataclass(frozen=True)
class Outputs:
    format: str = "json"  # json | text
    fields: tuple[OutputField, ...] = ()


@dataclass(frozen=True)
class _Step:
    id: str
    depends_on: tuple[str, ...] | None = None  # None: previous declared step; (): independent
    routing: tuple[Route, ...] = ()
    sinks: tuple[str, ...] = ()
    failure: FailurePolicy = field(default_factory=FailurePolicy)


@dataclass(frozen=True)
class MapStep(_Step):
    """Ordered ``target = expr`` list; every expr sees the step-entry context."""

    set: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class ConditionStep(_Step):
    expr: str = "true"
    action: str = "fail"  # fail | skip_to | emit
    reason: str | None = None
    skip_to: str | None = None


@dataclass(frozen=True)
class TransformStep(_Step):
    """User transform re-aimed from a process step.

    ``expr`` is a SQL expression returning either a string (stdout, exit code 0)
    or a struct with any of ``stdout, stderr, exit_code, duration_ms``.

    Alternatively ``fn`` is a Python function run as an Arrow-batched pandas UDF:
    it receives the step input (a ``pd.Series`` of strings, T2) and returns a
    ``pd.DataFrame`` with any of those four columns. ``stdin`` chooses the input:
    ``none`` (NULL), ``payload`` (the working payload as compact JSON) or
    ``template`` (``template`` rendered strictly: a NULL part fails the step).
    """

    expr: str = "CAST(NULL AS STRING)"
    fn: object = None
    stdin: str = "none"  # none | payload | template
    template: str | None = None
    outputs: Outputs | None = None
    success_exit_codes: tuple[int, ...] = DEFAULT_SUCCESS_EXIT_CODES
    stdout_max_bytes: int = DEFAULT_STDOUT_MAX_BYTES
    stderr_max_bytes: int = DEFAULT_STDERR_MAX_BYTES
    timeout_secs: int = 0


@dataclass(frozen=True)
class MergeSpec:
    strategy: str = "any"  # any | all
    correlation_key: str | None = None
    correlation_expr: str | None = None
    timeout_secs: int = DEFAULT_MERGE_TIMEOUT_SECS


@dataclass(frozen=True)
class PipelineSpec:
    id: str
    steps: tuple[_Step, ...]
    payload_schema: str | None = None  # DDL of the payload struct
    sources: tuple[str, ...] = ()
    sinks: tuple[str, ...] = ()
    labels: tuple[tuple[str, str], ...] = ()
    failure: FailurePolicy = field(default_factory=FailurePolicy)
    merge: MergeSpec | None = None

    def __post_init__(self):
        ids = [s.id for s in self.steps]
        if len(set(ids)) != len(ids):
            raise SpecError(f"pipeline {self.id}: duplicate step id")
        for s in self.steps:
            if not IDENT.match(s.id):
                raise SpecError(f"step id {s.id!r} must match {IDENT.pattern}")
        deps = self.dependencies()
        for sid, ds in deps.items():
            for d in ds:
                if d not in deps:
                    raise SpecError(f"step {sid}: unknown dependency {d}")
        for s in self.steps:
            if isinstance(s, ConditionStep):
                if s.action not in ("fail", "skip_to", "emit"):
                    raise SpecError(f"step {s.id}: unknown action {s.action}")
                if s.action == "skip_to" and s.skip_to not in deps:
                    raise SpecError(f"step {s.id}: skip_to target {s.skip_to!r} not found")
            if isinstance(s, TransformStep):
                if s.stdin not in ("none", "payload", "template"):
                    raise SpecError(f"step {s.id}: unknown stdin mode {s.stdin!r}")
                if s.stdin == "template" and not s.template:
                    raise SpecError(f"step {s.id}: stdin 'template' needs a template")
            if isinstance(s, MapStep):
                for target, _ in s.set:
                    if not target.startswith("job.payload.") or len(target) <= len("job.payload."):
                        raise SpecError(f"step {s.id}: map target {target!r} must start with job.payload.")
        self.levels()  # raises on cycles

    def step(self, sid: str) -> _Step:
        for s in self.steps:
            if s.id == sid:
                return s
        raise KeyError(sid)

    def dependencies(self) -> dict[str, tuple[str, ...]]:
        out: dict[str, tuple[str, ...]] = {}
        prev = None
        for s in self.steps:
            if s.depends_on is None:
                out[s.id] = (prev,) if prev is not None else ()
            else:
                out[s.id] = tuple(s.depends_on)
            prev = s.id
        return out

    def levels(self) -> list[list[str]]:
        """Topological levels (Kahn); inside a level, declared order."""
        deps = self.dependencies()
        order = [s.id for s in self.steps]
        indeg = {k: len(set(v)) for k, v in deps.items()}
        done: set[str] = set()
        levels: list[list[str]] = []
        current = [s for s in order if indeg[s] == 0]
        while current:
            levels.append(current)
            done.update(current)
            current = [s for s in order if s not in done and all(d in done for d in deps[s])]
        if len(done) != len(order):
            raise SpecError(f"pipeline {self.id} has a cycle in its step dependencies")
        return levels

    def level_of(self, sid: str) -> int:
        for i, lev in enumerate(self.levels()):
            if sid in lev:
                return i
        raise KeyError(sid)


def as_tuple(x: Sequence | None) -> tuple:
    return tuple(x) if x is not None else ()
