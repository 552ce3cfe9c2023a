"""Message texts.

Fixed values: the texts below must equal those of the orchestrator being
re-expressed, because they appear in step results, verdicts and sink rows.
Placeholders in braces are filled per row.
"""

# Fixed values (error kinds, then step, task, request and cancel texts).
PIPELINE_ERROR = "Pipeline error: "
TASK_ERROR = "Task execution error: "
TIMEOUT_ERROR = "Timeout error: "
EXPRESSION_ERROR = "Expression evaluation error: "
TEMPLATE_ERROR = "Template render error: "
CONDITION_FALSE = "Condition '{expr}' evaluated to false"
SKIPPED_TO = "skipped_to: {target}"
EMITTED = "emitted"
NOT_AN_OBJECT = "job.payload is not an object"
TIMED_OUT = "Task timed out after {secs}s"
STDOUT_CAP = "stdout exceeded max_bytes limit of {limit}"
STDERR_CAP = "stderr exceeded max_bytes limit of {limit}"
EXIT_CODE = "Exit code {code} is not in success_exit_codes {codes}"
NO_SOURCE = "No HTTP/webhook source found for path: {path}"
MISSING_SIGNATURE = "Missing HMAC signature header: {header}"
SIGNATURE_MISMATCH = "HMAC signature mismatch"
BODY_TOO_LARGE = "Payload exceeds max_body_bytes limit of {limit} bytes (received {size} bytes)"
INVALID_JSON = "Invalid JSON"
HEADER_NOT_VISIBLE = "{name} must be a non-empty visible ASCII value"
KEYS_DIFFER = "Idempotency-Key and X-Correlation-ID must match when both are supplied"
KEY_TOO_LONG = "correlation key exceeds {limit} bytes"
CANCEL_PREFIX = "__cancel__"

# Texts of this library (no counterpart to match).
NOT_BOOLEAN = "Condition '{expr}' did not evaluate to a boolean"
NO_VALUE = "'{expr}' has no value"
UNDEFINED_IN_TEMPLATE = "undefined value in template {template!r}"


def split(template: str, field: str, **known) -> tuple[str, str]:
    """Text before and after ``{field}`` with the other placeholders filled, for
    messages whose ``field`` is a per-row value concatenated in SQL."""
    marker = "\x00"
    text = template.format(**{field: marker, **known})
    before, after = text.split(marker)
    return before, after
