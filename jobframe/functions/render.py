"""Strict template rendering as column concatenation.

A template is a list of literal text and SQL expressions. ``concat`` returns NULL
as soon as one part is NULL, which is exactly the strict-undefined rule (a
missing or null variable is a render error). Never ``concat_ws``: it skips NULLs.
Variables such as ``now`` are job parameters passed in as literals, so a re-run
renders the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_VAR = re.compile(r"\{\{\s*(.*?)\s*\}\}")

RENDER_ERROR = "Template render error: "


def parts(template: str) -> list[tuple[str, str]]:
    """Split ``a {{ expr }} b`` into [("text","a "), ("expr","expr"), ("text"," b")]."""
    out, pos = [], 0
    for m in _VAR.finditer(template):
        if m.start() > pos:
            out.append(("text", template[pos:m.start()]))
        out.append(("expr", m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append(("text", template[pos:]))
    return out


def render(template: str, params: dict[str, str] | None = None) -> Column:
    """Rendered text, NULL when any referenced value is NULL."""
    cols = []
    for kind, v in parts(template):
        if kind == "text":
            cols.append(F.lit(v))
        elif params and v in params:
            cols.append(F.lit(params[v]))
        else:
            cols.append(F.expr(v).cast("string"))
    return F.concat(*cols) if cols else F.lit("")


def render_checked(template: str, params: dict[str, str] | None = None) -> Column:
    """struct(text, error): error names the template when rendering failed."""
    r = render(template, params)
    return F.struct(r.alias("text"),
                    F.when(r.isNull(), F.lit(f"{RENDER_ERROR}undefined value in template {template!r}")).alias("error"))
