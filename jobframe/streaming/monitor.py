"""Late data (W5): rows behind the watermark are dropped by Spark and only
counted in the query progress. Surface that count so it can be alerted on and
the watermark sized for the source's disorder."""

from __future__ import annotations


def dropped_by_watermark(query) -> int:
    """Rows dropped as late by the stateful operators, over the recent progress."""
    total = 0
    for p in query.recentProgress or []:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else getattr(p, "stateOperators", []):
            v = op.get("numRowsDroppedByWatermark", 0) if isinstance(op, dict) else \
                getattr(op, "numRowsDroppedByWatermark", 0)
            total += int(v or 0)
    return total
