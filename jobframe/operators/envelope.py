"""Job envelope (P1), id rule (P2) and label overlay."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobframe.functions.json import top_level_string


def labels_map(labels: Mapping[str, str] | None) -> Column:
    if not labels:
        return F.create_map().cast("map<string,string>")
    entries = []
    for k, v in labels.items():
        entries += [F.lit(k), F.lit(v)]
    return F.create_map(*entries)


def generated_id(*parts: Column) -> Column:
    """Deterministic id: a re-run task (or a re-read file) yields the same id."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def envelope(df: DataFrame, source: str | Column, payload: Column, ordinal: Column,
             id_field: str | None = "id", labels: Mapping[str, str] | None = None,
             keep: list[str] | None = None, payload_struct: Column | None = None) -> DataFrame:
    """P1 + P2: wrap rows as jobs ``(id, source, payload, correlation_key, labels)``.

    ``payload`` is JSON text. The id is the top-level ``id_field`` only when it is
    a JSON string (an empty string is kept); otherwise a content-derived id from
    (source, ordinal, payload). A columnar source may also pass the same payload
    as ``payload_struct``; pipelines with a declared schema then read it directly
    instead of parsing the text (the text stays the job's payload of record).
    """
    src = F.lit(source) if isinstance(source, str) else source
    keep = list(keep or [])
    extra = [payload_struct.alias("payload_struct")] if payload_struct is not None else []
    base = df.select(*keep, src.alias("source"), payload.alias("payload"), ordinal.alias("_ordinal"), *extra)
    if extra:
        keep.append("payload_struct")
    gen = generated_id(F.col("source"), F.col("_ordinal"), F.col("payload"))
    jid = F.coalesce(top_level_string(F.col("payload"), id_field), gen) if id_field else gen
    return base.select(
        *(keep or []),
        jid.alias("id"),
        "source",
        "payload",
        F.lit(None).cast("string").alias("correlation_key"),
        labels_map(labels).alias("labels"),
    )


def overlay_labels(source_labels: Column, pipeline_labels: Mapping[str, str] | Column) -> Column:
    """Pipeline labels override source labels on the same key."""
    pl = labels_map(pipeline_labels) if not isinstance(pipeline_labels, Column) else pipeline_labels
    keep = F.map_filter(F.coalesce(source_labels, labels_map(None)),
                        lambda k, _: ~F.array_contains(F.map_keys(pl), k))
    return F.map_concat(keep, pl)
