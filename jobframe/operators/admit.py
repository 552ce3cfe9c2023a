"""Admission: size gates, signatures, correlation headers, request verdicts,
cancel-target parsing (A1–A6, C3, S8, S9).

Source configuration is a handful of entries known on the driver, so per-source
parameters are compiled into literal ``CASE`` chains: no join, no broadcast,
nothing that grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobframe import messages as M
from jobframe.functions.hmac import hmac_sha256_hex
from jobframe.functions.json import key_path
from jobframe.operators.envelope import generated_id, labels_map
from jobframe.spec import DEFAULT_GLOBAL_MAX_PAYLOAD_BYTES, DEFAULT_SOURCE_MAX_BODY_BYTES

# Fixed values of the request contract being re-expressed.
DEFAULT_SIGNATURE_HEADER = "x-signature"
IDEMPOTENCY_HEADER = "idempotency-key"
CORRELATION_HEADER = "x-correlation-id"
MAX_CORRELATION_KEY_BYTES = 512
DEFAULT_ACK_STATUS = 202


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# ── A1 / A2 ──────────────────────────────────────────────────────────────────

def source_limit(limit: int) -> int:
    """0 means the per-source default."""
    return limit if limit > 0 else DEFAULT_SOURCE_MAX_BODY_BYTES


def size_verdict(payload_json: Column, source_limit_col: Column,
                 global_limit: int = DEFAULT_GLOBAL_MAX_PAYLOAD_BYTES) -> Column:
    """Source gate first, then the router's global gate; both strict ``>``."""
    n = F.octet_length(payload_json)
    return (F.when(n > source_limit_col, F.lit("source_too_large"))
            .when(n > F.lit(global_limit), F.lit("global_too_large"))
            .otherwise(F.lit("accepted")))


# ── A5 ───────────────────────────────────────────────────────────────────────

def _header_check(v: Column, name: str) -> tuple[Column, Column]:
    t = strip_ws(v)
    bad = v.isNotNull() & ((t == "") | ~t.rlike(r"^[\x21-\x7E]+$"))
    return t, F.when(bad, F.lit(M.HEADER_NOT_VISIBLE.format(name=name)))


def correlation_key(idem: Column, corr: Column) -> Column:
    """struct(key, error): both headers trimmed and graphic ASCII, equal when both
    present, at most 512 bytes."""
    a, ea = _header_check(idem, "idempotency-key")
    b, eb = _header_check(corr, "x-correlation-id")
    key = F.coalesce(F.when(idem.isNotNull(), a), F.when(corr.isNotNull(), b))
    err = (F.when(ea.isNotNull(), ea)
           .when(eb.isNotNull(), eb)
           .when(idem.isNotNull() & corr.isNotNull() & (a != b),
                 F.lit(M.KEYS_DIFFER))
           .when(F.octet_length(key) > MAX_CORRELATION_KEY_BYTES,
                 F.lit(M.KEY_TOO_LONG.format(limit=MAX_CORRELATION_KEY_BYTES))))
    return F.struct(F.when(err.isNull(), key).alias("key"), err.alias("error"))


# ── A3 / A4 / A6 ─────────────────────────────────────────────────────────────

@dataclass(frozen=True)
class HttpSource:
    id: str
    path: str
    kind: str = "http"  # http | webhook
    hmac_secret: str = ""
    hmac_header: str = ""
    max_body_bytes: int = 0
    ack_status: int = DEFAULT_ACK_STATUS
    id_field: str = ""
    labels: tuple[tuple[str, str], ...] = field(default_factory=tuple)


def _ack(src: HttpSource) -> int:
    if src.kind != "webhook":
        return 201
    return src.ack_status if 100 <= src.ack_status <= 999 else DEFAULT_ACK_STATUS


def request_verdict(requests: DataFrame, sources: list[HttpSource],
                    global_max: int = DEFAULT_GLOBAL_MAX_PAYLOAD_BYTES) -> DataFrame:
    """A6 over a landed request table ``(path, headers map<string,string>, body string, …)``.

    Order: unknown source 404 → signature 401 → size 413 → bad JSON 400 → bad
    correlation 400 → accepted (201, or the webhook ack status). Adds ``code``,
    ``reason``, ``source``, ``job_id`` and ``correlation_key``.
    """
    path = F.col("path")
    h = F.col("headers")
    body = F.col("body")
    src_id = F.lit(None).cast("string")
    for s in reversed(sources):
        src_id = F.when(path == s.path, F.lit(s.id)).otherwise(src_id)
    nbytes = F.octet_length(body)

    sig_fail = F.lit(None).cast("string")
    size_fail = F.lit(None).cast("string")
    ack = F.lit(None).cast("int")
    id_field_val = F.lit(None).cast("string")
    for s in sources:
        on = path == s.path
        if s.kind == "webhook" and s.hmac_secret:
            hdr_name = (s.hmac_header or DEFAULT_SIGNATURE_HEADER).lower()
            raw = h[hdr_name]
            v = strip_ws(raw)
            expected = F.when(v.startswith("sha256="), F.substr(v, F.lit(8))).otherwise(v)
            sig = (F.when(raw.isNull(), F.lit(M.MISSING_SIGNATURE.format(header=hdr_name)))
                   .when(expected != hmac_sha256_hex(body, s.hmac_secret), F.lit(M.SIGNATURE_MISMATCH)))
            sig_fail = F.when(on, sig).otherwise(sig_fail)
        limit = s.max_body_bytes if s.max_body_bytes > 0 else global_max
        before, after = M.split(M.BODY_TOO_LARGE, "size", limit=limit)
        size_fail = F.when(on & (nbytes > limit), F.concat(
            F.lit(before), nbytes.cast("string"), F.lit(after))).otherwise(size_fail)
        ack = F.when(on, F.lit(_ack(s))).otherwise(ack)
        if s.id_field:
            v = F.try_variant_get(F.try_parse_json(body), key_path(s.id_field), "variant")
            id_field_val = F.when(on & (F.schema_of_variant(v) == "STRING"),
                                  F.try_variant_get(v, "$", "string")).otherwise(id_field_val)

    parsed_ok = F.try_parse_json(body).isNotNull()
    corr = correlation_key(h[IDEMPOTENCY_HEADER], h[CORRELATION_HEADER])
    df = requests.select("*", src_id.alias("_src"), sig_fail.alias("_sig"), size_fail.alias("_size"),
                         parsed_ok.alias("_json"), corr.alias("_corr"), ack.alias("_ack"),
                         id_field_val.alias("_idf"))
    code = (F.when(F.col("_src").isNull(), F.lit(404))
            .when(F.col("_sig").isNotNull(), F.lit(401))
            .when(F.col("_size").isNotNull(), F.lit(413))
            .when(~F.col("_json"), F.lit(400))
            .when(F.col("_corr.error").isNotNull(), F.lit(400))
            .otherwise(F.col("_ack")))
    no_src, _ = M.split(M.NO_SOURCE, "path")
    reason = (F.when(F.col("_src").isNull(), F.concat(F.lit(no_src), path))
              .when(F.col("_sig").isNotNull(), F.col("_sig"))
              .when(F.col("_size").isNotNull(), F.col("_size"))
              .when(~F.col("_json"), F.lit(M.INVALID_JSON))
              .when(F.col("_corr.error").isNotNull(), F.col("_corr.error"))
              .otherwise(F.lit("accepted")))
    accepted = code < 300
    return df.select(
        *requests.columns,
        F.col("_src").alias("source"),
        code.alias("code"),
        reason.alias("reason"),
        F.when(accepted, F.coalesce(F.col("_idf"), generated_id(F.col("_src"), F.col("request_seq"), body))
               ).alias("job_id"),
        F.when(accepted, F.col("_corr.key")).alias("correlation_key"),
    )


def accepted_jobs(verdicts: DataFrame, sources: list[HttpSource]) -> DataFrame:
    """Accepted requests as job envelopes (payload = body JSON)."""
    lab = F.create_map().cast("map<string,string>")
    for s in reversed(sources):
        lab = F.when(F.col("source") == s.id, labels_map(dict(s.labels))).otherwise(lab)
    return verdicts.where(F.col("code") < 300).select(
        F.col("job_id").alias("id"), "source", F.col("body").alias("payload"), "correlation_key",
        lab.alias("labels"))


# ── C3 / S8 ──────────────────────────────────────────────────────────────────

def cancel_target(body: Column) -> Column:
    """First present of target_job_id / job_id / id decides (must be a
    non-empty JSON string); else the trimmed raw body when it has no whitespace
    and no '{'."""
    t = strip_ws(body)
    v = F.try_parse_json(t)
    present = None
    for k in ("target_job_id", "job_id", "id"):
        f = F.try_variant_get(v, key_path(k), "variant")
        present = f if present is None else F.coalesce(present, f)
    # A JSON null value still counts as present; try_variant_get gives a VARIANT null for it.
    as_str = F.when(F.schema_of_variant(present) == "STRING", F.try_variant_get(present, "$", "string"))
    from_json = F.when(as_str != "", as_str)
    fallback = F.when((t != "") & ~t.rlike(r"\s") & ~t.contains("{"), t)
    return F.coalesce(from_json, fallback)


def split_queue(messages: DataFrame, submit_key: str = "submit", cancel_key: str = "cancel"):
    """Landed queue messages ``(routing_key, body, …)`` → (submissions, cancellations).

    Submissions get a NULL payload when the body is not JSON (kept, as the
    orchestrator does); cancellations carry the parsed target id.
    """
    subs = messages.where(F.col("routing_key") == submit_key).withColumn(
        "payload", F.when(F.try_parse_json(F.col("body")).isNotNull(), F.col("body")))
    cancels = messages.where(F.col("routing_key") == cancel_key).withColumn(
        "target_job_id", cancel_target(F.col("body")))
    return subs, cancels.where(F.col("target_job_id").isNotNull())
