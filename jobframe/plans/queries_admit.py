"""Queries for ingest envelopes and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobframe.functions.hmac import hmac_sha256_hex, hmac_sql
from jobframe.operators.admit import (
    HttpSource,
    cancel_target,
    correlation_key,
    request_verdict,
    size_verdict,
    source_limit,
    split_queue,
)
from jobframe.operators.envelope import envelope
from jobframe.plans.catalog import query, table

# ── P1 / P2 ──────────────────────────────────────────────────────────────────


def envelope_payload():
    eid = F.col("event_id").cast("string")
    k = F.get_json_object("props", "$.k")
    return (F.when(F.col("event_type") == "click", F.concat(F.lit('{"id":"c-'), eid, F.lit('","k":'), k, F.lit("}")))
            .when(F.col("event_type") == "view", F.concat(F.lit('{"id":'), eid, F.lit(',"k":'), k, F.lit("}")))
            .when(F.col("event_type") == "signup", F.concat(F.lit('{"id":"","k":'), k, F.lit("}")))
            .otherwise(F.col("props")))


@query("job_envelope", sql="""
WITH p AS (
  SELECT event_id, CASE
      WHEN event_type = 'click' THEN '{"id":"c-' || CAST(event_id AS VARCHAR) || '","k":' || (props->>'$.k') || '}'
      WHEN event_type = 'view' THEN '{"id":' || CAST(event_id AS VARCHAR) || ',"k":' || (props->>'$.k') || '}'
      WHEN event_type = 'signup' THEN '{"id":"","k":' || (props->>'$.k') || '}'
      ELSE props END AS payload
  FROM events)
SELECT event_id,
       CASE WHEN json_type(payload, '$.id') = 'VARCHAR' THEN payload->>'$.id'
            ELSE sha256(concat_ws('|', 'events', CAST(event_id AS VARCHAR), payload)) END AS job_id,
       'events' AS source, 'prod' AS label_env, payload
FROM p
""")
def job_envelope(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    jobs = envelope(ev, "events", envelope_payload(), F.col("event_id"), id_field="id",
                    labels={"env": "prod"}, keep=["event_id"])
    return jobs.select("event_id", F.col("id").alias("job_id"), "source",
                       F.col("labels")["env"].alias("label_env"), "payload")


# ── A1 / A2 ──────────────────────────────────────────────────────────────────

GLOBAL_LIMIT = 20000
LIMITED_SOURCES = [f"src{i}" for i in range(10, 20)]  # these sources set max_body_bytes = 6000


@query("size_gate", sql=f"""
SELECT doc_id,
       CAST(octet_length(encode(to_json(struct_pack(doc_id := doc_id, lang := lang, source := source, text := text))))
            AS INTEGER) AS payload_bytes,
       CASE WHEN octet_length(encode(to_json(struct_pack(doc_id := doc_id, lang := lang, source := source, text := text))))
                 > CASE WHEN source IN ({", ".join(f"'{s}'" for s in LIMITED_SOURCES)}) THEN 6000 ELSE 1048576 END
            THEN 'source_too_large'
            WHEN octet_length(encode(to_json(struct_pack(doc_id := doc_id, lang := lang, source := source, text := text))))
                 > {GLOBAL_LIMIT} THEN 'global_too_large'
            ELSE 'accepted' END AS verdict
FROM documents
""")
def size_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    payload = F.to_json(F.struct("doc_id", "lang", "source", "text"))
    limit = F.when(F.col("source").isin(LIMITED_SOURCES), F.lit(source_limit(6000))).otherwise(F.lit(source_limit(0)))
    return docs.select(
        "doc_id",
        F.octet_length(payload).alias("payload_bytes"),
        size_verdict(payload, limit, GLOBAL_LIMIT).alias("verdict"),
    )


# ── A4 ───────────────────────────────────────────────────────────────────────

SECRET = "alpha-secret"
WRONG = "beta-secret"


@query("signature_check", sql=f"""
WITH h AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN role = 'user' THEN 'sha256=' || {hmac_sql('text', SECRET)}
              WHEN role = 'assistant' THEN {hmac_sql('text', WRONG)}
              ELSE upper({hmac_sql('text', SECRET)}) END AS header
  FROM conversations)
SELECT conv_id, turn, role,
       (CASE WHEN starts_with(trim(header), 'sha256=') THEN substr(trim(header), 8) ELSE trim(header) END)
         = {hmac_sql('text', SECRET)} AS valid
FROM h
""")
def signature_check(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    good = hmac_sha256_hex(F.col("text"), SECRET)
    header = (F.when(F.col("role") == "user", F.concat(F.lit("sha256="), good))
              .when(F.col("role") == "assistant", hmac_sha256_hex(F.col("text"), WRONG))
              .otherwise(F.upper(good)))
    from jobframe.functions.hmac import signature_ok

    return conv.select("conv_id", "turn", "role", signature_ok(F.col("text"), header, SECRET).alias("valid"))


# ── A5 ───────────────────────────────────────────────────────────────────────

def _corr_headers():
    cid = F.col("conv_id").cast("string")
    turn = F.col("turn").cast("string")
    idem = (F.when(F.col("role") == "user", F.concat(F.lit("c"), cid, F.lit("-"), turn))
            .when(F.col("role") == "assistant", F.concat(F.lit("  c"), cid, F.lit(" ")))
            .when(F.col("role") == "system", F.lit(None)))
    corr = (F.when((F.col("role") == "user") & (F.col("turn") == 0), F.concat(F.lit("c"), cid, F.lit("-0")))
            .when(F.col("role") == "user", F.lit("other"))
            .when((F.col("role") == "system") & (F.length("text") > 300), F.lit("has space"))
            .when(F.col("role") == "system", F.repeat(F.lit("k"), 513))
            .when(F.length("text") > 1500, F.lit("")))
    return idem, corr


CORR_SQL = """
WITH h AS (
  SELECT conv_id, turn, role,
    CASE WHEN role = 'user' THEN 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)
         WHEN role = 'assistant' THEN '  c' || CAST(conv_id AS VARCHAR) || ' ' END AS idem,
    CASE WHEN role = 'user' AND turn = 0 THEN 'c' || CAST(conv_id AS VARCHAR) || '-0'
         WHEN role = 'user' THEN 'other'
         WHEN role = 'system' AND length(text) > 300 THEN 'has space'
         WHEN role = 'system' THEN repeat('k', 513)
         WHEN length(text) > 1500 THEN '' END AS corr
  FROM conversations
), t AS (
  SELECT *, trim(idem) AS a, trim(corr) AS b,
    idem IS NOT NULL AND (trim(idem) = '' OR NOT regexp_full_match(trim(idem), '[\\x21-\\x7E]+')) AS bad_a,
    corr IS NOT NULL AND (trim(corr) = '' OR NOT regexp_full_match(trim(corr), '[\\x21-\\x7E]+')) AS bad_b
  FROM h
), e AS (
  SELECT *, coalesce(a, b) AS k,
    CASE WHEN bad_a THEN 'idempotency-key must be a non-empty visible ASCII value'
         WHEN bad_b THEN 'x-correlation-id must be a non-empty visible ASCII value'
         WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b
           THEN 'Idempotency-Key and X-Correlation-ID must match when both are supplied'
         WHEN octet_length(encode(coalesce(a, b))) > 512 THEN 'correlation key exceeds 512 bytes' END AS error
  FROM t)
SELECT conv_id, turn, role, CASE WHEN error IS NULL THEN k END AS correlation_key, error FROM e
"""


@query("correlation_rule", sql=CORR_SQL)
def correlation_rule(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    idem, corr = _corr_headers()
    c = correlation_key(idem, corr)
    return conv.select("conv_id", "turn", "role", c["key"].alias("correlation_key"), c["error"].alias("error"))


# ── A3 / A6 / S9 ─────────────────────────────────────────────────────────────

PAGE_SOURCES = [
    HttpSource(id="web_en", path="/en", kind="webhook", hmac_secret=SECRET, hmac_header="X-Signature",
               max_body_bytes=16384, id_field="key"),
    HttpSource(id="api_de", path="/de", kind="http", max_body_bytes=0),
    HttpSource(id="hook_es", path="/es", kind="webhook", ack_status=1000),
]
PAGE_GLOBAL = 20000


def page_requests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    esc = F.replace(F.replace(F.replace(F.col("html"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                    F.lit("\n"), F.lit("\\n"))
    pid = F.col("page_id").cast("string")
    body = F.when(F.col("url").contains("#"), F.col("html")).otherwise(F.concat(
        F.lit('{"key":"p-'), pid, F.lit('","url":"'), F.col("url"), F.lit('","html":"'), esc, F.lit('"}')))
    path = F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://[^/]+/([^/]+)/", 1))
    sig_ok = hmac_sha256_hex(body, SECRET)
    sig = (F.when(F.col("url").contains(".example.com"), F.concat(F.lit("sha256="), sig_ok))
           .when(F.col("url").contains(".example.org"), F.concat(F.lit(" "), sig_ok, F.lit(" ")))
           .when(F.col("url").startswith("https://m."), F.upper(sig_ok)))
    idem = F.when(F.col("url").contains("?"), F.concat(F.lit("k-"), pid))
    corr = (F.when(F.col("url").contains("ref=x"), F.concat(F.lit("k-"), pid))
            .when(F.col("url").contains("utm_source"), F.lit("other"))
            .when(F.col("url").endswith(".html"), F.repeat(F.lit("x"), 600)))
    headers = F.map_filter(F.create_map(F.lit("x-signature"), sig, F.lit("idempotency-key"), idem,
                                        F.lit("x-correlation-id"), corr), lambda k, v: v.isNotNull())
    return pages.select(F.col("page_id").alias("request_seq"), path.alias("path"), headers.alias("headers"),
                        body.alias("body"))


PAGE_SQL = f"""
WITH r AS (
  SELECT page_id AS request_seq,
    '/' || regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1) AS path,
    CASE WHEN contains(url, '#') THEN html ELSE
      '{{"key":"p-' || CAST(page_id AS VARCHAR) || '","url":"' || url || '","html":"'
      || replace(replace(replace(html, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"}}' END AS body,
    url
  FROM pages
), h AS (
  SELECT *,
    CASE WHEN contains(url, '.example.com') THEN 'sha256=' || {hmac_sql('body', SECRET)}
         WHEN contains(url, '.example.org') THEN ' ' || {hmac_sql('body', SECRET)} || ' '
         WHEN starts_with(url, 'https://m.') THEN upper({hmac_sql('body', SECRET)}) END AS sig,
    CASE WHEN contains(url, '?') THEN 'k-' || CAST(request_seq AS VARCHAR) END AS idem,
    CASE WHEN contains(url, 'ref=x') THEN 'k-' || CAST(request_seq AS VARCHAR)
         WHEN contains(url, 'utm_source') THEN 'other'
         WHEN ends_with(url, '.html') THEN repeat('x', 600) END AS corr
  FROM r
), v AS (
  SELECT *,
    CASE path WHEN '/en' THEN 'web_en' WHEN '/de' THEN 'api_de' WHEN '/es' THEN 'hook_es' END AS source,
    octet_length(encode(body)) AS n,
    json_valid(body) AS ok_json,
    trim(idem) AS a, trim(corr) AS b
  FROM h
), c AS (
  SELECT *,
    CASE WHEN path = '/en' AND sig IS NULL THEN 'Missing HMAC signature header: x-signature'
         WHEN path = '/en' AND (CASE WHEN starts_with(trim(sig), 'sha256=') THEN substr(trim(sig), 8) ELSE trim(sig) END)
              <> {hmac_sql('body', SECRET)} THEN 'HMAC signature mismatch' END AS sig_fail,
    CASE WHEN path = '/en' AND n > 16384 THEN 'Payload exceeds max_body_bytes limit of 16384 bytes (received ' || CAST(n AS VARCHAR) || ' bytes)'
         WHEN path IN ('/de', '/es') AND n > {PAGE_GLOBAL} THEN 'Payload exceeds max_body_bytes limit of {PAGE_GLOBAL} bytes (received ' || CAST(n AS VARCHAR) || ' bytes)' END AS size_fail,
    CASE WHEN idem IS NOT NULL AND (a = '' OR NOT regexp_full_match(a, '[\\x21-\\x7E]+')) THEN 'idempotency-key must be a non-empty visible ASCII value'
         WHEN corr IS NOT NULL AND (b = '' OR NOT regexp_full_match(b, '[\\x21-\\x7E]+')) THEN 'x-correlation-id must be a non-empty visible ASCII value'
         WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN 'Idempotency-Key and X-Correlation-ID must match when both are supplied'
         WHEN octet_length(encode(coalesce(a, b))) > 512 THEN 'correlation key exceeds 512 bytes' END AS corr_err
  FROM v
), d AS (
  SELECT *,
    CASE WHEN source IS NULL THEN 404 WHEN sig_fail IS NOT NULL THEN 401 WHEN size_fail IS NOT NULL THEN 413
         WHEN NOT ok_json THEN 400 WHEN corr_err IS NOT NULL THEN 400
         WHEN source = 'api_de' THEN 201 ELSE 202 END AS code
  FROM c)
SELECT request_seq, path, source, code,
  CASE WHEN source IS NULL THEN 'No HTTP/webhook source found for path: ' || path
       WHEN sig_fail IS NOT NULL THEN sig_fail WHEN size_fail IS NOT NULL THEN size_fail
       WHEN NOT ok_json THEN 'Invalid JSON' WHEN corr_err IS NOT NULL THEN corr_err ELSE 'accepted' END AS reason,
  CASE WHEN code < 300 THEN coalesce(
       CASE WHEN source = 'web_en' AND json_type(body, '$.key') = 'VARCHAR' THEN body->>'$.key' END,
       sha256(concat_ws('|', source, CAST(request_seq AS VARCHAR), body))) END AS job_id,
  CASE WHEN code < 300 THEN coalesce(a, b) END AS correlation_key
FROM d
"""


@query("request_verdict", sql=PAGE_SQL)
def request_verdict_q(spark, sf_dir):
    req = page_requests(spark, sf_dir)
    v = request_verdict(req, PAGE_SOURCES, PAGE_GLOBAL)
    return v.select("request_seq", "path", "source", "code", "reason", "job_id", "correlation_key")


# ── C3 / S8 ──────────────────────────────────────────────────────────────────

def cancel_bodies():
    eid = F.col("event_id").cast("string")
    return (F.when(F.col("event_type") == "click", F.concat(F.lit('{"target_job_id":"ev-'), eid, F.lit('","job_id":"x"}')))
            .when(F.col("event_type") == "view", F.concat(F.lit('{"job_id":'), eid, F.lit("}")))
            .when(F.col("event_type") == "signup", F.concat(F.lit("  ev-"), eid, F.lit("  ")))
            .when(F.col("event_type") == "purchase", F.concat(F.lit('{"id":"p-'), eid, F.lit('"}')))
            .when(F.col("value") > 100, F.concat(F.lit('"q-'), eid, F.lit('"')))
            .when(F.col("value") > 50, F.lit('{"target_job_id":""}'))
            .otherwise(F.concat(F.lit("two words "), eid)))


CANCEL_BODIES_SQL = """
SELECT event_id, CASE
  WHEN event_type = 'click' THEN '{"target_job_id":"ev-' || CAST(event_id AS VARCHAR) || '","job_id":"x"}'
  WHEN event_type = 'view' THEN '{"job_id":' || CAST(event_id AS VARCHAR) || '}'
  WHEN event_type = 'signup' THEN '  ev-' || CAST(event_id AS VARCHAR) || '  '
  WHEN event_type = 'purchase' THEN '{"id":"p-' || CAST(event_id AS VARCHAR) || '"}'
  WHEN value > 100 THEN '"q-' || CAST(event_id AS VARCHAR) || '"'
  WHEN value > 50 THEN '{"target_job_id":""}'
  ELSE 'two words ' || CAST(event_id AS VARCHAR) END AS body
FROM events
"""

CANCEL_TARGET_SQL = f"""
WITH b AS ({CANCEL_BODIES_SQL}), t AS (
  SELECT event_id, body, trim(body) AS tb, json_valid(trim(body)) AS ok FROM b
), f AS (
  SELECT *,
    CASE WHEN ok AND json_type(tb) = 'OBJECT' THEN
      CASE WHEN json_exists(tb, '$.target_job_id') THEN
             CASE WHEN json_type(tb, '$.target_job_id') = 'VARCHAR' THEN tb->>'$.target_job_id' END
           WHEN json_exists(tb, '$.job_id') THEN
             CASE WHEN json_type(tb, '$.job_id') = 'VARCHAR' THEN tb->>'$.job_id' END
           WHEN json_exists(tb, '$.id') THEN
             CASE WHEN json_type(tb, '$.id') = 'VARCHAR' THEN tb->>'$.id' END END END AS js
  FROM t)
SELECT event_id, body,
  coalesce(CASE WHEN js <> '' THEN js END,
           CASE WHEN tb <> '' AND NOT regexp_matches(tb, '\\s') AND NOT contains(tb, '{{') THEN tb END) AS target_job_id
FROM f
"""


@query("cancel_target_parse", sql=CANCEL_TARGET_SQL)
def cancel_target_parse(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    b = ev.select("event_id", cancel_bodies().alias("body"))
    return b.select("event_id", "body", cancel_target(F.col("body")).alias("target_job_id"))


@query("queue_split", sql=f"""
WITH m AS (
  SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 'cancel' ELSE 'submit' END AS routing_key,
         CASE WHEN event_type = 'error' THEN '{{"target_job_id":"ev-' || CAST(event_id AS VARCHAR) || '"}}'
              WHEN event_type = 'view' THEN 'not json {{'
              WHEN value > 200 THEN 'not json'
              ELSE props END AS body
  FROM events)
SELECT event_id, 'submit' AS kind, CASE WHEN json_valid(body) THEN body END AS payload, NULL AS target_job_id
FROM m WHERE routing_key = 'submit'
UNION ALL
SELECT event_id, 'cancel', NULL, 'ev-' || CAST(event_id AS VARCHAR)
FROM m WHERE routing_key = 'cancel' AND starts_with(body, '{{')
""")
def queue_split(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    msgs = ev.select(
        "event_id",
        F.when(F.col("event_type").isin("error", "view"), F.lit("cancel")).otherwise(F.lit("submit")).alias("routing_key"),
        F.when(F.col("event_type") == "error",
               F.concat(F.lit('{"target_job_id":"ev-'), F.col("event_id").cast("string"), F.lit('"}')))
        .when(F.col("event_type") == "view", F.lit("not json {"))
        .when(F.col("value") > 200, F.lit("not json"))
        .otherwise(F.col("props")).alias("body"))
    subs, cancels = split_queue(msgs, "submit", "cancel")
    return subs.select("event_id", F.lit("submit").alias("kind"), "payload",
                       F.lit(None).cast("string").alias("target_job_id")).unionByName(
        cancels.select("event_id", F.lit("cancel").alias("kind"), F.lit(None).cast("string").alias("payload"),
                       "target_job_id"))
