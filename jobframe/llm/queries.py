"""Thin registered queries of this subpackage: each applies one operator, with production parameters, to its whole
table and derives the contract's columns from the operator's result. ``ORACLE`` has DuckDB SQL where SQL can
express the result; the other queries are tested against brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobframe.llm import bin_slack, collocation, decontam, html_extract, knn, licenses, packing, quality, simhash, toxicity, warc, whitening, wordpiece
from jobframe.llm.common import read, shared_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


def _licenses_sql() -> str:
    rows = ",\n  ".join(
        f"({t}, '{label}', {str(exact).lower()}, {n_words}, {n_grams}, {at}, '{' '.join(words)}')"
        for t, label, exact, n_words, n_grams, at, *words in licenses.template_rows())
    return rf"""
WITH t(template, label, exact, t_words, t_grams, place, g) AS (VALUES
  {rows}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
grams AS (
  SELECT r, i, array_to_string(w[i + 1:i + 3], ' ') AS g
  FROM (SELECT r, w, unnest(range(0, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
per AS (
  SELECT r, template, label, exact, t_words, t_grams, i - place AS diagonal, list(DISTINCT place) AS ats
  FROM grams JOIN t USING (g) GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal)
                      <= CASE WHEN exact THEN 0 ELSE {licenses.NEAR} END THEN 0 ELSE 1 END AS cut
  FROM per),
clustered AS (
  SELECT *, sum(cut) OVER (PARTITION BY r, template ORDER BY diagonal) AS cluster FROM marked),
merged AS (
  SELECT r, template, label, exact, t_words, t_grams, len(list_distinct(flatten(list(ats)))) AS votes,
         min(diagonal + list_min(ats)) AS first, max(diagonal + list_max(ats) + 2) AS last
  FROM clustered GROUP BY r, template, label, exact, t_words, t_grams, cluster),
found AS (
  SELECT *, votes / t_grams AS share,
         CASE WHEN exact THEN votes = t_grams
              ELSE votes / t_grams >= {licenses.COVER} AND last - first + 1 <= t_words + {licenses.SLACK} END AS ok
  FROM merged),
each AS (
  SELECT r, count(*) FILTER (ok AND exact) AS n_base, min(first) FILTER (ok AND exact) AS first_word,
         max(first) FILTER (ok AND exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok AND exact) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok) AS labels,
         max(share) FILTER (ok) AS sure, max(share) FILTER (NOT ok) AS weak
  FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       least(1.0::DOUBLE, coalesce(sure, weak * 0.5::DOUBLE, 0.0::DOUBLE)) AS score
FROM d LEFT JOIN each USING (r)
"""


ORACLE["op3_licenses"] = _licenses_sql()


@_query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


@_query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


#: Windows are lists of words; a window occurs where a document holds the same words in a row. Word i of a document
#: is hit if an occurrence starts at most (its length - 1) words before it.
ORACLE["op7_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
grams AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
found AS (SELECT r, i, p.n, item_id FROM grams JOIN p ON grams.phrase = p.phrase AND grams.n = p.n),
hit AS (
  SELECT r, count(DISTINCT pos) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM found) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         sha256(array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',')) AS sha
  FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@_query
def op8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


ORACLE["op8_knn"] = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (
  SELECT r, vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
  FROM e),
s AS (
  SELECT q.vec_id AS query_id, c.r, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.i = c.i AND q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
  GROUP BY q.vec_id, c.r, c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@_query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = wordpiece.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return wordpiece.token_counts(read(spark, sf_dir, "documents"), pieces)


@_query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    folder = shared_folder(spark, "warc")
    warc.write_archives(pages, folder, min_bytes=0)
    kind = pages.schema["page_id"].dataType
    found = warc.read_archives(spark, folder, payloads=False)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast(kind).alias("refers_to"))


#: base32: each 5 hex digits (20 bits) of the SHA-1 give 4 characters.
ORACLE["op10_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(body) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31), 1)), '')
           AS payload_digest,
         min(page_id) OVER (PARTITION BY body) AS first_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


@_query
def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read(spark, sf_dir, "embeddings"), k=8, scale=1024.0, shift=100_000)
    each = found.select("vec_id", "n", "deviation", "identity_error",
                        F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation",
                       F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(read(spark, sf_dir, "documents"), max_words=3, min_count=10, top=2000)


ORACLE["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?' || chr(10) || chr(11) || chr(12) || chr(13),
           'abcdefghijklmnopqrstuvwxyz.........'), '.')) AS piece
  FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, lang || chr(9) || phrase AS key, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS MATERIALIZED (
  SELECT c.lang, c.phrase, a, j, l.f AS l, r.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c
  JOIN f AS l ON l.key = c.lang || chr(9) || array_to_string(c.w[1:j], ' ')
  JOIN f AS r ON r.key = c.lang || chr(9) || array_to_string(c.w[j + 1:c.k], ' ')),
best AS MATERIALIZED (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS MATERIALIZED (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3)
  GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best AS b JOIN total USING (lang) LEFT JOIN inside AS i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""
