"""Quality classifier with hierarchical empirical Bayes.

A logistic model of text statistics gives each document's evidence. Grouped aggregates of it give every host and
every path below a host a posterior share of good documents: a path shrinks towards its host, a host towards the
corpus, by prior strengths that are estimated from the spread of the groups themselves. A document's final odds are
its own evidence times how much its path's posterior differs from the corpus's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobframe.llm.common import cut, give_back, maybe_broadcast
from jobframe.llm.training import SAMPLE_ROWS, fit_logistic, labelled_sample

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_ORDINARY = b".,;:!?'\"()-"
N_FEATURES = 17


def features(text: bytes | None) -> list[float]:
    """Statistics of a whole text, of any length; a null or wordless text has the values of an empty one."""
    from math import log

    words = text.split() if text else []
    if not words:
        return [1.0] + [0.0] * (N_FEATURES - 1)
    n, size = len(words), sum(map(len, words))
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    marks, ordinary = share(_MARKS), share(_ORDINARY)
    upper, digits = share(_UPPER), share(_DIGITS)
    lower = text.lower().split()
    distinct = len(set(lower))
    same = sum(map(bytes.__eq__, lower, lower[1:])) / n
    ended = [w[-1] in _MARKS for w in words]
    lines = text.split(b"\n")
    alone = sum(len(w) == 1 and w in _MARKS for w in words) / n
    return [
        0.0, log(n) / 10, size / n / 10, marks, marks - ordinary, float(marks - ordinary > 0.05), upper,
        float(upper > 0.3), digits, distinct / n, (log(distinct) - log(n) * 0.8) / 10, same, float(same > 0.1),
        sum(ended) / n, float(sum(ended) / n > 0.5), len(set(lines)) / len(lines), alone,
    ]


class QualityModel:
    """Standardized features, logistic weights; ``logit`` is the evidence for a good document."""

    def __init__(self, x, y):
        import numpy as np

        x, y = np.array(x, dtype=float).reshape(-1, N_FEATURES), np.array(y, dtype=float)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
        spread = x.std(axis=0) if len(x) else np.ones(N_FEATURES)
        self.spread = np.where(spread > 1e-9, spread, 1.0)
        self.weights = fit_logistic((x - self.mean) / self.spread, y)

    def logit(self, text: bytes | None) -> float:
        import numpy as np

        z = (np.array(features(text)) - self.mean) / self.spread
        return float(np.clip(np.clip(z, -8, 8) @ self.weights[:-1] + self.weights[-1], -30, 30))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on at most ``sample_rows`` labelled documents (labels.quality 0 or 1; the same rows are held out as for
    toxicity). Without labels the evidence is 0 for every document."""

    def run(batches):
        for b in batches:
            rows = [features(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("label")], ["x", "label"])

    sample = labelled_sample(docs, labels, "quality", sample_rows)
    rows = sorted(tuple(r) for r in sample.mapInArrow(run, "x array<double>, label int").collect())  # sample_rows
    return QualityModel([x for x, _ in rows], [y for _, y in rows])


def evidence(model: QualityModel, text):
    """Column: the model's logit of a text column."""
    @F.arrow_udf("double")
    def logit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([model.logit(t) for t in texts.cast(pa.binary()).to_pylist()], pa.float64())
        give_back()

    return logit(text.cast("string"))


def host(source="source"):
    """Column: what stands before the first slash of an address or source name, without a scheme; empty for null."""
    return F.coalesce(F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1), F.lit(""))


def path(source="source", section="lang"):
    """Column: the host and the first step below it; a source without one has its section (language) there."""
    step = F.coalesce(F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*/([^/?#]+)", 1), F.lit(""))
    return F.concat_ws("/", host(source), F.when(step != "", step).otherwise(F.coalesce(F.col(section), F.lit(""))))


def _strength(groups: DataFrame, share: str, n: str, mean, least: float, most: float) -> float:
    """Prior strength (as a number of documents) by the method of moments: the spread of the groups' shares around
    their prior mean beyond what their sizes explain. ``least`` and ``most`` bound it."""
    big = groups.where(F.col(n) >= 2)
    r = big.agg(F.count("*").alias("k"), F.avg(F.pow(F.col(share) - mean, 2)).alias("v"),
                F.avg(mean * (1 - mean)).alias("b"), F.avg(mean * (1 - mean) / F.col(n)).alias("e")).first()
    if not r["k"] or not r["b"]:
        return most
    between = r["v"] - r["e"]
    return most if between <= 0 else min(most, max(least, r["b"] / between - 1))


def site_posteriors(scored: DataFrame, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """(path, host, host_score, path_score, prior_logit) from ``scored`` (host, path, logit): posterior means of the
    shares of good documents. Every document counts with its probability; sums are made before any shuffle, so a
    site with a third of all documents is one row a task."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    overall = min(max((total["s"] + 1) / (total["n"] + 2), 1e-4), 1 - 1e-4) if total["n"] else 0.5
    hosts = hosts.withColumn("share", F.col("host_s") / F.col("host_n"))
    k_host = _strength(hosts, "share", "host_n", F.lit(overall), least, most)
    hosts = hosts.select("host", ((F.col("host_s") + k_host * overall) / (F.col("host_n") + k_host)).alias("host_score"))
    joined = paths.join(hosts, "host").withColumn("share", F.col("s") / F.col("n"))
    k_path = _strength(joined, "share", "n", F.col("host_score"), least, most)
    score = (F.col("s") + k_path * F.col("host_score")) / (F.col("n") + k_path)
    logit = lambda q: F.log(q / (1 - q))
    bounded = F.least(F.greatest(score, F.lit(1e-4)), F.lit(1 - 1e-4))
    return joined.select("path", "host", "host_score", score.alias("path_score"),
                         (logit(bounded) - logit(F.lit(overall))).alias("prior_logit"))


def _rated(scored: DataFrame, sites: DataFrame, threshold: float) -> DataFrame:
    known = maybe_broadcast(cut(sites.drop("host")))
    out = scored.join(known, "path", "left")
    score = 1 / (1 + F.exp(-(F.col("logit") + F.coalesce("prior_logit", F.lit(0.0)))))
    return out.withColumn("score", score).withColumn("keep", F.col("score") >= threshold)


def rate(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, host, path, doc_score (the text's own probability), host_score,
    path_score (posterior shares of the site), score (0 to 1, of both) and keep (score >= ``threshold``).

    Null sources and languages count as empty ones; a null or wordless text has the statistics of an empty text;
    repeated rows each get a row; extra columns are ignored; an empty table gives no rows."""
    model = fit(docs, labels, sample_rows)
    scored = cut(docs.select("doc_id", host().alias("host"), path().alias("path"),
                             evidence(model, F.col("text")).alias("logit")))
    out = _rated(scored, site_posteriors(scored), threshold)
    return out.select("doc_id", "host", "path", (1 / (1 + F.exp(-F.col("logit")))).alias("doc_score"), "host_score",
                      "path_score", "score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that :func:`rate` rejects; the same columns. Texts are read a second time rather
    than shuffled: only the sites' posteriors are joined."""
    model = fit(docs, labels, sample_rows)
    columns = [F.col(f"_doc.{c}").alias(c) for c in docs.columns]
    held = docs.select(F.struct(*docs.columns).alias("_doc"), host().alias("host"), path().alias("path"),
                       evidence(model, F.col("text")).alias("logit"))
    sites = site_posteriors(held.select("host", "path", "logit"))
    return _rated(held, sites, threshold).where("keep").select(*columns)
