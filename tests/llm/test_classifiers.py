import pytest
from pyspark.sql import functions as F

from jobframe.llm import quality, toxicity, training
from tests.llm.helpers import ODD, documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def shares(rated, labels, column, predicted):
    rows = rated.join(labels, "doc_id").where(training.held_out(F.col("doc_id"))).select(column, predicted).collect()
    hit = [r[1] for r in rows if r[0] == 1]
    miss = [r[1] for r in rows if r[0] == 0]
    return sum(hit) / len(hit), sum(miss) / len(miss)


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    rated = quality.rate(docs, labels).cache()
    good, bad = shares(rated.withColumn("p", F.col("keep").cast("int")), labels, "quality", "p")
    assert good > 0.95 and bad < 0.25
    assert rated.count() == docs.count() and rated.where("score < 0 or score > 1 or keep is null").count() == 0


def test_toxicity_on_held_out_documents(tables):
    docs, labels = tables
    rated = toxicity.rate(docs, labels).cache()
    toxic, clean = shares(rated, labels, "toxic", "predicted")
    assert toxic > 0.6 and clean < 0.03
    assert rated.count() == docs.count()
    assert rated.where("(score >= 0.5) <> (predicted = 1) or score < 0 or score > 1").count() == 0


def test_held_out_rule(spark):
    import zlib

    got = spark.range(50).select("id", training.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_labels_of_held_out_rows_are_never_read(tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(training.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (dict(toxicity.rate(docs, x).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert one == two


@pytest.mark.parametrize("rate, keep", [(quality.rate, quality.keep_good), (toxicity.rate, toxicity.keep_clean)])
def test_odd_rows(spark, tables, rate, keep):
    real, labels = tables
    docs = real.limit(300).unionByName(documents(spark, [*ODD, "s t u p i d trash"], [10**9 + k for k in range(len(ODD))] + [None]))
    docs = docs.withColumn("logit", F.lit(1)).withColumn("score", F.lit("x")).withColumn("path", F.lit(None).cast("int"))
    rows = rate(docs, labels).collect()
    assert len(rows) == 300 + len(ODD) + 1
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = keep(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["keep"] if "keep" in r else 1 - r["predicted"] for r in rows)
    assert rate(docs.limit(0), labels).count() == 0
    assert rate(docs, labels.limit(0)).count() == len(rows)
    odd_labels = labels.limit(5).select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    assert rate(docs, odd_labels).count() == len(rows)


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("a", "a/x", 3.0)] * 200 + [("a", "a/y", -3.0)] * 100 + [("a", "a/z", -3.0)] + [("b", "b/x", -3.0)] * 200
    rows += [("c", "c/x", 3.0)] * 50 + [("d", "d/x", -3.0)]
    got = {r["path"]: r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, logit double")).collect()}
    assert got["a/x"]["path_score"] > got["a"  "/z"]["path_score"] > got["a/y"]["path_score"]
    assert got["b/x"]["path_score"] < got["d/x"]["path_score"] < got["c/x"]["path_score"]
    assert got["b/x"]["prior_logit"] < 0 < got["c/x"]["prior_logit"]


def test_host_and_path(spark):
    t = spark.createDataFrame([("https://a.org/b/c?x", "en"), ("src1", "fr"), (None, None), ("a.org/b", "en")], "source string, lang string")
    got = [tuple(r) for r in t.select(quality.host(), quality.path()).collect()]
    assert got == [("a.org", "a.org/b"), ("src1", "src1/fr"), ("", "/"), ("a.org", "a.org/b")]


def words_model(words, times=50):
    text = " ".join(words * times).lower()
    codes = [toxicity.letter_class(c) for c in f" {text} "]
    counts = {}
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        counts[a * 784 + b * 28 + c] = counts.get(a * 784 + b * 28 + c, 0) + 1
    return toxicity.CharModel(counts.items())


def test_restoring_words():
    m = words_model("stupid trash idiot moron scum hello book all that it is a".split())
    r = toxicity.Restorer(m)
    for seen, want in {"stup1d": "stupid", "$tupid": "stupid", "tr4sh": "trash", "idiooot": "idiot", "m.o.r.o.n": "moron",
                       "s-t-u-p-i-d": "stupid", "trash!!!": "trash", "scum***": "scum", "\"hello,\"": "hello",
                       "ѕtuріd": "stupid", "сум": "сум", "book": "book", "all": "all", "": "", "!!!": "", "é": "é"}.items():
        assert r.word(seen) == want, seen
    assert "stupid" in r("a S T U P I D one") and "trash" in r("t r a s h.") and r(None) == []


def test_viterbi_is_the_best_path():
    from itertools import product

    m = words_model("stall tall still all sit".split())
    for word in ("5t@ll", "stt1l", "s.i.t", "a77"):
        best = m.restore(word)
        options = []
        for k, ch in enumerate(word):
            o = [(x, toxicity.LOOK_COST) for x in toxicity.LOOKS.get(ch, "")] + ([("", toxicity.MARK_COST)] if not ch.isalpha() else [])
            if ch.isalpha():
                o = [(ch, 0.0)] + ([("", toxicity.REPEAT_COST)] if k and word[k - 1] == ch else [])
            options.append(o)
        cost = {}
        for path in product(*options):
            s, price = "".join(c for c, _ in path), sum(p for _, p in path)
            c = [0, 0, *map(toxicity.letter_class, s), 0]
            total = price + sum(m.cost[x][y][z] for x, y, z in zip(c, c[1:], c[2:]))
            cost[s] = min(total, cost.get(s, 1e9))
        assert cost[best] == pytest.approx(min(cost.values()))


def test_trigram_counts_cover_all_texts(spark):
    docs = documents(spark, ["Ab, ab", None, "", "é1z"])
    got = {r["code"]: r["n"] for r in toxicity.count_trigrams(docs).collect()}
    code = lambda s: [toxicity.letter_class(c) for c in s]
    key = lambda s: code(s)[0] * 784 + code(s)[1] * 28 + code(s)[2]
    assert got[key(" ab")] == 2 and got[key("ab ")] == 2 and got[key(" e ")] == 1 and got[key(" z ")] == 1
