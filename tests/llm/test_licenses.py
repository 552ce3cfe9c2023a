import random

from jobframe.llm import licenses
from tests.llm.helpers import ODD, alnum, documents


def base_places(text):
    w = alnum(text)
    out = []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), out


def fixture():
    r = random.Random(4)
    out = [t and t[:5000] for t in ODD]
    parts = [p for _, p in licenses.PHRASES] + ["Under THE MIT-License", "apache license, version 20", "cc by nc nd",
             "under the mit", "license version 2", "Apache License, Version 2.0", "cc by cc by nc by nc"]
    for _ in range(60):
        out.append(" ".join(r.choice(["x", "the", "mit", "under", "license"]) + " " + r.choice([*parts, "y", "z"])
                            for _ in range(r.randint(0, 8))))
    return out


def test_base_places_match_brute_force(spark):
    texts = fixture()
    rows = licenses.scan(documents(spark, texts, extra="label template pos at n g0 t0 w")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, places = base_places(texts[r["doc_id"]])
        starts = [i for i, _ in places]
        assert r["n_words"] == n and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (not places or r["score"] == 1)


def test_notices_may_be_changed_a_little(spark):
    notice = dict((label, text) for label, text in licenses.NOTICES if label in ("bsd", "mit", "gpl"))
    w = notice["mit"].split()
    dropped = " ".join(w[:8] + w[9:])
    added = " ".join(w[:10] + ["and", "free"] + w[10:])
    half = " ".join(w[:9])
    far = " ".join(w[:9]) + " z" * 200 + " " + " ".join(w[9:])
    texts = [notice["bsd"].upper(), dropped, added, half, far, notice["gpl"] + " " + notice["bsd"], "clean text " * 50]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(7)] == ["bsd", "mit", "mit", "", "", "bsd,gpl", ""]
    assert got[6]["score"] == 0 and 0 < got[3]["score"] < 0.5 < got[1]["score"]
    (span,) = got[0]["spans"]
    assert (span["first"], span["last"]) == (0, len(notice["bsd"].split()) - 1)


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = ["cc by nc", "cc by nc", "cc by nc", None, None, ""]
    df = documents(spark, t, [1, 1, None, None, None, 2])
    rows = sorted((str(r["doc_id"]), r["n_base"], r["n_words"]) for r in licenses.scan(df).collect())
    assert rows == [("1", 1, 3), ("1", 1, 3), ("2", 0, 0), ("None", 0, 0), ("None", 0, 0), ("None", 1, 3)]
    assert licenses.scan(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = licenses.scan(documents(spark, ["a"]).select("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
