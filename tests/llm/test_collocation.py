import random
import re
from collections import Counter

import pytest

from jobframe.llm import collocation
from tests.llm.helpers import ODD, lower_az


def table(spark, rows, extra=""):
    names = extra.split()
    schema = "doc_id bigint, text string, lang string" + "".join(f", {n} bigint" for n in names)
    return spark.createDataFrame([(i, t, g) + (3,) * len(names) for i, (t, g) in enumerate(rows)], schema)


def brute(rows, max_words=3, min_count=10, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_az(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    out = []
    for (lang, w), a in cand.items():
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = any(g == lang and len(v) > len(w) and 100 * b >= 50 * a
                     and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (g, v), b in cand.items())
        if not inside:
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, count = [], Counter()
    for r in out:
        count[r[0]] += 1
        if count[r[0]] <= top:
            ranked.append((r[0], count[r[0]], *r[1:]))
    return ranked


def got(df):
    rows = df.collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows)


def corpus(seed=1, docs=150):
    rng = random.Random(seed)
    vocab = ["New", "york", "CITY", "the", "of", "é", "日本", "x\x00y", "a b", "zz\x85", "q\x1cq", *map(str, range(12))]
    rows = [(t, "en") for t in ODD]
    for i in range(docs):
        words = []
        for _ in range(rng.randrange(0, 60)):
            words += rng.choice([["new", "york", "city"], ["the"], [rng.choice(vocab)], ["of", "the"]])
            if rng.random() < 0.1:
                words.append(rng.choice([". ", "!", ",", "\n", "\x0b", "\r\n", ";x", " : "]))
        rows.append((rng.choice([" ", "\t", "  "]).join(words), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows


def test_against_brute_force_over_partitions(spark):
    rows = corpus()
    df = table(spark, rows, extra="n w1 w2 w3 part rank score size").repartition(6)
    for size, least, top in ((3, 10, 2000), (2, 2, 7), (4, 3, 50)):
        assert got(collocation.collocations(df, size, least, top)) == sorted(brute(rows, size, least, top))


def test_small_slabs_and_common_pairs(spark):
    rows = corpus(2, 60) + [(" ".join(f"hot pair w{i % 40}" for i in range(400)), "en")]
    df = table(spark, rows).repartition(3)
    before = collocation.SLAB, collocation.MERGE, collocation.COMMON
    try:
        collocation.SLAB, collocation.MERGE, collocation.COMMON = 2000, 300, 100  # many slabs a task, many merges
        common = collocation._common(df)
        assert "pair" in common["en", "hot"] and ("en", "pair") in common
        assert got(collocation.collocations(df, 3, 4)) == sorted(brute(rows, 3, 4))
        assert got(collocation.collocations(df, 2, 4)) == sorted(brute(rows, 2, 4))
    finally:
        collocation.SLAB, collocation.MERGE, collocation.COMMON = before


def test_phrase_counts_hold_every_frequent_phrase(spark):
    rows = corpus(3, 80)
    found = {(r["lang"], r["phrase"]): r["f"] for r in collocation.phrase_counts(table(spark, rows), 3, 5).collect()}
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_az(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f["und" if lang is None else lang, None] += len(w)
            f.update(("und" if lang is None else lang, " ".join(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert found == {p: n for p, n in f.items() if (p[1] is None and n) or (p[1] is not None and n >= 5)}


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3 * 10**13, 4 * 10**13, 5 * 10**13), (10, 10, 10), (7, 9, 11)], "a bigint, l bigint, r bigint")
    assert [(r["a"], r["score"]) for r in rows.select("a", collocation._score("a", "l", "r")).collect()] == [
        (3 * 10**13, 450_000), (10, 1_000_000), (7, 494_949)]


def test_wide_codes_and_odd_tables(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    cols = [rng.integers(0, 3, 500) for _ in range(4)]
    first, group, n = collocation._sums(cols, [1 << 30] * 4, np.full(500, 2))
    want = Counter(zip(*cols))
    assert {tuple(c[i] for c in cols): k for i, k in zip(first, n)} == {w: 2 * k for w, k in want.items()}
    assert all(tuple(c[first[g]] for c in cols) == tuple(c[i] for c in cols) for i, g in enumerate(group))
    assert got(collocation.collocations(table(spark, []))) == []
    assert got(collocation.collocations(table(spark, [(None, None), ("", "en"), (" .,; ", "de")]))) == []
    with pytest.raises(ValueError):
        collocation.collocations(table(spark, []), max_words=1)
