import random

import pytest

from jobframe.llm import decontam
from tests.llm.helpers import ODD, alnum, documents


def plain(texts, items, k=10):
    out = []
    for t in texts:
        w = alnum(t)
        hit, found = set(), set()
        for item_id, it in items:
            p = alnum(it)
            for i in range(max(1, len(p) - k + 1) if p else 0):
                q = p[i:i + k]
                for s in range(len(w) - len(q) + 1):
                    if w[s:s + len(q)] == q:
                        hit |= set(range(s, s + len(q)))
                        found |= {str(item_id)} if item_id is not None else set()
        out.append((len(w), len(hit), sorted(found), hit))
    return out


def fixture():
    r = random.Random(11)
    vocab = "aa bb cc dd ee ff gg".split()
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(10, 30)))) for i in range(8)]
    items += [(8, items[0][1].upper()), (9, "zz yy"), (10, None), (11, "..."), (None, "only here nn"), (2, "again 2")]
    docs = []
    for k in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 80))]
        if k % 3 == 0:
            it = r.choice(items[:8])[1].split()
            a = r.randint(0, 5)
            w[3:3] = it[a:a + r.randint(8, 25)]
        if k % 7 == 0:
            w += ["zz", "yy", "zz", "yy", "only", "here", "nn"]
        docs.append(", ".join(w).title())
    return docs + [t and t[:3000] for t in ODD] + ["aa " * 400], items


@pytest.mark.parametrize("shard_words, block_chars", [(250_000, 20_000_000), (200, 20_000_000), (250_000, 150)])
def test_matches_brute_force(spark, shard_words, block_chars):
    docs, items = fixture()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id bigint")
    df = documents(spark, docs, extra="item_id spans items n_words")
    got = decontam.contamination(df, bench, 10, shard_words, block_chars).collect()
    assert len(got) == len(docs)
    for r in got:
        n, h, names, hit = plain([docs[r["doc_id"]]], items)[0]
        assert (r["n_words"], r["n_hit"], list(r["items"])) == (n, h, names)
        assert {x for s in r["spans"] for x in range(s["first"], s["last"] + 1)} == hit


def test_cutting_removes_the_spans_and_only_them(spark):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = documents(spark, docs, extra="item_id spans")
    out = decontam.decontaminate(df, bench)
    assert out.columns == df.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == len(docs)
    for i, (_, _, _, hit) in enumerate(plain(docs, items)):
        if not hit:
            assert rows[i]["text"] == docs[i]
        else:
            assert alnum(rows[i]["text"]) == [w for k, w in enumerate(alnum(docs[i])) if k not in hit]
            assert rows[i]["n_chars"] == len(rows[i]["text"])


def test_cutting_in_several_blocks(spark):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = documents(spark, docs, extra="items spans n_words")
    one, many = (sorted(map(tuple, decontam.decontaminate(df, bench, block_chars=n).collect()), key=str) for n in (10**6, 150))
    assert one == many


def test_empty_tables(spark):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = documents(spark, docs)
    assert decontam.contamination(df.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(df, bench.limit(0)).collect()} == {0}
    assert decontam.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_index_finds_every_place():
    np = pytest.importorskip("numpy")
    r = random.Random(2)
    text = np.array([r.choice([0, 1, 1, 2, 3]) for _ in range(500)] + [0])
    index = decontam.FMIndex(text, 3)
    for n in (1, 2, 4):
        for _ in range(40):
            p = [r.randint(1, 3) for _ in range(n)]
            table = np.array([[0] * (4 - n) + p])
            lo, hi = index.search(table, np.array([n]))
            places = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert places == [i for i in range(len(text)) if text[i:i + n].tolist() == p]
