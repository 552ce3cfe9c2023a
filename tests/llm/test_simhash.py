import random

import numpy as np
import xxhash

from jobframe.llm import components, simhash
from tests.llm.helpers import ODD, blank, documents


def plain(text, k=4):
    w = blank(text)
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, ids, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            out[find(i)] = min(out.get(find(i), ids[i]), ids[i])
    return [out.get(find(i)) for i in range(len(fps))]


def texts():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    out = []
    for _ in range(40):
        w = [r.choice(vocab) for _ in range(r.randint(60, 160))]
        out.append(" ".join(w))
        for _ in range(r.randint(0, 3)):
            c = w[:]
            c[r.randrange(len(c))] = r.choice(vocab)
            out.append(" ".join(c))
    return out + [t and t[:2000] for t in ODD]


def test_fingerprints_and_groups_match_brute_force(spark):
    t = texts()
    ids = [3 * i + 1 for i in range(len(t))]
    ids[5] = None
    df = documents(spark, t, ids, extra="fp component key a b")
    rows = {(r["doc_id"], r["text_hash"]): r for r in simhash.near_duplicates(df).collect()}
    fps = [plain(x) for x in t]
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(t) and len(rows) == len(t)
    want = dict(zip(ids, zip(fps, groups(fps, ids, 4))))
    for r in got:
        fp, comp = want[r["doc_id"]]
        assert r["fp"] & (2**64 - 1) == fp
        assert r["component_id"] == comp
    assert len({c for _, c in want.values()}) < len(t) - 8  # the fixture has groups


def test_links_span_components_with_small_chunks(spark):
    r = np.random.RandomState(3)
    centre = r.randint(0, 2**62, size=12)
    vals = list(centre)
    for c in centre[:3]:
        v = int(c)
        for _ in range(60):  # chains: each value is close to the one before it
            v ^= 1 << int(r.randint(0, 63))
            vals.append(v)
    vals = sorted({int(v) for v in vals})
    df = spark.createDataFrame([(v,) for v in vals], "fp bigint")
    for chunk in (4, 2048):
        links = simhash.hamming_links(df, 4, 6, chunk)
        assert all(bin(x["a"] ^ x["b"]).count("1") <= 4 for x in links.collect())
        comp = {x["node"]: x["component"] for x in components.connected_components(links).collect()}
        lab = groups(vals, vals, 4)
        assert {v: comp.get(v, v) for v in vals} == dict(zip(vals, lab))


def test_components_of_long_chain_star_and_nothing(spark):
    e = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in
           components.connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(300)}}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keep_one_of_each_group(spark):
    t = texts()
    ids = [i + 1 for i in range(len(t))]
    df = documents(spark, t + [t[0], "other text with null id", None], ids + [1, None, None], extra="_id fp")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    fps = [plain(x) for x in t]
    lab = groups(fps, ids, 4)
    assert sorted(x for x in (r["doc_id"] for r in kept.collect()) if x) == sorted(set(lab))
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == ["other text with null id"]
    assert simhash.keep_one(df.limit(0)).count() == 0
