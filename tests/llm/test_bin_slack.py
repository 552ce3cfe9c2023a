import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobframe.llm import bin_slack
from tests.llm.helpers import ODD, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [*ODD, "<|endoftext|> hi <|endoftext|>", "It's the dog's; THE END...", "tab\tnew\r\n  line\x0b \x85z   ",
         "日本語 テキスト £5 don't 1234", "the " * 9000, "a" * 5000, "😀 é́ ẛ̣"]


def reachable(counts, room):
    """Sums of choices from ``counts`` up to ``room``, by trying all of them."""
    ways = product(*(range(min(n, room // x if x else 0) + 1) for x, n in counts.items()))
    return max(t for w in ways if (t := sum(k * x for k, x in zip(w, counts))) <= room)


def test_fullest_against_all_choices():
    rng = random.Random(3)
    for _ in range(300):
        room = rng.randrange(0, 40)
        counts = {rng.randrange(1, 25): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        got = bin_slack.fullest(counts, room)
        assert all(0 < k <= counts[x] for x, k in got.items())
        assert sum(x * k for x, k in got.items()) == reachable(counts, room)


def unrolled(rows):
    """(length, number) -> (sequence, offset) of a plan."""
    out = {}
    for length, first, last, each, sequence, offset in rows:
        for n in range(first, last + 1):
            turn, slot = divmod(n - first, each)
            assert (length, n) not in out
            out[length, n] = (sequence + turn, offset + slot * length)
    return out


def test_plan_uses_each_piece_once_and_fills_each_bin():
    rng = random.Random(5)
    for window in (7, 16, 50):
        for _ in range(60):
            counts = {x: rng.randrange(1, 9) for x in rng.sample(range(1, window + 1), rng.randrange(1, 7))}
            at = unrolled(bin_slack.plan(counts, window))
            assert set(at) == {(x, i) for x, n in counts.items() for i in range(n)}
            bins = {}
            for (x, _), (s, o) in at.items():
                bins.setdefault(s, []).append((o, x))
            assert sorted(bins) == list(range(len(bins)))
            left = dict(counts)
            for s in sorted(bins):
                end = 0
                for o, x in sorted(bins[s]):
                    assert o == end
                    end += x
                longest = max(x for x, n in left.items() if n)
                assert longest in [x for _, x in bins[s]]  # the bin's seed, and with it the fullest choice
                rest = {x: n - (x == longest) for x, n in left.items() if n - (x == longest) > 0}
                assert end == longest + reachable(rest, window - longest) <= window
                for _, x in bins[s]:
                    left[x] -= 1
            assert not any(left.values())


def test_plan_does_not_grow_with_the_counts():
    counts = {x: 10**9 + (2048 - x) * 7919 for x in range(1, 2049)}  # more short pieces than long ones
    rows = bin_slack.plan(counts, 2048)
    total = sum(x * n for x, n in counts.items())
    bins = max(r[4] + (r[2] - r[1] + 1) // r[3] for r in rows)
    assert len(rows) < 20_000 and bins - -(-total // 2048) <= 1


def check(rows, texts, ids, window):
    tok = Tokenizer.from_file(PATH)
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    assert set(by) == set(ids)
    for i, t in zip(ids, texts):
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by[i], key=lambda r: r["start"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["length"] for r in own] == bin_slack.cuts(len(want), window)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(want[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    for own in bins.values():
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= window
    return len(bins)


def test_pieces_match_the_tokenizer_over_partitions(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices("the of and to in".split(), k=rng.randrange(1, 60))) for _ in range(400)]
    ids = list(range(len(texts)))
    ids[2] = None
    df = documents(spark, texts, ids, extra="part length nth first n ids piece").repartition(5)
    n = check(bin_slack.pack(df, PATH, window=64, keep_ids=False).collect(), texts, ids, 64)
    tok = Tokenizer.from_file(PATH)
    lengths = [k for t in texts for k in bin_slack.cuts(len(tok.encode(t or "", add_special_tokens=False).ids) + 1, 64)]
    least = max(-(-sum(lengths) // 64), sum(k > 32 for k in lengths))  # two pieces over half a window never share one
    assert n <= least * 1.02 + 1
    check(bin_slack.pack(df, PATH, keep_ids=False).collect(), texts, ids, 2048)


def test_sequences_hold_the_ids(spark):
    packed = bin_slack.pack(documents(spark, TEXTS), PATH, window=128)
    rows = {(r["sequence_id"], r["offset"]): r["ids"] for r in packed.collect()}
    seqs = {r["sequence_id"]: r["ids"] for r in bin_slack.sequences(packed).collect()}
    for (s, o), ids in rows.items():
        assert seqs[s][o:o + len(ids)] == ids
    assert sum(map(len, seqs.values())) == sum(map(len, rows.values()))


def test_repeated_rows_empty_table_and_window(spark):
    df = documents(spark, ["a b", "a b"], [1, 1])
    rows = bin_slack.pack(df, PATH, keep_ids=False).collect()
    assert len(rows) == 2 and len({r["sequence_id"] for r in rows}) == 1 and len({r["offset"] for r in rows}) == 2
    assert bin_slack.pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bin_slack.pack(df, PATH, window=1 << 20)


def test_very_long_runs_fall_back(spark):
    tok = Tokenizer.from_file(PATH)
    encode = bin_slack.ByteEncoder(open(PATH, encoding="utf-8").read())
    assert encode.fast is not None
    for text in (" " * 300_000 + "x", "\n" * 100_000, "ab" * 50_000):
        assert encode(text) == tok.encode(text, add_special_tokens=False).ids
