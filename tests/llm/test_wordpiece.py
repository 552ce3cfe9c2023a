import random

import public_tokenizers

from jobframe.llm import wordpiece
from tests.llm.helpers import ODD, documents


def plain(word, pieces, alphabet):
    n = at = 0
    while at < len(word):
        for end in range(min(len(word), at + 40), at, -1):
            if word[at:end] in pieces:
                n, at = n + 1, end
                break
        else:
            n, at = n + len(word[at].encode()), at + 1
    return n


def test_automaton_is_greedy_longest_match():
    r = random.Random(1)
    for _ in range(200):
        pieces = {"".join(r.choice("abé▁") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 12))}
        auto = wordpiece.Automaton(pieces)
        for _ in range(30):
            w = "".join(r.choice("abé▁x") for _ in range(r.randint(0, 15)))
            assert auto.length(w) == plain(w, pieces, None), (pieces, w)


def test_counts_over_the_public_vocabulary(spark):
    pieces = wordpiece.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    known = set(pieces)
    texts = [*ODD, "unbelievably antidisestablishmentarianism 日本 ☃☃ ▁▁", "x" * 50000]
    rows = wordpiece.token_counts(documents(spark, texts, extra="n_tokens mark"), pieces).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = (texts[r["doc_id"]] or "").encode().split()
        lengths = [plain("▁" + w.decode(), known, None) for w in words[:2000]]
        if len(words) <= 2000:
            assert (r["n_words"], r["n_tokens"], r["max_word_tokens"]) == (len(words), sum(lengths), max(lengths, default=0))
        else:
            assert r["n_words"] == len(words) and r["n_tokens"] == len(words) * lengths[0]


def test_empty_table_and_repeated_rows(spark):
    df = documents(spark, ["a", "a"], [None, None])
    assert [r["n_tokens"] for r in wordpiece.token_counts(df, ["▁a"]).collect()] == [1, 1]
    assert wordpiece.token_counts(df.limit(0), ["a"]).count() == 0
