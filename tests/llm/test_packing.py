import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobframe.llm import packing
from tests.llm.helpers import ODD, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [*ODD, "It's the dog's; THE END...", "á ẛ̣ ΑΣ ΑΣΑ", "x\x1cy\x85z w", "<|endoftext|> hi",
         "tab\tnew\r\nline\x0bv\x0cf", "日本語 テキスト", "the " * 9000, "don't 'll 're 1234 £5"]


def test_pieces_match_the_tokenizer(spark):
    ids = list(range(len(TEXTS)))
    ids[2] = None
    df = documents(spark, TEXTS, ids, extra="start length ids")
    rows = packing.pack(df, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(ids)
    for i, t in zip(ids, TEXTS):
        want = tok.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by[i], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == want
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(want) and len(r["ids"]) == r["length"]
            assert r["length"] <= 4096 and r["length"] & (r["length"] - 1) == 0 and r["bucket"] == r["length"].bit_length() - 1
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
        rest = [r["length"] for r in own if r["length"] < 4096]
        assert len(rest) == len(set(rest))  # binary digits
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}


def test_repeated_rows_and_empty_table(spark):
    df = documents(spark, ["a b", "a b"], [1, 1])
    rows = packing.pack(df, PATH, keep_ids=False).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) == 4
    assert packing.pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, PATH, window=1000)


def test_buckets_hold_one_length(spark, tmp_path):
    packing.write_buckets(packing.pack(documents(spark, TEXTS[3:5]), PATH), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("length <> pow(2, bucket)").count() == 0 and back.count() > 0


def test_piece_lengths():
    for n in list(range(1, 300)) + [4095, 4096, 4097, 12288, 20001]:
        p = packing.piece_lengths(n, 4096)
        assert sum(p) == n and len(p) == n // 4096 + bin(n % 4096).count("1")
