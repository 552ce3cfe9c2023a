"""The pipeline's stages, each on its own input, against plain versions or the operators' decisions."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from jobframe.llm import quality, toxicity
from jobframe.llm.common import read
from tests.llm.helpers import alnum
from tests.llm.test_decontam import plain as hits
from tests.llm.test_simhash import groups
from tests.llm.test_simhash import plain as simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, as rows."""
    docs, out = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash", "decontamination", "packing"]
    assert all(after.columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, after in stages[:-1])


@pytest.mark.parametrize("k, rate, keeps", [(0, quality.rate, lambda r: r["keep"]), (1, toxicity.rate, lambda r: not r["predicted"])])
def test_rejected_documents_go(spark, stages, k, rate, keeps):
    before, after = stages[k]
    want = sorted(r["doc_id"] for r in rate(before, read(spark, SF, "labels")).collect() if keeps(r))
    assert sorted(r["doc_id"] for r in after.collect()) == want
    assert 0 < len(want) < before.count() + k  # so few labels may mark no toxic document


def test_one_document_of_each_group_stays(stages):
    before, after = stages[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    lab = groups([simhash(t) for _, t in rows], [i for i, _ in rows], 4)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(lab))


def test_benchmark_passages_go(spark, stages):
    before, after = stages[3]
    items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    new = {r["doc_id"]: r for r in after.collect()}
    assert set(old) == set(new)
    for i, t in old.items():
        cut = hits([t], items)[0][3]
        if cut:
            assert alnum(new[i]["text"]) == [w for k, w in enumerate(alnum(t)) if k not in cut]
        else:
            assert new[i]["text"] == t
        assert new[i]["n_chars"] == len(new[i]["text"])


def test_packed_ids(spark, stages):
    before, after = stages[4]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in before.collect()}
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    key = lambda rs: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert key(E.queries()["pipeline"](spark, SF).collect()) == key(rows)


def test_packed_rows_hold_their_ids_by_bucket(spark, stages):
    before, after = stages[4]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in before.collect()}
    for r in after.collect():
        assert r["ids"] == ids[r["doc_id"]][r["start"]:r["start"] + r["length"]] and r["length"] == 1 << r["bucket"]
    out = E.queries()["pipeline"](spark, SF)
    files = {f.split("/bucket=")[0] for f in out.inputFiles()}
    assert len(files) == 1 and all("/bucket=" in f for f in out.inputFiles())
    none = corpus_pipeline.packing_stage(spark, before.limit(0), SF)
    assert none.count() == 0 and none.columns == after.columns
