"""Files read by byte ranges: the same records wherever a file is cut."""

import csv
import io
import json
import random

import pytest

from jobframe.sources import ranges
from jobframe.sources.files import read_csv, read_json_array, read_jsonl

ARRAYS = [
    '[]', ' [ \n ] ', '[1]', '[1,2,3]', '["a,b","]","[","\\"","\\\\",",\\",["]', '[[1,[2,{"a":[3,4]}]],{"k":"x,y"}]',
    '[\n {"id": "x", "n": [1, 2]},\n null, true, "é,日本" ]\n', '[{"a":"' + "p," * 40 + '"},2]', '[[],[[]],{}]',
]
OTHERS = [' ', '{}', '1', '[1', '1]', '[1]]', '[1],', '[1] 2', '[1][2]', '[1}', '{"a":[1,2]}', '"[1,2]"', '["a', ',[1]', '[[1]', 'x[1]']


def tables(n=40):
    rng = random.Random(7)
    cells = ["a", "", "b c", '"q"', '"x,y"', '"l\nm"', '"d""e"', '"\n\n"', 'u"v', '"w"z', "é", '"r\r\ns"', '""']
    out = ["h,i\n1,2\n", "h\r1\r2\r", "h,i\r\n\r\n1,2\r\n\n3", "\n\nh,h\n1,2\n", '"h\nk",i\n1,2\n"open', 'a,"b\rc"\rd,"e\n', "", "\n",
           'a\nb\r"c\nd"\re,f\n', 'x,y\n"1\n"\r"2\n",3\n', "only,head"]
    for _ in range(n):
        end = rng.choice(["\n", "\r\n"])
        rows = [",".join(rng.choice(cells) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 7))]
        out.append(end.join(rows) + rng.choice(["", end]))
    return out


@pytest.fixture
def small_ranges(spark):
    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset("spark.sql.files." + k)


def write(folder, texts, ext):
    folder.mkdir()
    for i, t in enumerate(texts):
        (folder / f"f{i:03d}.{ext}").write_bytes(t.encode())
    return str(folder)


def number(file):
    return int(file.rsplit("/f", 1)[1][:3])


def csv_rows(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return [(i, json.dumps(dict(zip(rows[0], r)), ensure_ascii=False, separators=(",", ":")) if len(r) == len(rows[0]) else None,
             None if len(r) == len(rows[0]) else ",".join(r)) for i, r in enumerate(rows) if i]


@pytest.mark.parametrize("size", [16, 1000])
def test_arrays_cut_by_spark(spark, tmp_path, small_ranges, size):
    small_ranges(size)
    path = write(tmp_path / "j", ARRAYS + OTHERS, "json")
    elements, others = ranges.json_elements(spark, path, "*.json", False)
    got = {}
    for r in elements.collect():
        got.setdefault(number(r["file"]), []).append((r["ordinal"], json.loads(r["text"])))
    for i, t in enumerate(ARRAYS):
        assert sorted(got.pop(i, []), key=lambda x: x[0]) == list(enumerate(json.loads(t))), t
    assert not got
    assert sorted(number(r["file"]) for r in others.collect()) == [len(ARRAYS) + i for i in range(len(OTHERS))]


@pytest.mark.parametrize("size", [24, 1000])
def test_csv_cut_by_spark(spark, tmp_path, small_ranges, size):
    small_ranges(size)
    texts = tables(10)
    path = write(tmp_path / "c", texts, "csv")
    got = {}
    for r in ranges.csv_records(spark, path, "*.csv", False).collect():
        got.setdefault(number(r["file"]), []).append((r["ordinal"], r["line"], r["record"]))
    for i, t in enumerate(texts):
        assert sorted(got.pop(i, [])) == csv_rows(t), repr(t)
    assert not got


class Sent:
    def __init__(self, value):
        self.value = value


def cut_in_python(data, sep, size, outline, compose, cut, key):
    """The two passes over ranges of ``size`` bytes, tokens dealt to ranges as the text reader does."""
    import pandas as pd
    import pyarrow as pa

    found, at = {}, 0
    for token in data.removesuffix(sep).split(sep) if data else []:
        found.setdefault(max(at - 1, 0) // size * size, []).append(token)
        at += len(token) + 1
    batches = [pa.RecordBatch.from_arrays([pa.array(["f"] * len(v)), pa.array([b] * len(v), pa.int64()), pa.array(v, pa.binary())],
                                          ["file", "block", "value"]) for b, v in found.items()]
    rows = [r for b in batches for o in outline([b]) for r in o.to_pylist()]
    if not rows:
        return [], []
    states = compose(pd.DataFrame(rows).assign(size=len(data)))
    sent = Sent({("f", r["block"]): key(r) for r in states.to_dict("records") if r.get("ok", True)})
    names = states["head"][0] if "head" in states else None
    lists = [[r for b in batches for o in cut(sent, cross, names)([b]) for r in o.to_pylist()] for cross in (False, True)]
    joined = {}
    for r in sorted(lists[1], key=lambda r: r["block"]):
        joined[r["ordinal"]] = joined.get(r["ordinal"], "") + r["text"]
    return lists[0], sorted(joined.items())


def test_arrays_cut_at_every_place():
    for text in ARRAYS + OTHERS:
        data = text.encode()
        for size in range(1, len(data) + 1):
            whole, joined = cut_in_python(
                data, b",", size, ranges._outline_json, ranges._compose_json, lambda sent, cross, _: ranges._cut_json(sent, cross),
                lambda r: (r["quoted"], r["depth"], r["ordinal"], r["commas"]))
            got = sorted([(r["ordinal"], r["text"]) for r in whole] + joined)
            want = [] if text in OTHERS else list(enumerate(json.loads(text)))
            assert [(i, json.loads(t)) for i, t in got] == want, (text, size)


def test_csv_cut_at_every_place():
    def emit(out, file, ordinal, text):
        for n, record in enumerate(ranges.parse_csv(text), ordinal):
            out.add(file, n, json.dumps(record), None, None)

    for text in tables(60):
        data = text.encode()
        want = [json.dumps(r) for r in csv.reader(io.StringIO(text, newline="")) if r]
        for size in range(1, len(data) + 1):
            whole, joined = cut_in_python(
                data, b"\n", size, ranges._outline_csv, ranges._compose_csv,
                lambda sent, cross, _: ranges._cut_csv(sent, emit, ranges._CROSSING if cross else ranges._CSV_ROW, cross),
                lambda r: (r["quoted"], r["ordinal"], r["open"], r["end"]))
            got = {r["ordinal"]: r["line"] for r in whole}
            for first, piece in joined:
                got |= {n: json.dumps(r) for n, r in enumerate(ranges.parse_csv(piece), first)}
            assert [got[i] for i in sorted(got)] == want and sorted(got) == list(range(len(want))), (text, size)


def test_line_automaton_against_the_csv_reader():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice(['a', '"', '"', ',', '\r', '\n', '\n']) for _ in range(rng.randrange(0, 14)))
        quoted = total = 0
        for line in text.split("\n"):
            quoted, started = ranges.scan_line(line.encode(), bool(quoted))
            total += started
        assert total == len(list(ranges.parse_csv(text))), repr(text)


def test_a_large_file_takes_many_tasks(spark, tmp_path, small_ranges):
    small_ranges(100_000)
    n = 20_000
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"id":"i{k}","p":"x,{"y" * (k % 90)}"}}' for k in range(n)) + "]")
    (tmp_path / "a.csv").write_text("id,p\n" + "".join(f'i{k},"x\n{"y" * (k % 90)}"\n' for k in range(n)))
    for read in (read_json_array, read_csv):
        jobs, bad = read(spark, str(tmp_path), "s")
        assert jobs.rdd.getNumPartitions() > 8
        rows = {r["id"]: json.loads(r["payload"])["p"].replace("\n", ",") for r in jobs.select("id", "payload").collect()}
        assert rows == {f"i{k}": "x," + "y" * (k % 90) for k in range(n)} and bad.count() == 0


def test_unreadable_elements_are_rejected_alone(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"x"}, oops, {"id":"y","f":[1.0E300, 1e300]},, {]]')
    jobs, bad = read_json_array(spark, str(tmp_path), "s")
    assert {r["id"]: r["payload"] for r in jobs.collect()} == {"x": '{"id":"x"}', "y": '{"id":"y","f":[1.0E300,1e300]}'}
    assert sorted((r["record"], r["reason"]) for r in bad.collect()) == [
        (t, "unparsable JSON element") for t in ("", "oops", "{]")]


def test_records_above_the_variant_limit(spark, tmp_path, monkeypatch):
    from jobframe.functions import json as functions
    from jobframe.sources import files

    for module in (functions, files):
        monkeypatch.setattr(module, "VARIANT_BYTES", 1000)
    pad = "p" * 5000
    (tmp_path / "a.jsonl").write_text('{"id":"big","p":"' + pad + '"}\n{"id":"small"}\n{"id":"bad","p":"' + pad + '\n')
    jobs, bad = read_jsonl(spark, str(tmp_path), "s")
    assert sorted(r["id"] for r in jobs.select("id").collect()) == ["big", "small"]
    assert bad.selectExpr("length(record) > 5000 AS long").collect()[0]["long"]
    (tmp_path / "a.json").write_text('[{"id":"one"},{"id":"big","p":"' + pad + '"},2]')
    jobs, bad = read_json_array(spark, str(tmp_path), "s")
    got = {r["id"]: r["n"] for r in jobs.selectExpr("id", "length(payload) AS n").collect()}
    assert got["one"] == 12 and got["big"] == len(pad) + 19 and len(got) == 3 and bad.count() == 0
