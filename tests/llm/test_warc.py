import base64
import gzip
import hashlib
import random

from jobframe.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload bigint, refers_to bigint"


def pages():
    r = random.Random(9)
    bodies = ["".join(r.choice("abcdefé<>\n ") for _ in range(r.randint(0, 4000))) for _ in range(40)]
    rows = [(i, f"http://h/{i} é\n", bodies[i % 25], 1, 2) for i in range(60)]
    rows += [(100, None, None, 0, 0), (101, "u", "", 0, 0), (None, "n", bodies[0], 0, 0), (7, rows[7][1], rows[7][2], 1, 2),
             (200, "u", "WARC/1.1\r\n\r\n" + "x" * 10, 0, 0), (201, "u", None, 0, 0)]
    return rows


def expected(rows, least=0):
    first = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and f != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                    "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def read(spark, folder, split):
    got = warc.read_archives(spark, folder, split).collect()
    num = lambda x: None if x is None else int(x)
    return got, sorted([(num(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"],
                         num(r["refers_to"])) for r in got], key=str)


def test_round_trip_with_any_split_size(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least in (0, 1000):
        folder = str(tmp_path / f"a{least}")
        warc.write_archives(df, folder, least)
        for split in (50, 700, 1 << 22):
            got, short = read(spark, folder, split)
            assert short == expected(rows, least)
            for r in got:
                if r["record_type"] == "response":
                    assert warc.digest_of(bytes(r["payload"])) == r["payload_digest"]
    texts = {r["page_id"]: r["payload"] for r in got if r["payload"] is not None}
    assert bytes(texts["3"]).decode() == rows[3][2]


def test_files_are_plain_members(spark, tmp_path):
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "a"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("part-*")))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows) and raw.endswith(b"\r\n\r\n")


def test_other_archives_are_read(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    resp = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: %d\r\n\r\n" % len(body)
            + body + b"\r\n\r\n")
    (tmp_path / "x").mkdir()
    junk = warc.MAGIC + b"not a member" + gzip.compress(b"no record") + warc.EMPTY
    (tmp_path / "x" / "a b.warc.gz").write_bytes(gzip.compress(info) + junk + gzip.compress(resp, 9) + warc.MAGIC)
    (tmp_path / "x" / "empty.warc.gz").write_bytes(b"")
    for split in (10, 1 << 20):
        got, = warc.read_archives(spark, str(tmp_path / "x"), split).collect()
        assert bytes(got["payload"]) == b"<p>hi</p>" and got["page_id"] == "<urn:uuid:1>"


def test_large_member_ends_with_an_empty_one():
    r = random.Random(1)
    big = b"WARC/1.1\r\nContent-Length: 1\r\n\r\n" + r.randbytes(17 << 20)
    line = warc.line_of(big) + b"\0"
    assert gzip.decompress(line) == big and line.endswith(warc.EMPTY)
    small = b"abc"
    assert warc.line_of(small) + b"\0" == warc.member(small)


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
