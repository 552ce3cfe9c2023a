"""JSON arrays and CSV files of any size, read by byte ranges.

Spark's text reader cuts files into ranges at a separator (a comma or a line end), so each task sees whole tokens of a
range but not whether the range begins inside a string, or how deep. A first pass over each range works out what the
range does for each state it may begin in; composing these outlines over a file's ranges (one small row a range) fixes
the states. A second pass then cuts records. A record that crosses ranges leaves a fragment in each, and fragments meet
by their record's number. Nothing is ever gathered but the fragments of one record, and the driver holds one small row
for each input split, as many as it lists to read the files.
"""

from __future__ import annotations

import csv
import io
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that the cutting tasks hand on at once.
HAND_ON = 4 << 20
#: Bytes of whole CSV records that are parsed at once.
CHUNK = 1 << 18
BLANK = b" \t\n\r"

_WHOLE = "file string, ordinal bigint, text string"
_CROSSING = "file string, ordinal bigint, block bigint, text string"


def reader(spark: SparkSession, glob: str | None, recursive: bool):
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return r.option("pathGlobFilter", glob) if glob else r


def tokens(spark: SparkSession, path: str, sep: str, glob: str | None, recursive: bool) -> DataFrame:
    """(file, block, value): the texts between separators, in order within each range (``block`` is its start)."""
    return reader(spark, glob, recursive).option("lineSep", sep).text(path).select(
        F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def sizes(spark: SparkSession, path: str, glob: str | None, recursive: bool) -> DataFrame:
    files = reader(spark, glob, recursive).format("binaryFile").load(path)
    return files.select(F.input_file_name().alias("file"), F.col("length").alias("size"))


def _runs(batches):
    """(file, block, token values as bytes) for each run of rows of one range in a batch."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        block = b.column("block").to_numpy()
        file = b.column("file").dictionary_encode()
        names, number = file.dictionary.to_pylist(), file.indices.to_numpy()
        new = (np.flatnonzero((np.diff(block) != 0) | (np.diff(number) != 0)) + 1).tolist()
        values = b.column("value")
        values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
        for lo, hi in zip([0, *new], [*new, b.num_rows], strict=True):
            yield names[number[lo]], int(block[lo]), values.slice(lo, hi - lo).to_pylist()


class _Out:
    """Rows of a task, handed on in batches of bounded size."""

    def __init__(self, schema: str):
        import pyarrow as pa

        kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
        self.schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
        self.rows, self.size = [], 0

    def add(self, *row, size: int = 0) -> None:
        self.rows.append(row)
        self.size += size + 60

    def take(self, least: int = HAND_ON):
        import pyarrow as pa

        if self.rows and self.size >= least:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(cols, schema=self.schema)


def _text(parts) -> str:
    return b"".join(parts).decode("utf-8", "replace")


def _joined(crossing: DataFrame) -> DataFrame:
    """The fragments of each record that crosses ranges, joined. A group holds one record."""
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    return crossing.groupBy("file", "ordinal").agg(F.array_join(parts["text"], "").alias("text"))


# --- JSON arrays -------------------------------------------------------------------------------------------------------

_QUOTE, _COMMA, _OPEN, _CLOSE = 1, 2, 3, 4
_KIND = bytes({0x22: _QUOTE, 0x2C: _COMMA, 0x5B: _OPEN, 0x7B: _OPEN, 0x5D: _CLOSE, 0x7D: _CLOSE}.get(b, 0) for b in range(256))
_ESCAPE = re.compile(rb"\\.", re.DOTALL)


def structure(chunk: bytes, quoted: bool):
    """(places, kinds, depths) of the brackets and commas outside strings, depths relative to the chunk's start and
    after the bracket, and whether the chunk ends inside a string. ``quoted`` says whether it begins in one."""
    import numpy as np

    if b"\\" in chunk:
        chunk = _ESCAPE.sub(b"__", chunk)  # in valid JSON no escape crosses a comma, so none crosses a chunk's end
    kinds = np.frombuffer(chunk.translate(_KIND), dtype=np.uint8)
    at = np.flatnonzero(kinds)
    k = kinds[at]
    quotes = np.cumsum(k == _QUOTE) + quoted
    free = (quotes % 2 == 0) & (k != _QUOTE)
    ends = bool(quotes[-1] % 2) if len(quotes) else quoted
    at, k = at[free], k[free]
    return at, k, np.cumsum((k == _OPEN).astype(np.int64) - (k == _CLOSE)), ends


class _Outline:
    """What a range does if it begins inside or outside a string: depth change, lowest depth, commas by depth (from
    one above the start downwards) and closing brackets by the depth they reach (from the start's downwards)."""

    def __init__(self, quoted: bool):
        self.quoted, self.depth, self.low, self.commas, self.closers = quoted, 0, 0, {}, {}

    def add(self, chunk: bytes) -> None:
        import numpy as np

        _, k, d, self.quoted = structure(chunk, self.quoted)
        d = d + self.depth
        for mask, found, top in (((k == _COMMA) & (d <= 1), self.commas, 1), ((k == _CLOSE) & (d <= 0), self.closers, 0)):
            for depth, n in zip(*np.unique(d[mask], return_counts=True), strict=True):
                found[top - int(depth)] = found.get(top - int(depth), 0) + int(n)
        if len(d):
            self.depth, self.low = int(d[-1]), min(self.low, int(d.min()))

    def cells(self) -> list:
        flat = lambda x: [x.get(i, 0) for i in range(max(x, default=-1) + 1)]
        return [self.depth, self.low, flat(self.commas), flat(self.closers)]


_SIDE = "depth{0} bigint, low{0} bigint, commas{0} array<bigint>, closers{0} array<bigint>"
_JSON_OUTLINE = ("file string, block bigint, bytes bigint, first string, last string, flips boolean, "
                 + _SIDE.format(0) + ", " + _SIDE.format(1))


def _outline_json(batches):
    out, now, sides = _Out(_JSON_OUTLINE), None, ()

    def done():
        if now is not None:
            out.add(*now, sides[0].quoted, *sides[0].cells(), *sides[1].cells())

    for file, block, values in _runs(batches):
        if now is None or now[:2] != [file, block]:
            done()
            now, sides = [file, block, 0, None, None], (_Outline(False), _Outline(True))
        chunk = b",".join(values) + b","
        now[2] += len(chunk)
        body = b" ".join(values).strip(BLANK)
        if body:
            now[3] = "[" if now[3] is None and body[:1] == b"[" else now[3] or "other"
            now[4] = "]" if body[-1:] == b"]" else "other"
        for s in sides:
            s.add(chunk)
    done()
    yield from out.take(0)


_JSON_STATE = "file string, block bigint, ok boolean, quoted boolean, depth bigint, ordinal bigint, commas bigint"


def _compose_json(ranges):
    """The state that each range of a file begins in, the number of its first element, and whether the file is an
    array: it opens with a bracket, closes at its very end and not before."""
    import pandas as pd

    r = ranges.sort_values("block")
    quoted, depth, ordinal, ends, outer, low, rows = False, 0, 0, 0, 0, 0, []
    at = lambda x, i: int(x[i]) if 0 <= i < len(x) else 0
    for x in r.to_dict("records"):
        h = int(quoted)
        rows.append([x["file"], x["block"], quoted, depth, ordinal])
        low = min(low, depth + x[f"low{h}"])
        ordinal += at(x[f"commas{h}"], depth)
        outer += at(x[f"commas{h}"], depth + 1)
        ends += at(x[f"closers{h}"], depth)
        depth += x[f"depth{h}"]
        quoted ^= bool(x["flips"])
    first, last = ([v for v in r[c] if v is not None] for c in ("first", "last"))
    # outside the array lies only the comma put after the last token; one in the file, or a byte order mark, shows in
    # the number of bytes
    ok = (bool(first) and first[0] == "[" and last[-1] == "]" and not quoted and depth == 0 and low == 0 and ends == 1
          and outer == 1 and int(r["bytes"].sum()) == int(r["size"].iloc[0]) + 1)
    return pd.DataFrame([[*x[:2], ok, *x[2:], ordinal] for x in rows], columns=[c.split()[0] for c in _JSON_STATE.split(", ")])


def _cut_json(sent, crossing: bool):
    """The elements that lie in one range, or with ``crossing`` the fragments of the others."""
    def run(batches):
        out = _Out(_CROSSING if crossing else _WHOLE)
        key, held, state = None, [], None

        def put(whole, parts):
            if whole != crossing:
                text = _text(parts)
                out.add(*key[:1], ordinal, *([key[1]] if crossing else []), text, size=len(text))

        for file, block, values in _runs(batches):
            if key != (file, block):
                if held:
                    put(False, held)
                key, held, state = (file, block), [], sent.value.get((file, block))
                if state is not None:
                    quoted, depth, ordinal, commas = state
                    began, open_ = False, depth > 0  # whether the element began in this range; whether the array is open
            if state is None:  # not an array
                continue
            chunk = b",".join(values) + b","
            at, k, d, quoted = structure(chunk, quoted)
            d = d + depth
            lo = 0
            mark = ((k == _COMMA) & (d == 1)) | ((k == _OPEN) & (d == 1)) | ((k == _CLOSE) & (d == 0))
            for p, kind in zip(at[mark].tolist(), k[mark].tolist(), strict=True):
                if kind == _OPEN:
                    began = open_ = True
                elif kind == _COMMA:
                    put(began, [*held, chunk[lo:p]])
                    began, ordinal = True, ordinal + 1
                else:
                    parts = [*held, chunk[lo:p]]
                    if commas or not began or b"".join(parts).strip(BLANK):  # else an empty array
                        put(began, parts)
                    open_ = False
                held, lo = [], p + 1
            if open_:
                held.append(chunk[lo:])
            depth = int(d[-1]) if len(d) else depth
            yield from out.take()
        if held:
            put(False, held)
        yield from out.take(0)

    return run


def json_elements(spark: SparkSession, path: str, glob: str | None, recursive: bool) -> tuple[DataFrame, DataFrame]:
    """(file, ordinal, text) of the elements, as written, of the files that are JSON arrays; (file) of the others, but
    for empty files, which have no records and no rejects.

    Elements are cut, not parsed: one that is no JSON comes as its text (blank for nothing between two commas)."""
    source = tokens(spark, path, ",", glob, recursive)
    listed = sizes(spark, path, glob, recursive)
    outline = source.mapInArrow(_outline_json, _JSON_OUTLINE).join(listed, "file")
    found = outline.groupBy("file").applyInPandas(_compose_json, _JSON_STATE).collect()  # one row for each input split
    states = {(r["file"], r["block"]): (r["quoted"], r["depth"], r["ordinal"], r["commas"]) for r in found if r["ok"]}
    bad = spark.createDataFrame(sorted({(r["file"],) for r in found if not r["ok"]}), "file string")
    sent = spark.sparkContext.broadcast(states)
    elements = source.mapInArrow(_cut_json(sent, False), _WHOLE)
    if any(block for _, block in states):
        elements = elements.unionByName(_joined(source.mapInArrow(_cut_json(sent, True), _CROSSING)))
    return elements, bad


# --- CSV ---------------------------------------------------------------------------------------------------------------

_FIELD_END = re.compile(rb"[,\r]")


def scan_line(line: bytes, quoted: bool) -> tuple[bool, int]:
    """(whether the line ends inside quotes, records that start in it and are not blank). Four states: a field's
    start, in a field, in quotes, and after a quote in quotes; a carriage return outside quotes ends a record too."""
    if b'"' not in line and b"\r" not in line:
        return (True, 0) if quoted else (False, int(line != b""))
    i, n, started, fresh = 0, len(line), 0, not quoted
    while True:
        if quoted:
            j = line.find(b'"', i)
            if j < 0:
                return True, started
            i = j + 1
            if line[i:i + 1] == b'"':
                i += 1
                continue
            quoted = False
        elif i >= n:
            return False, started
        else:
            c = line[i:i + 1]
            if fresh and c != b"\r":
                started, fresh = started + 1, False
            if c == b'"':
                quoted, i = True, i + 1
                continue
        m = _FIELD_END.search(line, i)
        if not m:
            return False, started
        fresh, i = m[0] == b"\r", m.end()


def parse_csv(text: str):
    """Records of a text that begins at a record's start; blank lines give none."""
    csv.field_size_limit(2**31 - 1)
    return (r for r in csv.reader(io.StringIO(text, newline="")) if r)


def first_record(text: str) -> list[str]:
    return next(parse_csv(text.removeprefix("\ufeff")))


_CSV_SIDE = "quoted{0} boolean, started{0} bigint, open{0} bigint, head{0} string"
_CSV_OUTLINE = "file string, block bigint, bytes bigint, " + _CSV_SIDE.format(0) + ", " + _CSV_SIDE.format(1)


class _Lines:
    """What a range of lines does if it begins inside or outside quotes: how it ends, the records that start in it,
    how many of them before the lines that are open at its end (-1: those were open before), and the first of them as
    a JSON array if it ends here, too (for ranges that begin outside quotes; no other holds a header)."""

    def __init__(self, quoted: bool):
        self.quoted, self.started, self.open, self.lines = quoted, 0, -1 if quoted else 0, []
        self.head = "" if quoted else None

    def add(self, line: bytes, quoted: bool, started: int) -> None:
        if not self.quoted:
            self.open = self.started
        self.quoted = quoted
        if self.head is None and (self.started or started):
            self.lines.append(line)
            if not quoted:
                self._find_head()
        self.started += started

    def _find_head(self) -> None:
        self.head, self.lines = json.dumps(first_record(_text([b"\n".join(self.lines)]))), []

    def cells(self) -> list:
        if self.head is None and self.started > 1:  # a carriage return ends it within the open lines
            self._find_head()
        return [self.quoted, self.started, self.open, self.head]


def _outline_csv(batches):
    out, now, sides = _Out(_CSV_OUTLINE), None, ()

    def done():
        if now is not None:
            out.add(*now, *sides[0].cells(), *sides[1].cells())

    for file, block, lines in _runs(batches):
        if now is None or now[:2] != [file, block]:
            done()
            now, sides = [file, block, 0], (_Lines(False), _Lines(True))
        for line in lines:
            now[2] += len(line) + 1
            first = scan_line(line, sides[0].quoted)
            second = first if sides[0].quoted == sides[1].quoted else scan_line(line, sides[1].quoted)
            sides[0].add(line, *first)
            sides[1].add(line, *second)
    done()
    yield from out.take(0)


_CSV_STATE = ("file string, block bigint, quoted boolean, ordinal bigint, open bigint, end bigint, head string, "
              "lacking boolean")


def _compose_csv(ranges):
    """The state that each range of a file begins in: inside quotes or not, the number of its first record, and that
    of the first record of the lines that are open then; 1 if the file ends there, 2 if without a line end; the header,
    or ``lacking`` if the header crosses ranges."""
    import pandas as pd

    r = ranges.sort_values("block")
    quoted, ordinal, open_, head, lacking, rows = False, 0, 0, None, False, []
    for x in r.to_dict("records"):
        rows.append([x["file"], x["block"], quoted, ordinal, open_, 0])
        h = int(quoted)
        if not ordinal and x[f"started{h}"]:
            head, lacking = x[f"head{h}"], x[f"head{h}"] is None
        open_ = ordinal + x[f"open{h}"] if x[f"open{h}"] >= 0 else open_
        ordinal += int(x[f"started{h}"])
        quoted = bool(x[f"quoted{h}"])
    bare = int(r["bytes"].sum()) - int(r["size"].iloc[0]) in (1, -2)  # the reader drops a byte order mark
    rows[-1][-1] = 1 + bare
    return pd.DataFrame([[*x, head, lacking] for x in rows], columns=[c.split()[0] for c in _CSV_STATE.split(", ")])


def _cut_csv(sent, emit, schema: str, crossing: bool, files=None):
    """``emit(out, file, ordinal, text)`` for runs of whole records within a range, the first of them numbered
    ``ordinal``; with ``crossing`` rows with the fragments of the lines that cross ranges."""

    def run(batches):
        out, key, held, size = _Out(schema), None, [], 0
        closed = done = count = 0  # held lines that are whole records, the records in those, and in all held lines

        def put(lines, cross, number, last=False):
            if lines and cross == crossing:
                text = _text([b"\n".join(lines), b"" if last and end == 2 else b"\n"])
                if crossing:
                    out.add(key[0], number, key[1], text, size=len(text))
                else:
                    emit(out, key[0], number, text)

        def leave():
            if inside:
                put(held, True, open_, True)
            elif end:  # what is still open ends with the file
                put(held, False, ordinal, True)
            else:
                put(held[:closed], False, ordinal)
                put(held[closed:], True, ordinal + done)

        for file, block, lines in _runs(batches):
            if files is not None and file not in files:
                continue
            if key != (file, block):
                if held:
                    leave()
                key, held, size, closed, done, count = (file, block), [], 0, 0, 0, 0
                quoted, ordinal, open_, end = sent.value[file, block]
                inside = quoted  # in lines that were open before this range
            for line in lines:
                quoted, started = scan_line(line, quoted)
                held.append(line)
                size += len(line)
                count += started
                if quoted:
                    continue
                closed, done = len(held), count
                if inside or size >= CHUNK:
                    number = open_ if inside else ordinal
                    # whether the file ends here is not known yet; a line end more ends no other record
                    put(held, inside, number)
                    inside, ordinal = False, ordinal + count
                    held, size, closed, done, count = [], 0, 0, 0, 0
            yield from out.take()
        if held:
            leave()
        yield from out.take(0)

    return run


_CSV_ROW = "file string, ordinal bigint, line string, record string, fields string"


def _emit_records(heads):
    def emit(out, file, ordinal, text):
        show = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        head = heads.value.get(file)
        if head is None:
            return
        for n, record in enumerate(parse_csv(text), ordinal):
            if n == 0:
                continue
            if len(record) == len(head):
                row = (show(dict(zip(head, record, strict=True))), None, None)
            else:
                row = (None, ",".join(record), show(record))
            out.add(file, n, *row, size=len(row[0] or row[1]))

    return emit


def csv_records(spark: SparkSession, path: str, glob: str | None, recursive: bool,
                header: list[str] | None = None) -> DataFrame:
    """(file, ordinal, line, record, fields): each record but the header as a JSON object of strings, or, where its
    width is not its file's header's, the record and its fields. With ``header`` only files with that one."""
    source = tokens(spark, path, "\n", glob, recursive)
    outline = source.mapInArrow(_outline_csv, _CSV_OUTLINE).join(sizes(spark, path, glob, recursive), "file")
    found = outline.groupBy("file").applyInPandas(_compose_csv, _CSV_STATE).collect()  # one row for each input split
    states = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["quoted"], r["ordinal"], r["open"], r["end"])
                                           for r in found})
    names = {r["file"]: json.loads(r["head"]) for r in found if r["head"]}
    lacking = {r["file"] for r in found if r["lacking"]}
    crossing = None
    if any(r["block"] for r in found):
        crossing = _joined(source.mapInArrow(_cut_csv(states, None, _CROSSING, True), _CROSSING))
    if lacking:  # headers with line ends in quotes that cross ranges
        late = _joined(source.mapInArrow(_cut_csv(states, None, _CROSSING, True, lacking), _CROSSING))
        names |= {r["file"]: first_record(r["text"]) for r in late.where("ordinal = 0").collect()}
    if header is not None:
        names = {f: h for f, h in names.items() if h == header}
    heads = spark.sparkContext.broadcast(names)
    emit = _emit_records(heads)
    rows = source.mapInArrow(_cut_csv(states, emit, _CSV_ROW, False), _CSV_ROW)
    if crossing is None:
        return rows

    def parse(batches):
        out = _Out(_CSV_ROW)
        for b in batches:
            for file, ordinal, text in zip(*(b.column(c).to_pylist() for c in ("file", "ordinal", "text")), strict=True):
                emit(out, file, ordinal, text)
                yield from out.take()
        yield from out.take(0)

    return rows.unionByName(crossing.mapInArrow(parse, _CSV_ROW))
