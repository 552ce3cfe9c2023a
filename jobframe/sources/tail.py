"""Incremental tail of growing JSON-lines files (S5) as a Python streaming source.

Spark's file source tracks *paths*: a file that grows after it was read is never
read again. This source keeps a byte cursor per file as its streaming offset
(``{path: bytes}``), so every micro-batch reads exactly the complete lines
appended since the last committed offset; the offsets live in the query's
checkpoint, so a restarted query resumes where it stopped. A partially written
last line is left for the next batch (the cursor only advances past a newline).
A file that shrank is read again from byte 0; a vanished file is dropped.

    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("jobframe_tail").option("path", d).load()
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK = 64 * 1024 * 1024  # bytes of one input partition; large growth is split


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _complete_end(path: str, size: int) -> int:
    """Offset just after the last newline at or before ``size``."""
    with open(path, "rb") as f:
        pos = size
        while pos > 0:
            step = min(65536, pos)
            f.seek(pos - step)
            buf = f.read(step)
            i = buf.rfind(b"\n")
            if i >= 0:
                return pos - step + i + 1
            pos -= step
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.dir = options["path"]
        self.ext = options.get("ext", "jsonl")

    def _files(self):
        if os.path.isfile(self.dir):
            return [self.dir]
        return sorted(os.path.join(self.dir, n) for n in os.listdir(self.dir)
                      if n.endswith("." + self.ext) and os.path.isfile(os.path.join(self.dir, n)))

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {p: _complete_end(p, os.path.getsize(p)) for p in self._files()}

    def partitions(self, start, end):
        parts = []
        for p, e in end.items():
            s = start.get(p, 0)
            if e < s:  # shrunk: start over
                s = 0
            pos = s
            while pos < e:
                parts.append(_Part(p, pos, min(pos + CHUNK, e)))
                pos += CHUNK
        return parts

    def read(self, part):
        # lines whose first byte lies in [start, end); a chunk starting mid-line
        # skips to the next line, a chunk ending mid-line finishes it
        with open(part.path, "rb") as f:
            pos = part.start
            f.seek(pos)
            if pos > 0:
                f.seek(pos - 1)
                if f.read(1) != b"\n":
                    skipped = f.readline()
                    pos = pos + len(skipped)
            while pos < part.end:
                line = f.readline()
                if not line:
                    break
                yield (part.path, pos, line.rstrip(b"\n").decode("utf-8", errors="replace"))
                pos += len(line)

    def commit(self, end):
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls):
        return "jobframe_tail"

    def schema(self):
        return "file string, offset long, line string"

    def streamReader(self, schema):
        return TailReader(self.options)


def tail_jsonl(spark, path: str, source: str, id_field: str | None = "id"):
    """S5 → streaming jobs DataFrame (same parsing rules as S1)."""
    from pyspark.sql import functions as F

    from jobframe.operators.envelope import generated_id
    from jobframe.functions.json import top_level_string

    spark.dataSource.register(TailSource)
    raw = spark.readStream.format("jobframe_tail").option("path", path).load()
    lines = raw.withColumn("line", F.trim("line")).where((F.col("line") != "") &
                                                         F.try_parse_json(F.col("line")).isNotNull())
    gen = generated_id(F.lit(source), F.col("file"), F.col("offset"), F.col("line"))
    jid = F.coalesce(top_level_string(F.col("line"), id_field), gen) if id_field else gen
    return lines.select(jid.alias("id"), F.lit(source).alias("source"), F.col("line").alias("payload"),
                        F.lit(None).cast("string").alias("correlation_key"),
                        F.create_map().cast("map<string,string>").alias("labels"), "file", "offset")
