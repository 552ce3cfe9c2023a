"""File sources.

* ``read_jsonl``       S1: one job per non-blank line; any JSON value; bad lines
                       go to a rejects DataFrame instead of vanishing.
* ``read_json_array``  S2: whole file must be a JSON array; one job per element.
* ``read_csv``         S3: header required, all fields strings, wrong-width rows
                       rejected; payload = JSON object of the row.
* ``read_directory``   S4: non-recursive, only .json/.jsonl/.csv, unioned.
* ``snapshot``         S6: a full re-read, for diffing with C1.

Every reader adds ``file`` (the source path) and ``ordinal`` (position inside the
file), from which the content-derived job id is built, so re-reading a file or
retrying a task yields the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobframe.functions.json import VARIANT_BYTES, compact_json, string_field, valid_json
from jobframe.operators.envelope import generated_id
from jobframe.sources.ranges import csv_records, json_elements

EXTENSIONS = ("json", "jsonl", "csv")


def _lines(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(path).select(F.col("value"), F.input_file_name().alias("file"))
    # a stable row ordinal: monotonically_increasing_id is (split index, row in
    # split), which a retried task over the same splits reproduces exactly.
    return df.withColumn("_mid", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str, source: str, glob: str | None = "*.jsonl",
               id_field: str | None = "id", recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """S1 → (jobs, rejects)."""
    df = _lines(spark, path, glob, recursive).withColumn("line", F.trim(F.col("value")))
    df = df.where(F.col("line") != "")
    parsed = df.withColumn("_ok", valid_json(F.col("line")))
    good = parsed.where("_ok")
    bad = parsed.where(~F.col("_ok")).select("file", F.col("line").alias("record"),
                                             F.lit("unparsable JSON line").alias("reason"))
    return _jobs(good, source, F.col("line"), id_field), bad


def read_json_array(spark: SparkSession, path: str, source: str, glob: str | None = "*.json",
                    id_field: str | None = "id", recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """S2 → (jobs, rejects). A file that is not a JSON array yields no jobs; an element that is not JSON is rejected
    alone.

    Files are read by byte ranges (``sources/ranges.py``), so one large file takes many tasks. Elements keep their
    text (numbers and strings as written, without the white space between tokens); one may take up to 2 GB."""
    from jobframe.session import ship_package

    ship_package(spark)
    elems, other = json_elements(spark, path, glob, recursive)
    whole = other.select("file", F.lit(None).cast("string").alias("record"), F.lit("not a JSON array").alias("reason"))
    elems = elems.withColumn("text", F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    elems = elems.withColumn("_ok", valid_json(F.col("text")))
    single = elems.where(~F.col("_ok")).select("file", F.col("text").alias("record"),
                                               F.lit("unparsable JSON element").alias("reason"))
    plain = F.col("text").startswith('"') & (F.octet_length("text") <= VARIANT_BYTES)
    line = F.when(plain, F.to_json(F.try_parse_json("text"))).otherwise(compact_json(F.col("text")))
    out = elems.where("_ok").select("file", "ordinal", line.alias("line"))
    return _jobs(out, source, F.col("line"), id_field, ordinal=F.col("ordinal")), whole.unionByName(single)


def read_csv(spark: SparkSession, path: str, source: str, glob: str | None = "*.csv",
             id_field: str | None = "id", schema: str | None = None, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3 → (jobs, rejects): each file's first record is its header; every field is a string, an empty one "";
    of columns of one name the last holds; records of another width than their header are rejected.

    Files may differ in their headers, and a record may hold line ends in quotes. Files are read by byte ranges
    (``sources/ranges.py``), so one large file takes many tasks. ``schema`` (DDL) only selects files with those columns."""
    from jobframe.session import ship_package

    ship_package(spark)
    head = [x.strip().split()[0].strip("`") for x in schema.split(",")] if schema is not None else None
    rows = csv_records(spark, path, glob, recursive, head)
    bad = rows.where("line IS NULL").select("file", "record", F.lit("wrong number of fields").alias("reason"), "fields")
    return _jobs(rows.where("line IS NOT NULL"), source, F.col("line"), id_field, ordinal=F.col("ordinal")), bad


def _jobs(df: DataFrame, source: str, payload, id_field: str | None, ordinal=None) -> DataFrame:
    ordn = ordinal if ordinal is not None else F.col("_mid")
    gen = generated_id(F.lit(source), F.col("file"), ordn, payload)
    jid = F.coalesce(string_field(payload, id_field), gen) if id_field else gen
    return df.select(jid.alias("id"), F.lit(source).alias("source"), payload.alias("payload"),
                     F.lit(None).cast("string").alias("correlation_key"),
                     F.create_map().cast("map<string,string>").alias("labels"), "file")


def read_directory(spark: SparkSession, path: str, source: str, id_field: str | None = "id") -> tuple[DataFrame, DataFrame]:
    """One reader per extension, unioned; other files are ignored."""
    jobs, rejects = [], []
    for ext, reader in (("jsonl", read_jsonl), ("json", read_json_array), ("csv", read_csv)):
        if not _has_files(spark, path, ext):
            continue
        j, r = reader(spark, path, source, glob=f"*.{ext}", id_field=id_field)
        jobs.append(j)
        rejects.append(r)
    if not jobs:
        empty = spark.createDataFrame([], "id string, source string, payload string, correlation_key string, "
                                          "labels map<string,string>, file string")
        return empty, spark.createDataFrame([], "file string, record string, reason string")
    out_j, out_r = jobs[0], rejects[0]
    for j, r in zip(jobs[1:], rejects[1:]):
        out_j, out_r = out_j.unionByName(j), out_r.unionByName(r, allowMissingColumns=True)
    return out_j, out_r


def _has_files(spark: SparkSession, path: str, ext: str) -> bool:
    """Listing check through the Hadoop file system (works for any shared store)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return False
    for st in fs.listStatus(p):
        if st.isFile() and st.getPath().getName().endswith("." + ext):
            return True
    return False


def snapshot(spark: SparkSession, path: str, source: str, id_field: str | None = "id") -> DataFrame:
    """Re-read the full source; diff two snapshots with ``cancel.removed_ids``."""
    jobs, _ = read_directory(spark, path, source, id_field)
    return jobs
