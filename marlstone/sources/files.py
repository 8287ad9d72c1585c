"""Sources and sinks: scans of folders, tolerant JSON lines, registries, snapshots, question sets, decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.operators.state import route_format

QUESTIONS = "id string, question string, expected_paths array<string>, keywords array<string>, note string"


def scan_sources(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, size, mtime, sha256, supported of all files below root, hashed where they are read.

    File scans leave files without bytes out; those are listed by the driver and added, so that they do not seem missing.
    """
    base = _qualified(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    hashed = files.select(_below(F.col("path"), base).alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))
    empty = spark.createDataFrame(_empty_files(spark, root, base), "relative_path string, size long, millis long").select(
        "relative_path", "size", F.timestamp_millis("millis").alias("mtime"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"))
    return route_format(hashed.unionByName(empty)).select("relative_path", "size", "mtime", "sha256", "supported")


def _below(path: Column, base: str) -> Column:
    return F.substring(F.regexp_replace(path, "^file:/+", "file:/"), len(base) + 2, 1 << 30)


def _hadoop(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _qualified(spark: SparkSession, root: str) -> str:
    path, fs = _hadoop(spark, root)
    return fs.makeQualified(path).toString().rstrip("/")


def _empty_files(spark: SparkSession, root: str, base: str) -> list[tuple[str, int, int]]:
    path, fs = _hadoop(spark, root)
    out, it = [], fs.listFiles(path, True)
    while it.hasNext():
        f = it.next()
        if f.getLen() == 0:
            out.append((f.getPath().toString()[len(base) + 1 :], 0, f.getModificationTime()))
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def append_jsonl(df: DataFrame, path: str, day: str | None = None) -> None:
    """Append to a log of JSON lines, by day if a column of days is named."""
    w = df.write.mode("append")
    (w.partitionBy(day) if day else w).json(path)


def digest(df: DataFrame) -> tuple:
    """The same for equal rows in any order."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return tuple(df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)"))).first())


def write_registry(df: DataFrame, path: str, keys: list[str]) -> bool:
    """Rewrite a registry sorted by its keys; nothing is written when its rows are the same. Says whether it wrote."""
    spark = df.sparkSession
    target, fs = _hadoop(spark, path)
    if fs.exists(target) and digest(spark.read.schema(df.schema).json(path)) == digest(df):
        return False
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)
    return True


POINTER = "CURRENT"


def point_to(spark: SparkSession, folder: str, name: str) -> None:
    """Let the pointer file of a folder name what is current: written beside it and moved over it in one step."""
    jvm, (new, fs) = spark._jvm, _hadoop(spark, f"{folder}/{POINTER}.new")
    stream = fs.create(new, True)
    stream.write(bytearray(name.encode()))
    stream.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}")
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(new).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(target), over)


def pointed_to(spark: SparkSession, folder: str) -> str | None:
    """What the pointer file of a folder names; None without one."""
    path, fs = _hadoop(spark, f"{folder}/{POINTER}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish_snapshot(df: DataFrame, path: str, published_at: str, keep: int) -> None:
    """Write history/published_at=…, make it the current one, and delete all but the newest `keep` of the history.

    A snapshot is complete before the pointer is moved to it; after a run that broke off anywhere, readers find the snapshot before,
    and the same run again gives the same folders. The current snapshot is never deleted.
    """
    spark = df.sparkSession
    name = f"published_at={published_at}"
    df.write.mode("overwrite").parquet(f"{path}/history/{name}")
    point_to(spark, path, name)
    folder, fs = _hadoop(spark, f"{path}/history")
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("published_at=")), reverse=True)
    for n in names[keep:]:
        if n != name:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/history/{n}"), True)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current snapshot."""
    name = pointed_to(spark, path)
    if name is None:
        raise ValueError(f"nothing was published below {path}")
    return spark.read.parquet(f"{path}/history/{name}")


def load_question_set(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The cases of a nested JSON file (or of one object a line) as rows, optional fields filled; an empty set is an error."""
    whole = spark.read.schema(f"cases array<struct<{QUESTIONS.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=not lines)
    cases = whole.select(F.inline("cases"))
    none = F.array().cast("array<string>")
    out = cases.select("id", "question", F.coalesce("expected_paths", none).alias("expected_paths"), F.coalesce("keywords", none).alias("keywords"), F.coalesce("note", F.lit("")).alias("note"))
    if out.isEmpty():
        raise ValueError(f"no cases in {path}")
    return out


def _gb18030(raw: pd.Series) -> pd.Series:
    def read(b):
        try:
            return bytes(b).decode("gb18030")
        except UnicodeDecodeError:
            return None

    return raw.map(read, na_action="ignore")


def decode_text_corpus(files: DataFrame) -> DataFrame:
    """files(path, content binary) with text and error: NUL bytes are rejected, then UTF-8 is tried, then GB18030.

    Only bytes that are not UTF-8 reach Python.
    """
    raw = F.col("content")
    binary, valid = F.contains(raw, F.lit(bytearray(1))), F.is_valid_utf8(raw)
    other = F.pandas_udf(_gb18030, "string")(F.when(~binary & ~valid, raw))
    text = F.when(binary, None).when(valid, F.regexp_replace(F.decode(raw, "UTF-8"), "^\\uFEFF", "")).otherwise(other)
    read = files.select("path", text.alias("text"), binary.alias("_b"))
    return read.select("path", "text", F.when(F.col("_b"), "binary").when(F.col("text").isNull(), "undecodable").alias("error"))
