"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The space characters between words: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


#: By application: the folder that stands in for an unset one, and the run folders that are open, innermost last.
_own_dir: dict[str, str] = {}
_run_dirs: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the run folder that is open below
    it. Only where the driver is the one executor, too, a folder of this machine is taken if that is unset."""
    if _run_dirs.get(spark.sparkContext.applicationId):
        return _run_dirs[spark.sparkContext.applicationId][-1]
    configured = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get(spark.sparkContext.applicationId)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        _own_dir[spark.sparkContext.applicationId] = configured
    return configured.rstrip("/")


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables that are written inside go to one folder, which is removed at the end. A result that is to be
    read later is written elsewhere before."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    open_ = _run_dirs.setdefault(spark.sparkContext.applicationId, [])
    open_.append(path)
    try:
        yield path
    finally:
        open_.remove(path)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, label: str = "step", compression: str = "snappy", few: bool = False) -> DataFrame:
    """Cut the lineage by writing df as Parquet to the shared folder and reading it again; a lost executor then costs no recomputation.

    few: for narrow tables, no more files than the cluster has cores."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.coalesce(spark.sparkContext.defaultParallelism) if few else df).write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like `name` that is not taken."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def let(value: Column, body) -> Column:
    """Evaluate value once for a row and hand it to body as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bits_for(rows: int, rows_each: int, least: int = 1) -> int:
    """Number of buckets, a power of two, so that rows spread evenly give about rows_each in each."""
    n = least
    while n * rows_each < rows:
        n *= 2
    return n


def key_filter(rows: DataFrame, key: str, bits: int):
    """A test, for numpy arrays of 64-bit keys inside tasks, that passes all values of the column `key` and few others.

    It is a bitmap of 2 ** bits bits at most, whatever the number of rows; what it lets through beside the keys, a
    join has to remove.
    """
    place = F.pmod(key, F.lit(1 << bits)) + 1
    found = rows.where(F.col(key).isNotNull()).select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("p")).groupBy("k").agg(
        F.bitmap_construct_agg("p").alias("m")).collect()  # 2 ** bits / 32768 rows at most
    whole = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in found:
        lo = (r.k - 1) * 4096
        whole[lo : lo + 4096] = np.frombuffer(r.m, dtype=np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(whole)

    def passes(keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.int64) & ((1 << bits) - 1)
        return (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return passes
