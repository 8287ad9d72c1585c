"""Tables in parts (months, buckets): a run rewrites the parts that it touches, and one pointer file says which files are current.

The files of a part lie below data/<run>/<column>=<part>. A run writes its parts beside the current ones and becomes current when the
pointer moves, so readers of a run that broke off find the table before it, and the same run again writes the same. Files that a run
replaced stay until the next run begins, for readers that have the pointer before.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources.files import _hadoop, point_to, pointed_to


def current(spark: SparkSession, path: str) -> dict:
    """run, parts (part: run that wrote it), column, replaced and what else was noted by the run; as long as the list of parts."""
    said = pointed_to(spark, path)
    return json.loads(said) if said else {"run": None, "parts": {}, "column": None, "replaced": []}


def read_parts(spark: SparkSession, path: str, schema: str, only: Iterable[str] | None = None) -> DataFrame:
    """The rows of the parts, or of those among `only`, without the column of parts."""
    at = current(spark, path)
    chosen = at["parts"] if only is None else [p for p in only if p in at["parts"]]
    files = [f"{path}/data/{at['parts'][p]}/{at['column']}={p}" for p in chosen]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def replace_parts(df: DataFrame, path: str, run: str, column: str, touched: Iterable[str], **notes) -> list[str]:
    """Let the rows of df stand for the parts `touched`; a touched part without rows goes. Returns the parts written."""
    spark = df.sparkSession
    at = current(spark, path)
    if at["run"] == run:
        raise ValueError(f"run {run} is current already")
    folder, fs = _hadoop(spark, f"{path}/data/{run}")
    for old in at["replaced"]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/{old}"), True)
    df.repartition(column).write.partitionBy(column).mode("overwrite").parquet(f"{path}/data/{run}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    written = sorted(n[len(column) + 1 :] for n in names if n.startswith(f"{column}="))
    gone = {*touched, *written}
    parts = {p: r for p, r in at["parts"].items() if p not in gone} | dict.fromkeys(written, run)
    replaced = [f"{r}/{column}={p}" for p, r in at["parts"].items() if p in gone]
    point_to(spark, path, json.dumps({"run": run, "parts": parts, "column": column, "replaced": replaced, **notes}))
    return written
