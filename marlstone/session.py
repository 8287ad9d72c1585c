"""Session settings that the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster use the cluster's own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("marlstone")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: By application: the folder that stands in for an unset one.
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share, spark.checkpoint.dir. Only where the driver is the one
    executor, too, a folder of this machine is taken if that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get(spark.sparkContext.applicationId)
    if not configured:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        _own_dir[spark.sparkContext.applicationId] = configured
    return f"{configured.rstrip('/')}/flow-{uuid.uuid4().hex}"
