"""Materialise a DataFrame where every executor (and a retry) can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one in local mode only."""
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.conf.set(_CONF, folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write once as Parquet to the shared folder and read back.

    Cuts the lineage, so a lost executor never makes two readers of the same
    intermediate result disagree, and gives the optimizer real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foretrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove what durable() has written in this process; call it once the results are stored."""
    jvm, n = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        n += 1
    return n


# Keys whose combinations are configuration: a table with one row per combination
# has at most (conditions x variables x groups) rows, whatever the data volume.
CONFIG_KEYS = {"condition", "variable", "settings_key", "band", "window_group", "setting"}


def small(df: DataFrame, keys) -> DataFrame:
    """Broadcast a table keyed by configuration; leave any other to the optimizer."""
    return F.broadcast(df) if set(keys) <= CONFIG_KEYS else df
