"""Raw table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Tried in this order.
SUFFIXES = (".csv.gz", ".csv")


def find_table(spark: SparkSession, root: str, stem: str) -> str:
    """Path of ``stem`` under ``root`` on whatever file system ``root`` names."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for suffix in SUFFIXES:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{stem}{suffix}")
        if path.getFileSystem(conf).exists(path):
            return path.toString()
    raise FileNotFoundError(f"no {stem}{SUFFIXES[0]} or {stem}{SUFFIXES[1]} under {root}")


def read_table(spark: SparkSession, root: str, stem: str, schema: T.StructType) -> DataFrame:
    """Tolerant CSV scan with an explicit schema: a row that does not parse is skipped.

    Columns are matched by header name, so the file may hold more of them. A
    gzip file is one task: convert it once with ``sinks.write_events`` and
    read the Parquet table from then on.
    """
    path = find_table(spark, root, stem)
    header = spark.read.text(path).first()
    names = [h.strip().strip('"') for h in header[0].split(",")] if header else schema.fieldNames()
    kinds = {f.name: f.dataType for f in schema.fields}
    full = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    # Every wanted column is selected before the mode applies, so a row is
    # judged on the columns the schema asks for.
    return (
        spark.read.schema(full)
        .option("header", True)
        .option("mode", "DROPMALFORMED")
        .csv(path)
        .select(*schema.fieldNames())
    )
