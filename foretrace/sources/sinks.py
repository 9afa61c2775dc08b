"""Writers and the readers that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace import schemas


def events_path(root: str, kind: str, window_hours: int) -> str:
    """The window is part of the path, so another window never reuses the table."""
    return f"{root.rstrip('/')}/{kind}/window_h={int(window_hours)}"


def write_events(df: DataFrame, root: str, kind: str, window_hours: int, cluster_by: str | None = None) -> str:
    """Filtered events as Parquet; clustering by key keeps row groups skippable. The ranges are
    over the key and a hash of the row, so one key with very many events spreads over many tasks."""
    path = events_path(root, kind, window_hours)
    out = df
    if cluster_by:
        spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        out = df.withColumn("_spread", spread).repartitionByRange(cluster_by, "_spread").sortWithinPartitions(cluster_by).drop("_spread")
    out.write.mode("overwrite").parquet(path)
    return path


def read_events(spark: SparkSession, root: str, kind: str, window_hours: int) -> DataFrame:
    return spark.read.parquet(events_path(root, kind, window_hours))


def write_cohort_and_panel(cohort: DataFrame, panel: DataFrame, root: str) -> None:
    cohort.write.mode("overwrite").partitionBy("split").parquet(f"{root}/cohort")
    panel.write.mode("overwrite").parquet(f"{root}/panel")


def read_cohort_and_panel(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/cohort"), spark.read.schema(schemas.PANEL).parquet(f"{root}/panel")


def write_mapping(mapping: DataFrame, path: str) -> None:
    mapping.write.mode("overwrite").json(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MAPPING).json(path)


def summary_rows(report: DataFrame, **constants: str) -> DataFrame:
    """One row per condition and variable, with run-level constants as columns."""
    return report.select("*", *[F.lit(v).alias(k) for k, v in constants.items()])


def write_summary(report: DataFrame, path: str, **constants: str) -> None:
    summary_rows(report, **constants).write.mode("overwrite").option("header", True).csv(path)
