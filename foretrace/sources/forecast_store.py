"""Forecast tables on disk: partitioned by run and condition, resumable."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretrace import schemas
from foretrace.operators.forecast import ensemble


def write(forecasts: DataFrame, path: str, run: str, batch: str = "all", params: dict | None = None) -> None:
    """Partitioned by run, condition and batch, so a reader opens only what it asks for.

    Writing a batch again replaces it; other batches stay. ``params`` are the settings it was
    computed under, stored as a fingerprint; a condition stored under others is refused."""
    spark = forecasts.sparkSession
    df = forecasts.drop("fingerprint").withColumn("run", F.lit(run)).withColumn("batch", F.lit(batch))
    if params is not None:
        df = df.withColumn("fingerprint", fingerprint(params))
        if _exists(spark, path):
            stored = read(spark, path, run).join(df.select("condition").distinct(), "condition", "left_semi")
            if stored.filter(F.col("fingerprint") != fingerprint(params)).head(1):
                raise ValueError(f"run {run!r} was stored under other settings; use another path or run")
    fields = [f for f in schemas.FORECASTS.fields]
    for f in fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    df.select(*[f.name for f in fields], "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run", "condition", "batch").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, path: str, run: str | None = None, conditions: list[str] | None = None) -> DataFrame:
    """A condition that was never stored simply has no rows."""
    names = [f.name for f in schemas.FORECASTS.fields]
    df = spark.read.schema(T.StructType([*schemas.FORECASTS.fields, T.StructField("batch", T.StringType())])).parquet(path).select(*names)
    if run is not None:
        df = df.filter(F.col("run") == run)
    if conditions is not None:
        df = df.filter(F.col("condition").isin(conditions))
    return df


def available(df: DataFrame) -> DataFrame:
    return df.select("run", "condition").distinct()


def fingerprint(params: dict) -> Column:
    """Digest of the settings a batch was computed under."""
    return F.sha2(F.lit(json.dumps(params, sort_keys=True, default=str)), 256)


def pending(stays: DataFrame, done: DataFrame, condition: str, params: dict) -> DataFrame:
    """Stays without a stored forecast for this condition and fingerprint."""
    mine = done.filter((F.col("condition") == condition) & (F.col("fingerprint") == fingerprint(params)))
    return stays.join(mine.select("stay_id").distinct(), "stay_id", "left_anti")


def changed(done: DataFrame, condition: str, params: dict) -> DataFrame:
    """Stored fingerprints of the condition that differ from the current settings."""
    return done.filter((F.col("condition") == condition) & (F.col("fingerprint") != fingerprint(params))).select(
        "condition", "fingerprint").distinct()


def check_fingerprint(done: DataFrame, condition: str, params: dict) -> None:
    """Raise when the condition was stored under other settings (runs a small job)."""
    if changed(done, condition, params).head(1):
        raise ValueError(f"{condition!r} was stored under other settings; use another path or run")


def stored_run(calibration: DataFrame, test: DataFrame, recent: DataFrame, variables, params: DataFrame,
               critic_stage: str = "final") -> tuple[DataFrame, DataFrame]:
    """Forecasts of the conditions present in both sets; the calibration ones are
    post-processed again with the stored parameters, where there are any."""
    from foretrace.operators import postprocess

    both = calibration.select("condition").distinct().join(test.select("condition").distinct(), "condition", "left_semi")
    cal = calibration.join(F.broadcast(both), "condition", "left_semi")  # one row per condition
    raw = F.col("y_raw").isNotNull()
    redone = postprocess.apply(cal.filter(raw), recent, variables, params, critic_stage)
    return (redone.select(*cal.columns).unionByName(cal.filter(~raw)),
            test.join(F.broadcast(both), "condition", "left_semi"))


def with_overrides(store: DataFrame, samples: DataFrame, overrides: DataFrame) -> DataFrame:
    """Forecasts of each sample: its own run's, but an overridden condition comes
    from the run named for it.

    ``samples``: sample, run. ``overrides``: sample, condition, run. Both are
    configuration tables with a handful of rows.
    """
    own = store.join(F.broadcast(samples), "run").join(
        F.broadcast(overrides.select("sample", "condition")), ["sample", "condition"], "left_anti")
    taken = store.join(F.broadcast(overrides), ["run", "condition"])
    columns = ["sample", *store.columns]
    return own.select(*columns).unionByName(taken.select(*columns))


def override_ensemble(forecasts: DataFrame, members: list[str]) -> DataFrame:
    """The ensemble of (possibly overridden) members, per sample."""
    return ensemble(forecasts, members, keys=("sample",))
