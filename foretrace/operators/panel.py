"""Raw events to a binned long panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.functions.cells import bounds, outside, seconds_between
from foretrace.settings import Variable, Windows


def range_table(spark, variables: list[Variable]) -> DataFrame:
    """Valid and hard ranges per variable; null is an open end."""
    rows = [(v.name, *map(_double, v.valid), *map(_double, v.hard)) for v in variables]
    return spark.createDataFrame(
        rows, "variable string, valid_lo double, valid_hi double, hard_lo double, hard_hi double")


def _double(x):
    return None if x is None else float(x)


def align(events: DataFrame, mapping: DataFrame, stays: DataFrame, windows: Windows,
          key: str = "stay_id", time_col: str = "charttime", value_col: str = "valuenum") -> DataFrame:
    """(stay_id, variable, offset, value): item to variable, time to bins since
    intime (fractional). Unmapped items, unknown stays and offsets outside the
    window (both ends included) are dropped."""
    named = events.join(mapping.select("itemid", "variable"), "itemid")
    columns = ["stay_id", "intime"] if key == "stay_id" else [key, "stay_id", "intime"]
    placed = named.drop(*([] if key == "stay_id" else ["stay_id"])).join(stays.select(*columns), key)
    offset = seconds_between("intime", time_col) / F.lit(float(windows.bin_seconds))
    return placed.select("stay_id", "variable", offset.alias("offset"), F.col(value_col).alias("value")).filter(
        F.col("offset").between(0, windows.total))


def drop_invalid(df: DataFrame, variables: list[Variable], value_col: str = "value") -> DataFrame:
    """Without the values outside their variable's valid range (artefacts)."""
    return df.filter(~outside(F.col(value_col), *bounds(variables, "valid")))


def invalid_counts(df: DataFrame, variables: list[Variable], value_col: str = "value") -> DataFrame:
    return df.filter(outside(F.col(value_col), *bounds(variables, "valid"))).groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_dropped"))


def resample(aligned: DataFrame) -> DataFrame:
    """Mean per (stay, variable, bin); a bin without measurement has no row."""
    return aligned.groupBy("stay_id", "variable", F.floor("offset").cast("int").alias("hour")).agg(
        F.avg("value").alias("value"))
