"""Dense series, short-gap interpolation and the observation/horizon cut.

A series, the bins of one (stay, variable), is packed to one array. Filling gaps, cutting and
summarising are folds over that array, so they need no window, no sort and no row per bin; the long
form, one row per bin, is made from it where a caller wants cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.settings import Variable, Windows


def packed(cohort: DataFrame, panel: DataFrame, variables: list[Variable], windows: Windows,
           carry: tuple[str, ...] = ()) -> DataFrame:
    """(stay_id, carry, variable, values): one array with every bin of the series, null = not
    measured. ``carry`` names cohort columns (such as the split) to keep.

    Every stay's empty series and the measured cells are brought together by one grouping instead
    of a join, so a series is packed where it is summarised. Cells of other stays drop out."""
    names = F.array(*[F.lit(v.name) for v in variables])
    no_cell = F.lit(None).cast("struct<hour: int, value: double>")
    empty = cohort.select("stay_id", F.explode(names).alias("variable"), no_cell.alias("_cell"), F.lit(True).alias("_own"), *carry)
    cells = panel.filter(F.col("hour").between(0, windows.total - 1)).select(
        "stay_id", "variable", F.struct(F.col("hour").cast("int").alias("hour"), F.col("value").cast("double").alias("value")).alias("_cell"),
        F.lit(None).cast("boolean").alias("_own"), *[F.lit(None).cast(cohort.schema[c].dataType).alias(c) for c in carry])
    series = empty.unionByName(cells).groupBy("stay_id", "variable").agg(
        F.map_from_entries(F.collect_list("_cell")).alias("_cells"), F.max("_own").alias("_own"), *[F.max(c).alias(c) for c in carry])
    values = F.transform(F.sequence(F.lit(0), F.lit(windows.total - 1)), lambda h: F.try_element_at("_cells", h))
    return series.filter("_own").select("stay_id", *carry, "variable", values.alias("values"))


def filled(values: Column, limit: int = 3, strict: bool = False) -> Column:
    """An array of bins with its inner gaps filled linearly (see ``interpolate``), in one fold: the
    state is what is done, the last measured value and the number of bins seen."""
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("seen"))

    def step(state: Column, value: Column) -> Column:
        gap = state["seen"] - F.size(state["done"])
        line = F.transform(F.sequence(F.lit(1), gap), lambda k: F.when(
            (gap <= limit) if strict else (k <= limit), state["last"] + (value - state["last"]) * k / (gap + 1)))
        between = F.when(gap == 0, F.array().cast("array<double>")).when(
            state["last"].isNull(), F.array_repeat(F.lit(None).cast("double"), gap)).otherwise(line)
        seen = (state["seen"] + 1).alias("seen")
        measured = F.struct(F.concat(state["done"], between, F.array(value)).alias("done"), value.alias("last"), seen)
        return F.when(value.isNull(), F.struct(state["done"].alias("done"), state["last"].alias("last"), seen)).otherwise(measured)

    return F.aggregate(values, start, step, lambda state: F.concat(
        state["done"], F.array_repeat(F.lit(None).cast("double"), state["seen"] - F.size(state["done"]))))


def fill_gaps(series: DataFrame, limit: int = 3, strict: bool = False, windows: Windows | None = None) -> DataFrame:
    """``filled`` on the values of packed series; with ``windows`` not across the cut."""
    values = F.col("values")
    if windows:
        parts = F.slice(values, 1, windows.obs), F.slice(values, windows.obs + 1, windows.horizon)
        return series.withColumn("values", F.concat(*[filled(p, limit, strict) for p in parts]))
    return series.withColumn("values", filled(values, limit, strict))


def unpacked(series: DataFrame) -> DataFrame:
    """One row per bin of packed series, with ``hour`` and ``value``."""
    keep = [c for c in series.columns if c != "values"]
    return series.select(*keep, F.posexplode("values").alias("hour", "value"))


def grid(cohort: DataFrame, panel: DataFrame, variables: list[Variable], windows: Windows,
         carry: tuple[str, ...] = ()) -> DataFrame:
    """(stay_id, carry, variable, hour, value) for every bin of every stay, null = not measured."""
    return unpacked(packed(cohort, panel, variables, windows, carry))


def interpolate(gridded: DataFrame, limit: int = 3, strict: bool = False, windows: Windows | None = None) -> DataFrame:
    """Fill inner gaps of rows per bin linearly, at most ``limit`` bins after the last measured one.

    By default the first ``limit`` bins of a longer gap are filled as well;
    ``strict`` leaves longer gaps empty. With ``windows`` the fill never crosses
    the cut between observation and horizon; by default it does.
    """
    keys = ["stay_id", "variable"] + (["_part"] if windows else [])
    df = gridded.withColumn("_part", F.col("hour") < windows.obs) if windows else gridded
    series = Window.partitionBy(*keys).orderBy("hour")
    back = series.rowsBetween(Window.unboundedPreceding, 0)
    ahead = series.rowsBetween(0, Window.unboundedFollowing)
    measured_hour = F.when(F.col("value").isNotNull(), F.col("hour"))
    df = (
        df.withColumn("_pv", F.last("value", ignorenulls=True).over(back))
        .withColumn("_ph", F.last(measured_hour, ignorenulls=True).over(back))
        .withColumn("_nv", F.first("value", ignorenulls=True).over(ahead))
        .withColumn("_nh", F.first(measured_hour, ignorenulls=True).over(ahead))
    )
    span = F.col("_nh") - F.col("_ph")
    reach = (span - 1 <= limit) if strict else (F.col("hour") - F.col("_ph") <= limit)
    filled = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("hour") - F.col("_ph")) / F.nullif(span, F.lit(0))
    return df.withColumn(
        "value", F.coalesce("value", F.when(F.col("_nv").isNotNull() & reach & (span > 0), filled))
    ).select(*gridded.columns)


def cut(gridded: DataFrame, windows: Windows) -> DataFrame:
    """Adds ``part`` (obs or horizon) and renumbers the horizon from zero."""
    is_obs = F.col("hour") < windows.obs
    return gridded.withColumn("part", F.when(is_obs, "obs").otherwise("horizon")).withColumn(
        "hour", F.when(is_obs, F.col("hour")).otherwise(F.col("hour") - windows.obs).cast("int"))


def tensors(cohort: DataFrame, panel: DataFrame, variables: list[Variable], windows: Windows,
            carry: tuple[str, ...] = ()) -> DataFrame:
    """Series, interpolation and cut in this order: values are filled across the cut."""
    return cut(unpacked(fill_gaps(packed(cohort, panel, variables, windows, carry))), windows)
