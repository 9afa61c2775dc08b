"""Summaries, reference statistics and model inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.ranks import quantiles
from foretrace.settings import Variable, Windows

STATS = ("last", "mean", "std", "slope")
DEFAULT_FILL = (0.0, 1.5)


def summarize(cut_grid: DataFrame, windows: Windows, recent: int = 6, keep_truth: bool = False,
              carry: tuple[str, ...] = (), recents: tuple[int, ...] = ()) -> DataFrame:
    """Per (stay, variable): last, mean, population std, least-squares slope and
    count of the observation bins, and the mean of the last ``recent`` bins.

    One aggregation. With ``keep_truth`` the horizon travels along as a map
    (hour to value, at most one entry per bin), so forecasts need no join back.
    ``carry`` names columns constant per stay to keep; ``recents`` adds
    ``recent_mean_<n>`` for further window lengths.
    """
    obs = F.col("part") == "obs"
    seen = obs & F.col("value").isNotNull()
    value, hour = F.when(seen, F.col("value")), F.when(seen, F.col("hour"))
    latest = F.max(F.when(seen, F.struct(F.col("hour"), F.col("value"))))
    aggregates = [
        latest.getField("value").alias("last"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.when(F.count(value) > 0, F.coalesce(F.regr_slope(value, hour), F.lit(0.0))).alias("slope"),
        F.count(value).alias("n_obs"),
        F.avg(F.when(F.col("hour") >= windows.obs - recent, value)).alias("recent_mean"),
    ]
    aggregates += [F.avg(F.when(F.col("hour") >= windows.obs - r, value)).alias(f"recent_mean_{r}") for r in recents]
    if keep_truth:
        truth = F.collect_list(F.when(~obs & F.col("value").isNotNull(), F.struct("hour", "value")))
        aggregates.append(F.map_from_entries(truth).alias("truth"))
    return cut_grid.groupBy("stay_id", *carry, "variable").agg(*aggregates)


def summarize_packed(series: DataFrame, windows: Windows, recent: int = 6, keep_truth: bool = False,
                     recents: tuple[int, ...] = ()) -> DataFrame:
    """``summarize`` for packed series (``harmonize.packed``): one fold per series, other columns
    than ``values`` are kept."""
    keep = [c for c in series.columns if c != "values"]

    def cells(first: int, count: int) -> Column:
        """Measured bins as (hour, value), hours from zero."""
        part = F.transform(F.slice("values", first + 1, count), lambda v, h: F.struct(h.alias("hour"), v.alias("value")))
        return F.filter(part, lambda c: c["value"].isNotNull())

    def total(column: str, term) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda a, c: a + term(c))

    def mean_since(hour: int) -> Column:
        own = F.filter("_seen", lambda c: c["hour"] >= hour)
        return F.aggregate(own, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, c: F.struct(
            (a["sum"] + c["value"]).alias("sum"), (a["n"] + 1).alias("n")), lambda a: F.try_divide(a["sum"], a["n"]))

    seen = series.select(*keep, cells(0, windows.obs).alias("_seen"), *([cells(windows.obs, windows.horizon).alias("_truth")] if keep_truth else []))
    known = F.nullif(F.size("_seen"), F.lit(0))
    seen = seen.withColumn("_n", known).withColumns({
        "_x": total("_seen", lambda c: c["value"]) / F.col("_n"), "_h": total("_seen", lambda c: c["hour"]) / F.col("_n")})
    x, h = F.col("_x"), F.col("_h")
    spread = total("_seen", lambda c: (c["value"] - x) * (c["value"] - x))
    hours = total("_seen", lambda c: (c["hour"] - h) * (c["hour"] - h))
    both = total("_seen", lambda c: (c["hour"] - h) * (c["value"] - x))
    return seen.select(
        *keep, F.get("_seen", F.size("_seen") - 1)["value"].alias("last"), x.alias("mean"), F.sqrt(spread / F.col("_n")).alias("std"),
        F.when(F.col("_n").isNotNull(), F.coalesce(F.try_divide(both, hours), F.lit(0.0))).alias("slope"),
        F.size("_seen").cast("long").alias("n_obs"), mean_since(windows.obs - recent).alias("recent_mean"),
        *[mean_since(windows.obs - r).alias(f"recent_mean_{r}") for r in recents],
        *([F.map_from_entries("_truth").alias("truth")] if keep_truth else []))


def reference_stats(train_grid: DataFrame) -> DataFrame:
    """Median, quartiles (exact) and population std of every value of the
    training stays, observation and horizon alike, per variable."""
    known = train_grid.filter(F.col("value").isNotNull())
    spread = known.groupBy("variable").agg(F.stddev_pop("value").alias("std"))
    return quantiles(known, ["variable"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).join(
        F.broadcast(spread), "variable").select("variable", "median", "q1", "q3", "std", F.col("n_rows").alias("n"))


def naive_fill(reference: DataFrame, variables: list[Variable]) -> DataFrame:
    """(variable, fill_value, fill_width): median and 1.645 std, or 0 and 1.5."""
    spark = reference.sparkSession
    panel = spark.createDataFrame([(v.name,) for v in variables], "variable string")
    has = F.col("median").isNotNull()
    return panel.join(F.broadcast(reference.select("variable", "median", "std")), "variable", "left").select(
        "variable",
        F.when(has, F.col("median")).otherwise(DEFAULT_FILL[0]).alias("fill_value"),
        F.when(has, 1.645 * F.col("std")).otherwise(DEFAULT_FILL[1]).alias("fill_width"))


def _wide(summary: DataFrame, variables: list[Variable], stats: tuple[str, ...]) -> DataFrame:
    """One row per stay; the panel is fixed, so the pivot needs no extra pass."""
    return summary.groupBy("stay_id").agg(*[
        F.max(F.when(F.col("variable") == v.name, F.col(s).cast("double"))).alias(f"{v.name}.{s}")
        for v in variables for s in stats])


def feature_names(variables: list[Variable], stats: tuple[str, ...] = STATS) -> list[str]:
    return [f"{v.name}.{s}" for v in variables for s in stats]


def knn_vector(summary: DataFrame, variables: list[Variable]) -> DataFrame:
    """(stay_id, vector) in panel order, null where the variable was not seen."""
    wide = _wide(summary, variables, STATS)
    return wide.select("stay_id", F.array(*[F.col(f"`{n}`") for n in feature_names(variables)]).alias("vector"))


def tree_vector(summary: DataFrame, variables: list[Variable]) -> DataFrame:
    """Feature columns of the tree models, 0 where missing, plus ``n_obs`` per variable."""
    stats = STATS + ("n_obs",)
    return _wide(summary, variables, stats).select("stay_id", *[
        F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n.replace(".", "_")) for n in feature_names(variables, stats)])


def normalisation(train_cut: DataFrame) -> DataFrame:
    """Mean and population std (0 becomes 1) of the training observation bins."""
    return train_cut.filter(F.col("part") == "obs").groupBy("variable").agg(
        F.avg("value").alias("norm_mean"),
        F.when(F.stddev_pop("value") == 0, 1.0).otherwise(F.stddev_pop("value")).alias("norm_std"))


def normalise(cut_grid: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``z``; the statistics have one row per configured variable."""
    return cut_grid.join(F.broadcast(stats), "variable").withColumn(
        "z", (F.col("value") - F.col("norm_mean")) / F.col("norm_std")).drop("norm_mean", "norm_std")


def ffill_mask(normalised: DataFrame, mode: str = "ffill_mask") -> DataFrame:
    """Model input per observation bin: last z carried forward and a measured
    flag, or (``zero_fill``) the bare z with 0 for missing."""
    if mode not in ("ffill_mask", "zero_fill"):
        raise ValueError(f"unknown mode {mode!r}")
    obs = normalised.filter(F.col("part") == "obs")
    if mode == "zero_fill":
        return obs.select("stay_id", "variable", "hour", F.coalesce("z", F.lit(0.0)).alias("filled"))
    upto = Window.partitionBy("stay_id", "variable").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return obs.select(
        "stay_id", "variable", "hour",
        F.coalesce(F.last("z", ignorenulls=True).over(upto), F.lit(0.0)).alias("filled"),
        F.col("z").isNotNull().cast("int").alias("measured"))


def anchor(normalised: DataFrame) -> DataFrame:
    """Last measured z of the observation window, 0 if never measured."""
    seen = F.when((F.col("part") == "obs") & F.col("z").isNotNull(), F.struct("hour", "z"))
    return normalised.groupBy("stay_id", "variable").agg(
        F.coalesce(F.max(seen).getField("z"), F.lit(0.0)).alias("anchor"))


def interval_scale(std: Column, n: Column) -> Column:
    """1.5 times the std (1 for a single value), never below 0.0015."""
    return F.greatest(F.when(n > 1, std).otherwise(1.0), F.lit(1e-3)) * 1.5
