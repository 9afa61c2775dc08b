"""Persistence and boosted-tree forecasts, intervals and ensembles."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions.cells import bounds, clip
from foretrace.functions.durable import durable
from foretrace.operators.features import DEFAULT_FILL, interval_scale, tree_vector
from foretrace.settings import PERSISTENCE_CONDITIONS, Variable, Windows, validate_conditions

COLUMNS = ("condition", "stay_id", "variable", "hour", "y_true", "y_pred", "y_lower", "y_upper")
MIN_TARGETS = 10
GAUSS_90 = 1.645
FITS_AT_ONCE = 8  # each boosting round is a handful of short jobs, so fits leave most cores to others


def _level(condition: str) -> Column:
    if condition == "naive":
        return F.col("last")
    if condition == "recent_mean":
        return F.coalesce("recent_mean", "last")
    if condition == "persistence_blend":
        return 0.5 * (F.col("last") + F.col("mean"))
    raise ValueError(f"unknown persistence condition {condition!r}")


def levels(summary: DataFrame, conditions=PERSISTENCE_CONDITIONS, fill: DataFrame | None = None) -> DataFrame:
    """One (level, width) row per condition and series. An unobserved variable
    takes the fill, or 0 and 1.5 without one. All conditions come out of one
    pass over the summary."""
    if fill is not None:
        df = summary.join(F.broadcast(fill), "variable", "left")  # one row per configured variable
    else:
        df = summary.withColumn("fill_value", F.lit(DEFAULT_FILL[0])).withColumn("fill_width", F.lit(DEFAULT_FILL[1]))
    seen = F.col("n_obs") > 0
    width = F.when(seen, interval_scale(F.col("std"), F.col("n_obs"))).otherwise(F.col("fill_width"))
    variants = F.array(*[
        F.struct(F.lit(c).alias("condition"), F.when(seen, _level(c)).otherwise(F.col("fill_value")).alias("level"))
        for c in conditions])
    return df.withColumn("_v", F.explode(variants)).select(
        "*", F.col("_v.condition").alias("condition"), F.col("_v.level").alias("level"), width.alias("width")
    ).drop("_v", "fill_value", "fill_width")


def with_interval(df: DataFrame, width: Column | str = "width") -> DataFrame:
    w = F.col(width) if isinstance(width, str) else width
    return df.withColumns({"y_lower": F.col("y_pred") - w, "y_upper": F.col("y_pred") + w})


def persistence(summary: DataFrame, windows: Windows, conditions=PERSISTENCE_CONDITIONS,
                fill: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Flat forecasts over the horizon; needs a summary with ``truth``. ``carry``
    names further summary columns to keep."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(windows.horizon - 1))).alias("hour")
    flat = levels(summary, conditions, fill).select(
        *carry, "condition", "stay_id", "variable", "truth", "level", "width", hours)
    cells = flat.withColumn("y_true", F.try_element_at("truth", F.col("hour"))).withColumn("y_pred", F.col("level"))
    return with_interval(cells).select(*carry, *COLUMNS)


def clip_to_valid(forecasts: DataFrame, variables: list[Variable]) -> DataFrame:
    return forecasts.withColumn("y_pred", clip(F.col("y_pred"), *bounds(variables, "valid")))


@dataclass(frozen=True)
class TreeModels:
    """One boosted regressor per variable; the lead hour is a feature."""

    models: dict
    residuals: DataFrame  # variable, hour, residual_std
    features: tuple[str, ...]


def _tree_cells(summary: DataFrame, variables: list[Variable], windows: Windows) -> tuple[DataFrame, tuple[str, ...]]:
    wide = tree_vector(summary, variables)
    features = tuple(c for c in wide.columns if c != "stay_id")
    hours = F.explode(F.sequence(F.lit(0), F.lit(windows.horizon - 1))).alias("hour")
    cells = summary.select("stay_id", "variable", "truth", hours).withColumn(
        "y_true", F.try_element_at("truth", F.col("hour"))).drop("truth").join(wide, "stay_id")
    assembler = VectorAssembler(inputCols=[*features, "hour"], outputCol="features")
    return assembler.transform(cells).select("stay_id", "variable", "hour", "y_true", "features"), features


def gbt_fit(train_summary: DataFrame, variables: list[Variable], windows: Windows,
            max_depth: int = 4, max_iter: int = 150, learning_rate: float = 0.1) -> TreeModels:
    """Distributed fits, one per variable and some side by side, over every (stay, lead hour) with a
    target. A (variable, hour) with fewer than ten targets gets no forecast.
    Fitting runs Spark jobs, and so does the writing of cells in ``gbt_predict``; everything else in this
    module is lazy."""
    cells, features = _tree_cells(train_summary, variables, windows)
    cells = cells.filter(F.col("y_true").isNotNull())
    counts = cells.groupBy("variable", "hour").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_TARGETS)
    usable = cells.join(F.broadcast(counts.drop("n")), ["variable", "hour"], "left_semi")
    usable = durable(usable)
    regressor = GBTRegressor(featuresCol="features", labelCol="y_true", predictionCol="fitted",
                             maxDepth=max_depth, maxIter=max_iter, stepSize=learning_rate, seed=0)
    present = {r[0] for r in usable.select("variable").distinct().collect()}  # at most one per configured variable
    names = [v.name for v in variables if v.name in present]
    if not names:
        raise ValueError("no variable has enough targets")

    def fit(name: str):
        rows = usable.filter(F.col("variable") == name)
        model = regressor.fit(rows)
        return model, model.transform(rows).groupBy("variable", "hour").agg(
            F.stddev_pop(F.col("y_true") - F.col("fitted")).alias("s"))

    with ThreadPoolExecutor(min(len(names), FITS_AT_ONCE)) as pool:
        fits = dict(zip(names, pool.map(inheritable_thread_target(usable.sparkSession)(fit), names)))
    residuals = None
    for _, part in fits.values():
        residuals = part if residuals is None else residuals.unionByName(part)
    # Written once: one row per variable and hour, which else cost all trees again for each reader.
    residuals = durable(residuals.select(
        "variable", "hour", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("residual_std")))
    models = {name: model for name, (model, _) in fits.items()}
    return TreeModels(models, residuals, features)


def gbt_predict(fitted: TreeModels, summary: DataFrame, variables: list[Variable], windows: Windows) -> DataFrame:
    """Clipped forecasts; half-width 1.645 times the mean residual std of the
    variable's fitted hours (1 if none). The cells are written once: each variable's part then only
    reads them, where they would all be joined again, side by side in the same tasks."""
    cells = durable(_tree_cells(summary, variables, windows)[0])
    widths = fitted.residuals.groupBy("variable").agg((GAUSS_90 * F.avg("residual_std")).alias("width"))
    parts = []
    for v in variables:
        rows = cells.filter(F.col("variable") == v.name)
        model = fitted.models.get(v.name)
        out = model.transform(rows) if model else rows.withColumn("fitted", F.lit(None).cast("double"))
        parts.append(out.select("stay_id", "variable", "hour", "y_true", "fitted"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    fitted_hours = fitted.residuals.select("variable", "hour").withColumn("_ok", F.lit(True))
    rows = rows.join(F.broadcast(fitted_hours), ["variable", "hour"], "left").join(
        F.broadcast(widths), "variable", "left")
    rows = rows.withColumn("condition", F.lit("gbm")).withColumn(
        "y_pred", F.when(F.col("_ok"), F.col("fitted"))).withColumn("width", F.coalesce("width", F.lit(1.0)))
    return with_interval(clip_to_valid(rows, variables)).select(*COLUMNS)


def run_conditions(summary: DataFrame, conditions: list[str], variables: list[Variable], windows: Windows,
                   fill: DataFrame | None = None, trees: TreeModels | None = None,
                   external: DataFrame | None = None) -> DataFrame:
    """Every requested condition as one lazy table.

    Persistence conditions share one pass; tree forecasts need fitted models;
    any other condition must be present in ``external`` (forecasts made outside
    Spark). Names are checked before anything runs.
    """
    validate_conditions(conditions)
    flat = [c for c in conditions if c in PERSISTENCE_CONDITIONS]
    others = [c for c in conditions if c not in PERSISTENCE_CONDITIONS and c != "gbm"]
    if "gbm" in conditions and trees is None:
        raise ValueError("condition 'gbm' needs fitted trees")
    if others and external is None:
        raise ValueError(f"conditions {others} need external forecasts")
    parts = []
    if flat:
        parts.append(persistence(summary, windows, flat, fill))
    if "gbm" in conditions:
        parts.append(gbt_predict(trees, summary, variables, windows))
    if others:
        parts.append(external.filter(F.col("condition").isin(others)).select(*COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ensemble(forecasts: DataFrame, members: list[str], name: str | None = None, keys: tuple[str, ...] = (),
             same_stays: bool = False) -> DataFrame:
    """Mean forecast and mean half-width of the members, per ``keys``; null where any member is.
    ``same_stays``: members that forecast different stays are an error (runs a small job)."""
    if len(members) < 2:
        raise ValueError("an ensemble needs at least two members")
    if same_stays and member_mismatch(forecasts, members).head(1):
        raise ValueError(f"the members {members} forecast different stays")
    n = len(members)
    width = (F.col("y_upper") - F.col("y_lower")) / 2
    joined = forecasts.filter(F.col("condition").isin(members)).groupBy(*keys, "stay_id", "variable", "hour").agg(
        F.max("y_true").alias("y_true"),
        F.when(F.count("y_pred") == n, F.avg("y_pred")).alias("y_pred"),
        F.when(F.count(width) == n, F.avg(width)).alias("width"))
    return with_interval(joined.withColumn("condition", F.lit(name or "+".join(members)))).select(*keys, *COLUMNS)


def member_mismatch(forecasts: DataFrame, members: list[str]) -> DataFrame:
    """Stays some member lacks; an ensemble is only valid when this is empty."""
    return (
        forecasts.filter(F.col("condition").isin(members)).select("stay_id", "condition").distinct()
        .groupBy("stay_id").agg(F.count(F.lit(1)).alias("n_members"))
        .filter(F.col("n_members") < len(members))
    )
