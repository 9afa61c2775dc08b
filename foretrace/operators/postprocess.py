"""Level anchor, drift damping and the fit of their parameters."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.cells import bounds, clip, half_width, smape_cell
from foretrace.functions.durable import durable, small
from foretrace.functions.ranks import positions
from foretrace.operators.forecast import with_interval
from foretrace.settings import CRITIC_CONDITIONS, PostprocessParams, Variable

# The parameter grids, in the order in which ties are resolved.
GRIDS = {  # dampings, anchor weights
    "standard": ((0.1, 0.25, 0.5, 0.75, 1.0), (0.0, 0.25, 0.5, 0.75)),
    "extended": ((0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0), (0.0, 0.25, 0.5, 0.75, 1.0)),
}
STRATEGIES = ("global", "vitals_labs", "per_variable")
TIE = 1e-12
SERIES = ("condition", "stay_id", "variable")


def with_first(raw: DataFrame, keys=SERIES) -> DataFrame:
    """Adds ``y_first``, the series' value at hour 0 (null when that is missing)."""
    series = Window.partitionBy(*keys)
    return raw.withColumn("y_first", F.max(F.when(F.col("hour") == 0, F.col("y_raw"))).over(series))


def adjusted(damping: Column, weight: Column) -> Column:
    """Closed form over y_raw, y_first and recent_mean (null: no shift)."""
    shift = F.coalesce(weight * (F.col("recent_mean") - F.col("y_first")), F.lit(0.0))
    start = F.col("y_first") + shift
    return F.when(damping < 1, start + damping * (F.col("y_raw") + shift - start)).otherwise(F.col("y_raw") + shift)


def is_clipped(condition: str = "condition", critic_stage: str = "final") -> Column:
    """Conditions whose last step is a critic clipping to the plausible range."""
    base = F.split(F.col(condition), "@")[0]
    return base.isin(*CRITIC_CONDITIONS) if critic_stage == "final" else F.lit(False)


def _finish(df: DataFrame, damping: Column, weight: Column, variables: list[Variable], clipped: Column) -> DataFrame:
    """Adds ``y_pred``. One named step per clip keeps the generated code small."""
    return (
        df.withColumn("_adjusted", adjusted(damping, weight))
        .withColumn("_hard", clip(F.col("_adjusted"), *bounds(variables, "hard")))
        .withColumn("y_pred", F.when(clipped, clip(F.col("_hard"), *bounds(variables, "plausible"))).otherwise(F.col("_hard")))
        .drop("_adjusted", "_hard")
    )


def apply(raw: DataFrame, recent: DataFrame, variables: list[Variable],
          params: PostprocessParams | DataFrame | None = None, critic_stage: str | None = None) -> DataFrame:
    """``y_pred`` from ``y_raw``; half-widths are kept and recentred.

    ``recent``: stay_id, variable, recent_mean. ``params`` is one setting, or a
    table (condition, variable, drift_damping, level_anchor_weight) with one row
    per fitted condition and variable. With ``critic_stage`` the conditions
    that end in a critic are clipped to the plausible range as well.
    """
    # Placed once for both the window per series and the join.
    placed = raw.repartition("stay_id", "variable")
    df = with_first(placed).join(recent.select("stay_id", "variable", "recent_mean"), ["stay_id", "variable"], "left")
    if isinstance(params, DataFrame):
        keys = ["condition", "variable"]
        df = df.join(small(params.select(*keys, "drift_damping", "level_anchor_weight"), keys), keys, "left")
        damping, weight = F.coalesce("drift_damping", F.lit(1.0)), F.coalesce("level_anchor_weight", F.lit(0.0))
    else:
        params = params or PostprocessParams()
        damping, weight = F.lit(params.drift_damping), F.lit(params.level_anchor_weight)
    clipped = is_clipped(critic_stage=critic_stage) if critic_stage else F.lit(False)
    out = _finish(df, damping, weight, variables, clipped)
    if "y_lower" in raw.columns:
        out = with_interval(out, half_width())
    return out.drop("y_first", "recent_mean", "drift_damping", "level_anchor_weight")


def contributions(raw: DataFrame, recent: DataFrame, variables: list[Variable], grid: str = "standard",
                  critic_stage: str | None = "final", keys: tuple[str, ...] = ("condition",)) -> DataFrame:
    """(keys, setting, drift_damping, level_anchor_weight, variable, term): terms
    whose sum over variables is the mean per-stay sMAPE under that setting.

    Each cell carries the weight 1 / (its stay's number of cells). A group's buffer has one sum per
    setting, to which a cell adds its closed-form errors; settings become rows after the grouping.
    """
    if grid not in GRIDS:
        raise ValueError(f"unknown grid {grid!r}")
    keys = list(keys)
    settings = list(product(*GRIDS[grid]))
    both = F.col("y_true").isNotNull() & F.col("y_raw").isNotNull()
    # One shuffle serves both windows below.
    placed = raw.repartition(*keys, "stay_id")
    df = with_first(placed, [*keys, "stay_id", "variable"]).filter(both)
    df = df.withColumn("_w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys, "stay_id")))
    df = df.join(recent.select("stay_id", "variable", "recent_mean"), ["stay_id", "variable"], "left")
    clipped = is_clipped(critic_stage=critic_stage) if critic_stage else F.lit(False)
    # One named step per clip keeps the generated code small.
    each = range(len(settings))
    df = df.withColumns({f"_y{i}": adjusted(F.lit(d), F.lit(w)) for i, (d, w) in enumerate(settings)})
    df = df.withColumns({f"_y{i}": clip(F.col(f"_y{i}"), *bounds(variables, "hard")) for i in each})
    df = df.withColumns({f"_y{i}": F.when(clipped, clip(F.col(f"_y{i}"), *bounds(variables, "plausible"))).otherwise(F.col(f"_y{i}")) for i in each})
    buffer = df.groupBy(*keys, "variable").agg(
        F.sum("_w").alias("_n"), *[F.sum(F.col("_w") * smape_cell("y_true", f"_y{i}")).alias(f"_t{i}") for i in each])
    # The weights of one stay add up to one, so their sum counts the stays.
    stays = buffer.withColumn("_stays", F.round(F.sum("_n").over(Window.partitionBy(*keys))))
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("setting"), F.lit(d).alias("drift_damping"), F.lit(w).alias("level_anchor_weight"),
                 (F.col(f"_t{i}") / F.col("_stays")).alias("term")) for i, (d, w) in enumerate(settings)]))
    return stays.select(*keys, "variable", rows.alias("s")).select(
        *keys, "s.setting", "s.drift_damping", "s.level_anchor_weight", "variable", "s.term")


def of_grid(terms: DataFrame, grid: str) -> DataFrame:
    """Terms of a grid out of those of a larger one, with that grid's order of settings."""
    rows = [(i, d, w) for i, (d, w) in enumerate(product(*GRIDS[grid]))]
    order = F.coalesce(*[F.when((F.col("drift_damping") == d) & (F.col("level_anchor_weight") == w), i) for i, d, w in rows])
    return terms.withColumn("setting", order).filter(F.col("setting").isNotNull())


def _variable_group(strategy: str, variables: list[Variable]) -> Column:
    if strategy == "global":
        return F.lit("all")
    if strategy == "vitals_labs":
        return F.when(F.col("variable").isin([v.name for v in variables if v.is_lab]), "labs").otherwise("vitals")
    if strategy == "per_variable":
        return F.col("variable")
    raise ValueError(f"unknown strategy {strategy!r}")


def choose(terms: DataFrame, variables: list[Variable], strategy: str = "global",
           keys: tuple[str, ...] = ("condition",)) -> DataFrame:
    """Best setting per (keys, variable): within each variable group the first
    setting in grid order that improves on the best so far by more than 1e-12."""
    keys = list(keys)
    scored = terms.withColumn("variable_group", _variable_group(strategy, variables)).groupBy(
        *keys, "variable_group", "setting", "drift_damping", "level_anchor_weight").agg(F.sum("term").alias("score"))
    # At most one entry per grid setting.
    ordered = F.array_sort(F.collect_list(F.struct("setting", "score", "drift_damping", "level_anchor_weight")))
    picked = scored.groupBy(*keys, "variable_group").agg(ordered.alias("_a")).withColumn("best", F.reduce(
        "_a", F.col("_a")[0],
        lambda best, x: F.when(x["score"] < best["score"] - F.lit(TIE), x).otherwise(best)))
    names = F.explode(F.array(*[F.lit(v.name) for v in variables])).alias("variable")
    members = terms.sparkSession.range(1).select(names).withColumn(
        "variable_group", _variable_group(strategy, variables))
    return picked.join(F.broadcast(members), "variable_group").select(  # one row per configured variable
        *keys, "variable", "variable_group", F.col("best.drift_damping").alias("drift_damping"),
        F.col("best.level_anchor_weight").alias("level_anchor_weight"), F.col("best.score").alias("score"))


def fit(raw: DataFrame, recent: DataFrame, variables: list[Variable], strategy: str = "global",
        grid: str = "standard", critic_stage: str | None = "final") -> DataFrame:
    """Fitted (condition, variable, drift_damping, level_anchor_weight, score)."""
    return choose(contributions(raw, recent, variables, grid, critic_stage), variables, strategy)


def cross_validate(raw: DataFrame, recent: DataFrame, variables: list[Variable],
                   critic_stage: str | None = "final") -> DataFrame:
    """(condition, strategy, grid, score): two folds by the parity of the stay's
    position; fitted on one, scored on the other, both averaged."""
    fold = positions(raw, [], "stay_id", "_p").select("stay_id", (F.col("_p") % 2).cast("int").alias("fold"))
    keys = ("condition", "fold")
    out = None
    # Small (settings x variables per condition and fold), read for every grid and strategy. All
    # grids are parts of the extended one.
    every = durable(contributions(raw.join(fold, "stay_id"), recent, variables, "extended", critic_stage, keys))
    for grid in GRIDS:
        terms = of_grid(every, grid)
        # The other fold's term of the same setting is that setting's score there.
        other = terms.withColumn("fold", 1 - F.col("fold")).select(
            *keys, "variable", "drift_damping", "level_anchor_weight", "term")
        for strategy in STRATEGIES:
            chosen = choose(terms, variables, strategy, keys)
            scored = chosen.join(other, [*keys, "variable", "drift_damping", "level_anchor_weight"]).groupBy(
                "condition").agg((F.sum("term") / 2).alias("score")).select(
                "condition", F.lit(strategy).alias("strategy"), F.lit(grid).alias("grid"), "score")
            out = scored if out is None else out.unionByName(scored)
    return out
