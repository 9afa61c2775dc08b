"""Plausibility review of forecasts: counting, clipping, corrections, replay."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions.cells import bounds, clip, half_width, outside
from foretrace.functions.durable import durable
from foretrace.operators.forecast import with_interval
from foretrace.settings import Variable

SERIES = ("condition", "stay_id", "variable")


def _out(variables: list[Variable], y: str) -> Column:
    return outside(F.col(y), *bounds(variables, "plausible"))


def count_violations(forecasts: DataFrame, variables: list[Variable], keys=("condition", "variable"),
                     y: str = "y_pred") -> DataFrame:
    return forecasts.groupBy(*keys).agg(
        F.count(F.when(_out(variables, y), 1)).alias("violations"), F.count(y).alias("cells"))


def clip_series(forecasts: DataFrame, variables: list[Variable], y: str = "y_pred") -> DataFrame:
    """Clip-only review: values clipped to the plausible range, with the cell's
    ``violation`` and ``clipped`` flags (equal here)."""
    bad = _out(variables, y)
    return forecasts.withColumn("violation", bad).withColumn("clipped", bad).withColumn(
        y, clip(F.col(y), *bounds(variables, "plausible")))


def apply_corrections(forecasts: DataFrame, corrections: DataFrame, variables: list[Variable], max_attempts: int = 1,
                      y: str = "y_pred", keys=SERIES) -> DataFrame:
    """A series with a violation takes the supplied correction of attempt 1, 2, …
    while it still violates; a missing or wrongly sized one leaves it unchanged
    and is counted. What is still outside at the end is clipped.

    ``corrections``: keys, attempt, values (array, one per hour). Series are
    packed to one row each (horizon values), so the attempts are unrolled in
    place with one join. Returns the cells with ``violation`` (before),
    ``clipped`` (after) flags and the series' ``failed_corrections``.
    """
    keys = list(keys)
    low, high = bounds(variables, "plausible")
    others = [c for c in forecasts.columns if c not in (*keys, y)]
    series = forecasts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hour", y, *[c for c in others if c != "hour"]))).alias("cells"))
    # Later attempts than allowed are never looked at; one entry per attempt.
    packed = corrections.filter(F.col("attempt") <= max_attempts).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("attempt", "values"))).alias("tries"))
    df = series.join(packed, keys, "left").withColumn("_lo", low).withColumn("_hi", high)
    violates = lambda arr: F.exists(arr, lambda x: outside(x, F.col("_lo"), F.col("_hi")))
    df = df.withColumn("_cur", F.transform("cells", lambda c: c[y])).withColumn("_failed", F.lit(0))
    for attempt in range(1, max_attempts + 1):
        offered = F.try_element_at("tries", F.lit(attempt))
        usable = F.coalesce(F.size(offered) == F.size("_cur"), F.lit(False))
        df = df.withColumn("_bad", violates(F.col("_cur"))).withColumn("_ok", usable).withColumn(
            "_failed", F.col("_failed") + F.when(F.col("_bad") & ~F.col("_ok"), 1).otherwise(0)).withColumn(
            "_cur", F.when(F.col("_bad") & F.col("_ok"), offered).otherwise(F.col("_cur")))
    cells = df.select(*keys, "_failed", "_lo", "_hi", F.explode(F.arrays_zip("cells", "_cur")).alias("z"))
    new, old = F.col("z._cur"), F.col(f"z.cells.{y}")
    return cells.select(
        *keys, *[F.col(f"z.cells.{c}").alias(c) for c in others],
        clip(new, F.col("_lo"), F.col("_hi")).alias(y),
        outside(old, F.col("_lo"), F.col("_hi")).alias("violation"),
        outside(new, F.col("_lo"), F.col("_hi")).alias("clipped"),
        F.col("_failed").alias("failed_corrections"))


def review(raw: DataFrame, recent: DataFrame, variables: list[Variable], params, stage: str = "final",
           corrections: DataFrame | None = None, max_attempts: int = 1) -> DataFrame:
    """Post-processing and critic in the order of the stage.

    ``final``: post-process, then review what is reported. ``raw``: review the
    model's own output, then post-process the reviewed one (``y_raw`` is then
    the reviewed forecast)."""
    from foretrace.operators import postprocess

    check = lambda df, y: (
        clip_series(df, variables, y) if corrections is None
        else apply_corrections(df, corrections, variables, max_attempts, y))
    if stage == "final":
        out = check(postprocess.apply(raw, recent, variables, params), "y_pred")
        return _recentred(raw, out)
    if stage != "raw":
        raise ValueError(f"unknown stage {stage!r}")
    return postprocess.apply(check(raw, "y_raw"), recent, variables, params)


def _recentred(raw: DataFrame, reviewed: DataFrame) -> DataFrame:
    if "y_lower" not in raw.columns:
        return reviewed
    return with_interval(reviewed, half_width())


def record(reviewed: DataFrame, keys=("condition",)) -> DataFrame:
    """Violation rate before the critic and the share it fixed without clipping
    (null when there was nothing to fix)."""
    n, clipped = F.count(F.when(F.col("violation"), 1)), F.count(F.when(F.col("clipped"), 1))
    return reviewed.groupBy(*keys).agg(
        n.alias("violations"), clipped.alias("clipped"), F.count(F.lit(1)).alias("cells")).select(
        *keys, "violations", "clipped",
        (F.col("violations") / F.greatest(F.col("cells"), F.lit(1))).alias("precritic_rate"),
        F.try_divide(F.col("violations") - F.col("clipped"), "violations").alias("fixed_share"))


def raw_rate(forecasts: DataFrame, variables: list[Variable], per_variable: bool = True) -> DataFrame:
    """Violations of the forecasts post-processing started from, over known cells."""
    keys = ["condition"] + (["variable"] if per_variable else [])
    return count_violations(forecasts, variables, keys, "y_raw").withColumn(
        "violation_rate", F.col("violations") / F.greatest(F.col("cells"), F.lit(1)))


def raw_violations(forecasts: DataFrame, variables: list[Variable]) -> DataFrame:
    """Audit per condition and variable: counts below and above the range, rate,
    and the stays with any violation of the variable."""
    low, high = bounds(variables, "plausible")
    y = F.col("y_raw")
    return forecasts.filter(y.isNotNull()).groupBy("condition", "variable").agg(
        F.count(F.lit(1)).alias("cells"), F.count(F.when(y < low, 1)).alias("below"),
        F.count(F.when(y > high, 1)).alias("above"),
        F.countDistinct(F.when(_out(variables, "y_raw"), F.col("stay_id"))).alias("stays_any"),
    ).withColumn("rate", (F.col("below") + F.col("above")) / F.greatest(F.col("cells"), F.lit(1)))


def violating_stays(forecasts: DataFrame, variables: list[Variable]) -> DataFrame:
    """Stays in all and stays with a violation of any variable, per condition."""
    per_stay = forecasts.filter(F.col("y_raw").isNotNull()).groupBy("condition", "stay_id").agg(
        F.max(_out(variables, "y_raw")).alias("bad"))
    return per_stay.groupBy("condition").agg(
        F.count(F.lit(1)).alias("stays"), F.count(F.when(F.col("bad"), 1)).alias("stays_with_violation"))


# --- replay -----------------------------------------------------------------

# Arms that review the model's own output, and the one reviewed after post-processing.
ARMS = ("no_critic", "clip_raw", "corrected_raw")
FINAL = "critic_final"


def arm_pairs(arms=ARMS) -> list[tuple[str, str]]:
    """Every two raw arms, the later one first, and each raw arm against the final one."""
    return [(b, a) for a, b in combinations(arms, 2)] + [(a, FINAL) for a in arms]


def replay_arms(raw: DataFrame, variables: list[Variable], corrections: DataFrame | None = None,
                max_attempts: int = 1) -> DataFrame:
    """The raw forecasts under every arm, as one table keyed by ``condition`` = arm."""
    cells = raw.withColumn("_arm", F.explode(F.array(F.lit("no_critic"), F.lit("clip_raw"))))
    clipped = clip(F.col("y_raw"), *bounds(variables, "plausible"))
    out = cells.withColumn("y_raw", F.when(F.col("_arm") == "clip_raw", clipped).otherwise(F.col("y_raw"))).withColumn(
        "condition", F.col("_arm")).drop("_arm")
    if corrections is None:
        return out
    fixed = apply_corrections(raw, corrections, variables, max_attempts, "y_raw").withColumn(
        "condition", F.lit("corrected_raw"))
    return out.unionByName(fixed.select(*out.columns))


def replay(calibration: DataFrame, test: DataFrame, recent: DataFrame, variables: list[Variable],
           strategy: str = "global", grid: str = "standard", percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """Refit, post-process and recalibrate every arm at once.

    Inputs are arms (``replay_arms``) of the calibration and test stays with
    y_true, y_raw, y_lower, y_upper. Returns the calibrated test forecasts and
    the settings chosen per arm and variable."""
    from foretrace.operators import calibrate, postprocess

    settings = durable(postprocess.fit(calibration, recent, variables, strategy, grid, critic_stage=None))
    fitted = postprocess.apply(calibration, recent, variables, settings)
    factors = calibrate.conformal_factors(fitted, percent=percent)
    return calibrate.apply(postprocess.apply(test, recent, variables, settings), factors), settings


def replay_scores(forecasts: DataFrame, variables: list[Variable], resamples: int = 2000, alpha: float = 0.05,
                  seed: int = 42) -> DataFrame:
    """sMAPE with interval, calibrated coverage and out-of-range count per arm."""
    from foretrace.operators import metrics, stats

    errors = stats.bootstrap_ci(metrics.per_stay_smape(forecasts), ["condition"], "smape", resamples, alpha, seed)
    covered = forecasts.groupBy("condition").agg(F.avg(metrics.inside()).alias("coverage"))
    bad = count_violations(forecasts, variables, ("condition",)).withColumn(
        "out_of_range_rate", F.col("violations") / F.greatest(F.col("cells"), F.lit(1)))
    return errors.join(covered, "condition").join(bad, "condition")


def with_final(replayed: DataFrame, stored: DataFrame) -> DataFrame:
    """The replayed arms and, as a further arm, the stored forecasts of the replayed condition."""
    columns = ["stay_id", "variable", "hour", "y_true", "y_pred"]
    return replayed.select("condition", *columns).unionByName(
        stored.select(F.lit(FINAL).alias("condition"), *columns))


def replay_pairs(forecasts: DataFrame, arms=ARMS, resamples: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Paired differences of every two raw arms and of each against the final one: mean with its interval,
    share where the first is better, signed-rank test. A pair with an arm that is not there has no row."""
    from foretrace.operators import stats

    return stats.compare_differences(forecasts, arm_pairs(arms), resamples, alpha, seed)


def replay_difference(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """Largest absolute difference between a stored forecast and its replay."""
    keys = ["condition", "stay_id", "variable", "hour"]
    return stored.select(*keys, F.col("y_pred").alias("_a")).join(
        replayed.select(*keys, F.col("y_pred").alias("_b")), keys).groupBy("condition").agg(
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"))
