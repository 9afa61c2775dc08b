"""Split-conformal interval factors: fit, apply, report and diagnose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions.cells import half_width
from foretrace.functions.durable import durable, small
from foretrace.functions.pvalues import kolmogorov_p
from foretrace.functions.ranks import GROUP_LIMIT, at_ranks, quantiles
from foretrace.functions.resample import resampled_at_rank, resampled_sums
from foretrace.operators.metrics import inside, per_stay_smape, two_sample_ks
from foretrace.operators.stats import bootstrap_interval

HOUR_BAND = 8


def conformal_rank(n: Column, percent: int) -> Column:
    """min(n, ceil((n + 1) * percent / 100)) in integers."""
    return F.least(n, F.floor((F.lit(percent) * (n + 1) + 99) / 100).cast("long"))


def with_score(forecasts: DataFrame) -> DataFrame:
    """Adds ``score`` = |error| / half-width where all three exist and the width is positive."""
    w = half_width()
    return forecasts.withColumn(
        "score", F.when(w > 0, F.abs(F.col("y_true") - F.col("y_pred")) / F.nullif(w, F.lit(0.0))))


def conformal_factors(forecasts: DataFrame, keys=("condition", "variable"), percent: int = 90,
                      group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(keys, factor, n): the score at the conformal rank. A group without any
    score has no row, i.e. no factor."""
    scored = with_score(forecasts).filter(F.col("score").isNotNull()).select(*keys, "score")
    rank = conformal_rank(F.col("n_rows"), percent)
    return at_ranks(scored, list(keys), "score", {"factor": rank}, group_limit).select(
        *keys, "factor", F.col("n_rows").alias("n"))


def scaled(forecasts: DataFrame, factor: Column) -> DataFrame:
    """Both sides scaled around the forecast; a null factor leaves the interval alone."""
    return forecasts.withColumns({
        "y_lower": F.when(factor.isNull(), F.col("y_lower")).otherwise(
            F.col("y_pred") - factor * (F.col("y_pred") - F.col("y_lower"))),
        "y_upper": F.when(factor.isNull(), F.col("y_upper")).otherwise(
            F.col("y_pred") + factor * (F.col("y_upper") - F.col("y_pred")))})


def apply(forecasts: DataFrame, factors: DataFrame, keys=("condition", "variable")) -> DataFrame:
    joined = forecasts.join(small(factors.select(*keys, F.col("factor").alias("_f")), keys), list(keys), "left")
    return scaled(joined, F.col("_f")).drop("_f")


def before_after(forecasts: DataFrame, factors: DataFrame, keys=("condition", "variable"),
                 on=("condition", "variable")) -> DataFrame:
    """Coverage and width per group before and after the factors, in one pass.

    ``on``: the key of the factors. The cell that defines a factor lies on its own bound, so
    cells with a scaled interval count as covered by score <= factor, not by rebuilt ends."""
    keys, on = list(keys), list(on)
    both = forecasts.withColumn("_lo", F.col("y_lower")).withColumn("_hi", F.col("y_upper"))
    joined = both.withColumn("_hit_half", half_width()).join(small(factors.select(*on, F.col("factor").alias("_f")), on), on, "left")
    error, half = F.abs(F.col("y_true") - F.col("y_pred")), F.col("_hit_half")
    scaled_hit = F.when(half > 0, error / F.nullif(half, F.lit(0.0)) <= F.col("_f")).otherwise(error <= F.col("_f") * half).cast("double")
    after = scaled(joined.withColumn("_now", F.when(F.col("_f").isNull(), inside()).otherwise(scaled_hit)), F.col("_f"))
    factor_cols = factors.select(*on, "factor")
    was = F.when(
        F.col("y_true").isNotNull() & F.col("_lo").isNotNull() & F.col("_hi").isNotNull(),
        F.col("y_true").between(F.col("_lo"), F.col("_hi")).cast("double"))
    out = after.groupBy(*keys).agg(
        F.avg(was).alias("coverage_before"), F.avg("_now").alias("coverage_after"),
        F.avg(F.col("_hi") - F.col("_lo")).alias("width_before"),
        F.avg(F.col("y_upper") - F.col("y_lower")).alias("width_after"))
    return out.join(factor_cols, keys, "left") if keys == on else out


def report(calibration: DataFrame, percent: int = 90) -> DataFrame:
    """Per condition and variable: factor, coverage and width before and after,
    with the condition's pooled coverage and mean per-stay sMAPE."""
    factors = durable(conformal_factors(calibration, percent=percent))
    per_variable = before_after(calibration, factors)
    pooled = before_after(calibration, factors, ("condition",)).select(
        "condition", F.col("coverage_before").alias("pooled_before"), F.col("coverage_after").alias("pooled_after"))
    means = per_stay_smape(calibration).groupBy("condition").agg(F.avg("smape").alias("smape_mean"))
    return per_variable.join(pooled, "condition").join(means, "condition")


def settings_key(*parts) -> Column:
    """Digest of the settings a forecast was made with, whoever was forecast."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def apply_to_test(test: DataFrame, factors: DataFrame) -> DataFrame:
    """Before/after coverage and width on test forecasts of factors fitted under
    the same ``settings_key``, with the pooled coverage of the condition; forecasts of other
    settings are left out (see ``rejected``)."""
    keys = ["condition", "variable", "settings_key"]
    both = ["condition", "settings_key"]
    matched = test.join(small(factors.select(*both).distinct(), both), both, "left_semi")
    pooled = before_after(matched, factors, both, keys).select(
        *both, F.col("coverage_before").alias("pooled_before"), F.col("coverage_after").alias("pooled_after"))
    return before_after(matched, factors, keys, keys).join(pooled, both)


def rejected(test: DataFrame, factors: DataFrame) -> DataFrame:
    """Conditions whose factors were fitted under other settings."""
    return test.select("condition", "settings_key").distinct().join(
        factors.select("condition", "settings_key").distinct(), ["condition", "settings_key"], "left_anti")


def hour_band(width: int = HOUR_BAND) -> Column:
    return F.floor(F.col("hour") / width).cast("int")


def covered_by(factor: Column) -> Column:
    """Cell indicator |error| <= factor * half-width, null when anything is missing.
    Written as score <= factor, so the cell that defines the factor is covered."""
    error, w = F.abs(F.col("y_true") - F.col("y_pred")), half_width()
    return F.when(w > 0, error / F.nullif(w, F.lit(0.0)) <= factor).otherwise(error <= factor * w).cast("double")


def by_group(calibration: DataFrame, test: DataFrame, group: str, percent: int = 90, zero_falls_back: bool = False) -> DataFrame:
    """One factor per (condition, variable, group), falling back to the single
    factor where the group's is missing or, if asked for, 0; coverage per group and overall and
    mean width relative to the single factor."""
    keys = ["condition", "variable"]
    single = conformal_factors(calibration, keys, percent).select(*keys, F.col("factor").alias("single"))
    fine = conformal_factors(calibration, [*keys, group], percent).select(*keys, group, F.col("factor").alias("fine"))
    cells = test.join(small(single, keys), keys).join(small(fine, [*keys, group]), [*keys, group], "left")
    use = F.coalesce(F.nullif("fine", F.lit(0.0)) if zero_falls_back else F.col("fine"), F.col("single"))
    w = half_width()
    grouped = cells.withColumn("_use", use).withColumn("_hit", covered_by(use)).withColumn("_w", w)
    overall = grouped.groupBy(*keys).agg(
        F.avg("_hit").alias("coverage_all"), (F.avg(F.col("_w") * F.col("_use")) / F.avg(F.col("_w") * F.col("single"))).alias("width_ratio"))
    return grouped.groupBy(*keys, group).agg(
        F.max("fine").alias("factor"), F.avg("_hit").alias("coverage"), F.count("_hit").alias("n_cells")
    ).join(overall, keys)


def mondrian(calibration: DataFrame, test: DataFrame, measured: DataFrame, percent: int = 90) -> DataFrame:
    """``by_group`` over measured / not measured in the observation window.
    ``measured``: stay_id, variable, measured (boolean). A factor of 0 falls back to the single one."""
    label = F.when(F.col("measured"), "measured").otherwise("not_measured")
    tag = lambda df: df.join(measured, ["stay_id", "variable"]).withColumn("window_group", label).drop("measured")
    return by_group(tag(calibration), tag(test), "window_group", percent, zero_falls_back=True)


def by_hour(calibration: DataFrame, test: DataFrame, percent: int = 90, width: int = HOUR_BAND) -> DataFrame:
    return by_group(calibration.withColumn("band", hour_band(width)), test.withColumn("band", hour_band(width)), "band", percent)


def diagnose(calibration: DataFrame, test: DataFrame, percent: int = 90) -> DataFrame:
    """Per condition and variable: factor, coverage, stays and cells on both
    sets, score median and 90th percentile, and the KS distance of the scores with its p-value.
    Calibration stays and cells are counted by known truths, test ones by scored cells."""
    keys = ["condition", "variable"]
    factors = conformal_factors(calibration, keys, percent).select(*keys, "factor")
    columns = [*keys, "stay_id", "y_true", "y_pred", "y_lower", "y_upper"]
    tagged = with_score(calibration.select(*columns, F.lit("cal").alias("set")).unionByName(
        test.select(*columns, F.lit("test").alias("set"))))
    cells = tagged.join(small(factors, keys), keys)
    hit = covered_by(F.col("factor"))
    per_stay = cells.groupBy(*keys, "factor", "set", "stay_id").agg(
        F.sum(hit).alias("hits"), F.count(hit).alias("cells"), F.count("y_true").alias("truths"))
    sides = [
        (f(F.when(F.col("set") == s, e)).alias(f"{s}_{n}"))
        for s in ("cal", "test") for n, f, e in (
            ("hits", F.sum, F.col("hits")), ("scored", F.sum, F.col("cells")),
            ("cells", F.sum, F.col("truths" if s == "cal" else "cells")),
            ("stays", F.count, F.when(F.col("truths" if s == "cal" else "cells") > 0, 1)))]
    both = per_stay.groupBy(*keys, "factor").agg(*sides)
    spread = quantiles(tagged.filter(F.col("score").isNotNull()), [*keys, "set"], "score", {"median": 0.5, "p90": 0.9})
    wide = spread.groupBy(*keys).agg(*[
        F.max(F.when(F.col("set") == s, F.col(c))).alias(f"{s}_{c}") for s in ("cal", "test") for c in ("median", "p90")])
    gap = two_sample_ks(tagged.filter(F.col("score").isNotNull()).select(*keys, "score", "set"), keys, "score",
                        F.col("set") == "cal").select(*keys, "ks_statistic", "n1", "n2").withColumn("ks_p_value", kolmogorov_p("ks_statistic", "n1", "n2")).drop("n1", "n2")
    return both.select(
        *keys, "factor",
        F.try_divide("cal_hits", "cal_scored").alias("cal_coverage"), "cal_stays", "cal_cells",
        F.try_divide("test_hits", "test_scored").alias("test_coverage"), "test_stays", "test_cells",
    ).join(wide, keys, "left").join(gap, keys, "left")


def coverage_by(test: DataFrame, factors: DataFrame, group: Column, name: str) -> DataFrame:
    """Coverage under the single factor, split by any grouping of the test cells."""
    keys = ["condition", "variable"]
    cells = test.join(small(factors.select(*keys, "factor"), keys), keys)
    return cells.groupBy(*keys, group.alias(name)).agg(
        F.avg(covered_by(F.col("factor"))).alias("coverage"), F.countDistinct("stay_id").alias("n_stays"))


def bootstrap_coverage(test: DataFrame, factors: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """5-95 % interval of the coverage over resampled stays (ratio of sums)."""
    keys = ["condition", "variable"]
    hit = covered_by(F.col("factor"))
    stays = test.join(small(factors.select(*keys, "factor"), keys), keys).groupBy(*keys, "stay_id").agg(
        F.sum(hit).alias("hits"), F.count(hit).alias("cells")).filter(F.col("cells") > 0)
    sums = resampled_sums(stays, keys, "stay_id", ["hits", "cells"], resamples, seed)
    return bootstrap_interval(sums.select(*keys, "b", (F.col("hits") / F.col("cells")).alias("value")), keys, 0.10)


def bootstrap_factor(calibration: DataFrame, resamples: int = 500, percent: int = 90, seed: int = 42) -> DataFrame:
    """5-95 % interval of the factor over resampled stays.

    A resample is a multiplicity per stay, so the factor is a weighted order
    statistic of the scores (see functions.resample).
    """
    keys = ["condition", "variable"]
    stays = with_score(calibration).filter(F.col("y_true").isNotNull()).groupBy(*keys, "stay_id").agg(
        F.collect_list("score").alias("scores"))
    factors = resampled_at_rank(durable(stays), keys, "stay_id", "scores", resamples, seed, conformal_rank(F.col("n_rows"), percent))
    return bootstrap_interval(factors, keys, 0.10)
