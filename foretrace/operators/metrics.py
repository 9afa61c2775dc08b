"""Point, distribution and interval metrics as grouped aggregates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions.cells import bounds, observed, outside, smape_cell
from foretrace.functions.pvalues import ks_p
from foretrace.functions.ranks import quantiles, running_totals
from foretrace.settings import Variable


def smape_col(y_true="y_true", y_pred="y_pred") -> Column:
    """Mean over cells with both values; the cell is null otherwise."""
    return F.avg(smape_cell(y_true, y_pred))


def point_metrics(forecasts: DataFrame, keys=("condition", "variable")) -> DataFrame:
    error = F.when(observed(), F.col("y_true") - F.col("y_pred"))
    return forecasts.groupBy(*keys).agg(
        smape_col().alias("smape"), F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"), F.count(error).alias("n_obs"))


def two_sample_ks(df: DataFrame, keys: list[str], value: str, is_first: Column, group_limit: int | None = None) -> DataFrame:
    """(keys, n1, n2, ks_statistic): largest gap between two empirical CDFs."""
    limit = {"group_limit": group_limit} if group_limit else {}
    cum = running_totals(df, keys, value, {
        "a": F.when(is_first, 1).otherwise(0), "b": F.when(is_first, 0).otherwise(1)}, **limit)
    joined = cum.withColumnsRenamed({"a_total": "n1", "b_total": "n2"}).filter((F.col("n1") > 0) & (F.col("n2") > 0))
    gap = F.abs(F.col("a_cum") / F.col("n1") - F.col("b_cum") / F.col("n2"))
    return joined.groupBy(*keys, "n1", "n2").agg(F.max(gap).alias("ks_statistic"))


def ks(forecasts: DataFrame, keys=("condition", "variable"), p_value: bool = True) -> DataFrame:
    """Two-sample test of truth against forecast over the paired cells."""
    keys = list(keys)
    both = F.explode(F.array(
        F.struct(F.col("y_true").alias("v"), F.lit(True).alias("first")),
        F.struct(F.col("y_pred").alias("v"), F.lit(False).alias("first"))))
    samples = forecasts.filter(observed()).select(*keys, both.alias("s")).select(*keys, "s.v", "s.first")
    out = two_sample_ks(samples, keys, "v", F.col("first"))
    out = out.select(*keys, "ks_statistic", "n1", "n2")
    return out.withColumn("p_value", ks_p("ks_statistic", "n1", "n2")) if p_value else out


def correlation(forecasts: DataFrame, variables: list[Variable], keys=("condition",)) -> DataFrame:
    """One row per key and variable pair: correlation of the truths and of the
    forecasts over the hours complete in every variable."""
    names = [v.name for v in variables]
    wide = forecasts.groupBy(*keys, "stay_id", "hour").agg(
        *[F.max(F.when(F.col("variable") == n, F.col("y_true"))).alias(f"t{i}") for i, n in enumerate(names)],
        *[F.max(F.when(F.col("variable") == n, F.col("y_pred"))).alias(f"p{i}") for i, n in enumerate(names)])
    complete = wide.dropna(subset=[f"{s}{i}" for s in "tp" for i in range(len(names))])
    pairs = list(combinations(range(len(names)), 2))
    one = complete.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.corr(f"{s}{i}", f"{s}{j}").alias(f"{s}{i}_{j}") for s in "tp" for i, j in pairs])
    rows = F.explode(F.array(*[
        F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"),
                 F.col(f"t{i}_{j}").alias("true_corr"), F.col(f"p{i}_{j}").alias("pred_corr")) for i, j in pairs]))
    return one.filter(F.col("n") >= 2).select(*keys, "n", rows.alias("r")).select(
        *keys, "n", F.col("r.a").alias("variable_a"), F.col("r.b").alias("variable_b"), "r.true_corr", "r.pred_corr")


def frobenius(correlations: DataFrame, keys=("condition",)) -> DataFrame:
    """Norm of the difference of the two matrices (each pair counts twice).
    Null as soon as one correlation is undefined."""
    gap = F.col("true_corr") - F.col("pred_corr")
    return correlations.groupBy(*keys, "n").agg(
        F.when(F.count(gap) == F.count(F.lit(1)), F.sqrt(2 * F.sum(gap * gap))).alias("frobenius_diff"))


def violation_rate(forecasts: DataFrame, variables: list[Variable], keys=("condition", "variable"),
                   y: str = "y_pred") -> DataFrame:
    """Share of forecasts outside the plausible range; null for a variable without one."""
    low, high = bounds(variables, "plausible")
    ranged = low.isNotNull() | high.isNotNull()
    flag = F.when(F.col(y).isNotNull() & ranged, outside(F.col(y), low, high).cast("double"))
    return forecasts.groupBy(*keys).agg(F.avg(flag).alias("violation_rate"))


def per_stay_smape(forecasts: DataFrame, keys=("condition",)) -> DataFrame:
    """sMAPE of each stay, pooled over variables and hours; null without a cell."""
    return forecasts.groupBy(*keys, "stay_id").agg(smape_col().alias("smape"))


def inside(slack: float = 0.0) -> Column:
    """Cell indicator, ends included; ``slack`` widens the interval by that share."""
    low, high = F.col("y_lower"), F.col("y_upper")
    margin = slack * (high - low) if slack else F.lit(0.0)
    return F.when(
        F.col("y_true").isNotNull() & low.isNotNull() & high.isNotNull(),
        F.col("y_true").between(low - margin, high + margin).cast("double"))


def coverage(forecasts: DataFrame, keys=("condition", "variable")) -> DataFrame:
    return forecasts.groupBy(*keys).agg(F.avg(inside()).alias("coverage"), F.count(inside()).alias("n_cells"))


def width(forecasts: DataFrame, keys=("condition", "variable")) -> DataFrame:
    return forecasts.groupBy(*keys).agg(F.avg(F.col("y_upper") - F.col("y_lower")).alias("width"))


def report(forecasts: DataFrame, variables: list[Variable], keys=("condition", "variable"),
           p_value: bool = True) -> DataFrame:
    """Point metrics, violations, coverage, width in one aggregation, plus the
    KS statistic per (condition, variable) and the condition's Frobenius norm."""
    keys = list(keys)
    low, high = bounds(variables, "plausible")
    ranged = low.isNotNull() | high.isNotNull()
    error = F.when(observed(), F.col("y_true") - F.col("y_pred"))
    flag = F.when(F.col("y_pred").isNotNull() & ranged, outside(F.col("y_pred"), low, high).cast("double"))
    base = forecasts.groupBy(*keys).agg(
        smape_col().alias("smape"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count(error).alias("n_obs"), F.avg(flag).alias("violation_rate"), F.avg(inside()).alias("coverage"),
        F.avg(F.col("y_upper") - F.col("y_lower")).alias("width"))
    over = [k for k in keys if k != "variable"]
    out = base.join(ks(forecasts, keys, p_value).drop("n1", "n2"), keys, "left")
    if over:
        out = out.join(frobenius(correlation(forecasts, variables, over), over).drop("n"), over, "left")
    return out


def trial_metrics(forecasts: DataFrame, variables: list[Variable], keys=("trial", "condition"),
                  flags: DataFrame | None = None) -> DataFrame:
    """Scalars of one tuning trial: number of stays, mean and median per-stay
    sMAPE, coverage and mean violation rate, plus fallback and filled rates
    from ``flags`` (keys, stay_id, fallback, n_filled) when given."""
    keys = list(keys)
    stays = per_stay_smape(forecasts, keys)
    means = stays.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_stays"), F.avg("smape").alias("smape_mean"))
    medians = quantiles(stays, keys, "smape", {"smape_median": 0.5}).drop("n_rows")
    covered = forecasts.groupBy(*keys).agg(F.avg(inside()).alias("coverage"))
    rates = violation_rate(forecasts, variables, [*keys, "variable"]).groupBy(*keys).agg(
        F.avg("violation_rate").alias("violation_rate"))
    out = means.join(medians, keys, "left").join(covered, keys).join(rates, keys)
    if flags is None:
        return out.withColumn("fallback_rate", F.lit(0.0)).withColumn("filled_rate", F.lit(0.0))
    n = F.count(F.lit(1))
    failures = flags.groupBy(*keys).agg(
        (F.sum(F.col("fallback").cast("double")) / n).alias("fallback_rate"),
        (F.sum("n_filled") / (n * len(variables))).alias("filled_rate"))
    return out.join(failures, keys, "left")
