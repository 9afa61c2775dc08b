"""Metrics, interval calibration and coverage diagnosis."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from foretrace.functions.durable import durable
from foretrace.functions.resample import mix_sql, stream_starts
from foretrace.operators import calibrate, metrics
from foretrace.plans import standin as S
from foretrace.plans.parts import SMAPE, kolmogorov_sql
from foretrace.plans.registry import part, register

POINT = f"avg({SMAPE}) AS smape, avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, count(y_true - y_pred) AS n_obs"
HIT = "CASE WHEN y_true IS NOT NULL AND y_lower IS NOT NULL AND y_upper IS NOT NULL THEN CAST(y_true BETWEEN y_lower AND y_upper AS DOUBLE) END"
BAD = "CAST(y_pred < 5 OR y_pred > 150 AS DOUBLE)"


@register("naive_point_metrics", "variable:s smape:d mae:d rmse:d n_obs:i",
          f"SELECT variable, {POINT} FROM persistence WHERE condition = 'naive' AND split = 'test' GROUP BY 1")
def naive_point_metrics(spark, sf):
    return metrics.point_metrics(S.Workspace(spark, sf).persistence("test").filter(F.col("condition") == "naive"), ("variable",))


@register("metric_points", "condition:s variable:s smape:d mae:d rmse:d n_obs:i",
          f"SELECT condition, variable, {POINT} FROM test_set GROUP BY ALL")
def points(spark, sf):
    return metrics.point_metrics(S.Workspace(spark, sf).finished("test"))


@register("metric_pooled_points", "condition:s smape:d mae:d rmse:d n_obs:i", f"SELECT condition, {POINT} FROM test_set GROUP BY ALL")
def pooled_points(spark, sf):
    return metrics.point_metrics(S.Workspace(spark, sf).finished("test"), ("condition",))


part("ks_values", """
SELECT condition, variable, y_true AS v, 1 AS a, 0 AS b FROM test_set WHERE y_true IS NOT NULL AND y_pred IS NOT NULL
UNION ALL SELECT condition, variable, y_pred, 0, 1 FROM test_set WHERE y_true IS NOT NULL AND y_pred IS NOT NULL""")
part("ks_stats", """
SELECT condition, variable, max(abs(ca/na - cb/nb)) AS ks_statistic, max(na) AS n1 FROM (
  SELECT condition, variable, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER g AS na, sum(b) OVER g AS nb FROM ks_values
  WINDOW w AS (PARTITION BY condition, variable ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), g AS (PARTITION BY condition, variable))
GROUP BY ALL""")


@register("metric_ks_two_sample", "condition:s variable:s ks_statistic:d n1:i", "SELECT * FROM ks_stats")
def ks(spark, sf):
    return metrics.ks(S.Workspace(spark, sf).finished("test"), p_value=False)


@register("metric_ks_p_values", "condition:s variable:s ks_statistic:d p_value:d p_log10:d", f"""
SELECT *, log10(p_value) AS p_log10 FROM (SELECT condition, variable, ks_statistic, {kolmogorov_sql('ks_statistic', 'n1', 'n1')} AS p_value FROM ks_stats)""")
def ks_p_values(spark, sf):
    return metrics.ks(S.Workspace(spark, sf).finished("test")).withColumn("p_log10", F.log10("p_value"))


PAIRS = list(combinations(range(len(S.NAMES)), 2))
part("complete_hours", f"""
SELECT condition, stay_id, hour, {', '.join(f"max(y_true) FILTER (variable = '{n}') AS t{i}, max(y_pred) FILTER (variable = '{n}') AS p{i}" for i, n in enumerate(S.NAMES))}
FROM test_set GROUP BY ALL HAVING count(y_true) = 5 AND count(y_pred) = 5""")
part("correlations", " UNION ALL ".join(
    f"SELECT condition, count(*) AS n, '{S.NAMES[i]}' AS variable_a, '{S.NAMES[j]}' AS variable_b, corr(t{i}, t{j}) AS true_corr, corr(p{i}, p{j}) AS pred_corr "
    f"FROM complete_hours GROUP BY condition HAVING count(*) >= 2" for i, j in PAIRS))


@register("metric_correlation_pairs", "condition:s variable_a:s variable_b:s n:i true_corr:d pred_corr:d", "SELECT * FROM correlations")
def correlation_pairs(spark, sf):
    return metrics.correlation(S.Workspace(spark, sf).finished("test"), S.VARIABLES)


@register("metric_correlation_frobenius", "condition:s n:i frobenius_diff:d", """
SELECT condition, n, sqrt(2*sum(pow(true_corr - pred_corr, 2))) AS frobenius_diff FROM correlations GROUP BY ALL""")
def frobenius(spark, sf):
    return metrics.frobenius(metrics.correlation(S.Workspace(spark, sf).finished("test"), S.VARIABLES))


@register("metric_violation_rate", "condition:s variable:s violation_rate:d",
          f"SELECT condition, variable, avg({BAD}) AS violation_rate FROM test_set GROUP BY ALL")
def violation_rate(spark, sf):
    return metrics.violation_rate(S.Workspace(spark, sf).finished("test"), S.VARIABLES)


@register("metric_per_stay_smape", "condition:s stay_id:i smape:d", "SELECT * FROM per_stay")
def per_stay(spark, sf):
    return metrics.per_stay_smape(S.Workspace(spark, sf).finished("test"))


@register("metric_coverage", "condition:s variable:s coverage:d n_cells:i",
          f"SELECT condition, variable, avg({HIT}) AS coverage, count({HIT}) AS n_cells FROM test_set GROUP BY ALL")
def coverage(spark, sf):
    return metrics.coverage(S.Workspace(spark, sf).finished("test"))


@register("metric_pooled_coverage", "condition:s coverage:d n_cells:i",
          f"SELECT condition, avg({HIT}) AS coverage, count({HIT}) AS n_cells FROM test_set GROUP BY ALL")
def pooled_coverage(spark, sf):
    return metrics.coverage(S.Workspace(spark, sf).finished("test"), ("condition",))


@register("metric_interval_width", "condition:s variable:s width:d",
          "SELECT condition, variable, avg(y_upper - y_lower) AS width FROM test_set GROUP BY ALL")
def width(spark, sf):
    return metrics.width(S.Workspace(spark, sf).finished("test"))


REPORT = "condition:s variable:s smape:d mae:d rmse:d n_obs:i violation_rate:d coverage:d width:d ks_statistic:d frobenius_diff:d"
REPORT_SQL = f"""
SELECT m.*, ks_statistic, frobenius_diff FROM (
  SELECT condition, variable, {POINT}, avg({BAD}) AS violation_rate, avg({HIT}) AS coverage, avg(y_upper - y_lower) AS width FROM test_set GROUP BY ALL) m
LEFT JOIN ks_stats USING (condition, variable)
LEFT JOIN (SELECT condition, sqrt(2*sum(pow(true_corr - pred_corr, 2))) AS frobenius_diff FROM correlations GROUP BY ALL) USING (condition)"""


@register("metric_full_report", REPORT, REPORT_SQL)
def full_report(spark, sf):
    return metrics.report(durable(S.Workspace(spark, sf).finished("test")), S.VARIABLES, p_value=False)


@register("summary_rows_store", "condition:s variable:s smape:d mae:d model:s",
          f"SELECT condition, variable, {POINT}, 'm1' AS model FROM test_set GROUP BY ALL")
def summary_store(spark, sf):
    from foretrace.plans.cohort_queries import scratch
    from foretrace.sources import sinks

    path = scratch(spark, "summary")
    sinks.write_summary(metrics.point_metrics(S.Workspace(spark, sf).finished("test")), path, model="m1")
    return spark.read.option("header", True).schema(
        "condition string, variable string, smape double, mae double, rmse double, n_obs long, model string").csv(path)


@register("metric_trial_scalars", "trial:s condition:s n_stays:i smape_mean:d smape_median:d coverage:d violation_rate:d", f"""
SELECT 't1' AS trial, condition, count(*) AS n_stays, avg(smape) AS smape_mean, quantile_cont(smape, 0.5) AS smape_median,
  max(coverage) AS coverage, max(violation_rate) AS violation_rate
FROM per_stay JOIN (SELECT condition, avg({HIT}) AS coverage FROM test_set GROUP BY ALL) USING (condition)
JOIN (SELECT condition, avg(r) AS violation_rate FROM (SELECT condition, variable, avg({BAD}) AS r FROM test_set GROUP BY ALL) GROUP BY ALL) USING (condition)
GROUP BY ALL""")
def trial_scalars(spark, sf):
    done = durable(S.Workspace(spark, sf).finished("test").withColumn("trial", F.lit("t1")))
    return metrics.trial_metrics(done, S.VARIABLES)


# --- calibration ---------------------------------------------------------------

@register("conformal_factors", "condition:s variable:s factor:d n:i", "SELECT * FROM factors")
def factors_query(spark, sf):
    return calibrate.conformal_factors(S.Workspace(spark, sf).finished("calibration"))


part("calibrated", """
SELECT t.*, factor, CASE WHEN factor IS NULL THEN y_lower ELSE y_pred - factor*half END AS lo, CASE WHEN factor IS NULL THEN y_upper ELSE y_pred + factor*half END AS hi
FROM test_set t LEFT JOIN factors USING (condition, variable)""")
IN = "CAST(CASE WHEN factor IS NULL THEN y_true BETWEEN y_lower AND y_upper ELSE abs(y_true - y_pred)/half <= factor END AS DOUBLE)"


def both(spark, sf):
    ws = S.Workspace(spark, sf)
    return ws, durable(ws.finished("calibration")), durable(ws.finished("test"))


@register("conformal_intervals_applied", "condition:s stay_id:i variable:s hour:i y_lower:d y_upper:d",
          "SELECT condition, stay_id, variable, hour, lo AS y_lower, hi AS y_upper FROM calibrated")
def applied(spark, sf):
    _, cal, test = both(spark, sf)
    return calibrate.apply(test, calibrate.conformal_factors(cal))


@register("calibration_report", "condition:s variable:s factor:d coverage_before:d coverage_after:d width_before:d width_after:d pooled_before:d pooled_after:d smape_mean:d", f"""
SELECT v.*, pooled_before, pooled_after, smape_mean FROM (
  SELECT condition, variable, max(factor) AS factor, avg({HIT}) AS coverage_before, avg({IN}) AS coverage_after,
    avg(y_upper - y_lower) AS width_before, avg(hi - lo) AS width_after FROM cal_scaled GROUP BY ALL) v
JOIN (SELECT condition, avg({HIT}) AS pooled_before, avg({IN}) AS pooled_after FROM cal_scaled GROUP BY ALL) USING (condition)
JOIN (SELECT condition, avg(s) AS smape_mean FROM (SELECT condition, stay_id, avg({SMAPE}) AS s FROM calibration GROUP BY ALL) GROUP BY ALL) USING (condition)""")
def calibration_report(spark, sf):
    return calibrate.report(durable(S.Workspace(spark, sf).finished("calibration")))


part("cal_scaled", """
SELECT t.*, factor, CASE WHEN factor IS NULL THEN y_lower ELSE y_pred - factor*half END AS lo, CASE WHEN factor IS NULL THEN y_upper ELSE y_pred + factor*half END AS hi
FROM calibration t LEFT JOIN factors USING (condition, variable)""")


part("keyed_test", """
SELECT *, CASE WHEN factor IS NULL THEN y_lower ELSE y_pred - factor*half END AS lo, CASE WHEN factor IS NULL THEN y_upper ELSE y_pred + factor*half END AS hi FROM (
  SELECT t.* EXCLUDE (factor, lo, hi), sha256(split_part(condition, '@', 1) || '|v' || k) AS settings_key, factor + 0.25*(k - 1) AS factor
  FROM (SELECT *, 1 + stay_id % 2 AS k FROM calibrated WHERE condition NOT LIKE '%@alt') t)""")


@register("calibration_on_test", "condition:s variable:s settings_key:s factor:d coverage_before:d coverage_after:d width_before:d width_after:d pooled_before:d pooled_after:d", f"""
SELECT v.*, pooled_before, pooled_after FROM (
  SELECT condition, variable, settings_key, max(factor) AS factor, avg({HIT}) AS coverage_before, avg({IN}) AS coverage_after,
    avg(y_upper - y_lower) AS width_before, avg(hi - lo) AS width_after FROM keyed_test GROUP BY ALL) v
JOIN (SELECT condition, settings_key, avg({HIT}) AS pooled_before, avg({IN}) AS pooled_after FROM keyed_test GROUP BY ALL) USING (condition, settings_key)""")
def calibration_on_test(spark, sf):
    """Half of the stays were forecast under a second setting, whose factors are wider. The '@alt'
    forecasts carry keys without factors and are left out."""
    _, cal, test = both(spark, sf)
    base = F.split("condition", "@")[0]
    fitted = calibrate.conformal_factors(cal).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    factors = fitted.withColumn("factor", F.col("factor") + 0.25 * (F.col("k") - 1)).withColumn(
        "settings_key", calibrate.settings_key(base, F.concat(F.lit("v"), F.col("k").cast("string"))))
    version = F.when(F.col("condition").endswith("@alt"), "v3").otherwise(F.concat(F.lit("v"), (1 + F.col("stay_id") % 2).cast("string")))
    return calibrate.apply_to_test(test.withColumn("settings_key", calibrate.settings_key(base, version)), factors)


@register("calibration_rejected_settings", "condition:s", "SELECT DISTINCT condition FROM test_set WHERE condition LIKE '%@alt'")
def rejected(spark, sf):
    _, cal, test = both(spark, sf)
    factors = calibrate.conformal_factors(cal).withColumn("settings_key", calibrate.settings_key(F.split("condition", "@")[0], "v1"))
    keyed = test.withColumn("settings_key", calibrate.settings_key(
        F.split("condition", "@")[0], F.when(F.col("condition").endswith("@alt"), "v2").otherwise("v1")))
    return calibrate.rejected(keyed, factors)


def grouped_sql(cal_tag, test_tag, group, zero=False):
    """One factor per group with fallback to the single one where it is missing or, with ``zero``, 0."""
    fine = "nullif(f.factor, 0)" if zero else "f.factor"
    def fitted(keys):
        return f"""(SELECT {keys}, score AS factor FROM (
        SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM (
          SELECT {keys}, abs(y_true - y_pred)/half AS score FROM ({cal_tag}) WHERE y_true IS NOT NULL)
        WINDOW w AS (PARTITION BY {keys} ORDER BY score)) WHERE r = least(n, (9*(n + 1) + 9)//10))"""

    return f"""
SELECT condition, variable, {group}, max(fine) AS factor, avg(hit) AS coverage, count(hit) AS n_cells, max(cov) AS coverage_all, max(ratio) AS width_ratio FROM (
  SELECT *, avg(hit) OVER g AS cov, (avg(half*used) OVER g)/(avg(half*single) OVER g) AS ratio FROM (
    SELECT *, CAST(abs(y_true - y_pred)/half <= used AS DOUBLE) AS hit FROM (
      SELECT t.*, s.factor AS single, f.factor AS fine, coalesce({fine}, s.factor) AS used
      FROM ({test_tag}) t JOIN {fitted('condition, variable')} s USING (condition, variable)
      LEFT JOIN {fitted(f'condition, variable, {group}')} f
      USING (condition, variable, {group})))
  WINDOW g AS (PARTITION BY condition, variable)) GROUP BY ALL"""


PERFECT = "CASE WHEN variable = 'view' AND hour < 8 AND y_true IS NOT NULL THEN y_pred ELSE y_true END"
GROUPED = "factor:d coverage:d n_cells:i coverage_all:d width_ratio:d"
MEASURED = "(SELECT stay_id, variable, CASE WHEN n_obs > 6 THEN 'measured' ELSE 'not_measured' END AS window_group FROM summary)"


@register("coverage_by_window_group", f"condition:s variable:s window_group:s {GROUPED}", grouped_sql(
    f"SELECT * FROM calibration JOIN {MEASURED} USING (stay_id, variable)",
    f"SELECT * FROM test_set JOIN {MEASURED} USING (stay_id, variable)", "window_group", zero=True))
def by_window(spark, sf):
    """Often measured (more than six bins) plays 'measured in the window'."""
    ws, cal, test = both(spark, sf)
    measured = ws.series().select("stay_id", "variable", (F.col("n_obs") > 6).alias("measured"))
    return calibrate.mondrian(cal, test, measured)


@register("coverage_by_hour_band", f"condition:s variable:s band:i {GROUPED}", grouped_sql(
    f"SELECT * REPLACE ({PERFECT} AS y_true), hour//8 AS band FROM calibration", "SELECT *, hour//8 AS band FROM test_set", "band"))
def by_hour(spark, sf):
    """One variable is calibrated on perfect forecasts of the first band, so its factor there is 0."""
    _, cal, test = both(spark, sf)
    perfect = (F.col("variable") == "view") & (F.col("hour") < 8) & F.col("y_true").isNotNull()
    return calibrate.by_hour(cal.withColumn("y_true", F.when(perfect, F.col("y_pred")).otherwise(F.col("y_true"))), test)


DIAG = ("condition:s variable:s factor:d cal_coverage:d cal_stays:i cal_cells:i test_coverage:d test_stays:i test_cells:i "
        "cal_median:d cal_p90:d test_median:d test_p90:d ks_statistic:d ks_p_value:d")
part("all_scores", """
SELECT 'cal' AS side, condition, variable, stay_id, hour, abs(y_true - y_pred)/half AS score FROM calibration WHERE y_true IS NOT NULL
UNION ALL SELECT 'test', condition, variable, stay_id, hour, abs(y_true - y_pred)/half FROM test_set WHERE y_true IS NOT NULL""")


def side_sql(s):
    return f"""avg(CAST(score <= factor AS DOUBLE)) FILTER (side = '{s}') AS {s}_coverage, count(DISTINCT stay_id) FILTER (side = '{s}') AS {s}_stays,
    count(*) FILTER (side = '{s}') AS {s}_cells, quantile_cont(score, 0.5) FILTER (side = '{s}') AS {s}_median, quantile_cont(score, 0.9) FILTER (side = '{s}') AS {s}_p90"""


@register("coverage_diagnosis", DIAG, f"""
SELECT * FROM (SELECT condition, variable, max(factor) AS factor, {side_sql('cal')}, {side_sql('test')}
  FROM all_scores JOIN factors USING (condition, variable) GROUP BY ALL)
JOIN (SELECT condition, variable, ks_statistic, {kolmogorov_sql('ks_statistic', 'na', 'nb')} AS ks_p_value FROM (
  SELECT condition, variable, max(abs(ca/na - cb/nb)) AS ks_statistic, max(na) AS na, max(nb) AS nb FROM (
  SELECT condition, variable, count(*) FILTER (side = 'cal') OVER w AS ca, count(*) FILTER (side = 'test') OVER w AS cb,
    count(*) FILTER (side = 'cal') OVER g AS na, count(*) FILTER (side = 'test') OVER g AS nb FROM all_scores
  WINDOW w AS (PARTITION BY condition, variable ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), g AS (PARTITION BY condition, variable))
  GROUP BY ALL)) USING (condition, variable)""")
def diagnosis(spark, sf):
    _, cal, test = both(spark, sf)
    return calibrate.diagnose(cal, test)


@register("coverage_by_hour_single_factor", "condition:s variable:s band:i coverage:d n_stays:i", """
SELECT condition, variable, hour//8 AS band, avg(CAST(abs(y_true - y_pred)/half <= factor AS DOUBLE)) AS coverage, count(DISTINCT stay_id) AS n_stays
FROM test_set JOIN factors USING (condition, variable) GROUP BY ALL""")
def by_hour_single(spark, sf):
    _, cal, test = both(spark, sf)
    return calibrate.coverage_by(test, calibrate.conformal_factors(cal), calibrate.hour_band(), "band")


def draws_sql(source, keys, resamples, seed):
    """Positions drawn per resample, as on the Spark side where a key's rows are one leaf."""
    ks = ", ".join(keys)
    s = stream_starts(seed)
    words = lambda x, a, b: f"{mix_sql(f'xor({x}, {s[a]})')} AS h, {mix_sql(f'xor({x}, {s[b]})')} AS l"
    return f"""
SELECT {ks}, b, (({mix_sql("xor(r.h, d.h)")} * 1073741824) + ({mix_sql("xor(r.l, d.l)")} >> 2)) % n_rows AS position
FROM (SELECT {ks}, position AS j, n_rows, {words("position", 2, 3)} FROM (SELECT DISTINCT {ks}, position, n_rows FROM {source})) d
CROSS JOIN (SELECT b, {words("b", 0, 1)} FROM (SELECT unnest(range({resamples})) AS b)) r"""


part("stay_hits", """
SELECT *, row_number() OVER (PARTITION BY condition, variable ORDER BY md5('42:' || stay_id), stay_id) - 1 AS position, count(*) OVER (PARTITION BY condition, variable) AS n_rows
FROM (SELECT condition, variable, stay_id, sum(CAST(abs(y_true - y_pred)/half <= factor AS INT)) AS hits, count(y_true) AS cells
  FROM test_set JOIN factors USING (condition, variable) GROUP BY ALL HAVING count(y_true) > 0)""")
part("coverage_draws", draws_sql("stay_hits", ("condition", "variable"), 1000, 42))


@register("coverage_bootstrap", "condition:s variable:s ci_lo:d ci_hi:d", """
SELECT condition, variable, quantile_cont(v, 0.05) AS ci_lo, quantile_cont(v, 0.95) AS ci_hi FROM (
  SELECT condition, variable, b, sum(hits)/sum(cells) AS v FROM coverage_draws JOIN stay_hits USING (condition, variable, position) GROUP BY ALL) GROUP BY ALL""")
def coverage_bootstrap(spark, sf):
    _, cal, test = both(spark, sf)
    return calibrate.bootstrap_coverage(test, calibrate.conformal_factors(cal), 1000, 42)


part("cal_stays", """
SELECT *, row_number() OVER (PARTITION BY condition, variable ORDER BY md5('42:' || stay_id), stay_id) - 1 AS position, count(*) OVER (PARTITION BY condition, variable) AS n_rows
FROM (SELECT DISTINCT condition, variable, stay_id FROM calibration WHERE y_true IS NOT NULL)""")
part("factor_draws", draws_sql("cal_stays", ("condition", "variable"), 500, 42))


@register("conformal_factor_bootstrap", "condition:s variable:s ci_lo:d ci_hi:d", """
SELECT condition, variable, quantile_cont(score, 0.05) AS ci_lo, quantile_cont(score, 0.95) AS ci_hi FROM (
  SELECT condition, variable, b, score, row_number() OVER (PARTITION BY condition, variable, b ORDER BY score) AS r,
    count(*) OVER (PARTITION BY condition, variable, b) AS n
  FROM factor_draws JOIN cal_stays USING (condition, variable, position)
  JOIN (SELECT condition, variable, stay_id, score FROM all_scores WHERE side = 'cal') USING (condition, variable, stay_id))
WHERE r = least(n, (9*(n + 1) + 9)//10) GROUP BY ALL""")
def factor_bootstrap(spark, sf):
    return calibrate.bootstrap_factor(durable(S.Workspace(spark, sf).finished("calibration")), 500, seed=42)
