"""Forecasts, post-processing and the critic."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from foretrace.functions.durable import durable
from foretrace.operators import critic, forecast, postprocess
from foretrace.operators.forecast import gbt_fit, gbt_predict
from foretrace.plans import standin as S
from foretrace.plans.parts import SMAPE, adjusted, clip, final, values
from foretrace.plans.registry import part, register
from foretrace.sources import forecast_store

CELL = "condition:s stay_id:i variable:s hour:i y_true:d y_pred:d y_lower:d y_upper:d"
CELLS = "condition, stay_id, variable, hour, y_true, y_pred, y_lower, y_upper"


def one_condition(name, sql_filter):
    @register(f"forecast_{name}", CELL, f"SELECT {CELLS} FROM persistence WHERE condition = '{sql_filter}' AND split = 'test'")
    def run(spark, sf):
        ws = S.Workspace(spark, sf).with_fill()
        return forecast.persistence(ws.series("test"), S.WINDOWS, (sql_filter,), ws.fill)

    return run


for _name in ("naive", "recent_mean", "persistence_blend"):
    one_condition(_name, _name)


@register("forecast_conditions_together", CELL, f"SELECT {CELLS} FROM persistence WHERE split IN ('test', 'val')")
def conditions_together(spark, sf):
    ws = S.Workspace(spark, sf).with_fill()
    series = ws.series().filter(F.col("split").isin("test", "val"))
    return forecast.run_conditions(series, ["naive", "recent_mean", "persistence_blend"], S.VARIABLES, S.WINDOWS, ws.fill)


@register("forecast_without_fill", CELL, f"""
SELECT 'naive' AS condition, t.stay_id, t.variable, t.hour, y_true, coalesce(last, 0.0) AS y_pred,
  coalesce(last, 0.0) - w AS y_lower, coalesce(last, 0.0) + w AS y_upper
FROM truth t JOIN (SELECT *, CASE WHEN n_obs > 0 THEN greatest(CASE WHEN n_obs > 1 THEN std ELSE 1.0 END, 1e-3)*1.5 ELSE 1.5 END AS w
  FROM summary) USING (stay_id, variable) WHERE t.split = 'test'""")
def without_fill(spark, sf):
    return forecast.persistence(S.Workspace(spark, sf).series("test"), S.WINDOWS, ("naive",))


@register("forecast_boosted_trees", CELL)
def boosted_trees(spark, sf):
    """Few rounds here; the default is 150. No SQL counterpart."""
    ws = S.Workspace(spark, sf)
    fitted = gbt_fit(ws.series("train"), S.VARIABLES, S.WINDOWS, max_depth=3, max_iter=3)
    return gbt_predict(fitted, ws.series("test"), S.VARIABLES, S.WINDOWS)


@register("forecast_clipped_to_valid", "condition:s stay_id:i variable:s hour:i y_pred:d", f"""
SELECT condition, stay_id, variable, hour, {clip('y_raw', '0.1', '300')} AS y_pred FROM model_raw WHERE split = 'test'""")
def clipped_to_valid(spark, sf):
    raw = S.Workspace(spark, sf).raw("test").withColumnRenamed("y_raw", "y_pred")
    return forecast.clip_to_valid(raw, S.VARIABLES)


@register("forecast_intervals", "condition:s stay_id:i variable:s hour:i y_lower:d y_upper:d", """
SELECT condition, stay_id, variable, hour, y_raw - half*(1 + hour/10.0) AS y_lower, y_raw + half*(1 + hour/10.0) AS y_upper
FROM model_raw WHERE split = 'test'""")
def intervals(spark, sf):
    """Half-widths that differ per hour."""
    raw = S.Workspace(spark, sf).raw("test").withColumnRenamed("y_raw", "y_pred")
    return forecast.with_interval(raw, (F.col("y_upper") - F.col("y_lower")) / 2 * (1 + F.col("hour") / 10.0))


ENSEMBLE = ["full_pipeline", "full_pipeline@alt", "single_model_llm"]
part("ensembled", f"""
SELECT 'mix' AS condition, stay_id, split, variable, hour, max(y_true) AS y_true, avg(y_pred) AS y_pred, avg(half) AS half
FROM test_set WHERE condition IN ({', '.join(repr(c) for c in ENSEMBLE)}) GROUP BY ALL HAVING count(y_pred) = 3""")


@register("forecast_ensemble", CELL, """
SELECT condition, stay_id, variable, hour, y_true, y_pred, y_pred - half AS y_lower, y_pred + half AS y_upper FROM ensembled""")
def ensemble_query(spark, sf):
    return forecast.ensemble(S.Workspace(spark, sf).finished("test"), ENSEMBLE, "mix")


@register("ensemble_member_mismatch", "stay_id:i n_members:i", """
SELECT stay_id, 1 AS n_members FROM (SELECT DISTINCT stay_id FROM test_set) WHERE stay_id % 5 = 0""")
def member_mismatch(spark, sf):
    """One member lacks every fifth stay."""
    done = S.Workspace(spark, sf).finished("test", S.PLAIN)
    partial = done.filter((F.col("condition") != "full_pipeline") | (F.col("stay_id") % 5 != 0))
    return forecast.member_mismatch(partial, ["full_pipeline", "single_model_llm"])


# --- post-processing ---------------------------------------------------------

RAW = "condition:s stay_id:i variable:s hour:i y_pred:d"


@register("postprocess_one_setting", RAW + " y_lower:d y_upper:d",
          "SELECT condition, stay_id, variable, hour, y_pred, y_lower, y_upper FROM test_set")
def one_setting(spark, sf):
    return S.Workspace(spark, sf).finished("test")


SETTINGS = [(v, 0.1 + 0.2 * i, 0.15 * i) for i, v in enumerate(S.NAMES)]
part("per_variable_settings", f"SELECT * FROM (VALUES {values([(v, round(d, 3), round(w, 3)) for v, d, w in SETTINGS])}) t(variable, d, w)")


@register("postprocess_per_variable", RAW, f"""
SELECT condition, stay_id, variable, hour, {clip('y_adj', '0.0', "(CASE WHEN variable = 'purchase' THEN 180.0 END)")} AS y_pred
FROM (SELECT *, {adjusted('d', 'w')} AS y_adj FROM (SELECT * EXCLUDE (d) FROM (SELECT condition, stay_id, split, variable, hour, y_raw, y_first, recent_mean, 0 AS d FROM with_first))
  JOIN per_variable_settings USING (variable)) WHERE split = 'test'""")
def per_variable(spark, sf):
    ws = S.Workspace(spark, sf)
    raw = ws.raw("test")
    table = raw.sparkSession.createDataFrame(
        [(c, v, round(d, 3), round(w, 3)) for c in S.CONDITIONS for v, d, w in SETTINGS],
        "condition string, variable string, drift_damping double, level_anchor_weight double")
    return postprocess.apply(raw, ws.recent(), S.VARIABLES, table)


def _grid_rows(grid):
    return values([(i, d, w) for i, (d, w) in enumerate(product(*postprocess.GRIDS[grid]))])


for _g in ("standard", "extended"):
    part(f"grid_{_g}", f"SELECT * FROM (VALUES {_grid_rows(_g)}) t(setting, gd, gw)")
    part(f"terms_{_g}", f"""
SELECT condition, setting, gd, gw, variable, sum({SMAPE}/n_cells)/(SELECT count(DISTINCT stay_id) FROM calibration WHERE y_true IS NOT NULL) AS term
FROM (SELECT condition, stay_id, variable, hour, y_true, n_cells, setting, gd, gw, {final('y_adj')} AS y_pred FROM (
  SELECT *, {adjusted('gd', 'gw')} AS y_adj, count(y_true) OVER (PARTITION BY condition, stay_id, setting) AS n_cells
  FROM with_first CROSS JOIN grid_{_g} WHERE stay_id IN (SELECT stay_id FROM subsets WHERE subset = 'calibration')))
WHERE y_true IS NOT NULL GROUP BY ALL""")
GROUPS = {
    "global": "'all'",
    "vitals_labs": "CASE WHEN variable IN ('error', 'purchase') THEN 'labs' ELSE 'vitals' END",
    "per_variable": "variable",
}


def best_sql(strategy, grid):
    g = GROUPS[strategy]
    return f"""
SELECT s.condition, v.variable, s.gd AS drift_damping, s.gw AS level_anchor_weight, s.score FROM (
  SELECT * FROM (SELECT condition, {g} AS vg, setting, gd, gw, sum(term) AS score FROM terms_{grid} GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY condition, vg ORDER BY round(score, 12), setting) = 1) s
JOIN (SELECT variable, {g} AS vg FROM vars) v ON v.vg = s.vg"""


FIT = "condition:s variable:s drift_damping:d level_anchor_weight:d score:d"


def fit_query(name, strategy, grid):
    @register(name, FIT, best_sql(strategy, grid))
    def run(spark, sf):
        ws = S.Workspace(spark, sf)
        return postprocess.fit(ws.raw("calibration"), ws.recent(), S.VARIABLES, strategy, grid)

    return run


fit_query("postprocess_fit_global", "global", "standard")
fit_query("postprocess_fit_vitals_labs_extended", "vitals_labs", "extended")
fit_query("postprocess_fit_per_variable", "per_variable", "standard")


@register("postprocess_terms", "condition:s setting:i variable:s term:d", "SELECT * FROM terms_standard")
def terms(spark, sf):
    ws = S.Workspace(spark, sf)
    return postprocess.contributions(ws.raw("calibration"), ws.recent(), S.VARIABLES)


def cv_sql():
    rows = []
    for grid in postprocess.GRIDS:
        for strategy in postprocess.STRATEGIES:
            g = GROUPS[strategy]
            rows.append(f"""
SELECT b.condition, '{strategy}' AS strategy, '{grid}' AS grid, sum(o.term)/2 AS score FROM (
  SELECT * FROM (SELECT condition, fold, {g} AS vg, setting, sum(term) AS s FROM fold_terms_{grid} GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY condition, fold, vg ORDER BY round(s, 12), setting) = 1) b
JOIN vars v ON {g.replace('variable', 'v.variable')} = b.vg
JOIN fold_terms_{grid} o ON o.condition = b.condition AND o.fold = 1 - b.fold AND o.setting = b.setting AND o.variable = v.variable
GROUP BY ALL""")
    return " UNION ALL ".join(rows)


part("folds", """
SELECT stay_id, (row_number() OVER (ORDER BY stay_id) - 1) % 2 AS fold FROM (SELECT DISTINCT stay_id FROM calibration)""")
for _g in ("standard", "extended"):
    part(f"fold_terms_{_g}", f"""
SELECT condition, fold, setting, variable, sum({SMAPE}/n_cells)/max(n_stays) AS term FROM (
  SELECT *, {final('y_adj')} AS y_pred FROM (
    SELECT *, {adjusted('gd', 'gw')} AS y_adj, count(y_true) OVER (PARTITION BY condition, stay_id, setting) AS n_cells
    FROM with_first JOIN folds USING (stay_id)
    JOIN (SELECT fold, count(*) AS n_stays FROM folds GROUP BY fold) USING (fold) CROSS JOIN grid_{_g}))
WHERE y_true IS NOT NULL GROUP BY ALL""")


@register("postprocess_two_fold_validation", "condition:s strategy:s grid:s score:d", cv_sql())
def two_fold(spark, sf):
    ws = S.Workspace(spark, sf)
    return postprocess.cross_validate(durable(ws.raw("calibration")), ws.recent(), S.VARIABLES)


# --- critic ------------------------------------------------------------------

OUT = "(y_raw < 5 OR y_raw > 150)"


@register("critic_violation_counts", "condition:s variable:s violations:i cells:i", f"""
SELECT condition, variable, count(*) FILTER {OUT} AS violations, count(y_raw) AS cells FROM model_raw WHERE split = 'test' GROUP BY ALL""")
def violation_counts(spark, sf):
    return critic.count_violations(S.Workspace(spark, sf).raw("test"), S.VARIABLES, y="y_raw")


@register("critic_clip_only", "condition:s stay_id:i variable:s hour:i y_raw:d violation:b", f"""
SELECT condition, stay_id, variable, hour, {clip('y_raw', '5', '150')} AS y_raw, {OUT} AS violation FROM model_raw WHERE split = 'test'""")
def clip_only(spark, sf):
    return critic.clip_series(S.Workspace(spark, sf).raw("test"), S.VARIABLES, "y_raw")


def w(expr):
    from foretrace.plans.parts import word

    return word(expr)


part("series_pick", f"""
SELECT condition, stay_id, variable, {w("'fix:' || condition || ':' || stay_id || ':' || variable")} % 3 AS pick,
  bool_or({OUT}) AS bad0, bool_or(70.0 + (y_raw - 70.0)*0.5 < 5 OR 70.0 + (y_raw - 70.0)*0.5 > 150) AS bad1
FROM model_raw GROUP BY ALL""")
part("corrected", f"""
SELECT m.* EXCLUDE (y_raw), y_raw AS y_before, {OUT} AS violation, pick, bad0, bad1,
  CASE WHEN NOT bad0 OR pick = 2 THEN y_raw
       WHEN pick = 0 AND NOT bad1 THEN 70.0 + (y_raw - 70.0)*0.5
       ELSE {clip('y_raw', '5', '150')} END AS y_fixed,
  CASE WHEN bad0 AND pick = 1 THEN 1 WHEN bad0 AND pick = 2 THEN 2 ELSE 0 END AS failed
FROM model_raw m JOIN series_pick USING (condition, stay_id, variable)""")


@register("critic_corrections", "condition:s stay_id:i variable:s hour:i y_raw:d violation:b clipped:b failed_corrections:i", f"""
SELECT condition, stay_id, variable, hour, {clip('y_fixed', '5', '150')} AS y_raw, violation, (y_fixed < 5 OR y_fixed > 150) AS clipped,
  failed AS failed_corrections FROM corrected WHERE split = 'test'""")
def corrections(spark, sf):
    raw = S.Workspace(spark, sf).raw("test")
    return critic.apply_corrections(raw, S.corrections(raw), S.VARIABLES, 2, "y_raw")


@register("critic_record", "condition:s violations:i clipped:i precritic_rate:d fixed_share:d", """
SELECT condition, count(*) FILTER (violation) AS violations, count(*) FILTER (y_fixed < 5 OR y_fixed > 150) AS clipped,
  count(*) FILTER (violation)/count(*) AS precritic_rate,
  (count(*) FILTER (violation) - count(*) FILTER (y_fixed < 5 OR y_fixed > 150))/nullif(count(*) FILTER (violation), 0) AS fixed_share
FROM corrected WHERE split = 'test' GROUP BY ALL""")
def record(spark, sf):
    return critic.record(corrections(spark, sf))


def stage_query(stage, sql):
    @register(f"critic_stage_{stage}", RAW + " violation:b", sql)
    def run(spark, sf):
        ws = S.Workspace(spark, sf)
        return critic.review(ws.raw("test"), ws.recent(), S.VARIABLES, S.PARAMS, stage)

    return run


HARD = clip("y_adj", "0.0", "(CASE WHEN variable = 'purchase' THEN 180.0 END)")
stage_query("final", f"""
SELECT condition, stay_id, variable, hour, {clip('y_post', '5', '150')} AS y_pred, (y_post < 5 OR y_post > 150) AS violation
FROM (SELECT *, {HARD} AS y_post FROM moved) WHERE split = 'test'""")
stage_query("raw", f"""
SELECT condition, stay_id, variable, hour, {HARD} AS y_pred, violation FROM (
  SELECT *, {adjusted('0.5', '0.25')} AS y_adj FROM (
    SELECT *, max(CASE WHEN hour = 0 THEN y_raw END) OVER (PARTITION BY condition, stay_id, variable) AS y_first FROM (
      SELECT condition, stay_id, split, variable, hour, recent_mean, {OUT} AS violation, {clip('y_raw', '5', '150')} AS y_raw FROM model_raw)))
WHERE split = 'test'""")


@register("critic_raw_rate", "condition:s variable:s violation_rate:d", f"""
SELECT condition, variable, avg(CAST({OUT} AS DOUBLE)) AS violation_rate FROM model_raw WHERE split = 'test' GROUP BY ALL""")
def raw_rate(spark, sf):
    return critic.raw_rate(S.Workspace(spark, sf).raw("test"), S.VARIABLES)


@register("critic_raw_audit", "condition:s variable:s cells:i below:i above:i stays_any:i rate:d", f"""
SELECT condition, variable, count(*) AS cells, count(*) FILTER (y_raw < 5) AS below, count(*) FILTER (y_raw > 150) AS above,
  count(DISTINCT stay_id) FILTER {OUT} AS stays_any, avg(CAST({OUT} AS DOUBLE)) AS rate FROM model_raw WHERE split = 'test' GROUP BY ALL""")
def raw_audit(spark, sf):
    return critic.raw_violations(S.Workspace(spark, sf).raw("test"), S.VARIABLES)


@register("critic_violating_stays", "condition:s stays:i stays_with_violation:i", f"""
SELECT condition, count(DISTINCT stay_id) AS stays, count(DISTINCT stay_id) FILTER {OUT} AS stays_with_violation
FROM model_raw WHERE split = 'test' GROUP BY ALL""")
def violating_stays(spark, sf):
    return critic.violating_stays(S.Workspace(spark, sf).raw("test"), S.VARIABLES)


# The replay compares the arms of one condition.
ONE = ["full_pipeline"]
part("arms", f"""
SELECT 'no_critic' AS arm, stay_id, split, variable, hour, y_true, recent_mean, half, y_before AS y FROM corrected WHERE condition = 'full_pipeline'
UNION ALL SELECT 'clip_raw', stay_id, split, variable, hour, y_true, recent_mean, half, {clip('y_before', '5', '150')} FROM corrected WHERE condition = 'full_pipeline'
UNION ALL SELECT 'corrected_raw', stay_id, split, variable, hour, y_true, recent_mean, half, {clip('y_fixed', '5', '150')} FROM corrected WHERE condition = 'full_pipeline'""")
part("arms_first", """
SELECT arm AS condition, stay_id, split, variable, hour, y_true, recent_mean, half, y AS y_raw,
  max(CASE WHEN hour = 0 THEN y END) OVER (PARTITION BY arm, stay_id, variable) AS y_first FROM arms""")
part("arm_terms", f"""
SELECT condition, setting, gd, gw, sum({SMAPE}/n_cells) AS score FROM (
  SELECT *, {HARD} AS y_pred FROM (SELECT *, {adjusted('gd', 'gw')} AS y_adj,
    count(y_true) OVER (PARTITION BY condition, stay_id, setting) AS n_cells
    FROM arms_first CROSS JOIN grid_standard WHERE stay_id IN (SELECT stay_id FROM subsets WHERE subset = 'calibration')))
WHERE y_true IS NOT NULL GROUP BY ALL""")
part("arm_best", """
SELECT condition, gd, gw FROM arm_terms QUALIFY row_number() OVER (PARTITION BY condition ORDER BY round(score, 12), setting) = 1""")
part("arm_final", f"""
SELECT condition, stay_id, split, variable, hour, y_true, half, gd, gw, {HARD} AS y_pred
FROM (SELECT *, {adjusted('gd', 'gw')} AS y_adj FROM arms_first JOIN arm_best USING (condition))""")
part("arm_factors", """
SELECT condition, variable, score AS factor FROM (
  SELECT *, row_number() OVER (PARTITION BY condition, variable ORDER BY score) AS r, count(*) OVER (PARTITION BY condition, variable) AS n
  FROM (SELECT condition, variable, abs(y_true - y_pred)/half AS score FROM arm_final
        WHERE y_true IS NOT NULL AND stay_id IN (SELECT stay_id FROM subsets WHERE subset = 'calibration')))
WHERE r = least(n, (9*(n + 1) + 9)//10)""")
part("arm_test", """
SELECT a.*, coalesce(factor, 1.0) AS factor FROM arm_final a LEFT JOIN arm_factors USING (condition, variable) WHERE split = 'test'""")


def replay_tables(spark, sf):
    ws = S.Workspace(spark, sf)
    sides = []
    for which in ("calibration", "test"):
        raw = durable(ws.raw(which, ONE))
        sides.append(durable(critic.replay_arms(raw, S.VARIABLES, S.corrections(raw), 2)))
    return critic.replay(*sides, ws.recent(), S.VARIABLES)


@register("critic_replay_settings", "condition:s drift_damping:d level_anchor_weight:d",
          "SELECT condition, gd AS drift_damping, gw AS level_anchor_weight FROM arm_best")
def replay_settings(spark, sf):
    return replay_tables(spark, sf)[1].select("condition", "drift_damping", "level_anchor_weight").distinct()


@register("critic_replay_difference", "condition:s max_abs_diff:d", f"""
SELECT condition, max(abs(y_pred - {HARD})) AS max_abs_diff FROM (
  SELECT f.condition, f.y_pred, m.y_adj, m.variable FROM test_set f JOIN moved m USING (condition, stay_id, variable, hour)) GROUP BY ALL""")
def replay_difference(spark, sf):
    """Stored (clipped) forecasts against a replay without the critic's clip."""
    ws = S.Workspace(spark, sf)
    return critic.replay_difference(ws.finished("test"), postprocess.apply(ws.raw("test"), ws.recent(), S.VARIABLES, S.PARAMS))


# --- stored forecasts ----------------------------------------------------------

def stored(spark, sf, conditions=None):
    from foretrace.plans.cohort_queries import scratch

    ws = S.Workspace(spark, sf)
    path = scratch(spark, "forecasts")
    for run, which in (("calibration", "calibration"), ("test", "test")):
        forecast_store.write(ws.finished(which, conditions), path, run)
    return ws, path


@register("forecast_store_partition_read", "run:s condition:s stay_id:i variable:s hour:i y_pred:d", """
SELECT 'test' AS run, condition, stay_id, variable, hour, y_pred FROM test_set WHERE condition IN ('full_pipeline', 'single_model_llm@alt')""")
def store_read(spark, sf):
    _, path = stored(spark, sf)
    return forecast_store.read(spark, path, "test", ["full_pipeline", "single_model_llm@alt", "never_stored"])


@register("forecast_store_finished_run", "condition:s stay_id:i variable:s hour:i y_pred:d", f"""
SELECT condition, stay_id, variable, hour, {final('y_adj')} AS y_pred FROM (SELECT *, {adjusted('0.25', '0.5')} AS y_adj FROM with_first)
WHERE stay_id IN (SELECT stay_id FROM subsets WHERE subset = 'calibration') AND condition IN ('full_pipeline', 'single_model_llm', 'full_pipeline_no_critic')""")
def finished_run(spark, sf):
    """Calibration forecasts re-post-processed with stored settings."""
    ws, path = stored(spark, sf, S.PLAIN)
    settings = spark.createDataFrame([(c, v, 0.25, 0.5) for c in S.PLAIN for v in S.NAMES],
                                     "condition string, variable string, drift_damping double, level_anchor_weight double")
    cal, test = (forecast_store.read(spark, path, r) for r in ("calibration", "test"))
    return forecast_store.stored_run(cal, test, ws.recent(), S.VARIABLES, settings)[0]


def half_stored(spark, sf):
    """A third of the test stays stored under the same settings, a third under others in another run."""
    from foretrace.plans.cohort_queries import scratch

    ws = S.Workspace(spark, sf)
    path = scratch(spark, "batches")
    done = durable(ws.finished("test", ["full_pipeline"]))
    forecast_store.write(done.filter(F.col("stay_id") % 3 == 0), path, "mine", "b0", {"k": 20})
    forecast_store.write(done.filter(F.col("stay_id") % 3 == 1), path, "other", "b1", {"k": 50})
    return done, path


@register("forecast_pending_stays", "stay_id:i", """
SELECT stay_id FROM cohort WHERE split = 'test' AND stay_id % 3 <> 0""")
def pending(spark, sf):
    done, path = half_stored(spark, sf)
    return forecast_store.pending(done.select("stay_id").distinct(), forecast_store.read(spark, path), "full_pipeline", {"k": 20})


@register("forecast_store_resumed", "stay_id:i variable:s hour:i y_pred:d fingerprint:s", """
SELECT stay_id, variable, hour, y_pred, sha256('{"k": 20}') AS fingerprint FROM test_set WHERE condition = 'full_pipeline'""")
def resumed(spark, sf):
    """A first batch, then what is still pending, then that batch once more; each row is there once."""
    done, path = half_stored(spark, sf)
    left = forecast_store.pending(done.select("stay_id").distinct(), forecast_store.read(spark, path, "mine"), "full_pipeline", {"k": 20})
    rest = durable(done.join(left, "stay_id", "left_semi"))
    for _ in range(2):
        forecast_store.write(rest, path, "mine", "b1", {"k": 20})
    return forecast_store.read(spark, path, "mine")


@register("forecast_store_changed_settings", "condition:s fingerprint:s", """
SELECT 'full_pipeline' AS condition, sha256('{"k": 50}') AS fingerprint FROM test_set WHERE condition = 'full_pipeline' AND stay_id % 3 = 1 LIMIT 1""")
def changed_settings(spark, sf):
    """Stored settings that differ from the present ones; writing under them is refused."""
    done, path = half_stored(spark, sf)
    try:
        forecast_store.write(done, path, "other", "b2", {"k": 20})
    except ValueError:
        return forecast_store.changed(forecast_store.read(spark, path), "full_pipeline", {"k": 20})
    raise AssertionError("a changed fingerprint was accepted")


@register("forecast_overridden_conditions", "sample:s condition:s stay_id:i variable:s hour:i y_pred:d", """
SELECT 'one' AS sample, condition, stay_id, variable, hour, y_pred FROM test_set WHERE condition <> 'full_pipeline' AND condition IN ('single_model_llm', 'full_pipeline_no_critic')
UNION ALL SELECT 'one', condition, stay_id, variable, hour, y_pred FROM calibration WHERE condition = 'full_pipeline'
UNION ALL SELECT 'two', condition, stay_id, variable, hour, y_pred FROM calibration WHERE condition IN ('single_model_llm', 'full_pipeline', 'full_pipeline_no_critic')""")
def overridden(spark, sf):
    """Sample one takes a condition from the other run."""
    _, path = stored(spark, sf, S.PLAIN)
    samples = spark.createDataFrame([("one", "test"), ("two", "calibration")], "sample string, run string")
    overrides = spark.createDataFrame([("one", "full_pipeline", "calibration")], "sample string, condition string, run string")
    return forecast_store.with_overrides(forecast_store.read(spark, path), samples, overrides)


@register("forecast_overridden_ensemble", "sample:s stay_id:i variable:s hour:i y_pred:d", """
SELECT 'two' AS sample, stay_id, variable, hour, avg(y_pred) AS y_pred FROM calibration WHERE condition IN ('single_model_llm', 'full_pipeline') GROUP BY ALL
UNION ALL SELECT 'one', stay_id, variable, hour, CASE WHEN count(*) = 2 THEN avg(y_pred) END FROM (
  SELECT condition, stay_id, variable, hour, y_pred FROM test_set WHERE condition = 'single_model_llm'
  UNION ALL SELECT condition, stay_id, variable, hour, y_pred FROM calibration WHERE condition = 'full_pipeline') GROUP BY ALL""")
def overridden_ensemble(spark, sf):
    return forecast_store.override_ensemble(overridden(spark, sf), ["single_model_llm", "full_pipeline"])
