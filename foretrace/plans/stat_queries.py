"""Paired statistics, pooled samples, selection and tuning."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from foretrace.functions.durable import durable
from foretrace.operators import critic, metrics, stats, tuning
from foretrace.plans import standin as S
from foretrace.plans.feature_queries import knn_vectors, train_horizons
from foretrace.plans.forecast_queries import best_sql, replay_tables
from foretrace.plans.metric_queries import draws_sql
from foretrace.plans.parts import SMAPE, adjusted, final, normal_p_sql
from foretrace.plans.registry import part, register

B = 2000
PAIRS = [("single_model_llm", "full_pipeline"), ("full_pipeline_no_critic", "full_pipeline"),
         ("single_model_llm@alt", "full_pipeline@alt"), ("full_pipeline_no_critic@alt", "full_pipeline@alt")]


def pair_name(p):
    return f"{p[0]}_vs_{p[1]}"


def paired_sql(pairs, source="per_stay", extra=""):
    cols = "".join(f"a.{c}, " for c in extra.split())
    on = " AND ".join(["a.stay_id = b.stay_id"] + [f"a.{c} = b.{c}" for c in extra.split()])
    return " UNION ALL ".join(
        f"SELECT {cols}'{pair_name(p)}' AS comparison, a.stay_id, a.smape AS smape_a, b.smape AS smape_b, round(a.smape - b.smape, 12) AS d "
        f"FROM {source} a JOIN {source} b ON {on} WHERE a.condition = '{p[0]}' AND b.condition = '{p[1]}'" for p in pairs)


def boot_sql(name, source, keys, value, id_expr="stay_id", seed=42, b=B):
    """Parts: placed rows, draws and the interval of the mean."""
    ks = ", ".join(keys)
    part(f"{name}_placed", f"""
SELECT {ks}, {value} AS v, row_number() OVER (PARTITION BY {ks} ORDER BY md5('{seed}:' || {id_expr}), {id_expr}) - 1 AS position,
  count(*) OVER (PARTITION BY {ks}) AS n_rows FROM ({source}) WHERE {value} IS NOT NULL""")
    part(f"{name}_draws", draws_sql(f"{name}_placed", keys, b, seed))
    part(f"{name}_ci", f"""
SELECT p.*, ci_lo, ci_hi FROM (SELECT {ks}, count(*) AS n, avg(v) AS mean FROM {name}_placed GROUP BY ALL) p
JOIN (SELECT {ks}, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM (
  SELECT {ks}, b, avg(v) AS m FROM {name}_draws JOIN {name}_placed USING ({ks}, position) GROUP BY ALL) GROUP BY ALL) USING ({ks})""")


boot_sql("stay_smape", "per_stay", ("condition",), "smape")


@register("bootstrap_mean_interval", "condition:s n:i mean:d ci_lo:d ci_hi:d", "SELECT * FROM stay_smape_ci")
def bootstrap_mean(spark, sf):
    return stats.bootstrap_ci(durable(S.Workspace(spark, sf).finished("test").transform(metrics.per_stay_smape)), ["condition"], "smape", B)


STEPS = stats.poisson_steps()
part("poisson_weights", " UNION ALL ".join(f"""
SELECT condition, smape, k*2 + {i} AS b, {' + '.join(f"CAST(u >= {s!r} AS INT)" for s in STEPS)} AS w FROM (
  SELECT condition, smape, k, CAST('0x' || substr(md5('42:p:' || k || ':' || stay_id), {1 + 16 * i}, 15) AS BIGINT)/1152921504606846976.0 AS u
  FROM per_stay CROSS JOIN (SELECT unnest(range({B // 2})) AS k) WHERE smape IS NOT NULL)""" for i in range(2)))


@register("bootstrap_poisson_interval", "condition:s n:i mean:d ci_lo:d ci_hi:d", """
SELECT p.*, ci_lo, ci_hi FROM (SELECT condition, count(smape) AS n, avg(smape) AS mean FROM per_stay GROUP BY ALL) p
JOIN (SELECT condition, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM (
  SELECT condition, b, sum(smape*w)/nullif(sum(w), 0) AS m FROM poisson_weights GROUP BY ALL) GROUP BY ALL) USING (condition)""")
def bootstrap_poisson(spark, sf):
    return stats.bootstrap_ci(metrics.per_stay_smape(S.Workspace(spark, sf).finished("test")), ["condition"], "smape", B, method="poisson")


def signed_rank_sql(source, keys):
    ks = ", ".join(keys)
    return f"""
SELECT {ks}, n_all AS n, m AS n_nonzero, w_plus, least(w_plus, m*(m + 1)/2 - w_plus) AS statistic,
  (least(w_plus, m*(m + 1)/2 - w_plus) - m*(m + 1)/4)/sqrt(m*(m + 1)*(2*m + 1)/24 - ties/48) AS z FROM (
  SELECT {ks}, max(n_all) AS n_all, count(*)::DOUBLE AS m, sum(CASE WHEN d > 0 THEN r + (t - 1)/2.0 ELSE 0 END) AS w_plus, sum(t*t - 1)::DOUBLE AS ties FROM (
    SELECT *, rank() OVER (PARTITION BY {ks} ORDER BY abs(d)) AS r, count(*) OVER (PARTITION BY {ks}, abs(d)) AS t
    FROM (SELECT *, count(*) OVER (PARTITION BY {ks}) AS n_all FROM ({source}) WHERE d IS NOT NULL) WHERE d <> 0) GROUP BY ALL)"""


part("paired", paired_sql(PAIRS))


@register("paired_differences", "comparison:s stay_id:i smape_a:d smape_b:d d:d", "SELECT * FROM paired")
def paired(spark, sf):
    return stats.paired_errors(S.Workspace(spark, sf).finished("test"), PAIRS)


@register("signed_rank_test", "comparison:s n:i n_nonzero:i w_plus:d statistic:d z:d", signed_rank_sql("SELECT * FROM paired", ["comparison"]))
def signed_rank(spark, sf):
    return stats.wilcoxon(paired(spark, sf), ["comparison"], "d", p_value=False)


@register("signed_rank_on_prices", "group:i n:i n_nonzero:i w_plus:d statistic:d z:d", signed_rank_sql(
    """SELECT l_linenumber AS "group", l_quantity - 25 AS d FROM lineitem""", ['"group"']))
def signed_rank_ties(spark, sf):
    """A large table with very many ties and zeros."""
    lines = S.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("group"), (F.col("l_quantity") - 25).alias("d"))
    return stats.wilcoxon(lines, ["group"], "d", p_value=False)


@register("signed_rank_p_values", "comparison:s statistic:d p_value:d p_log10:d", f"""
SELECT *, log10(p_value) AS p_log10 FROM (
  SELECT comparison, statistic, {normal_p_sql('z')} AS p_value FROM ({signed_rank_sql("SELECT * FROM paired", ["comparison"])}))""")
def signed_rank_p(spark, sf):
    return stats.wilcoxon(paired(spark, sf), ["comparison"], "d").withColumn("p_log10", F.log10("p_value"))


def rank_sum_sql(source, keys):
    ks = ", ".join(keys)
    return f"""
SELECT {ks}, n1, n2, u, (abs(u - n1*n2/2) - 0.5)/sqrt(n1*n2/12*(n1 + n2 + 1 - ties/((n1 + n2)*(n1 + n2 - 1)))) AS z FROM (
  SELECT {ks}, n1, n2, r1 - n1*(n1 + 1)/2 AS u, ties FROM (
    SELECT {ks}, count(*) FILTER (first)::DOUBLE AS n1, count(*) FILTER (NOT first)::DOUBLE AS n2,
      sum(CASE WHEN first THEN r + (t - 1)/2.0 ELSE 0 END) AS r1, sum(t*t - 1)::DOUBLE AS ties FROM (
      SELECT *, rank() OVER (PARTITION BY {ks} ORDER BY v) AS r, count(*) OVER (PARTITION BY {ks}, v) AS t FROM ({source})) GROUP BY ALL))"""


def with_rank_sum_p(sql):
    return f"SELECT *, log10(p_value) AS p_log10 FROM (SELECT *, CASE WHEN z < 0 THEN 1.0 ELSE {normal_p_sql('z')} END AS p_value FROM ({sql}))"


@register("rank_sum_test", "l_linestatus:s n1:i n2:i u:d z:d p_value:d p_log10:d", with_rank_sum_p(rank_sum_sql(
    "SELECT l_linestatus, l_discount AS v, l_returnflag = 'R' AS first FROM lineitem", ["l_linestatus"])))
def rank_sum(spark, sf):
    lines = S.table(spark, sf, "lineitem").select("l_linestatus", "l_discount", "l_returnflag")
    return stats.mann_whitney(lines, ["l_linestatus"], "l_discount", F.col("l_returnflag") == "R").withColumn("p_log10", F.log10("p_value"))


# --- comparisons -----------------------------------------------------------------

COMPARE = "comparison:s n_pairs:i a_mean:d a_ci_lo:d a_ci_hi:d b_mean:d b_ci_lo:d b_ci_hi:d statistic:d z:d p_value:d"


def compare_sql(name, pairs, source="per_stay"):
    part(f"{name}_paired", paired_sql(pairs, source))
    boot_sql(name, f"SELECT comparison, 'a' AS side, stay_id, smape_a AS smape FROM {name}_paired UNION ALL "
                   f"SELECT comparison, 'b', stay_id, smape_b FROM {name}_paired", ("comparison", "side"), "smape")
    side = ", ".join(f"max({c}) FILTER (side = '{s}') AS {s}_{c}" for s in "ab" for c in ("mean", "ci_lo", "ci_hi"))
    # The test is reported for ten pairs or more that are not all close to each other.
    tested = "n_pairs >= 10 AND far > 0"
    return f"""
SELECT * EXCLUDE (far, rank_statistic, rank_z), CASE WHEN {tested} THEN rank_statistic END AS statistic, CASE WHEN {tested} THEN rank_z END AS z, CASE WHEN {tested} THEN {normal_p_sql('rank_z')} END AS p_value
FROM (SELECT comparison, count(d) AS n_pairs, max(abs(d) - (1e-8 + 1e-5*abs(smape_b))) AS far FROM {name}_paired GROUP BY ALL)
LEFT JOIN (SELECT comparison, {side} FROM {name}_ci GROUP BY ALL) USING (comparison)
LEFT JOIN (SELECT comparison, statistic AS rank_statistic, z AS rank_z FROM ({signed_rank_sql(f'SELECT * FROM {name}_paired', ['comparison'])})) USING (comparison)"""


@register("compare_listed_pairs", COMPARE, compare_sql("listed", PAIRS))
def compare_listed(spark, sf):
    """One listed pair lacks its forecasts and is skipped."""
    done = durable(S.Workspace(spark, sf).finished("test"))
    return stats.compare_many(done, [*PAIRS, ("full_pipeline", "not_there")], B)


VARIANTS = stats.all_pairs(S.CONDITIONS)


@register("compare_model_variants", COMPARE, compare_sql("variants", VARIANTS))
def compare_variants(spark, sf):
    return stats.compare_many(durable(S.Workspace(spark, sf).finished("test")), VARIANTS, B)


ABLATION = [p for p in PAIRS if p[0].startswith("full_pipeline_no_critic")]
OUT = "(y_raw < 5 OR y_raw > 150)"
PLAUSIBLE_SQL = " UNION ALL ".join(
    f"SELECT '{pair_name(p)}' AS comparison, '{s}' AS side, * FROM rates WHERE condition = '{c}'" for p in ABLATION for s, c in zip("ab", p))
part("rates", f"""
SELECT condition, violation_rate, raw_rate, raw_violations FROM (
  SELECT condition, avg(r) AS violation_rate FROM (SELECT condition, variable, avg(CAST(y_pred < 5 OR y_pred > 150 AS DOUBLE)) AS r FROM test_set GROUP BY ALL) GROUP BY ALL)
JOIN (SELECT condition, avg(CAST({OUT} AS DOUBLE)) AS raw_rate, count(*) FILTER {OUT} AS raw_violations FROM test_set GROUP BY ALL) USING (condition)""")
PLAUSIBLE = "comparison:s side:s condition:s violation_rate:d raw_rate:d raw_violations:i"


@register("compare_plausibility", PLAUSIBLE, PLAUSIBLE_SQL)
def compare_plausibility(spark, sf):
    return stats.compare_plausibility(durable(S.Workspace(spark, sf).finished("test")), ABLATION, S.VARIABLES)


@register("deterioration_flags", "stay_id:i deteriorating:b", "SELECT * FROM flags")
def flags(spark, sf):
    return S.Workspace(spark, sf).flags()


SUBGROUP = "condition:s subgroup:s n:i smape_mean:d smape_std:d"
SUBGROUP_SQL = """
SELECT condition, CASE WHEN deteriorating THEN 'deteriorating' ELSE 'stable' END AS subgroup, count(*) AS n, avg(smape) AS smape_mean, stddev_pop(smape) AS smape_std
FROM per_stay JOIN flags USING (stay_id) GROUP BY ALL"""


@register("deterioration_subgroups", SUBGROUP, SUBGROUP_SQL)
def subgroups(spark, sf):
    ws = S.Workspace(spark, sf)
    return stats.subgroup_report(ws.finished("test"), ws.flags())


def question(name, columns, sql, table):
    @register(name, columns, sql)
    def run(spark, sf):
        ws = S.Workspace(spark, sf)
        done = durable(ws.finished("test"))
        return stats.question_report(done, ws.flags(), S.VARIABLES, (None, "alt"), resamples=B)[table]

    return run


question("questions_accuracy", COMPARE, compare_sql("questions", [p for v in (None, "alt") for p in stats.question_pairs(v)]), "accuracy")
question("questions_plausibility", PLAUSIBLE, PLAUSIBLE_SQL, "plausibility")
question("questions_subgroups", SUBGROUP, f"SELECT * FROM ({SUBGROUP_SQL}) WHERE condition NOT LIKE 'full_pipeline_no_critic%'", "subgroup")


# --- pooled samples: the stays fall into two overlapping samples ---------------------

SAMPLES = ["s0", "s1"]
part("sampled", """
SELECT 's' || k AS sample, t.* FROM test_set t CROSS JOIN (VALUES (0), (1)) v(k) WHERE t.stay_id % 3 <> k""")
part("sampled_smape", f"SELECT sample, condition, stay_id, avg({SMAPE}) AS smape FROM sampled GROUP BY ALL")
POOL_PAIRS = PAIRS[:2]
part("pool_paired", paired_sql(POOL_PAIRS, "sampled_smape", "sample"))
part("scoped", """
SELECT comparison, sample, stay_id, d, scope, subgroup FROM (
  SELECT p.*, CASE WHEN deteriorating THEN 'deteriorating' ELSE 'stable' END AS g FROM pool_paired p JOIN flags USING (stay_id) WHERE d IS NOT NULL)
CROSS JOIN LATERAL (SELECT unnest([sample, 'pooled']) AS scope) CROSS JOIN LATERAL (SELECT unnest([g, 'all']) AS subgroup)""")
boot_sql("pool", "SELECT * FROM scoped WHERE scope = 'pooled' AND subgroup = 'all'", ("comparison", "scope", "subgroup"), "d",
         "(sample || '/' || stay_id)")


def sampled(ws):
    done = ws.finished("test")
    samples = F.explode(F.array(*[F.when(F.col("stay_id") % 3 != k, F.lit(s)) for k, s in enumerate(SAMPLES)])).alias("sample")
    return durable(done.select("*", samples).filter(F.col("sample").isNotNull()))


def sampled_flags(ws):
    return ws.flags().select("stay_id", "deteriorating", F.explode(F.array(*[F.lit(s) for s in SAMPLES])).alias("sample"))


@register("pooled_comparison", "comparison:s scope:s subgroup:s n:i mean_diff:d share_a_better:d w_plus:d z:d p_value:d ci_lo:d ci_hi:d", f"""
SELECT *, {normal_p_sql('z')} AS p_value FROM ({signed_rank_sql('SELECT * FROM scoped', ['comparison', 'scope', 'subgroup'])})
JOIN (SELECT comparison, scope, subgroup, avg(d) AS mean_diff, avg(CAST(d < 0 AS DOUBLE)) AS share_a_better FROM scoped GROUP BY ALL) USING (comparison, scope, subgroup)
LEFT JOIN (SELECT comparison, scope, subgroup, ci_lo, ci_hi FROM pool_ci) USING (comparison, scope, subgroup)""")
def pooled(spark, sf):
    ws = S.Workspace(spark, sf)
    return stats.pooled_compare(sampled(ws), sampled_flags(ws), POOL_PAIRS, B)


@register("pooled_subgroup_interaction", "comparison:s n1:i n2:i u:d z:d p_value:d", with_rank_sum_p(rank_sum_sql(
    "SELECT comparison, d AS v, subgroup = 'stable' AS first FROM scoped WHERE scope = 'pooled' AND subgroup <> 'all'", ["comparison"])))
def interaction(spark, sf):
    ws = S.Workspace(spark, sf)
    return stats.subgroup_interaction(sampled(ws), sampled_flags(ws), POOL_PAIRS)


@register("shared_test_stays", "sample_a:s sample_b:s n_shared:i", """
SELECT 's0' AS sample_a, 's1' AS sample_b, count(*) AS n_shared FROM (
  SELECT stay_id FROM sampled WHERE sample = 's0' INTERSECT SELECT stay_id FROM sampled WHERE sample = 's1')""")
def shared(spark, sf):
    return stats.shared_stays(sampled(S.Workspace(spark, sf)), SAMPLES)


# --- selection and tuning --------------------------------------------------------------

CANDIDATES = ["full_pipeline", "full_pipeline@alt", "full_pipeline_no_critic@alt"]
part("cal_smape", f"SELECT condition, stay_id, avg({SMAPE}) AS smape FROM calibration GROUP BY ALL")
part("selection_diffs", f"""
SELECT c.condition, c.stay_id, c.smape - p.smape AS d FROM cal_smape c JOIN cal_smape p ON p.stay_id = c.stay_id AND p.condition = 'full_pipeline'
WHERE c.condition IN ({', '.join(repr(c) for c in CANDIDATES)})""")
boot_sql("selection", "SELECT * FROM selection_diffs", ("condition",), "d")
part("candidates", """
SELECT * FROM (SELECT condition, avg(smape) AS smape_mean FROM cal_smape GROUP BY ALL) JOIN selection_ci USING (condition)
JOIN (VALUES ('full_pipeline', 0.02), ('full_pipeline@alt', 0.01), ('full_pipeline_no_critic@alt', 0.3)) f(condition, fallback_rate) USING (condition)""")


@register("model_selection", "condition:s smape_mean:d diff:d ci_lo:d ci_hi:d eligible:b chosen:b", """
SELECT c.condition, smape_mean, mean AS diff, ci_lo, ci_hi, fallback_rate <= 0.05 AS eligible,
  c.condition = coalesce((SELECT condition FROM candidates WHERE ci_hi < 0 AND condition = (
    SELECT arg_min(condition, smape_mean) FROM candidates WHERE fallback_rate <= 0.05)), 'full_pipeline') AS chosen FROM candidates c""")
def model_selection(spark, sf):
    errors = durable(metrics.per_stay_smape(S.Workspace(spark, sf).finished("calibration", CANDIDATES)))
    fallback = spark.createDataFrame(list(zip(CANDIDATES, (0.02, 0.01, 0.3))), "condition string, fallback_rate double")
    return stats.select_model(errors, fallback, "full_pipeline", 0.05, B)


part("tune_truth", """
SELECT stay_id, variable, hour, y_true FROM truth WHERE stay_id IN (SELECT stay_id FROM subsets WHERE subset = 'tune')""")
TRIAL_KS = (3, 10)
part("tune_near", """
SELECT query_id, neighbor_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM (
  SELECT q.stay_id AS query_id, t.stay_id AS neighbor_id, sqrt(sum((q.x - t.x)*(q.x - t.x))) AS distance
  FROM scaled q JOIN scaled t USING (feature) WHERE t.split = 'train' AND q.stay_id IN (SELECT stay_id FROM subsets WHERE subset = 'tune') GROUP BY ALL)""")
part("neighbour_trial", " UNION ALL ".join(f"""
SELECT 'k{k}' AS trial, n.query_id AS stay_id, h.variable, h.hour, avg(h.value) AS y_pred FROM tune_near n
JOIN (SELECT * FROM cut WHERE part = 'horizon') h ON h.stay_id = n.neighbor_id WHERE rank <= {k} GROUP BY ALL""" for k in TRIAL_KS))
part("window_trial", " UNION ALL ".join(f"""
SELECT 'window{w}' AS trial, stay_id, variable, CASE WHEN n_obs > 0 THEN coalesce(r, last) ELSE 0.0 END AS y_pred FROM (
  SELECT stay_id, variable, arg_max(value, hour) FILTER (value IS NOT NULL) AS last, count(value) AS n_obs,
    avg(value) FILTER (hour >= {15 - w}) AS r FROM cut WHERE part = 'obs' GROUP BY ALL)""" for w in (3, 10)))
part("trial_smape", f"""
SELECT trial, stay_id, avg({SMAPE}) AS smape FROM (
  SELECT trial, stay_id, variable, hour, y_true, y_pred FROM neighbour_trial JOIN tune_truth USING (stay_id, variable, hour)
  UNION ALL SELECT trial, stay_id, variable, hour, y_true, y_pred FROM window_trial JOIN tune_truth USING (stay_id, variable)) GROUP BY ALL""")


def trial_errors(spark, sf):
    """Neighbour counts and window lengths, scored on the tuning stays."""
    ws = S.Workspace(spark, sf)
    tune = ws.subsets.filter(F.col("subset") == "tune").select("stay_id")
    cells = durable(ws.cells.join(tune, "stay_id", "left_semi"))
    truth = cells.filter(F.col("part") == "horizon").select("stay_id", "variable", "hour", F.col("value").alias("y_true"))
    _, scaler, pick = knn_vectors(ws)
    queries = pick("val").join(tune, "stay_id", "left_semi")
    near = tuning.neighbour_trials(queries, pick("train"), train_horizons(ws), truth, list(TRIAL_KS), S.VARIABLES, S.WINDOWS)
    flat = tuning.window_trials(cells, S.WINDOWS, [3, 10]).select(*near.columns)
    return metrics.per_stay_smape(near.unionByName(flat), ("trial", "condition"))


@register("tuning_trials", "trial:s stay_id:i smape:d", "SELECT * FROM trial_smape")
def tuning_trials(spark, sf):
    return trial_errors(spark, sf)


@register("tuning_winner", "round:s winner:s objective:d incumbent_objective:d n_trials:i", """
SELECT 'round1' AS round, CASE WHEN i - o >= 0.0001 THEN best ELSE 'incumbent' END AS winner, CASE WHEN i - o >= 0.0001 THEN o ELSE i END AS objective,
  i AS incumbent_objective, n AS n_trials FROM (
  SELECT arg_min(trial, (m, trial)) AS best, min(m) AS o, max(m) FILTER (trial = 'window10') AS i, count(*) AS n FROM (
    SELECT trial, avg(smape) AS m FROM trial_smape GROUP BY ALL))""")
def tuning_winner(spark, sf):
    """The ten-bin window is the incumbent."""
    scored = trial_errors(spark, sf).groupBy("trial", "condition").agg(F.avg("smape").alias("smape_mean"))
    trials = scored.withColumn("trial", F.when(F.col("trial") == "window10", "incumbent").otherwise(F.col("trial"))).withColumn(
        "round", F.lit("round1")).withColumn("fallback_rate", F.lit(0.0))
    return stats.pick_winner(trials, 0.0001)


SIZES = (3, 5, 10, 15)
SIZED = {"neighbour_mean": ("size",), "recent_mean": ("size",)}
part("size_cells", " UNION ALL ".join([f"""
SELECT 'neighbour_mean' AS condition, {k} AS size, n.query_id AS stay_id, h.variable, h.hour, avg(h.value) AS y_pred FROM tune_near n
JOIN (SELECT * FROM cut WHERE part = 'horizon') h ON h.stay_id = n.neighbor_id WHERE rank <= {k} GROUP BY ALL""" for k in SIZES] + [f"""
SELECT 'recent_mean' AS condition, {w} AS size, stay_id, variable, hour, CASE WHEN n_obs > 0 THEN coalesce(r, last) ELSE 0.0 END AS y_pred FROM (
  SELECT stay_id, variable, arg_max(value, hour) FILTER (value IS NOT NULL) AS last, count(value) AS n_obs,
    avg(value) FILTER (hour >= {15 - w}) AS r FROM cut WHERE part = 'obs' GROUP BY ALL) CROSS JOIN (SELECT unnest(range(15)) AS hour)""" for w in SIZES]))
part("size_smape", f"""
SELECT condition, size, avg(smape) AS m FROM (
  SELECT condition, size, stay_id, avg({SMAPE}) AS smape FROM size_cells JOIN tune_truth USING (stay_id, variable, hour) GROUP BY ALL) GROUP BY ALL""")
GAIN = 0.0001
part("joint_round", f"""
SELECT CASE WHEN i - b >= {GAIN} THEN best ELSE 'incumbent' END AS winner, CASE WHEN i - b >= {GAIN} THEN best_size ELSE 5 END AS size,
  CASE WHEN i - b >= {GAIN} THEN b ELSE i END AS objective, i AS incumbent_objective, n AS n_trials FROM (
  SELECT arg_min(trial, (o, trial <> 'incumbent', trial)) AS best, arg_min(size, (o, trial <> 'incumbent', trial)) AS best_size, min(o) AS b,
    max(o) FILTER (trial = 'incumbent') AS i, count(*) AS n FROM (
    SELECT trial, size, avg(m) AS o FROM (VALUES ('incumbent', 5), ('few', 3), ('many', 10)) t(trial, size) JOIN size_smape USING (size) GROUP BY ALL))""")


@register("tuning_rounds", "round:s scope:s winner:s objective:d incumbent_objective:d n_trials:i", f"""
SELECT 'joint' AS round, 'all' AS scope, winner, objective, incumbent_objective, n_trials FROM joint_round UNION ALL
SELECT 'own', condition, CASE WHEN i - b >= {GAIN} THEN best ELSE 'incumbent' END, CASE WHEN i - b >= {GAIN} THEN b ELSE i END, i, n FROM (
  SELECT condition, arg_min(trial, (m, trial <> 'incumbent', trial)) AS best, min(m) AS b, max(m) FILTER (trial = 'incumbent') AS i, count(*) AS n
  FROM (SELECT 'incumbent' AS trial, size FROM joint_round UNION ALL SELECT * FROM (VALUES ('small', 3), ('large', 15)) t(trial, size))
  JOIN size_smape USING (size) GROUP BY condition)""")
def tuning_rounds(spark, sf):
    """One size for both conditions, then one for each: neighbours of the mean, bins of the window."""
    ws = S.Workspace(spark, sf)
    tune = ws.subsets.filter(F.col("subset") == "tune").select("stay_id")
    cells = durable(ws.cells.join(tune, "stay_id", "left_semi"))
    truth = cells.filter(F.col("part") == "horizon").select("stay_id", "variable", "hour", F.col("value").alias("y_true"))
    _, _, pick = knn_vectors(ws)
    queries, train = durable(pick("val").join(tune, "stay_id", "left_semi")), durable(pick("train"))

    def score(wanted):
        sizes = {c: [used["size"] for name, _, used in wanted if name == c] for c in SIZED}
        parts = []
        if sizes["neighbour_mean"]:
            parts.append(tuning.neighbour_trials(queries, train, train_horizons(ws), truth, sizes["neighbour_mean"], S.VARIABLES, S.WINDOWS))
        if sizes["recent_mean"]:
            parts.append(tuning.window_trials(cells, S.WINDOWS, sizes["recent_mean"]))
        columns = ["trial", "condition", "stay_id", "variable", "hour", "y_true", "y_pred"]
        rows = functools.reduce(lambda a, b: a.unionByName(b), [p.select(*columns) for p in parts])
        names = {("k" if c == "neighbour_mean" else "window") + str(used["size"]): key for c, key, used in wanted}
        key_of = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        return metrics.per_stay_smape(rows, ("trial", "condition")).groupBy("trial", "condition").agg(
            F.avg("smape").alias("smape_mean")).select(
            "condition", F.try_element_at(key_of, "trial").alias("settings_key"), "smape_mean", F.lit(0.0).alias("fallback_rate"))

    rounds = [tuning.Round("joint", tuple(SIZED), {"few": {"size": 3}, "many": {"size": 10}}),
              tuning.Round("own", tuple(SIZED), {"small": {"size": 3}, "large": {"size": 15}}, per_condition=True)]
    return tuning.search(spark, rounds, {"size": 5}, score, SIZED, min_improvement=GAIN).rounds


@register("tuning_trees", "trial:s condition:s n_stays:i smape_mean:d")
def tuning_trees(spark, sf):
    """Two tree settings, else as by default: 150 rounds, and depth 4 where it is not the trial. No SQL counterpart."""
    ws = S.Workspace(spark, sf)
    out = tuning.tree_trials(ws.series("train"), ws.series("val"), S.VARIABLES, S.WINDOWS,
                             {"depth2": {"max_depth": 2}, "slow": {"learning_rate": 0.05}})
    return metrics.per_stay_smape(out, ("trial", "condition")).groupBy("trial", "condition").agg(
        F.count(F.lit(1)).alias("n_stays"), F.avg("smape").alias("smape_mean"))


@register("reproduction_check", "unmatched_stays:i max_abs_diff:d smape_first:d smape_second:d", f"""
SELECT count(*) FILTER (c1 = 0 OR c2 = 0) AS unmatched_stays, max(gap) AS max_abs_diff, avg(s1) AS smape_first, avg(s2) AS smape_second FROM (
  SELECT stay_id, max(abs(p1 - p2)) AS gap, avg(2*abs(t1 - p1)/(abs(t1) + abs(p1) + 1e-8)) AS s1, avg(2*abs(t2 - p2)/(abs(t2) + abs(p2) + 1e-8)) AS s2,
    count(p1) AS c1, count(p2) AS c2
  FROM (SELECT stay_id, variable, hour, y_true AS t1, y_pred AS p1 FROM test_set WHERE condition = 'full_pipeline')
  FULL JOIN (SELECT stay_id, variable, hour, y_true AS t2, y_pred AS p2 FROM test_set WHERE condition = 'full_pipeline@alt' AND stay_id % 4 <> 0) USING (stay_id, variable, hour)
  GROUP BY ALL)""")
def reproduction(spark, sf):
    done = durable(S.Workspace(spark, sf).finished("test"))
    pick = lambda c: done.filter(F.col("condition") == c).drop("condition")
    return stats.reproduction_check(pick("full_pipeline"), pick("full_pipeline@alt").filter(F.col("stay_id") % 4 != 0))


# Each run of the forecaster stands for a seed.
part("seed_stays", """
SELECT CASE WHEN condition LIKE '%@alt' THEN 2 ELSE 1 END AS seed, replace(condition, '@alt', '') AS condition, stay_id, smape FROM per_stay""")
part("seed_paired", paired_sql(stats.question_pairs(), "seed_stays", "seed"))
boot_sql("seed_diff", "seed_paired", ("seed", "comparison"), "d")


@register("seed_sensitivity", "seed:i comparison:s n_pairs:i mean_diff:d ci_lo:d ci_hi:d share_a_better:d statistic:d p_value:d n_seeds:i least_diff:d largest_diff:d same_sign:b", f"""
SELECT seed, comparison, n AS n_pairs, mean AS mean_diff, ci_lo, ci_hi, share_a_better, statistic, {normal_p_sql('z')} AS p_value, count(*) OVER w AS n_seeds,
  min(mean) OVER w AS least_diff, max(mean) OVER w AS largest_diff, min(sign(mean)) OVER w = max(sign(mean)) OVER w AS same_sign
FROM seed_diff_ci JOIN (SELECT seed, comparison, avg(CAST(d < 0 AS DOUBLE)) AS share_a_better FROM seed_paired GROUP BY ALL) USING (seed, comparison)
LEFT JOIN (SELECT * EXCLUDE (n) FROM ({signed_rank_sql("SELECT * FROM seed_paired", ["seed", "comparison"])})) USING (seed, comparison)
WINDOW w AS (PARTITION BY comparison)""")
def seed_sensitivity(spark, sf):
    alt = F.col("condition").endswith("@alt")
    done = S.Workspace(spark, sf).finished("test").withColumn("seed", F.when(alt, 2).otherwise(1))
    return stats.seed_sensitivity(durable(done.withColumn("condition", F.replace("condition", F.lit("@alt"), F.lit("")))),
                                  stats.question_pairs(), B)


RESCORED = final("y_adj")
part("rescored", f"""
SELECT condition, stay_id, split, variable, hour, y_true, half, {RESCORED} AS y_pred FROM (
  SELECT m.*, {adjusted('drift_damping', 'level_anchor_weight')} AS y_adj FROM with_first m JOIN ({best_sql('vitals_labs', 'standard')}) b USING (condition, variable))""")
IN_CAL = "stay_id IN (SELECT stay_id FROM subsets WHERE subset = 'calibration')"


def version_sql(version, source):
    return f"""
SELECT '{version}' AS version, * FROM (
  SELECT condition, avg(s) AS calibration_smape FROM (SELECT condition, stay_id, avg({SMAPE}) AS s FROM {source} WHERE {IN_CAL} GROUP BY ALL) GROUP BY ALL)
JOIN (SELECT condition, avg(s) AS test_smape FROM (SELECT condition, stay_id, avg({SMAPE}) AS s FROM {source} WHERE split = 'test' GROUP BY ALL) GROUP BY ALL) USING (condition)
JOIN (SELECT condition, avg(CAST(abs(y_true - y_pred) <= factor*half AS DOUBLE)) AS coverage FROM (SELECT * FROM {source} WHERE split = 'test') JOIN (
  SELECT condition, variable, score AS factor FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY condition, variable) AS n FROM (
    SELECT condition, variable, abs(y_true - y_pred)/half AS score FROM {source} WHERE {IN_CAL} AND y_true IS NOT NULL)
    WINDOW w AS (PARTITION BY condition, variable ORDER BY score)) WHERE r = least(n, (9*(n + 1) + 9)//10)) USING (condition, variable) GROUP BY ALL) USING (condition)"""


@register("rescore_stored_run", "version:s condition:s calibration_smape:d test_smape:d coverage:d",
          version_sql("run", "finished") + " UNION ALL " + version_sql("rescored", "rescored"))
def rescore(spark, sf):
    ws = S.Workspace(spark, sf)
    return tuning.rescore(durable(ws.finished("calibration")), durable(ws.finished("test")), ws.recent(), S.VARIABLES, "vitals_labs")["report"]


@register("rescore_reproduces_settings", "condition:s reproduces:b", f"""
SELECT condition, bool_and(abs(drift_damping - 0.1) < 1e-8 AND abs(level_anchor_weight - 0.75) < 1e-8) AS reproduces FROM ({best_sql('global', 'standard')}) GROUP BY ALL""")
def reproduces(spark, sf):
    from foretrace.operators import postprocess

    ws = S.Workspace(spark, sf)
    fitted = postprocess.fit(ws.raw("calibration"), ws.recent(), S.VARIABLES)
    kept = spark.createDataFrame([(c, 0.1, 0.75) for c in S.CONDITIONS], "condition string, drift_damping double, level_anchor_weight double")
    return tuning.reproduces(fitted, kept)


# --- replayed critic arms --------------------------------------------------------

part("arm_smape", f"SELECT condition, stay_id, avg({SMAPE}) AS smape FROM arm_test GROUP BY ALL")
boot_sql("arms_boot", "arm_smape", ("condition",), "smape")


@register("critic_replay_scores", "condition:s smape:d ci_lo:d ci_hi:d coverage:d violations:i", """
SELECT condition, mean AS smape, ci_lo, ci_hi, coverage, violations FROM arms_boot_ci
JOIN (SELECT condition, avg(CAST(y_true BETWEEN y_pred - factor*half AND y_pred + factor*half AS DOUBLE)) AS coverage,
        count(*) FILTER (y_pred < 5 OR y_pred > 150) AS violations FROM arm_test GROUP BY condition) USING (condition)""")
def replay_scores(spark, sf):
    return critic.replay_scores(replay_tables(spark, sf)[0], S.VARIABLES, resamples=B).withColumnRenamed("mean", "smape")


part("arm_smape_final", f"""
SELECT * FROM arm_smape UNION ALL
SELECT 'critic_final', stay_id, avg({SMAPE}) FROM test_set WHERE condition = 'full_pipeline' GROUP BY stay_id""")
part("arms_paired", paired_sql(critic.arm_pairs(), "arm_smape_final"))
boot_sql("arms_diff", "arms_paired", ("comparison",), "d")


@register("critic_replay_pairs", "comparison:s n_pairs:i mean_diff:d ci_lo:d ci_hi:d share_a_better:d n_nonzero:i statistic:d z:d p_value:d", f"""
SELECT comparison, n AS n_pairs, mean AS mean_diff, ci_lo, ci_hi, share_a_better, n_nonzero, statistic, z, {normal_p_sql('z')} AS p_value
FROM arms_diff_ci JOIN (SELECT comparison, avg(CAST(d < 0 AS DOUBLE)) AS share_a_better FROM arms_paired GROUP BY ALL) USING (comparison)
LEFT JOIN (SELECT * EXCLUDE (n) FROM ({signed_rank_sql("SELECT * FROM arms_paired", ["comparison"])})) USING (comparison)""")
def replay_pairs(spark, sf):
    stored = S.Workspace(spark, sf).finished("test").filter(F.col("condition") == "full_pipeline")
    return critic.replay_pairs(durable(critic.with_final(replay_tables(spark, sf)[0], stored)), resamples=B)
