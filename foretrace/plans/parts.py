"""Common table expressions that mirror ``standin`` in portable SQL."""

from __future__ import annotations

from foretrace.plans.registry import part
from foretrace.plans.standin import CONDITIONS, NAMES


def word(expr: str, index: int = 0) -> str:
    return f"CAST('0x' || substr(md5({expr}), {1 + 8 * index}, 8) AS BIGINT)"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def normal_p_sql(z: str) -> str:
    """P(|Z| >= |z|) as in functions.pvalues."""
    return (f"CASE WHEN abs({z}) < 0.1 THEN 1 - sqrt(2/pi())*(abs({z}) - pow(abs({z}), 3)/6 + pow(abs({z}), 5)/40 - pow(abs({z}), 7)/336) "
            f"WHEN {z} IS NOT NULL THEN list_sum(list_transform(range(400), lambda i: exp(-({z})*({z})/(2*pow(sin((i + 0.5)*pi()/800), 2)))))/400 END")


def kolmogorov_sql(d: str, n1: str, n2: str) -> str:
    """The limit law of the two-sample distance as in functions.pvalues."""
    x = f"({d}*sqrt({n1}::DOUBLE*{n2}/({n1} + {n2})))"
    return (f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} < 1 THEN 1 - sqrt(2*pi())/{x}*list_sum(list_transform(range(12), lambda i: exp(-pow((2*i + 1)*pi()/{x}, 2)/8))) "
            f"ELSE least(1.0, greatest(0.0, 2*list_sum(list_transform(range(12), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END*exp(-2*pow((i + 1)*{x}, 2)))))) END")


VARS = values([(n, i) for i, n in enumerate(NAMES)])
CONDS = values([(c,) for c in CONDITIONS])
# Hard upper bound per variable; the lower one is 0 for all.
HARD_HI = "CASE WHEN variable = 'purchase' THEN 180.0 END"
SMAPE = "2*abs(y_true - y_pred)/(abs(y_true) + abs(y_pred) + 1e-8)"


def clip(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END"


part("vars", f"SELECT * FROM (VALUES {VARS}) t(variable, idx)")
part("conds", f"SELECT * FROM (VALUES {CONDS}) t(condition)")
part("stays", "SELECT DISTINCT user_id AS stay_id, TIMESTAMP '2024-01-01' AS intime FROM events")
part("aligned", """
SELECT user_id AS stay_id, event_type AS variable, value,
       (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))/1e6/86400.0 AS "offset"
FROM events WHERE (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))/1e6/86400.0 BETWEEN 0 AND 30""")
part("clean", "SELECT * FROM aligned WHERE NOT (value < 0.1 OR value > 300)")
part("panel", """
SELECT stay_id, variable, CAST(floor("offset") AS INT) AS hour, avg(value) AS value FROM clean GROUP BY ALL""")
part("covered", """
SELECT stay_id, count(*)/150.0 AS coverage FROM panel GROUP BY stay_id HAVING count(*)/150.0 >= 0.3""")
part("placed", """
SELECT stay_id, intime, row_number() OVER (ORDER BY md5('split-42:' || stay_id), stay_id) - 1 AS p, count(*) OVER () AS n
FROM stays SEMI JOIN covered USING (stay_id)""")
part("cohort", """
SELECT stay_id, intime, CASE WHEN p < floor(n*0.7) THEN 'train' WHEN p < floor(n*0.7) + floor(n*0.15) THEN 'val' ELSE 'test' END AS split
FROM placed""")
part("subsets", """
SELECT stay_id, CASE WHEN row_number() OVER (ORDER BY md5('tune-42:' || stay_id), stay_id) <= 8 THEN 'tune' ELSE 'calibration' END AS subset
FROM cohort WHERE split = 'val'""")
part("grid", """
SELECT c.stay_id, c.split, v.variable, CAST(h.hour AS INT) AS hour, p.value
FROM cohort c CROSS JOIN vars v CROSS JOIN (SELECT unnest(range(30)) AS hour) h
LEFT JOIN panel p ON p.stay_id = c.stay_id AND p.variable = v.variable AND p.hour = h.hour""")
part("bracketed", """
SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) OVER b AS ph,
  first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN hour END IGNORE NULLS) OVER a AS nh
FROM grid
WINDOW b AS (PARTITION BY stay_id, variable ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       a AS (PARTITION BY stay_id, variable ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
part("interp", """
SELECT stay_id, split, variable, hour, CASE WHEN value IS NOT NULL THEN value
  WHEN pv IS NOT NULL AND nv IS NOT NULL AND hour - ph <= 3 THEN pv + (nv - pv)*(hour - ph)/(nh - ph) END AS value
FROM bracketed""")
part("cut", """
SELECT stay_id, split, variable, CASE WHEN hour < 15 THEN 'obs' ELSE 'horizon' END AS part,
  CASE WHEN hour < 15 THEN hour ELSE hour - 15 END AS hour, value FROM interp""")
part("summary", """
SELECT stay_id, split, variable, arg_max(value, hour) FILTER (part = 'obs' AND value IS NOT NULL) AS last,
  avg(value) FILTER (part = 'obs') AS mean, stddev_pop(value) FILTER (part = 'obs') AS std,
  CASE WHEN count(value) FILTER (part = 'obs') = 0 THEN NULL WHEN count(value) FILTER (part = 'obs') = 1 THEN 0.0
       ELSE regr_slope(value, hour) FILTER (part = 'obs') END AS slope,
  count(value) FILTER (part = 'obs') AS n_obs, avg(value) FILTER (part = 'obs' AND hour >= 9) AS recent_mean
FROM cut GROUP BY stay_id, split, variable""")
part("reference", """
SELECT variable, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
  stddev_pop(value) AS std, count(value) AS n FROM cut WHERE split = 'train' AND value IS NOT NULL GROUP BY variable""")
part("fill", """
SELECT v.variable, coalesce(r.median, 0.0) AS fill_value, CASE WHEN r.median IS NOT NULL THEN 1.645*r.std ELSE 1.5 END AS fill_width
FROM vars v LEFT JOIN reference r USING (variable)""")
part("levels", """
SELECT stay_id, split, variable, n_obs, recent_mean,
  CASE WHEN n_obs > 0 THEN last ELSE fill_value END AS naive,
  CASE WHEN n_obs > 0 THEN coalesce(recent_mean, last) ELSE fill_value END AS recent,
  CASE WHEN n_obs > 0 THEN 0.5*(last + mean) ELSE fill_value END AS blend,
  CASE WHEN n_obs > 0 THEN greatest(CASE WHEN n_obs > 1 THEN std ELSE 1.0 END, 1e-3)*1.5 ELSE fill_width END AS width
FROM summary JOIN fill USING (variable)""")
part("truth", "SELECT stay_id, split, variable, hour, value AS y_true FROM cut WHERE part = 'horizon'")
part("persistence", """
SELECT condition, stay_id, split, variable, hour, y_true, level AS y_pred, level - width AS y_lower, level + width AS y_upper
FROM truth JOIN (
  SELECT stay_id, variable, width, 'naive' AS condition, naive AS level FROM levels UNION ALL
  SELECT stay_id, variable, width, 'recent_mean', recent FROM levels UNION ALL
  SELECT stay_id, variable, width, 'persistence_blend', blend FROM levels) USING (stay_id, variable)""")
KEY = "condition || ':' || stay_id || ':' || variable"
part("hashed", f"""
SELECT condition, stay_id, split, variable, recent AS level, width, recent_mean,
  ({word(f"'offset:' || {KEY}")} % 2001 - 1000)/1000.0 AS a, ({word(f"'drift:' || {KEY}")} % 2001 - 1000)/1000.0 AS d,
  width*(0.5 + ({word(f"'width:' || {KEY}")} % 1000)/1000.0) AS half
FROM levels CROSS JOIN conds""")
part("model_raw", """
SELECT condition, stay_id, split, variable, hour, y_true, recent_mean,
  level + 0.6*width*a + 0.25*width*d*(hour + 1) AS y_raw, half
FROM hashed JOIN (SELECT stay_id, variable, hour, y_true FROM truth) USING (stay_id, variable)""")
part("with_first", """
SELECT *, max(CASE WHEN hour = 0 THEN y_raw END) OVER (PARTITION BY condition, stay_id, variable) AS y_first FROM model_raw""")


def adjusted(damping: str, weight: str) -> str:
    shift = f"coalesce({weight}*(recent_mean - y_first), 0.0)"
    return (f"CASE WHEN {damping} < 1 THEN y_first + {shift} + {damping}*(y_raw - y_first) ELSE y_raw + {shift} END")


CRITIC = ("split_part(condition, '@', 1) IN ('full_pipeline', 'full_pipeline_no_similarity', 'full_pipeline_clip_critic')")


def final(x: str) -> str:
    hard = clip(x, "0.0", f"({HARD_HI})")
    return f"CASE WHEN {CRITIC} THEN {clip(f'({hard})', '5.0', '150.0')} ELSE {hard} END"


part("moved", f"SELECT *, {adjusted('0.5', '0.25')} AS y_adj FROM with_first")
part("finished", f"""
SELECT condition, stay_id, split, variable, hour, y_true, y_raw, y_pred, y_pred - half AS y_lower, y_pred + half AS y_upper, half
FROM (SELECT *, {final('y_adj')} AS y_pred FROM moved)""")
part("calibration", """
SELECT * FROM finished WHERE stay_id IN (SELECT stay_id FROM subsets WHERE subset = 'calibration')""")
part("test_set", "SELECT * FROM finished WHERE split = 'test'")
part("scores", """
SELECT condition, variable, abs(y_true - y_pred)/half AS score FROM calibration
WHERE y_true IS NOT NULL AND y_pred IS NOT NULL AND half > 0""")
part("factors", """
SELECT condition, variable, score AS factor, n FROM (
  SELECT *, row_number() OVER (PARTITION BY condition, variable ORDER BY score) AS r,
    count(*) OVER (PARTITION BY condition, variable) AS n FROM scores)
WHERE r = least(n, (9*(n + 1) + 9)//10)""")
part("per_stay", f"""
SELECT condition, stay_id, avg({SMAPE}) AS smape FROM test_set GROUP BY ALL""")
part("flags", """
SELECT stay_id, bool_or(coalesce(h BETWEEN 15 AND 20, FALSE)) AS deteriorating FROM (
  SELECT c.stay_id, (epoch_us(e.ts) - epoch_us(TIMESTAMP '2024-01-01'))/1e6/86400.0 AS h FROM cohort c
  LEFT JOIN events e ON e.user_id = c.stay_id AND e.event_type = 'error' AND e.value > 120) GROUP BY stay_id""")
