"""Prompt texts and model-written answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretrace.functions.draws import draw
from foretrace.functions.durable import durable
from foretrace.operators import prompts, responses, similarity
from foretrace.operators.forecast import levels
from foretrace.plans import standin as S
from foretrace.plans.feature_queries import neighbours, outcomes
from foretrace.plans.parts import clip, word
from foretrace.plans.registry import NUDGE, part, register
from foretrace.settings import PromptOptions

H = S.WINDOWS.horizon
CONTEXT = 8192


# --- prompts: numbers are rounded to five places first, on both sides -----------------

def fixed(df, *columns):
    return df.select(*[
        F.round(F.col(c) + NUDGE, 5).alias(c) if c in columns else F.col(c) for c in df.columns])


def sql_fixed(c):
    return f"round({c} + {NUDGE!r}, 5)"


UNIT = "CASE variable WHEN 'click' THEN 'u' WHEN 'purchase' THEN 'mg' ELSE '' END"
part("sum5", f"""
SELECT stay_id, split, variable, idx, n_obs, {', '.join(f'{sql_fixed(c)} AS {c}' for c in ('last', 'mean', 'std', 'slope'))}, {UNIT} AS unit
FROM summary JOIN vars USING (variable)""")
part("ref5", f"""
SELECT variable, idx, {', '.join(f'{sql_fixed(c)} AS {c}' for c in ('median', 'q1', 'q3'))}, {UNIT} AS unit FROM reference JOIN vars USING (variable)""")
TYPICAL = ("printf('- %s: not measured in this window; typical value in this ICU cohort: median %.1f%s (interquartile range %.1f–%.1f)', "
           "variable, median, unit, q1, q3)")


def observation_line(absent, slope=True):
    trend = "printf(', trend_slope=%+.2f/hr', slope)" if slope else "''"
    return (f"CASE WHEN n_obs > 0 THEN printf('- %s: last=%.1f%s, mean=%.1f%s, std=%.1f', variable, last, unit, mean, unit, std) || {trend} "
            f"|| ', n_obs=' || n_obs ELSE {absent} END")


part("obs_block", f"""
SELECT stay_id, string_agg({observation_line(TYPICAL)}, chr(10) ORDER BY s.idx) AS observations
FROM sum5 s JOIN (SELECT variable, median, q1, q3 FROM ref5) USING (variable) WHERE split = 'test' GROUP BY stay_id""")
part("obs_block_flat", f"""
SELECT stay_id, string_agg({observation_line("'- ' || variable || ': no observations in window'", False)}, chr(10) ORDER BY idx) AS observations
FROM sum5 WHERE split = 'test' GROUP BY stay_id""")
part("recent_rows", f"""
SELECT stay_id, variable, idx, string_agg(CASE WHEN value IS NULL THEN 'NA' ELSE printf('%.1f', {sql_fixed('value')}) END, ', ' ORDER BY hour) AS t
FROM cut JOIN vars USING (variable) WHERE split = 'test' AND part = 'obs' AND hour >= 9 GROUP BY ALL""")
part("recent_text", """
SELECT stay_id, 'Last 6 hourly values (oldest first, NA = not measured):' || chr(10) || string_agg('- ' || variable || ': [' || t || ']', chr(10) ORDER BY idx) AS recent
FROM recent_rows GROUP BY stay_id""")
part("anchor_text", """
SELECT 'Typical values in this ICU cohort (all training patients, median [interquartile range]), for reference:' || chr(10) ||
  string_agg(rtrim(printf('- %s: %.1f [%.1f–%.1f] %s', variable, median, q1, q3, unit)), chr(10) ORDER BY idx) AS anchor FROM ref5""")
part("spread_rows", f"""
SELECT query_id, variable, idx, string_agg(printf('+%dh %.1f [%.1f–%.1f]', lead, {sql_fixed('median')}, {sql_fixed('q1')}, {sql_fixed('q3')}), '; ' ORDER BY lead) AS t
FROM spread JOIN vars USING (variable) GROUP BY ALL""")
part("similar_text", f"""
SELECT query_id AS stay_id, 'For context, here is how the ' || k || ' most similar patients in the training cohort (patients whose observation window looked most like this one) actually evolved, as median [interquartile range] at hours after the forecast start. Use it to inform both the forecast and its uncertainty, especially where this patient''s own data are sparse:' || chr(10) ||
  string_agg('- ' || variable || ' (' || {UNIT} || '): ' || t, chr(10) ORDER BY idx) AS alike
FROM spread_rows JOIN (SELECT query_id, count(*) AS k FROM near GROUP BY query_id) USING (query_id) GROUP BY query_id, k""")
part("means_text", f"""
SELECT query_id AS stay_id, 'For context, here is the average trajectory of the ' || k || ' most similar patients in the training cohort (patients whose observation window looked most like this one), which you may use to inform your forecast, especially where this patient''s own observation window is sparse:' || chr(10) ||
  string_agg(printf('- %s: similar-patient cohort average over the horizon ≈ %.1f%s', variable, {sql_fixed('horizon_mean')}, {UNIT}), chr(10) ORDER BY idx) AS alike
FROM horizon_means JOIN vars USING (variable) JOIN (SELECT query_id, count(*) AS k FROM near GROUP BY query_id) USING (query_id)
WHERE horizon_mean IS NOT NULL GROUP BY query_id, k""")
HEAD = "'Observation window summary (5 variables, most recent reading first in ''last''):' || chr(10) || "
ASK = ("'Forecast each variable for the next 15 hours, one value per hour with one decimal place, as strict JSON per the system instructions.'")
STRICT = ("|| ' Every variable listed above, including any with no observations, must have exactly 15 values — no more, no fewer.'")
GAP = " || chr(10) || chr(10) || "


def prompt_summary(ws):
    return fixed(ws.series("test"), "last", "mean", "std", "slope")


def prompt_reference(ws):
    return fixed(ws.reference, "median", "q1", "q3")


@register("prompt_observation_lines", "stay_id:i observations:s", "SELECT * FROM obs_block")
def observation_lines(spark, sf):
    ws = S.Workspace(spark, sf).with_fill()
    return prompts.observation_block(prompt_summary(ws), S.VARIABLES, prompt_reference(ws))


@register("prompt_with_neighbour_means", "stay_id:i prompt:s", f"""
SELECT stay_id, {HEAD} observations{GAP}alike{GAP}{ASK} AS prompt FROM obs_block JOIN means_text USING (stay_id)""")
def prompt_means(spark, sf):
    ws = S.Workspace(spark, sf).with_fill()
    near = durable(neighbours(ws))
    means = similarity.horizon_mean(similarity.mean_trajectories(outcomes(ws, near), S.VARIABLES, S.WINDOWS))
    return prompts.build(prompt_summary(ws), S.VARIABLES, S.WINDOWS, PromptOptions(), prompt_reference(ws),
                         neighbors=near, means=fixed(means, "horizon_mean"))


@register("prompt_with_every_block", "stay_id:i prompt:s", f"""
SELECT stay_id, {HEAD} observations || chr(10) || recent{GAP}anchor{GAP}alike{GAP}
'{prompts.DAMPED_NOTE.replace("'", "''")}'{GAP}{ASK}{STRICT} AS prompt
FROM (SELECT stay_id, string_agg({observation_line("'- ' || variable || ': no observations in window'")}, chr(10) ORDER BY idx) AS observations
  FROM sum5 WHERE split = 'test' GROUP BY stay_id)
JOIN recent_text USING (stay_id) JOIN similar_text USING (stay_id) CROSS JOIN anchor_text""")
def prompt_everything(spark, sf):
    ws = S.Workspace(spark, sf).with_fill()
    near = durable(neighbours(ws))
    spread = similarity.trajectory_quantiles(outcomes(ws, near), S.VARIABLES, S.WINDOWS)
    options = PromptOptions("trajectory", True, 6, "damped", True)
    cells = fixed(ws.cells.filter(F.col("split") == "test"), "value")
    return prompts.build(prompt_summary(ws), S.VARIABLES, S.WINDOWS, options, prompt_reference(ws), cells,
                         near, spread=fixed(spread, "median", "q1", "q3"))


@register("prompt_per_group_options", "prompt_group:s stay_id:i prompt:s", f"""
SELECT 'single_model_llm' AS prompt_group, stay_id, {HEAD} observations{GAP}{ASK} AS prompt FROM obs_block_flat
UNION ALL SELECT 'full_pipeline', stay_id, {HEAD} observations{GAP}{ASK}{STRICT} FROM obs_block_flat""")
def prompt_groups(spark, sf):
    ws = S.Workspace(spark, sf)
    return prompts.build_per_group(
        PromptOptions(trend_hint="none"), {"full_pipeline": PromptOptions(trend_hint="none", strict_length=True)},
        summary=prompt_summary(ws), variables=S.VARIABLES, windows=S.WINDOWS)


# --- answers: the naive forecast as JSON, with hash-chosen defects -----------------------

part("answer_series", f"""
SELECT l.stay_id, l.split, l.variable, v.idx, c.condition, l.naive, l.width,
  CAST(floor(10*round(l.naive, 3) + 1e-6) AS BIGINT) AS t0, CAST(floor(10*round(l.width, 3) + 1e-6) AS BIGINT) AS w0,
  {word("'step:' || c.condition || ':' || l.stay_id || ':' || l.variable")} % 7 AS step, {word("'shape:' || c.condition || ':' || l.stay_id")} % 16 AS pick
FROM levels l JOIN vars v USING (variable) CROSS JOIN (SELECT * FROM conds WHERE condition NOT LIKE '%@alt') c WHERE l.split = 'test'""")
part("answer_cells", """
SELECT *, CASE WHEN pick = 7 AND variable = 'error' AND hour = 2 THEN 999999 ELSE t0 + step*hour END AS t
FROM answer_series CROSS JOIN (SELECT unnest(range(15)) AS hour)""")


def dec(x):
    return f"({x})//10 || '.' || ({x}) % 10"


part("answer_fragments", f"""
SELECT condition, stay_id, variable, idx, pick,
  '"' || variable || '": [' || string_agg({dec('t')}, ', ' ORDER BY hour) FILTER (NOT (pick = 5 AND variable = 'click' AND hour = 14)) || ']' AS f,
  '"' || variable || '": ' || CASE
    WHEN variable = 'click' AND pick = 6 THEN '0'
    WHEN variable = 'click' AND pick = 8 THEN '[' || string_agg(CASE WHEN hour = 1 THEN '0' ELSE {dec('w0 + hour')} END, ', ' ORDER BY hour) || ']'
    WHEN variable = 'click' AND pick = 9 THEN '{{"start": ' || any_value({dec('w0')}) || ', "end": ' || any_value({dec('w0 + 28')}) || '}}'
    WHEN variable = 'signup' THEN '-' || any_value({dec('w0')}) ELSE any_value({dec('w0')}) END AS h
FROM answer_cells GROUP BY condition, stay_id, variable, idx, pick, w0""")
part("answer_json", """
SELECT condition, stay_id, pick, '{"forecast": {' || string_agg(f, ', ' ORDER BY idx) FILTER (NOT (pick = 4 AND variable = 'view')) ||
  '}, "interval_halfwidth": {' || string_agg(h, ', ' ORDER BY idx) FILTER (NOT (pick = 4 AND variable = 'view')) || '}}' AS j
FROM answer_fragments GROUP BY condition, stay_id, pick""")
part("answers", """
SELECT condition, stay_id, pick, CASE WHEN pick IN (0, 1) THEN '' WHEN pick = 2 THEN substr(j, 1, length(j)//2)
    WHEN pick = 3 THEN 'Here is the forecast: ' || j || ' Best regards' WHEN pick = 11 THEN 'no forecast today' ELSE j END AS text,
  CASE pick WHEN 0 THEN 'timeout' WHEN 1 THEN 'server_error' ELSE 'ok' END AS status,
  CASE pick WHEN 2 THEN 'length' ELSE 'stop' END AS done_reason,
  CASE pick WHEN 10 THEN 8000 ELSE 400 END AS prompt_tokens, length(j)//2 + stay_id % 7 AS answer_tokens FROM answer_json""")


def decimal(x: Column) -> Column:
    return F.concat(F.floor(x / 10).cast("string"), F.lit("."), (x % 10).cast("string"))


def answers(ws):
    """(condition, stay_id, text, status, done_reason, prompt_tokens, answer_tokens, pick)."""
    base = levels(ws.with_fill().series("test"), ("naive",), ws.fill).drop("condition")
    names = F.explode(F.array(*[F.lit(c) for c in S.PLAIN])).alias("condition")
    df = base.select("stay_id", "variable", "level", "width", names)
    tenth = lambda c: F.floor(10 * F.round(c, 3) + 1e-6).cast("long")
    step = draw("step", F.col("condition"), F.col("stay_id"), F.col("variable")) % 7
    df = df.select("*", tenth(F.col("level")).alias("t0"), tenth(F.col("width")).alias("w0"), step.alias("step"),
                   (draw("shape", F.col("condition"), F.col("stay_id")) % 16).alias("pick"))
    hours = F.sequence(F.lit(0), F.lit(H - 1))
    click = F.col("variable") == "click"
    short = F.filter(hours, lambda h: ~((F.col("pick") == 5) & click & (h == H - 1)))
    value = lambda h: F.when((F.col("pick") == 7) & (F.col("variable") == "error") & (h == 2), F.lit(999999)).otherwise(
        F.col("t0") + F.col("step") * h)
    values = F.array_join(F.transform(short, lambda h: decimal(value(h))), ", ")
    listed = F.array_join(F.transform(hours, lambda h: F.when(h == 1, F.lit("0")).otherwise(decimal(F.col("w0") + h))), ", ")
    width = (
        F.when(click & (F.col("pick") == 6), F.lit("0"))
        .when(click & (F.col("pick") == 8), F.concat(F.lit("["), listed, F.lit("]")))
        .when(click & (F.col("pick") == 9), F.concat(F.lit('{"start": '), decimal(F.col("w0")), F.lit(', "end": '), decimal(F.col("w0") + 28), F.lit("}")))
        .when(F.col("variable") == "signup", F.concat(F.lit("-"), decimal(F.col("w0")))).otherwise(decimal(F.col("w0"))))
    name = F.concat(F.lit('"'), F.col("variable"), F.lit('": '))
    kept = ~((F.col("pick") == 4) & (F.col("variable") == "view"))
    entry = F.when(kept, F.struct("variable", F.concat(name, F.lit("["), values, F.lit("]")).alias("f"), F.concat(name, width).alias("h")))
    packed = df.groupBy("condition", "stay_id", "pick").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    joined = lambda k: F.array_join(F.transform("e", lambda x: x[k]), ", ")
    json = F.concat(F.lit('{"forecast": {'), joined("f"), F.lit('}, "interval_halfwidth": {'), joined("h"), F.lit("}}"))
    pick = F.col("pick")
    return packed.withColumn("j", json).select(
        "condition", "stay_id", "pick",
        F.when(pick.isin(0, 1), "").when(pick == 2, F.substring(F.col("j"), F.lit(1), F.floor(F.length("j") / 2).cast("int")))
        .when(pick == 3, F.concat(F.lit("Here is the forecast: "), F.col("j"), F.lit(" Best regards")))
        .when(pick == 11, "no forecast today").otherwise(F.col("j")).alias("text"),
        F.when(pick == 0, "timeout").when(pick == 1, "server_error").otherwise("ok").alias("status"),
        F.when(pick == 2, "length").otherwise("stop").alias("done_reason"),
        F.when(pick == 10, 8000).otherwise(400).alias("prompt_tokens"),
        (F.floor(F.length("j") / 2) + F.col("stay_id") % 7).alias("answer_tokens"))


@register("answer_texts", "condition:s stay_id:i text:s status:s done_reason:s answer_tokens:i",
          "SELECT condition, stay_id, text, status, done_reason, answer_tokens FROM answers")
def answer_texts(spark, sf):
    return answers(S.Workspace(spark, sf))


@register("answer_json_block", "condition:s stay_id:i block:s", """
SELECT condition, stay_id, CASE WHEN instr(text, '{') > 0 AND instr(text, '}') > 0 AND length(text) - instr(reverse(text), '}') + 1 >= instr(text, '{')
  THEN substr(text, instr(text, '{'), length(text) - instr(reverse(text), '}') + 2 - instr(text, '{')) END AS block FROM answers""")
def json_block(spark, sf):
    return answers(S.Workspace(spark, sf)).withColumn("block", responses.extract_json())


FAILED = "pick IN (0, 1, 2, 5, 10, 11)"
# A half-written answer keeps whatever ends in '}', so it parses to nothing usable.
part("answer_state", f"""
SELECT condition, stay_id, variable, idx, pick, naive, width, w0, hour, t,
  CASE pick WHEN 0 THEN 'llm_timeout' WHEN 1 THEN 'llm_server_error' WHEN 2 THEN 'truncated_forecast' WHEN 10 THEN 'context_overflow'
    WHEN 5 THEN 'malformed_forecast' WHEN 11 THEN 'malformed_forecast' END AS error_kind,
  CASE WHEN {FAILED} THEN 'fallback' WHEN pick = 4 AND variable = 'view' THEN 'filled' WHEN pick = 7 AND variable = 'error' THEN 'filled' ELSE 'model' END AS source,
  CASE WHEN variable = 'click' AND pick = 6 THEN 0.0 WHEN variable = 'click' AND pick = 8 THEN CASE WHEN hour = 1 THEN 0.0 ELSE (w0 + hour)/10.0 END
    WHEN variable = 'click' AND pick = 9 THEN w0/10.0 + 2.8*hour/14 ELSE w0/10.0 END AS said
FROM answer_cells""")
part("answer_fixed", """
SELECT *, CASE WHEN source <> 'model' THEN width WHEN said > 0 THEN said
    ELSE coalesce(min(CASE WHEN said > 0 THEN said END) OVER (PARTITION BY condition, stay_id, variable), width) END AS halfwidth,
  source = 'model' AND bool_or(said <= 0) OVER (PARTITION BY condition, stay_id, variable) AS zero_fixed FROM answer_state""")
part("answer_rows", f"""
SELECT *, CASE WHEN source = 'fallback' THEN naive
    WHEN source = 'filled' THEN {clip('naive', '0.0', "(CASE WHEN variable = 'purchase' THEN 180.0 END)")}
    ELSE {clip('(t/10.0)', '0.0', "(CASE WHEN variable = 'purchase' THEN 180.0 END)")} END AS y_raw FROM answer_fixed""")


def resolved(spark, sf):
    ws = S.Workspace(spark, sf)
    texts = durable(answers(ws))
    return responses.resolve(texts.drop("pick"), ws.series("test"), S.VARIABLES, S.WINDOWS, ws.fill, CONTEXT)


@register("answer_validation", "condition:s stay_id:i variable:s present:b n_values:i malformed:b usable:b", """
SELECT condition, stay_id, variable, p AS present, CASE WHEN p THEN CASE WHEN pick = 5 AND variable = 'click' THEN 14 ELSE 15 END END AS n_values,
  pick IN (0, 1, 2, 5, 11) AS malformed, p AND pick <> 5 AND NOT (pick = 7 AND variable = 'error') AS usable FROM (
  SELECT *, pick NOT IN (0, 1, 2, 11) AND NOT (pick = 4 AND variable = 'view') AS p FROM answer_series)""")
def validation(spark, sf):
    checked = responses.validate(answers(S.Workspace(spark, sf)), S.VARIABLES, S.WINDOWS)
    # A cut-off text may still hold the first block; nothing in it counts as present here.
    cut_off = F.col("pick") == 2
    return checked.withColumn("n_values", F.when(~cut_off, F.nullif(F.size("values"), F.lit(-1)))).withColumn(
        "present", F.col("present") & ~cut_off).withColumn("usable", F.col("usable") & ~cut_off)


@register("answer_halfwidths", "condition:s stay_id:i variable:s hour:i halfwidth:d", """
SELECT condition, stay_id, variable, hour, halfwidth FROM answer_rows WHERE source = 'model'""")
def answer_halfwidths(spark, sf):
    return responses.to_forecasts(resolved(spark, sf)).filter(F.col("source") == "model")


@register("answer_forecasts", "condition:s stay_id:i variable:s hour:i y_raw:d halfwidth:d source:s",
          "SELECT condition, stay_id, variable, hour, y_raw, halfwidth, source FROM answer_rows")
def answer_forecasts(spark, sf):
    return responses.to_forecasts(resolved(spark, sf))


@register("answer_absurd_values", "condition:s variable:s present:i absurd:i", """
SELECT condition, variable, count(*) AS present, count(*) FILTER (pick = 7 AND variable = 'error') AS absurd FROM answer_series
WHERE pick NOT IN (0, 1, 2, 11) AND NOT (pick = 4 AND variable = 'view') GROUP BY ALL""")
def absurd_values(spark, sf):
    whole = answers(S.Workspace(spark, sf)).filter(F.col("done_reason") == "stop")
    return responses.absurd(responses.validate(whole, S.VARIABLES, S.WINDOWS))


@register("answer_error_counts", "condition:s kind:s n:i", """
SELECT condition, error_kind AS kind, count(DISTINCT stay_id) AS n FROM answer_rows WHERE error_kind IS NOT NULL GROUP BY ALL
UNION ALL SELECT condition, 'zero_interval', count(*) FROM answer_rows WHERE zero_fixed AND hour = 0 GROUP BY ALL
UNION ALL SELECT condition, 'absurd_values', count(*) FROM answer_series WHERE pick = 7 AND variable = 'error' GROUP BY ALL""")
def error_counts(spark, sf):
    return responses.error_counts(resolved(spark, sf), len(S.VARIABLES))


@register("answer_fill_rates", "condition:s variable:s n_stays:i fallback_rate:d filled_rate:d", """
SELECT condition, variable, count(*) AS n_stays, avg(CAST(source = 'fallback' AS DOUBLE)) AS fallback_rate, avg(CAST(source = 'filled' AS DOUBLE)) AS filled_rate
FROM answer_rows WHERE hour = 0 GROUP BY ALL""")
def fill_rates(spark, sf):
    return responses.rates(resolved(spark, sf))


@register("answer_audit", "condition:s stay_id:i parses:b n_right_length:i all_lengths_ok:b max_decimals:i", """
SELECT condition, stay_id, pick NOT IN (0, 1, 2, 11) AS parses, CASE WHEN pick IN (0, 1, 2, 11) THEN 0 WHEN pick IN (4, 5) THEN 4 ELSE 5 END AS n_right_length,
  pick NOT IN (0, 1, 2, 4, 5, 11) AS all_lengths_ok,
  coalesce(list_max(list_transform(regexp_extract_all(text, '[0-9]\\.([0-9]+)', 1), lambda x: length(x))), 0) AS max_decimals FROM answers""")
def answer_audit(spark, sf):
    out = responses.audit(answers(S.Workspace(spark, sf)), S.VARIABLES, S.WINDOWS)
    # What a cut-off text still yields depends on where it was cut.
    cut_off = F.col("pick") == 2
    return out.withColumn("n_right_length", F.when(cut_off, 0).otherwise(F.col("n_right_length")))


@register("answer_audit_report", "mode:s n:i stopped:i cut_off:i median_tokens:i max_tokens:i usable:i max_decimals:i", """
SELECT condition AS mode, count(*) AS n, count(*) FILTER (done_reason = 'stop') AS stopped, count(*) FILTER (done_reason = 'length') AS cut_off,
  list_sort(list(answer_tokens))[count(*)//2 + 1] AS median_tokens, max(answer_tokens) AS max_tokens,
  count(*) FILTER (pick NOT IN (0, 1, 2, 4, 5, 11)) AS usable, 1 AS max_decimals FROM answers GROUP BY ALL""")
def audit_report(spark, sf):
    texts = durable(answers(S.Workspace(spark, sf)).withColumn("mode", F.col("condition")))
    return responses.audit_report(responses.audit(texts, S.VARIABLES, S.WINDOWS))
