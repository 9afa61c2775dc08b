"""Prompt texts as a table, one row per stay, for a model that runs elsewhere.

Numbers are printed half-even from the exact binary value, like C and Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions.cells import lookup
from foretrace.operators.similarity import report_hours
from foretrace.settings import PromptOptions, Variable, Windows

# The wording of the prompt, on which the answers depend.
HEAD = "Observation window summary ({n} variables, most recent reading first in 'last'):\n"
NOT_OBSERVED = "no observations in window"
TYPICAL = "not measured in this window; typical value in this ICU cohort: median "
RECENT_HEAD = "Last {n} hourly values (oldest first, NA = not measured):\n"
ANCHOR_HEAD = "Typical values in this ICU cohort (all training patients, median [interquartile range]), for reference:\n"
SIMILAR_TRAJECTORY = (
    "For context, here is how the ",
    " most similar patients in the training cohort (patients whose observation window looked most like this one) "
    "actually evolved, as median [interquartile range] at hours after the forecast start. Use it to inform both the "
    "forecast and its uncertainty, especially where this patient's own data are sparse:\n",
)
SIMILAR_MEAN = (
    "For context, here is the average trajectory of the ",
    " most similar patients in the training cohort (patients whose observation window looked most like this one), "
    "which you may use to inform your forecast, especially where this patient's own observation window is sparse:\n",
)
SIMILAR_LINE = ": similar-patient cohort average over the horizon ≈ "
ASK = (
    "Forecast each variable for the next {h} hours, one value per hour with one decimal place, as strict JSON per the "
    "system instructions."
)
STRICT = (
    " Every variable listed above, including any with no observations, must have exactly {h} values — no more, no fewer."
)
DAMPED_NOTE = (
    "Note on trends: over the next day, ICU vital signs and labs usually stay near their current level or drift "
    "back toward the patient's recent average. A trend seen in the observation window rarely continues at the "
    "same rate for 24 hours, so do not extend trend_slope in a straight line."
)


def one_decimal(x: Column | str) -> Column:
    return _pattern(x, "0.0")


def signed_two(x: Column | str) -> Column:
    return _pattern(x, "+0.00;-0.00")


def _pattern(x: Column | str, pattern: str) -> Column:
    return F.call_function("format_number", F.col(x) if isinstance(x, str) else x, F.lit(pattern))


def _unit(variables: list[Variable]) -> Column:
    pairs = [F.lit(x) for v in variables for x in (v.name, v.unit)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("variable")), F.lit(""))


def _index(variables: list[Variable]) -> Column:
    return lookup({v.name: i for i, v in enumerate(variables)})


def joined_lines(df: DataFrame, line: Column, variables: list[Variable], name: str, key: str = "stay_id") -> DataFrame:
    """One line per variable, in panel order, joined with newlines; null lines are skipped."""
    entry = F.when(line.isNotNull(), F.struct(_index(variables).alias("i"), line.alias("t")))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_l")).select(
        key, F.when(F.size("_l") > 0, F.array_join(F.transform("_l", lambda x: x["t"]), "\n")).alias(name))


def observation_block(summary: DataFrame, variables: list[Variable], reference: DataFrame | None = None,
                      trend: bool = True) -> DataFrame:
    """(stay_id, observations): last, mean, std, optional slope and count, or the
    cohort's typical value for a variable that was not measured."""
    unit = _unit(variables)
    df = summary if reference is None else summary.join(
        F.broadcast(reference.select("variable", "median", "q1", "q3")), "variable", "left")
    name = F.concat(F.lit("- "), F.col("variable"), F.lit(": "))
    slope = F.concat(F.lit(", trend_slope="), signed_two("slope"), F.lit("/hr")) if trend else F.lit("")
    seen = F.concat(
        name, F.lit("last="), one_decimal("last"), unit, F.lit(", mean="), one_decimal("mean"), unit,
        F.lit(", std="), one_decimal("std"), slope, F.lit(", n_obs="), F.col("n_obs").cast("string"))
    absent = F.concat(name, F.lit(NOT_OBSERVED))
    if reference is not None:
        typical = F.concat(
            name, F.lit(TYPICAL), one_decimal("median"),
            unit, F.lit(" (interquartile range "), one_decimal("q1"), F.lit("–"), one_decimal("q3"), F.lit(")"))
        absent = F.coalesce(typical, absent)
    return joined_lines(df, F.when(F.col("n_obs") > 0, seen).otherwise(absent), variables, "observations")


def recent_block(cut_grid: DataFrame, variables: list[Variable], windows: Windows, n_hours: int) -> DataFrame:
    """(stay_id, recent): the last n values of each variable, oldest first, NA = missing."""
    last = cut_grid.filter((F.col("part") == "obs") & (F.col("hour") >= windows.obs - n_hours))
    cells = F.array_sort(F.collect_list(F.struct("hour", F.coalesce(one_decimal("value"), F.lit("NA")).alias("t"))))
    rows = last.groupBy("stay_id", "variable").agg(cells.alias("_c"))
    line = F.concat(F.lit("- "), F.col("variable"), F.lit(": ["),
                    F.array_join(F.transform("_c", lambda c: c["t"]), ", "), F.lit("]"))
    head = F.lit(RECENT_HEAD.format(n=n_hours))
    return joined_lines(rows, line, variables, "_r").select("stay_id", F.concat(head, "_r").alias("recent"))


def anchor_block(reference: DataFrame, variables: list[Variable]) -> DataFrame:
    """One row: the cohort's median and quartiles per variable."""
    line = F.rtrim(F.concat(F.lit("- "), F.col("variable"), F.lit(": "), one_decimal("median"), F.lit(" ["),
                            one_decimal("q1"), F.lit("–"), one_decimal("q3"), F.lit("] "), _unit(variables)))
    head = F.lit(ANCHOR_HEAD)
    lines = joined_lines(reference.withColumn("_g", F.lit(0)), line, variables, "_a", key="_g")
    return lines.select(F.concat(head, "_a").alias("anchor"))


def similarity_block(neighbors: DataFrame, variables: list[Variable], windows: Windows, kind: str,
                     means: DataFrame | None = None, spread: DataFrame | None = None) -> DataFrame:
    """(stay_id, similar): neighbour outcomes as one mean per variable
    (``means``) or as quartiles at a few lead hours (``spread``)."""
    size = neighbors.groupBy(F.col("query_id").alias("stay_id")).agg(F.count(F.lit(1)).alias("_k"))
    unit = _unit(variables)
    if kind == "trajectory":
        part = F.concat(F.lit("+"), F.col("lead").cast("string"), F.lit("h "), one_decimal("median"), F.lit(" ["),
                        one_decimal("q1"), F.lit("–"), one_decimal("q3"), F.lit("]"))
        rows = spread.filter(F.col("lead").isin(report_hours(windows))).groupBy(
            F.col("query_id").alias("stay_id"), "variable").agg(
            F.array_sort(F.collect_list(F.struct("lead", part.alias("t")))).alias("_p"))
        line = F.concat(F.lit("- "), F.col("variable"), F.lit(" ("), unit, F.lit("): "),
                        F.array_join(F.transform("_p", lambda x: x["t"]), "; "))
        head = SIMILAR_TRAJECTORY
    else:
        rows = means.select(F.col("query_id").alias("stay_id"), "variable", "horizon_mean")
        line = F.concat(F.lit("- "), F.col("variable"), F.lit(SIMILAR_LINE),
                        one_decimal("horizon_mean"), unit)
        head = SIMILAR_MEAN
    lines = joined_lines(rows, line, variables, "_s")
    return lines.join(size, "stay_id").select(
        "stay_id", F.concat(F.lit(head[0]), F.col("_k").cast("string"), F.lit(head[1]), "_s").alias("similar"))


def build(summary: DataFrame, variables: list[Variable], windows: Windows, options: PromptOptions | None = None,
          reference: DataFrame | None = None, cut_grid: DataFrame | None = None, neighbors: DataFrame | None = None,
          means: DataFrame | None = None, spread: DataFrame | None = None) -> DataFrame:
    """(stay_id, prompt)."""
    options = options or PromptOptions()
    if options.cohort_anchor and reference is None:
        raise ValueError("cohort_anchor needs reference statistics")
    if options.recent_hours > 0 and cut_grid is None:
        raise ValueError("recent_hours needs the grid")
    df = observation_block(summary, variables, None if options.cohort_anchor else reference,
                           options.trend_hint != "none")
    if options.recent_hours > 0:
        df = df.join(recent_block(cut_grid, variables, windows, options.recent_hours), "stay_id", "left").withColumn(
            "observations", F.concat_ws("\n", "observations", "recent")).drop("recent")
    df = df.withColumn("_g", F.lit(0))
    if options.cohort_anchor:
        # A single text row, attached by a constant key.
        df = df.join(F.broadcast(anchor_block(reference, variables).withColumn("_g", F.lit(0))), "_g", "left")
    else:
        df = df.withColumn("anchor", F.lit(None).cast("string"))
    if neighbors is not None:
        df = df.join(similarity_block(neighbors, variables, windows, options.similarity_context, means, spread),
                     "stay_id", "left")
    else:
        df = df.withColumn("similar", F.lit(None).cast("string"))
    head = HEAD.format(n=len(variables))
    ask = (ASK + STRICT if options.strict_length else ASK).format(h=windows.horizon)
    note = F.lit(DAMPED_NOTE) if options.trend_hint == "damped" else F.lit(None).cast("string")
    return df.select("stay_id", F.concat_ws(
        "\n\n", F.concat(F.lit(head), "observations"), "anchor", "similar", note, F.lit(ask)).alias("prompt"))


def build_per_group(base_options: PromptOptions, overrides: dict[str, PromptOptions], **inputs) -> DataFrame:
    """(prompt_group, stay_id, prompt): each prompt group under its own options."""
    from foretrace.settings import PROMPT_GROUPS

    unknown = set(overrides) - set(PROMPT_GROUPS)
    if unknown:
        raise ValueError(f"unknown prompt groups {sorted(unknown)}")
    out = None
    for group in PROMPT_GROUPS:
        texts = build(options=overrides.get(group, base_options), **inputs).withColumn("prompt_group", F.lit(group))
        out = texts if out is None else out.unionByName(texts)
    return out
