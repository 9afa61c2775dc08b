"""Model-written JSON answers to forecast rows.

Input: responses(condition, stay_id, text, status, done_reason, prompt_tokens,
answer_tokens). Everything is parsed with built-in JSON functions in one narrow
pass; an answer that cannot be used becomes the naive forecast and is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions.cells import bounds, clip, outside
from foretrace.operators.forecast import levels
from foretrace.settings import Variable, Windows

# Names under which failures are reported.
TIMEOUT, SERVER_ERROR = "llm_timeout", "llm_server_error"
TRUNCATED, OVERFLOW, MALFORMED = "truncated_forecast", "context_overflow", "malformed_forecast"
ZERO_INTERVAL, ABSURD = "zero_interval", "absurd_values"

# Widths keep the JSON type of their entries; forecasts take any text that is a number.
_TOP = "array<struct<forecast: map<string,string>, interval_halfwidth: map<string,variant>>>"
_NUMBER = r"(?i)^\s*[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?\s*$"
_NOT_FINITE = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def extract_json(text: Column | str = "text") -> Column:
    """From the first '{' to the last '}'; null when there is no such block."""
    text = F.col(text) if isinstance(text, str) else text
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    found = (start > 0) & (F.instr(text, "}") > 0) & (end >= start)
    return F.when(found, F.substring(text, start, end - start + 1))


def parse(responses: DataFrame) -> DataFrame:
    """Adds ``parsed`` (two maps, null parts when absent or malformed; null when the block is
    not JSON: quotes are double and nothing follows the object)."""
    wrapped = F.from_json(F.concat(F.lit("["), extract_json(), F.lit("]")), _TOP, {"allowSingleQuotes": "false"})
    return responses.withColumn("parsed", F.when(F.size(wrapped) == 1, wrapped[0]))


def _last(entries: Column, name: str) -> Column:
    """The value of a key; of a doubled key the last one."""
    same = F.filter(F.map_entries(entries), lambda e: e["key"] == name)
    return F.try_element_at(F.transform(same, lambda e: e["value"]), F.lit(-1))


def _number(text: Column) -> Column:
    """A written number, NaN for one that is not finite, null for any other text."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double")).when(text.rlike(_NOT_FINITE), F.lit(float("nan")))


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def halfwidths(value: Column, horizon: int) -> Column:
    """A variant that holds a number, a list of ``horizon`` numbers or {start, end}, as absolute
    values per hour; null for any other shape. The end points are interpolated. A single width
    has to be a JSON number; inside a list or pair, quoted numbers count too."""
    kind, text = F.schema_of_variant(value), F.to_json(value)
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))
    listed = F.transform(F.from_json(text, "array<string>"), _number)
    pair = F.from_json(text, "start string, end string")
    ends = F.struct(_number(pair["start"]).alias("start"), _number(pair["end"]).alias("end"))
    hours = F.sequence(F.lit(0), F.lit(horizon - 1))
    step = lambda h: ends["start"] + (ends["end"] - ends["start"]) * h / F.lit(max(1, horizon - 1))
    both = ends["start"].isNotNull() & ends["end"].isNotNull()
    raw = (
        F.when(kind.startswith("ARRAY"), F.when((F.size(listed) == horizon) & ~F.exists(listed, lambda x: x.isNull()), listed))
        .when(kind.startswith("OBJECT"), F.when(both, F.transform(hours, step)))
        .when(number.isNotNull(), F.array_repeat(number, horizon)))
    return F.transform(raw, lambda x: F.abs(x))


def validate(responses: DataFrame, variables: list[Variable], windows: Windows) -> DataFrame:
    """One row per answer and panel variable: present, values, widths, absurd,
    usable, whether the shape was right and whether the answer failed (``malformed``)."""
    h = windows.horizon
    parsed = parse(responses)
    values_map, width_map = F.col("parsed.forecast"), F.col("parsed.interval_halfwidth")
    entries = []
    for v in variables:
        present = F.coalesce(F.map_contains_key(values_map, v.name), F.lit(False))
        text = _last(values_map, v.name)
        listed = F.when(F.substring(F.ltrim(text), 1, 1) == "[", F.from_json(text, "array<string>"))
        # A null counts as a value that is not finite; a text that is no number spoils the answer.
        values = F.transform(listed, lambda x: F.when(x.isNull(), F.lit(float("nan"))).otherwise(_number(x)))
        widths = halfwidths(_last(width_map, v.name), h)
        low, high = (F.lit(x).cast("double") for x in v.sane)
        absurd = F.exists(values, lambda x: ~_finite(x) | outside(x, low, high))
        entries.append(F.struct(
            F.lit(v.name).alias("variable"), present.alias("present"), values.alias("values"),
            widths.alias("widths"), (present & F.coalesce(absurd, F.lit(False))).alias("absurd")))
    df = parsed.withColumn("_vars", F.array(*entries))
    right = lambda s: (F.size(s["values"]) == h) & ~F.exists(s["values"], lambda x: x.isNull())
    wrong = F.exists("_vars", lambda s: s["present"] & ~F.coalesce(right(s), F.lit(False)))
    usable = lambda s: s["present"] & ~s["absurd"]
    nothing = ~F.exists("_vars", usable)
    no_width = F.exists("_vars", lambda s: usable(s) & s["widths"].isNull())
    absent = ~F.exists("_vars", lambda s: s["present"])
    misshapen = F.coalesce(values_map.isNull() | width_map.isNull() | wrong | absent, F.lit(True))
    df = df.withColumn("shape_ok", ~misshapen).withColumn(
        "malformed", F.coalesce(misshapen | nothing | no_width, F.lit(True)))
    return df.withColumn("v", F.explode("_vars")).select(
        *responses.columns, "shape_ok", "malformed", "v.variable", "v.present", "v.values", "v.widths", "v.absurd",
        (F.col("v.present") & ~F.col("v.absurd") & ~F.col("malformed")).alias("usable"))


def error_kind(context_tokens: int | None = None) -> Column:
    """First matching failure of an answer, null when it can be used."""
    overflow = (
        F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("answer_tokens", F.lit(0)) >= context_tokens
        if context_tokens else F.lit(False))
    return (
        F.when(F.col("status") == "timeout", TIMEOUT)
        .when(F.col("status") == "server_error", SERVER_ERROR)
        .when(F.col("done_reason") == "length", TRUNCATED)
        .when(overflow, OVERFLOW)
        .when(F.col("malformed"), MALFORMED))


def absurd(validated: DataFrame) -> DataFrame:
    """Absurd variables per condition and variable, of answers that arrived."""
    return validated.filter(F.col("present")).groupBy("condition", "variable").agg(
        F.count(F.lit(1)).alias("present"), F.count(F.when(F.col("absurd"), 1)).alias("absurd"))


def fix_zero_widths(df: DataFrame, floor: Column | str = "width") -> DataFrame:
    """Widths that are 0 or not finite become the smallest positive one of the
    series, else the naive width; adds ``zero_fixed``."""
    floor = F.col(floor) if isinstance(floor, str) else floor
    good = lambda x: _finite(x) & (x > 0)
    least = F.coalesce(F.array_min(F.filter("widths", good)), floor)
    return df.withColumn("zero_fixed", F.coalesce(F.exists("widths", lambda x: ~good(x)), F.lit(False))).withColumn(
        "_least", least).withColumn(
        "widths", F.transform("widths", lambda x: F.when(good(x), x).otherwise(F.col("_least")))).drop("_least")


def resolve(responses: DataFrame, summary: DataFrame, variables: list[Variable], windows: Windows,
            fill: DataFrame | None = None, context_tokens: int | None = None) -> DataFrame:
    """One row per (condition, stay, variable): series ``y`` and ``widths``,
    ``source`` (model, filled, fallback), ``error_kind`` and the count flags."""
    h = windows.horizon
    checked = validate(responses, variables, windows).withColumn("error_kind", error_kind(context_tokens))
    naive = levels(summary, ("naive",), fill).select("stay_id", "variable", "level", "width")
    df = fix_zero_widths(checked.join(naive, ["stay_id", "variable"]))
    failed = F.col("error_kind").isNotNull()
    take = ~failed & F.col("usable")
    low, high = bounds(variables, "hard")
    df = df.withColumn("_lo", low).withColumn("_hi", high)
    flat, flat_width = F.array_repeat("level", h), F.array_repeat("width", h)
    clipped = lambda a: F.transform(a, lambda x: clip(x, F.col("_lo"), F.col("_hi")))
    return df.select(
        "condition", "stay_id", "variable",
        F.when(failed, flat).when(take, clipped(F.col("values"))).otherwise(clipped(flat)).alias("y"),
        F.when(take, F.col("widths")).otherwise(flat_width).alias("widths"),
        F.when(failed, "fallback").when(take, "model").otherwise("filled").alias("source"), "error_kind",
        (take & F.col("zero_fixed")).alias("zero_fixed"),
        # Absurd variables count as soon as an answer of the right shape arrived.
        (F.coalesce(F.col("error_kind") == MALFORMED, F.lit(True)) & F.col("shape_ok") & F.col("absurd")).alias("absurd"))


def to_forecasts(resolved: DataFrame) -> DataFrame:
    """Rows (condition, stay_id, variable, hour, y_raw, halfwidth, source)."""
    return resolved.select(
        "condition", "stay_id", "variable", "source", F.posexplode(F.arrays_zip("y", "widths")).alias("hour", "_z")
    ).select("condition", "stay_id", "variable", "hour", F.col("_z.y").alias("y_raw"),
             F.col("_z.widths").alias("halfwidth"), "source")


def error_counts(resolved: DataFrame, n_variables: int) -> DataFrame:
    """(condition, kind, n): failed answers by kind, and fixed widths and absurd
    values per variable of the answers that were used."""
    stays = resolved.filter(F.col("error_kind").isNotNull()).select("condition", "stay_id", F.col("error_kind").alias("kind")).distinct()
    flags = resolved.select("condition", F.explode(F.array_compact(F.array(
        F.when(F.col("zero_fixed"), F.lit(ZERO_INTERVAL)), F.when(F.col("absurd"), F.lit(ABSURD))))).alias("kind"))
    return stays.select("condition", "kind").unionByName(flags).groupBy("condition", "kind").agg(
        F.count(F.lit(1)).alias("n"))


def rates(resolved: DataFrame) -> DataFrame:
    """Per condition and variable: share of fallbacks and of filled variables."""
    n = F.count(F.lit(1))
    return resolved.groupBy("condition", "variable").agg(
        n.alias("n_stays"), (F.count(F.when(F.col("source") == "fallback", 1)) / n).alias("fallback_rate"),
        (F.count(F.when(F.col("source") == "filled", 1)) / n).alias("filled_rate"))


def audit(responses: DataFrame, variables: list[Variable], windows: Windows) -> DataFrame:
    """Shape of each answer: parses, variables of the right length, longest run of decimals."""
    parsed = parse(responses)
    values_map = F.col("parsed.forecast")
    parses = F.col("parsed").isNotNull()
    sizes = [F.coalesce(F.size(F.from_json(_last(values_map, v.name), "array<string>")), F.lit(-1)) for v in variables]
    right = sum([F.when(s == windows.horizon, 1).otherwise(0) for s in sizes], F.lit(0))
    runs = F.transform(F.regexp_extract_all("text", F.lit(r"\d\.(\d+)"), 1), lambda x: F.length(x))
    return parsed.select(
        *responses.columns, parses.alias("parses"), right.alias("n_right_length"),
        (parses & (right == len(variables))).alias("all_lengths_ok"),
        F.coalesce(F.array_max(runs), F.lit(0)).alias("max_decimals"))


def audit_report(audited: DataFrame, key: str = "mode") -> DataFrame:
    """Per mode: stopped and cut-off answers, upper median and maximum of the
    answer tokens, usable answers, longest decimals."""
    from foretrace.functions.ranks import at_ranks

    base = audited.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("done_reason") == "stop", 1)).alias("stopped"),
        F.count(F.when(F.col("done_reason") == "length", 1)).alias("cut_off"),
        F.max("answer_tokens").alias("max_tokens"), F.count(F.when(F.col("all_lengths_ok"), 1)).alias("usable"),
        F.max("max_decimals").alias("max_decimals"))
    middle = at_ranks(audited, [key], "answer_tokens", {"median_tokens": F.floor(F.col("n_rows") / 2) + 1}).drop("n_rows")
    return base.join(middle, key, "left")
