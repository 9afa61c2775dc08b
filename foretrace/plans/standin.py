"""The given tables in the role of the raw medical ones.

``events`` is the event stream (stay = user, variable = event type, one-day
bins, 15 observed and 15 forecast), ``orders`` and ``customer`` stand for stays
and patients, ``part`` for the item dictionary and ``lineitem`` for item events.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions.draws import draw
from foretrace.functions.durable import durable
from foretrace.operators import cohort as C
from foretrace.operators import features, forecast, harmonize, postprocess
from foretrace.operators import panel as P
from foretrace.operators.stats import deterioration_flags
from foretrace.settings import CHART_SOURCE, LAB_SOURCE, PostprocessParams, Variable, Windows

WINDOWS = Windows(obs=15, horizon=15, bin_seconds=86_400)
RECENT = 6
COVERAGE = 0.3
SEED = 42
N_TUNE = 8
START = "2024-01-01 00:00:00"
RANGES = {"plausible_range": (5.0, 150.0), "valid_range": (0.1, 300.0)}
# Same order as the panel everywhere; two of them play laboratory values.
VARIABLES = [
    Variable("click", CHART_SOURCE, unit="u", **RANGES),
    Variable("error", LAB_SOURCE, **RANGES),
    Variable("purchase", LAB_SOURCE, unit="mg", hard_range=(0.0, 180.0), **RANGES),
    Variable("signup", CHART_SOURCE, **RANGES),
    Variable("view", CHART_SOURCE, **RANGES),
]
NAMES = [v.name for v in VARIABLES]
LAB_OFFSET = 1_000_000_000
LOOKAHEAD = 5
PARAMS = PostprocessParams(drift_damping=0.5, level_anchor_weight=0.25)
CONDITIONS = ["single_model_llm", "full_pipeline", "full_pipeline_no_critic",
              "single_model_llm@alt", "full_pipeline@alt", "full_pipeline_no_critic@alt"]
PLAIN = ["single_model_llm", "full_pipeline", "full_pipeline_no_critic"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stays(spark, sf) -> DataFrame:
    """One stay per user, all admitted at the start of the stream."""
    users = table(spark, sf, "events").select(F.col("user_id").alias("stay_id")).distinct()
    return users.select("stay_id", (F.col("stay_id") + LAB_OFFSET).alias("hadm_id"), F.lit(START).cast("timestamp").alias("intime"))


def item_id() -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in NAMES]), F.col("event_type")).cast("long")


def mapping(spark) -> DataFrame:
    return spark.createDataFrame(
        [(v.name, v.source, i + 1, v.name) for i, v in enumerate(VARIABLES)],
        "variable string, source string, itemid long, label string")


def aligned(spark, sf) -> DataFrame:
    """Chart events keyed by stay and laboratory events keyed by admission, united."""
    raw = table(spark, sf, "events").select("user_id", "ts", "value", "event_type")
    lab_names = [v.name for v in VARIABLES if v.is_lab]
    is_lab = F.col("event_type").isin(lab_names)
    chart = raw.filter(~is_lab).select(
        F.col("user_id").alias("stay_id"), item_id().alias("itemid"), F.col("ts").alias("charttime"), F.col("value").alias("valuenum"))
    lab = raw.filter(is_lab).select(
        (F.col("user_id") + LAB_OFFSET).alias("hadm_id"), item_id().alias("itemid"), F.col("ts").alias("charttime"),
        F.col("value").alias("valuenum"))
    items, st = mapping(spark), stays(spark, sf)
    return P.align(chart, items, st, WINDOWS).unionByName(P.align(lab, items, st, WINDOWS, key="hadm_id"))


class Workspace:
    """The shared stages of one query run. Each table is written once and read by
    everything after it, as the stages of a batch job would."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    @cached_property
    def panel(self) -> DataFrame:
        return durable(P.resample(P.drop_invalid(aligned(self.spark, self.sf), VARIABLES)))

    @cached_property
    def cohort(self) -> DataFrame:
        covered = C.coverage(self.panel, len(VARIABLES), WINDOWS, COVERAGE)
        kept = C.keep_covered(stays(self.spark, self.sf), covered)
        return durable(C.assign_splits(kept, 0.7, 0.15, SEED))

    @cached_property
    def subsets(self) -> DataFrame:
        return durable(C.validation_subsets(self.cohort, N_TUNE, SEED).select("stay_id", "subset"))

    @cached_property
    def packed(self) -> DataFrame:
        """One array per (stay, variable), short gaps filled, with the stay's split."""
        return durable(harmonize.fill_gaps(harmonize.packed(self.cohort, self.panel, VARIABLES, WINDOWS, carry=("split",))))

    @cached_property
    def cells(self) -> DataFrame:
        """One row per bin, cut into observation and horizon (lazy)."""
        return harmonize.cut(harmonize.unpacked(self.packed), WINDOWS)

    @cached_property
    def all_series(self) -> DataFrame:
        return durable(features.summarize_packed(self.packed, WINDOWS, RECENT, keep_truth=True))

    def series(self, split: str | None = None) -> DataFrame:
        """One row per (stay, variable): summary, split and horizon truth."""
        return self.all_series if split is None else self.all_series.filter(F.col("split") == split)

    @cached_property
    def reference(self) -> DataFrame:
        return durable(features.reference_stats(self.cells.filter(F.col("split") == "train")))

    @cached_property
    def fill(self) -> DataFrame:
        return features.naive_fill(self.reference, VARIABLES)

    def persistence(self, split: str = "test") -> DataFrame:
        return forecast.persistence(self.with_fill().series(split), WINDOWS, fill=self.fill)

    def with_fill(self) -> "Workspace":
        self.fill
        return self

    @property
    def calibration_series(self) -> DataFrame:
        chosen = self.subsets.filter(F.col("subset") == "calibration").select("stay_id")
        return self.with_fill().series("val").join(chosen, "stay_id", "left_semi")

    def raw(self, which: str = "test", conditions=None) -> DataFrame:
        """Model forecasts before post-processing, of the test or calibration stays."""
        series = self.calibration_series if which == "calibration" else self.with_fill().series(which)
        return model_raw(series, self.fill, conditions)

    def recent(self) -> DataFrame:
        return self.series().select("stay_id", "variable", "recent_mean")

    def finished(self, which: str = "test", conditions=None) -> DataFrame:
        """Model forecasts as reported: post-processed, clipped where a critic ends them."""
        return postprocess.apply(self.raw(which, conditions), self.recent(), VARIABLES, PARAMS, critic_stage="final")

    def flags(self) -> DataFrame:
        """Deterioration flags: high error events play the drug starts."""
        starts = table(self.spark, self.sf, "events").filter((F.col("event_type") == "error") & (F.col("value") > 120)).select(
            F.col("user_id").alias("stay_id"), F.col("ts").alias("starttime"))
        return deterioration_flags(self.cohort, starts, WINDOWS, LOOKAHEAD)


def _signed(*parts) -> Column:
    return (draw(*parts) % 2001 - 1000) / F.lit(1000.0)


def model_raw(summary_df: DataFrame, fill_df: DataFrame | None, conditions=None) -> DataFrame:
    """Stand-in for model forecasts: the recent mean plus a hashed offset and drift
    per (condition, stay, variable), so some values leave the plausible range."""
    base = forecast.levels(summary_df, ("recent_mean",), fill_df).drop("condition")
    names = F.explode(F.array(*[F.lit(c) for c in conditions or CONDITIONS])).alias("condition")
    key = (F.col("condition"), F.col("stay_id"), F.col("variable"))
    hours = F.explode(F.sequence(F.lit(0), F.lit(WINDOWS.horizon - 1))).alias("hour")
    rows = base.select("*", names).withColumn("_a", _signed("offset", *key)).withColumn("_d", _signed("drift", *key)).withColumn(
        "half", F.col("width") * (0.5 + (draw("width", *key) % 1000) / F.lit(1000.0)))
    cells = rows.select("condition", "stay_id", "variable", "truth", "level", "width", "half", "_a", "_d", "recent_mean", hours)
    raw = F.col("level") + 0.6 * F.col("width") * F.col("_a") + 0.25 * F.col("width") * F.col("_d") * (F.col("hour") + 1)
    return cells.select(
        "condition", "stay_id", "variable", "hour", F.try_element_at("truth", F.col("hour")).alias("y_true"),
        raw.alias("y_raw"), (raw - F.col("half")).alias("y_lower"), (raw + F.col("half")).alias("y_upper"))


def corrections(raw: DataFrame, y: str = "y_raw", keys=("condition", "stay_id", "variable")) -> DataFrame:
    """Stand-in for a critic's answers: two attempts per hashed third of the series,
    the first pulling values halfway to 70, the second fully inside; some of the
    first ones have a wrong length."""
    packed = raw.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hour", y))).alias("_c"))
    pick = draw("fix", *[F.col(k) for k in keys]) % 3
    values = F.transform("_c", lambda c: c[y])
    halfway = F.transform(values, lambda x: 70.0 + (x - 70.0) * 0.5)
    inside = F.transform(values, lambda x: F.greatest(F.lit(5.0), F.least(F.lit(150.0), x)))
    first = F.when(pick == 1, F.slice(halfway, 1, 3)).otherwise(halfway)
    return packed.filter(pick < 2).select(*keys, F.explode(F.array(
        F.struct(F.lit(1).alias("attempt"), first.alias("values")),
        F.struct(F.lit(2).alias("attempt"), inside.alias("values")))).alias("t")).select(*keys, "t.attempt", "t.values")
