"""Eligible stays, event extraction, coverage, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.functions.cells import hours_crossed
from foretrace.functions.draws import hashed_position
from foretrace.settings import CohortRules, Variable, Windows


def eligible_stays(stays: DataFrame, patients: DataFrame, admissions: DataFrame, rules: CohortRules) -> DataFrame:
    """Stays long enough, then (optionally) the first such stay of each patient,
    of patients old enough with a known admission.

    The first stay is a partial-aggregating minimum rather than a window, so a
    patient with very many stays never becomes one sorted group.
    """
    long_enough = (
        stays.withColumn("los_hours", hours_crossed("intime", "outtime"))
        .filter(F.col("los_hours") >= rules.min_stay_hours)
        .select("subject_id", "hadm_id", "stay_id", "intime", "outtime", "los_hours")
    )
    if rules.first_stay_only:
        first = F.min(F.struct("intime", "stay_id", "hadm_id", "outtime", "los_hours")).alias("s")
        long_enough = long_enough.groupBy("subject_id").agg(first).select(
            "subject_id", "s.hadm_id", "s.stay_id", "s.intime", "s.outtime", "s.los_hours")
    adults = patients.filter(F.col("anchor_age") >= rules.min_age).select(
        "subject_id", F.col("anchor_age").alias("age_at_admission"))
    return long_enough.join(adults, "subject_id").join(admissions.select("hadm_id"), "hadm_id", "left_semi").select(
        "subject_id", "hadm_id", "stay_id", "intime", "outtime", "los_hours", "age_at_admission")


def extract_events(events: DataFrame, items: DataFrame, stays: DataFrame, window_hours: int,
                   key: str = "stay_id", time_col: str = "charttime", value_col: str | None = "valuenum",
                   item_ids: list[int] | None = None) -> DataFrame:
    """Events of the wanted items inside [intime, intime + window] of an eligible
    stay, both ends included; only the needed columns are kept.

    Two semi-joins. Neither side is hinted: the optimizer broadcasts it only
    when its size allows and shuffles otherwise, splitting skewed keys. With
    ``item_ids`` (see ``items.pushable_ids``) the item filter reaches the scan,
    so row groups without a wanted item are skipped, and replaces its semi-join.
    """
    columns = [key, "itemid", time_col] + ([value_col] if value_col else [])
    wanted = events.select(*columns)
    if value_col:
        wanted = wanted.filter(F.col(value_col).isNotNull())
    if item_ids is not None:
        wanted = wanted.filter(F.col("itemid").isin(item_ids))
    else:
        wanted = wanted.join(items.select("itemid").distinct(), "itemid", "left_semi")
    window = stays.select(
        F.col(key).alias("_key"), F.col("intime").alias("_from"),
        (F.col("intime") + F.expr(f"INTERVAL {int(window_hours)} HOURS")).alias("_to"))
    inside = (F.col(key) == F.col("_key")) & F.col(time_col).between(F.col("_from"), F.col("_to"))
    return wanted.join(window, inside, "left_semi").select(*columns)


def coverage(panel: DataFrame, n_variables: int, windows: Windows, threshold: float) -> DataFrame:
    """Stays whose share of filled cells reaches the threshold. The closing bin
    (exactly at the window's end) counts too, so a share may exceed one."""
    return (
        panel.groupBy("stay_id").agg((F.count(F.lit(1)) / F.lit(windows.total * n_variables)).alias("coverage"))
        .filter(F.col("coverage") >= threshold)
    )


def coverage_vitals_labs(panel: DataFrame, variables: list[Variable], windows: Windows, threshold: float) -> DataFrame:
    """Threshold on the chart variables only, and every laboratory variable seen
    at least once inside the observation window."""
    vitals = [v.name for v in variables if not v.is_lab]
    labs = [v.name for v in variables if v.is_lab]
    lab_flags = [
        F.max(F.when((F.col("variable") == lab) & (F.col("hour") < windows.obs), 1).otherwise(0)) for lab in labs]
    seen = sum(lab_flags, F.lit(0))
    per_stay = panel.groupBy("stay_id").agg(
        (F.count(F.when(F.col("variable").isin(vitals), 1)) / F.lit(windows.total * max(1, len(vitals)))).alias("coverage"),
        seen.alias("labs_seen"))
    return per_stay.filter((F.col("coverage") >= threshold) & (F.col("labs_seen") == len(labs))).filter(
        F.lit(bool(vitals)))


def keep_covered(stays: DataFrame, covered: DataFrame) -> DataFrame:
    return stays.join(covered.select("stay_id"), "stay_id", "left_semi")


def sample_stays(stays: DataFrame, max_stays: int | None, seed: int) -> DataFrame:
    """The first ``max_stays`` in the seeded hash order; all of them when None."""
    if max_stays is None:
        return stays
    return hashed_position(stays, f"sample-{seed}", "stay_id", position="_p", total="_n").filter(
        F.col("_p") < max_stays).drop("_p", "_n")


def assign_splits(stays: DataFrame, train: float, val: float, seed: int) -> DataFrame:
    """First floor(n*train) of the seeded order train, next floor(n*val) val, rest test."""
    n_train = F.floor(F.col("_n") * F.lit(train))
    n_val = F.floor(F.col("_n") * F.lit(val))
    split = F.when(F.col("_p") < n_train, "train").when(F.col("_p") < n_train + n_val, "val").otherwise("test")
    return hashed_position(stays, f"split-{seed}", "stay_id", position="_p", total="_n").withColumn(
        "split", split).drop("_p", "_n")


def validation_subsets(stays: DataFrame, n_tune: int, seed: int) -> DataFrame:
    """Validation stays labelled ``tune`` (first n_tune of a seeded order) or ``calibration``."""
    val = stays.filter(F.col("split") == "val")
    return hashed_position(val, f"tune-{seed}", "stay_id", position="_p", total="_n").withColumn(
        "subset", F.when(F.col("_p") < n_tune, "tune").otherwise("calibration")).drop("_p", "_n")


def route(df: DataFrame, cohort: DataFrame, split: str) -> DataFrame:
    """Rows of the stays of one split."""
    return df.join(cohort.filter(F.col("split") == split).select("stay_id"), "stay_id", "left_semi")
