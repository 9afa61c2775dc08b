"""Worked examples of the cohort and panel stages."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foretrace.functions.cells import hours_crossed
from foretrace.operators import cohort, items, panel
from foretrace.settings import CHART_SOURCE, LAB_SOURCE, CohortRules, Variable, Windows

T0 = datetime(2150, 1, 1, 8, 0)


def at(hours):
    from datetime import timedelta

    return T0 + timedelta(hours=hours)


def test_label_resolution(spark):
    labels = [(1, "Respiratory Rate"), (2, "Respiratory Rate (Set)"), (3, "Respiratory Rate (spontaneous)"),
              (4, "Respiratory Rate (Total)"), (5, None)]
    d = spark.createDataFrame(labels, "itemid long, label string")
    v = Variable("resp_rate", CHART_SOURCE, ("Respiratory Rate",), ("Set", "Spontaneous", "Total"))
    assert [r.itemid for r in items.resolve(d, [v], CHART_SOURCE).collect()] == [1]


def test_fluid_filter_and_exact_match(spark):
    d = spark.createDataFrame(
        [(1, "Lactate", "Blood"), (2, "Lactate", "blood"), (3, "Lactate Dehydrogenase", "Blood"), (4, "Lactate", "Urine"),
         (5, "pH", "Blood"), (6, "Phosphate", "Blood"), (7, "Lactate", None)],
        "itemid long, label string, fluid string")
    lactate = Variable("lactate", LAB_SOURCE, ("Lactate",), ("Dehydrogenase",), fluids=("Blood",))
    ph = Variable("ph", LAB_SOURCE, ("PH",), match="exact")
    got = {(r.variable, r.itemid) for r in items.resolve(d, [lactate, ph], LAB_SOURCE).collect()}
    assert got == {("lactate", 1), ("lactate", 2), ("ph", 5)}


def test_unmatched_variable_is_kept(spark):
    d = spark.createDataFrame([(1, "Heart Rate")], "itemid long, label string")
    vs = [Variable("hr", CHART_SOURCE, ("heart",)), Variable("none", CHART_SOURCE, ("zzz",))]
    out = {r.variable: r.n_items for r in items.with_unmatched(items.resolve(d, vs, CHART_SOURCE), vs).collect()}
    assert out == {"hr": 1, "none": 0}


@pytest.mark.parametrize("kwargs", [
    {"source": "elsewhere"}, {"match": "fuzzy"}, {"fluids": ("Blood",), "source": CHART_SOURCE}])
def test_bad_variable_is_rejected(kwargs):
    with pytest.raises(ValueError):
        Variable("v", **kwargs)


def test_epinephrine_also_matches_norepinephrine(spark):
    d = spark.createDataFrame([(1, "Norepinephrine"), (2, "Epinephrine"), (3, "Saline")], "itemid long, label string")
    assert {r.itemid for r in items.item_ids(d, ["Epinephrine"]).collect()} == {1, 2}


def test_hour_boundaries(spark):
    df = spark.createDataFrame([(datetime(2150, 1, 1, 10, 59), datetime(2150, 1, 1, 11, 1))], "a timestamp, b timestamp")
    assert df.select(hours_crossed("a", "b")).first()[0] == 1


def test_first_long_enough_stay(spark):
    stays = spark.createDataFrame(
        [(1, 11, 101, at(0), at(20)), (1, 12, 102, at(100), at(174)), (1, 13, 103, at(300), at(415)), (2, 14, 104, at(0), at(22)),
         (3, 15, 105, at(0), at(90)), (4, 16, 106, at(0), at(90))],
        "subject_id long, hadm_id long, stay_id long, intime timestamp, outtime timestamp")
    patients = spark.createDataFrame([(1, 60), (2, 60), (3, 17), (4, 50)], "subject_id long, anchor_age int")
    admissions = spark.createDataFrame([(11,), (12,), (13,), (14,), (15,)], "hadm_id long")
    out = cohort.eligible_stays(stays, patients, admissions, CohortRules()).collect()
    assert [(r.stay_id, r.los_hours) for r in out] == [(102, 74)]


def test_events_window_is_inclusive(spark):
    stays = spark.createDataFrame([(1, T0)], "stay_id long, intime timestamp")
    events = spark.createDataFrame(
        [(1, 7, at(h), 1.0) for h in (-0.1, 0, 47, 48, 49)] + [(1, 7, at(3), None), (1, 8, at(3), 1.0), (2, 7, at(3), 1.0)],
        "stay_id long, itemid long, charttime timestamp, valuenum double")
    wanted = spark.createDataFrame([(7,)], "itemid long")
    out = cohort.extract_events(events, wanted, stays, 48)
    assert sorted(r.charttime for r in out.collect()) == [at(0), at(47), at(48)]


def test_drug_starts_window(spark):
    stays = spark.createDataFrame([(1, T0)], "stay_id long, intime timestamp")
    starts = spark.createDataFrame([(1, 7, at(h)) for h in (0.75, 11, 48, 49.7)], "stay_id long, itemid long, starttime timestamp")
    out = cohort.extract_events(starts, spark.createDataFrame([(7,)], "itemid long"), stays, 48, time_col="starttime", value_col=None)
    assert out.count() == 3


def test_align_and_resample(spark):
    stays = spark.createDataFrame([(1, 10, T0)], "stay_id long, hadm_id long, intime timestamp")
    mapping = spark.createDataFrame([("heart_rate", 7), ("map", 8)], "variable string, itemid long")
    chart = spark.createDataFrame(
        [(1, 7, at(0.2), 92.0), (1, 7, at(0.9), 96.0), (1, 8, at(1.1), 71.0), (1, 8, at(1.5), 75.0), (1, 9, at(1), 1.0), (1, 8, at(48), 60.0)],
        "stay_id long, itemid long, charttime timestamp, valuenum double")
    w = Windows(24, 24)
    out = panel.resample(panel.align(chart, mapping, stays, w))
    got = {(r.variable, r.hour): r.value for r in out.collect()}
    # The closing bin survives here.
    assert got == {("heart_rate", 0): 94.0, ("map", 1): 73.0, ("map", 48): 60.0}
    lab = chart.withColumnRenamed("stay_id", "hadm_id").withColumn("hadm_id", F.lit(10).cast("long"))
    assert panel.align(lab, mapping, stays, w, key="hadm_id").count() == 5


def test_artefacts_are_dropped_before_averaging(spark):
    vs = [Variable("map", plausible_range=(20, 180)), Variable("hr", plausible_range=(20, 250), valid_range=(1, 300))]
    df = spark.createDataFrame([("map", 79104.0), ("map", 70.0), ("hr", 0.0), ("hr", 299.0), ("other", 1e9), ("map", None)],
                               "variable string, value double")
    kept = panel.drop_invalid(df, vs)
    assert sorted((r.variable, r.value or 0) for r in kept.collect()) == [("hr", 299.0), ("map", 0), ("map", 70.0), ("other", 1e9)]
    assert {r.variable: r.n_dropped for r in panel.invalid_counts(df, vs).collect()} == {"map": 1, "hr": 1}


def test_coverage_rules(spark):
    w = Windows(24, 24)
    rows = [(1, f"v{i % 5}", i // 5) for i in range(200)] + [(2, f"v{i % 5}", i // 5) for i in range(90)]
    df = spark.createDataFrame(rows, "stay_id long, variable string, hour int")
    out = {r.stay_id: round(r.coverage, 3) for r in cohort.coverage(df, 5, w, 0.5).collect()}
    assert out == {1: 0.833}
    vs = [Variable(f"v{i}", LAB_SOURCE if i == 4 else CHART_SOURCE) for i in range(5)]
    seen = {r.stay_id for r in cohort.coverage_vitals_labs(df, vs, w, 0.3).collect()}
    assert seen == {1, 2}
    late = df.filter("variable <> 'v4' or hour >= 24")
    assert {r.stay_id for r in cohort.coverage_vitals_labs(late, vs, w, 0.3).collect()} == set()


@pytest.mark.parametrize("n,sizes", [(3000, (2100, 450, 450)), (2999, (2099, 449, 451))])
def test_split_sizes(spark, n, sizes):
    out = cohort.assign_splits(spark.range(n).withColumnRenamed("id", "stay_id"), 0.7, 0.15, 42)
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert (got["train"], got["val"], got["test"]) == sizes


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "stay_id")
    one = cohort.assign_splits(df.coalesce(1), 0.7, 0.15, 1).orderBy("stay_id").collect()
    many = cohort.assign_splits(df.repartition(13), 0.7, 0.15, 1).orderBy("stay_id").collect()
    assert one == many
    assert cohort.sample_stays(df, 40, 3).count() == 40
    assert cohort.sample_stays(df, None, 3).count() == 500
