"""One key holding a third of all rows, or more, changes nothing."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from foretrace.functions.draws import hashed_position
from foretrace.operators import cohort, panel, similarity
from foretrace.settings import CohortRules, Windows

T0 = datetime(2150, 1, 1)


def test_hot_stay_in_extraction_and_resampling(spark):
    n = 6000
    stay = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 97 + 2).cast("long")
    events = spark.range(n).select(
        stay.alias("stay_id"), (F.col("id") % 5).alias("itemid"),
        (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 200000).cast("decimal(18,6)"))).alias("charttime"),
        (F.col("id") % 13).cast("double").alias("valuenum"))
    stays = spark.range(1, 60).select(F.col("id").alias("stay_id"), F.lit(T0).alias("intime"))
    items = spark.createDataFrame([(i, f"v{i}") for i in range(3)], "itemid long, variable string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cohort.extract_events(events, items, stays, 1)
        want = events.toPandas()
        want = want[(want.itemid < 3) & (want.stay_id < 60) & (want.charttime <= T0 + timedelta(hours=1))]
        assert out.count() == len(want)
        cells = panel.resample(panel.align(out, items, stays, Windows(1, 1, 600))).toPandas()
        raw = want.assign(hour=((want.charttime - T0).dt.total_seconds() // 600).astype(int))
        raw = raw[(raw.charttime - T0).dt.total_seconds() <= 1200]
        direct = raw.groupby(["stay_id", "itemid", "hour"]).valuenum.mean()
        assert len(cells) == len(direct) and np.isclose(cells.value.sum(), direct.sum())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_patient_with_most_stays(spark):
    stays = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("subject_id"), F.col("id").alias("hadm_id"), F.col("id").alias("stay_id"),
        (F.lit(T0) + F.make_dt_interval((F.col("id") * 7 % 100).cast("int"))).alias("intime"),
        (F.lit(T0) + F.make_dt_interval((F.col("id") * 7 % 100 + 3).cast("int"))).alias("outtime"))
    patients = stays.select("subject_id").distinct().withColumn("anchor_age", F.lit(50))
    out = cohort.eligible_stays(stays, patients, stays.select("hadm_id"), CohortRules()).filter("subject_id = 1").collect()
    ids = [i for i in range(3000) if i % 3 > 0]
    assert [r.stay_id for r in out] == [min(ids, key=lambda i: (i * 7 % 100, i))]


def test_positions_are_dense_within_a_hot_key(spark):
    df = spark.range(2000).select(F.col("id").alias("stay_id"), F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    out = hashed_position(df, 1, "stay_id", ("k",)).filter("k = 'hot'").toPandas()
    assert sorted(out.position) == list(range(1500)) and set(out.n_rows) == {1500}


def test_neighbours_when_all_queries_share_one_cell(spark):
    rng = np.random.default_rng(0)
    t = np.concatenate([rng.normal(0, 1e-3, (300, 3)), rng.normal(5, 1, (60, 3))])
    q = rng.normal(0, 1e-3, (90, 3))
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "stay_id long, vector array<double>")
    got = similarity.knn_join(frame(q), frame(t), 4, block_rows=20).toPandas()
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(-1))
    for i in range(len(q)):
        assert got[got.query_id == i].sort_values("rank").neighbor_id.tolist() == np.lexsort((np.arange(len(t)), d[i]))[:4].tolist()
