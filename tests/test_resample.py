"""The bootstrap by tree splitting against its law and against direct computation."""

import numpy as np
from pyspark.sql import functions as F

from foretrace.functions import resample
from foretrace.operators import calibrate, stats


def leaf_weights(df, columns, resamples, seed, leaf_rows):
    """All leaves' rows and weights, from the table of leaves."""
    values, weights = [], []
    for row in resample.leaves(df, ["k"], "stay_id", columns, seed, leaf_rows).collect():
        path = [(p["whole"], p["left"], p["right"]) for p in row["path"]]
        parts = [w for _, w in resample.weights_of_leaf(path, len(row["rows"]), resamples, seed, row["leaf"])]
        weights.append(np.concatenate(parts))
        values += [[r[c] for c in columns] for r in row["rows"]]
    return values, np.concatenate(weights, axis=1)


def test_draws_are_split_without_loss_and_follow_the_law(spark):
    n, resamples = 900, 400
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("stay_id"), (F.col("id") % 7).cast("double").alias("v"))
    for leaf_rows in (2048, 100):
        values, weights = leaf_weights(df, ["v"], resamples, 3, leaf_rows)
        assert len(values) == n and (weights.sum(axis=1) == n).all()
        # Multinomial: mean 1, variance 1 - 1/n, covariance of two rows -1/n.
        assert abs(weights.var() - 1) < 0.02
        halves = weights[:, : n // 2].sum(axis=1)
        assert abs(halves.var() / (n / 4) - 1) < 0.3
        sums = {r.b: r for r in resample.resampled_sums(df, ["k"], "stay_id", ["v"], resamples, 3, leaf_rows).collect()}
        direct = weights @ np.array(values)[:, 0]
        assert all(sums[b].draws == n and np.isclose(sums[b].v, direct[b]) for b in range(resamples))


def test_many_leaves_keep_the_width_of_the_interval(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 3000)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, stay_id long, v double")
    sums = resample.resampled_sums(df, ["k"], "stay_id", ["v"], 1000, 9, leaf_rows=64).select((F.col("v") / F.col("draws")).alias("m")).toPandas()
    assert abs(sums.m.std() / (x.std() / np.sqrt(3000)) - 1) < 0.1


def test_leaves_of_one_key_do_not_depend_on_other_keys(spark):
    one = spark.range(500).select(F.lit("a").alias("k"), F.col("id").alias("stay_id"), F.col("id").cast("double").alias("v"))
    more = one.unionByName(spark.range(9000).select(F.lit("b").alias("k"), F.col("id").alias("stay_id"), F.lit(1.0).alias("v")))
    sums = lambda df: [tuple(r) for r in resample.resampled_sums(df, ["k"], "stay_id", ["v"], 20, 1, 100).filter("k = 'a'").orderBy("b").collect()]
    assert sums(one) == sums(more.repartition(7))


def test_order_statistic_equals_direct_computation(spark):
    rng = np.random.default_rng(5)
    rows = [("a", i, [float(v) for v in np.round(rng.exponential(1, rng.integers(0, 6)), 1)]) for i in range(300)]
    rows += [("b", i, [2.5] * 3) for i in range(40)]  # one value
    df = spark.createDataFrame(rows, "k string, stay_id long, scores array<double>")
    resamples, rank = 60, calibrate.conformal_rank(F.col("n_rows"), 90)
    for leaf_rows, buckets in ((2048, 1024), (50, 8), (2048, 2)):
        got = {(r.k, r.b): r.value for r in resample.resampled_at_rank(df, ["k"], "stay_id", "scores", resamples, 7, rank, leaf_rows, buckets).collect()}
        for key in ("a", "b"):
            values, weights = leaf_weights(df.filter(F.col("k") == key), ["scores"], resamples, 7, leaf_rows)
            for b in range(resamples):
                drawn = np.sort(np.concatenate([np.repeat(v[0], w) for v, w in zip(values, weights[b])]))
                n = len(drawn)
                assert got[key, b] == drawn[min(n, (90 * (n + 1) + 99) // 100) - 1]


def test_only_sums_are_shuffled(spark):
    """A leaf sends one row per resample; nothing has a row for each draw."""
    n, resamples = 5000, 50
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("stay_id"), F.rand(1).alias("v"))
    plan = resample.resampled_sums(df, ["k"], "stay_id", ["v"], resamples, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    ci = stats.bootstrap_ci(df.drop("k"), [], "v", resamples).first()
    assert ci.n == n and ci.ci_lo < ci["mean"] < ci.ci_hi
