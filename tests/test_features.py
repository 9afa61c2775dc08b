"""Interpolation, summaries, neighbours and persistence against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foretrace.operators import features, forecast, harmonize, similarity
from foretrace.settings import CHART_SOURCE, Variable, Windows


def series(spark, rows):
    data = [(s, "v", h, None if x is None or np.isnan(x) else float(x)) for s, xs in enumerate(rows) for h, x in enumerate(xs)]
    return spark.createDataFrame(data, "stay_id long, variable string, hour int, value double")


def filled(df, n):
    out = df.orderBy("stay_id", "hour").toPandas()
    return out["value"].to_numpy(dtype=float).reshape(-1, n)


def test_short_gap_examples(spark):
    n = None
    out = filled(harmonize.interpolate(series(spark, [[1, n, n, n, n, n, 7]])), 7)[0]
    np.testing.assert_allclose(out, [1, 2, 3, 4, np.nan, np.nan, 7])
    out = filled(harmonize.interpolate(series(spark, [[n, 1, n, 3, n]])), 5)[0]
    np.testing.assert_allclose(out, [np.nan, 1, 2, 3, np.nan])
    strict = filled(harmonize.interpolate(series(spark, [[1, n, n, n, n, n, 7]]), strict=True), 7)[0]
    np.testing.assert_allclose(strict, [1] + [np.nan] * 5 + [7])


def test_interpolation_matches_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(80, 5, (40, 48))
    x[rng.random(x.shape) < 0.6] = np.nan
    want = np.stack([pd.Series(r).interpolate(method="linear", limit=3, limit_area="inside").to_numpy() for r in x])
    np.testing.assert_allclose(filled(harmonize.interpolate(series(spark, x)), 48), want, atol=1e-9)


def test_fill_can_stop_at_the_cut(spark):
    df = series(spark, [[1, None, None, 4]])
    kept = filled(harmonize.interpolate(df, windows=Windows(2, 2)), 4)[0]
    np.testing.assert_allclose(kept, [1, np.nan, np.nan, 4])


def cells(spark, x, obs):
    return harmonize.cut(series(spark, x), Windows(obs, x.shape[1] - obs))


def test_summary_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(50, 9, (30, 12))
    x[rng.random(x.shape) < 0.5] = np.nan
    x[0, :8] = np.nan
    x[1, :8] = np.nan
    x[1, 3] = 5.0
    w = Windows(8, 4)
    out = features.summarize(cells(spark, x, 8), w, 3).orderBy("stay_id").toPandas()
    for i, row in out.iterrows():
        o = x[i, :8]
        ok = ~np.isnan(o)
        assert row.n_obs == ok.sum()
        if not ok.any():
            assert pd.isna(row["last"]) and pd.isna(row["slope"])
            continue
        idx = np.where(ok)[0]
        assert row["last"] == o[idx[-1]]
        assert np.isclose(row["mean"], o[ok].mean())
        assert np.isclose(row["std"], o[ok].std() if ok.sum() > 1 else 0.0)
        assert np.isclose(row["slope"], np.polyfit(idx, o[ok], 1)[0] if ok.sum() > 1 else 0.0)
        recent = o[-3:][~np.isnan(o[-3:])]
        assert (pd.isna(row["recent_mean"]) and not len(recent)) or np.isclose(row["recent_mean"], recent.mean())


def test_reference_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(10, 2, (60, 6)), 1)
    got = features.reference_stats(series(spark, x)).first()
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    np.testing.assert_allclose([got.q1, got["median"], got.q3, got["std"]], [q1, med, q3, x.std()])


def test_persistence_rules(spark):
    n = np.nan
    x = np.array([[1, 2, 3, 9, 9], [n, n, n, 9, 9], [n, 4, n, n, 9]], dtype=float)
    w = Windows(3, 2)
    summary = features.summarize(cells(spark, x, 3), w, 1, keep_truth=True)
    fill = spark.createDataFrame([("v", 5.0, 2.0)], "variable string, fill_value double, fill_width double")
    out = forecast.persistence(summary, w, fill=fill)
    got = {(r.condition, r.stay_id): (r.y_pred, round((r.y_upper - r.y_lower) / 2, 6)) for r in out.filter("hour = 0").collect()}
    sd = round(float(np.std([1, 2, 3]) * 1.5), 6)
    assert got[("naive", 0)] == (3.0, sd) and got[("recent_mean", 0)] == (3.0, sd) and got[("persistence_blend", 0)] == (2.5, sd)
    assert got[("naive", 1)] == (5.0, 2.0)
    assert got[("naive", 2)] == (4.0, 1.5) and got[("recent_mean", 2)] == (4.0, 1.5)
    bare = forecast.persistence(summary, w, ("naive",)).filter("stay_id = 1").first()
    assert (bare.y_pred, bare.y_upper) == (0.0, 1.5)
    assert out.filter("stay_id = 2 and hour = 0 and y_true is not null").count() == 0


@pytest.mark.parametrize("block_rows,pivots", [(4096, None), (16, None), (7, 20)])
def test_neighbours_match_brute_force(spark, block_rows, pivots):
    rng = np.random.default_rng(6)
    t = np.concatenate([rng.normal(0, 1, (120, 5)), rng.normal(0, 0.01, (80, 5))])  # one dense cell
    t[5] = t[6]
    q = np.concatenate([rng.normal(0, 1, (30, 5)), t[:3]])
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "stay_id long, vector array<double>")
    got = similarity.knn_join(frame(q), frame(t), 6, block_rows, pivots).toPandas()
    d = np.sqrt(((q[:, None, :] - t[None, :, :]) ** 2).sum(-1))
    for i in range(len(q)):
        order = np.lexsort((np.arange(len(t)), d[i]))[:6]
        mine = got[got.query_id == i].sort_values("rank")
        assert mine.neighbor_id.tolist() == order.tolist()
        np.testing.assert_allclose(mine.distance, d[i][order], atol=1e-12)


def test_k_is_capped_by_the_training_size(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "stay_id long, vector array<double>")
    assert similarity.knn_join(df, df, 10).count() == 9


def test_scaler_imputes_like_the_column_mean(spark):
    m = np.array([[1.0, 5.0], [3.0, np.nan], [5.0, 5.0], [np.nan, 5.0]])
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(m)]
    df = spark.createDataFrame(rows, "stay_id long, vector array<double>")
    scaler = similarity.fit(df)
    full = np.where(np.isnan(m), np.nanmean(m, axis=0), m)
    sd = full.std(axis=0)
    sd[sd == 0] = 1
    got = np.array([r.vector for r in similarity.standardise(df, scaler).orderBy("stay_id").collect()])
    np.testing.assert_allclose(got, (full - full.mean(axis=0)) / sd)


def test_forward_fill_and_anchor(spark):
    x = np.array([[np.nan, 2.0, np.nan, 4.0, 7.0], [np.nan] * 5])
    stats = spark.createDataFrame([("v", 2.0, 2.0)], "variable string, norm_mean double, norm_std double")
    z = features.normalise(cells(spark, x, 4), stats)
    got = features.ffill_mask(z).orderBy("stay_id", "hour").toPandas()
    assert got.filled.tolist() == [0.0, 0.0, 0.0, 1.0] + [0.0] * 4
    assert got.measured.tolist() == [0, 1, 0, 1] + [0] * 4
    assert {r.stay_id: r.anchor for r in features.anchor(z).collect()} == {0: 1.0, 1: 0.0}


def test_trees_beat_a_constant_and_respect_ranges(spark):
    rng = np.random.default_rng(7)
    level = rng.uniform(10, 90, 80)
    x = level[:, None] + rng.normal(0, 1, (80, 6))
    w = Windows(4, 2)
    vs = [Variable("v", plausible_range=(0, 80))]
    summary = features.summarize(cells(spark, x, 4), w, 2, keep_truth=True)
    fitted = forecast.gbt_fit(summary, vs, w, max_depth=3, max_iter=4)
    out = forecast.gbt_predict(fitted, summary, vs, w).toPandas()
    assert ((out.y_pred - out.y_true) ** 2).mean() < 0.5 * out.y_true.var()
    assert out.y_pred.max() <= 80 and out.y_pred.min() >= 0
    width = ((out.y_upper - out.y_lower) / 2).round(9)
    assert width.nunique() == 1 and (width > 0).all()
    few = forecast.gbt_fit
    with pytest.raises(ValueError):
        few(summary.filter("stay_id < 5"), vs, w, max_iter=1)


def test_runner_checks_names(spark):
    df = spark.createDataFrame([], "stay_id long")
    for bad in (["nonsense"], ["naive@x"], ["gbm"], ["full_pipeline"]):
        with pytest.raises(ValueError):
            forecast.run_conditions(df, bad, [], Windows(2, 2))


def test_ensemble_needs_every_member(spark):
    rows = [("a", 1, "v", 0, 5.0, 4.0, 3.0, 5.0), ("b", 1, "v", 0, 5.0, 6.0, 3.0, 9.0), ("a", 1, "v", 1, 5.0, None, None, None), ("b", 1, "v", 1, 5.0, 6.0, 5.0, 7.0)]
    df = spark.createDataFrame(rows, "condition string, stay_id long, variable string, hour int, y_true double, y_pred double, y_lower double, y_upper double")
    got = {r.hour: (r.y_pred, r.y_lower, r.y_upper) for r in forecast.ensemble(df, ["a", "b"]).collect()}
    assert got == {0: (5.0, 3.0, 7.0), 1: (None, None, None)}
    with pytest.raises(ValueError):
        forecast.ensemble(df, ["a"])


def test_grid_of_a_stay_without_rows(spark):
    cohort = spark.createDataFrame([(1,), (2,)], "stay_id long")
    panel = spark.createDataFrame([(1, "v", 0, 3.0), (1, "v", 4, 8.0)], "stay_id long, variable string, hour int, value double")
    out = harmonize.grid(cohort, panel, [Variable("v")], Windows(2, 2))
    assert out.count() == 8 and out.filter(F.col("value").isNotNull()).count() == 1


def packed_series(spark, x):
    rows = [(s, "v", [None if np.isnan(v) else float(v) for v in r]) for s, r in enumerate(x)]
    return spark.createDataFrame(rows, "stay_id long, variable string, values array<double>")


def sparse_series(seed, n=60, bins=20):
    rng = np.random.default_rng(seed)
    x = rng.normal(50, 9, (n, bins))
    x[rng.random(x.shape) < rng.choice([0.3, 0.6, 0.95], (n, 1))] = np.nan
    x[0] = np.nan
    x[1, 1:] = np.nan
    return x


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("inside", [None, Windows(12, 8)])
def test_packed_fill_equals_rows_per_bin(spark, strict, inside):
    x = sparse_series(5)
    rows = filled(harmonize.interpolate(series(spark, x), 3, strict, inside), 20)
    fold = filled(harmonize.unpacked(harmonize.fill_gaps(packed_series(spark, x), 3, strict, inside)), 20)
    np.testing.assert_allclose(fold, rows, atol=1e-9)


def test_packed_summary_equals_rows_per_bin(spark):
    x, w = sparse_series(6), Windows(12, 8)
    columns = ["last", "mean", "std", "slope", "n_obs", "recent_mean", "recent_mean_2"]
    rows = features.summarize(cells(spark, x, 12), w, 5, keep_truth=True, recents=(2,)).orderBy("stay_id").toPandas()
    fold = features.summarize_packed(packed_series(spark, x), w, 5, keep_truth=True, recents=(2,)).orderBy("stay_id").toPandas()
    np.testing.assert_allclose(fold[columns].astype(float), rows[columns].astype(float), atol=1e-9)
    assert fold.truth.tolist() == rows.truth.tolist()


def test_packing_needs_no_window_sort_or_join(spark):
    cohort = spark.createDataFrame([(1, "train"), (2, "test")], "stay_id long, split string")
    panel = spark.createDataFrame([(1, "v", 0, 3.0), (1, "v", 9, 8.0), (3, "v", 0, 1.0)], "stay_id long, variable string, hour int, value double")
    w = Windows(2, 2)
    series_ = harmonize.fill_gaps(harmonize.packed(cohort, panel, [Variable("v"), Variable("u")], w, carry=("split",)))
    out = features.summarize_packed(series_, w, keep_truth=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Window", "Sort", "Join"))
    got = sorted((r.stay_id, r.variable, r.split, r.n_obs, r["last"]) for r in out.collect())
    assert got == [(1, "u", "train", 0, None), (1, "v", "train", 1, 3.0), (2, "u", "test", 0, None), (2, "v", "test", 0, None)]


def test_grid_fit_makes_no_row_per_setting_and_cell(spark):
    from foretrace.operators import postprocess

    raw = spark.range(40).select(
        F.lit("c").alias("condition"), (F.col("id") % 4).alias("stay_id"), F.lit("v").alias("variable"), F.floor(F.col("id") / 4).cast("int").alias("hour"),
        (F.col("id") % 5 + 1.0).alias("y_true"), (F.col("id") % 3 + 1.0).alias("y_raw"))
    recent = spark.range(4).select(F.col("id").alias("stay_id"), F.lit("v").alias("variable"), F.lit(2.0).alias("recent_mean"))
    terms = postprocess.contributions(raw, recent, [Variable("v")], "extended")
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # settings become rows above the grouping
    small = {(r.setting, r.drift_damping, r.level_anchor_weight): r.term for r in postprocess.contributions(raw, recent, [Variable("v")]).collect()}
    part = {(r.setting, r.drift_damping, r.level_anchor_weight): r.term for r in postprocess.of_grid(terms, "standard").collect()}
    assert small.keys() == part.keys() and all(np.isclose(small[k], part[k]) for k in small) and len(small) == 20


def test_packed_outcomes_equal_numpy(spark):
    rng = np.random.default_rng(8)
    w, vs = Windows(2, 6), [Variable("a"), Variable("b")]
    x = rng.normal(50, 9, (12, 2, 8))
    x[rng.random(x.shape) < 0.5] = np.nan
    x[:, 1, 7] = np.nan  # an hour that no neighbour has
    data = [(s, v.name, [None if np.isnan(y) else float(y) for y in x[s, i]]) for s in range(12) for i, v in enumerate(vs) if (s, i) != (4, 1)]
    x[4, 1] = np.nan  # a stay without one of the series
    horizons = similarity.packed_horizons(spark.createDataFrame(data, "stay_id long, variable string, values array<double>"), vs, w)
    near = {100: [4, 0, 7, 3, 9], 101: [1, 2, 4, 5, 6], 102: [4]}
    pairs = spark.createDataFrame([(q, n, i + 1) for q, ns in near.items() for i, n in enumerate(ns)], "query_id long, neighbor_id long, rank int")
    found = similarity.outcomes(pairs, horizons)
    means = {(r.query_id, r.k, r.variable, r.hour): (r.mean_value, r.n_values) for r in similarity.mean_trajectory(found, vs, w, (2, 5)).collect()}
    assert len(means) == 3 * 2 * 2 * 6
    for (q, k, v, h), (mean, n) in means.items():
        own = x[near[q][:k], "ab".index(v), 2 + h]
        own = own[~np.isnan(own)]
        assert n == len(own) and (mean is None if not n else np.isclose(mean, own.mean()))
    spread = {(r.query_id, r.variable, r.lead): (r.q1, r.median, r.q3) for r in similarity.trajectory_quantiles(found, vs, w).collect()}
    for q, ns in near.items():
        for i, v in enumerate("ab"):
            for lead in similarity.report_hours(w):
                own = x[ns, i, 1 + lead]
                own = own[~np.isnan(own)]
                assert ((q, v, lead) in spread) == (len(own) >= 3)
                if len(own) >= 3:
                    np.testing.assert_allclose(spread[q, v, lead], np.quantile(own, [0.25, 0.5, 0.75]))
    totals = similarity.horizon_mean(similarity.mean_trajectories(found, vs, w)).collect()
    for r in totals:
        hours = [means[r.query_id, 5, r.variable, h][0] for h in range(6)]
        known = [m for m in hours if m is not None]
        assert r.horizon_mean is None if not known else np.isclose(r.horizon_mean, np.mean(known))


def test_scaler_takes_missing_vectors(spark):
    df = spark.createDataFrame([(0, None), (1, [1.0, 4.0]), (2, [3.0, 4.0])], "stay_id long, vector array<double>")
    scaler = similarity.fit(df)
    assert scaler.means == (2.0, 4.0) and scaler.n_train == 3
    assert similarity.standardise(df, scaler).filter("stay_id = 0").first().vector == [0.0, 0.0]


def clustered(spark, seed, n, centres, shift=0):
    rng = np.random.default_rng(seed)
    m = centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.3, (n, centres.shape[1]))
    m[: n // 3] = centres[0]  # a third of all vectors is one point
    return m, spark.createDataFrame([(i + shift, [float(v) for v in r]) for i, r in enumerate(m)], "stay_id long, vector array<double>")


def test_lsh_finds_the_neighbours_and_compares_little(spark):
    centres = np.random.default_rng(9).normal(0, 6, (40, 8))
    t, train = clustered(spark, 10, 900, centres)
    q, queries = clustered(spark, 11, 90, centres, 10_000)
    hashes = similarity.fit_hashes(train, 5)
    assert hashes.recall >= 0.95 and hashes.compared < 4
    found = similarity.knn_lsh(queries, train, 5, hashes, block_rows=64).toPandas()
    assert len(found) == 90 * 5 and not found.duplicated(["query_id", "neighbor_id"]).any()
    d = np.sqrt(((q[found.query_id - 10_000] - t[found.neighbor_id]) ** 2).sum(axis=1))
    np.testing.assert_allclose(found.distance, d, atol=1e-12)
    exact = similarity.knn_join(queries, train, 5)
    row = similarity.recall(spark.createDataFrame(found), exact).first()
    assert (row.n_queries, row.n_neighbours) == (90, 450) and row.recall >= 0.9
    assert similarity.recall(exact, exact).first().recall == 1.0


def test_lsh_hands_short_queries_to_the_exact_join(spark):
    train = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], "stay_id long, vector array<double>")
    far = spark.createDataFrame([(100, [1e6, -1e6]), (101, [3.2, 0.0])], "stay_id long, vector array<double>")
    got = similarity.knn_lsh(far, train, 4).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 100].neighbor_id.tolist() == [39, 38, 37, 36]
    assert got.groupby("query_id").size().tolist() == [4, 4]
    assert similarity.knn_lsh(far, train.limit(2), 4).count() == 4
    assert similarity.knn_lsh(far, train.limit(0), 4).count() == 0


def test_blocks_grow_with_the_join(spark, monkeypatch):
    """Rows are copied for each block they meet: there may only be so many pairs of blocks."""
    rng = np.random.default_rng(8)
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "stay_id long, vector array<double>")
    count = lambda q, t, k: pd.DataFrame({"query_id": [hash((q.query_id.iloc[0], t.neighbor_id.iloc[0], len(q)))], "neighbor_id": [len(q) * len(t)], "distance": [0.0]})
    monkeypatch.setattr(similarity, "BLOCK_PAIRS", 16, raising=False)
    monkeypatch.setattr(similarity, "_nearest_in_block", count)
    met = similarity.knn_join(frame(rng.normal(0, 1, (200, 12))), frame(rng.normal(0, 1, (400, 12))), 5, block_rows=4).count()
    assert met <= 100


def test_block_is_screened_in_parts():
    """The distances of a block are never all in memory."""
    import tracemalloc

    rng = np.random.default_rng(9)
    side = lambda n, name: pd.DataFrame({name: np.arange(n), "vector": list(rng.normal(0, 1, (n, 3)))})
    q, t = side(4000, "query_id"), side(4000, "neighbor_id")
    tracemalloc.start()
    found = similarity._nearest_in_block(q, t, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 12_000 and peak < 8 * 4000 * 4000


def test_tree_cells_are_not_joined_again_for_each_variable(spark):
    rows = [(s, v, 1.0, 1.0, 0.0, 0.0, 3, {0: 1.0, 1: 2.0}) for s in range(3) for v in ("a", "b")]
    summary = spark.createDataFrame(rows, "stay_id long, variable string, last double, mean double, std double, slope double, n_obs long, truth map<int, double>")
    none = spark.createDataFrame([], "variable string, hour int, residual_std double")
    out = forecast.gbt_predict(forecast.TreeModels({}, none, ()), summary, [Variable("a", CHART_SOURCE), Variable("b", CHART_SOURCE)], Windows(2, 2))
    assert "Aggregate [stay_id" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 12


def test_registered_tree_trials_run_all_rounds(monkeypatch):
    """Only what a trial is named for differs from the operator's own settings."""
    import inspect

    from foretrace.operators import tuning
    from foretrace.plans import stat_queries

    class Stop(Exception):
        pass

    def seen(train, val, variables, windows, grid):
        asked.update(grid)
        raise Stop

    asked = {}
    monkeypatch.setattr(tuning, "tree_trials", seen)
    monkeypatch.setattr(stat_queries.S, "Workspace", lambda spark, sf: type("W", (), {"series": lambda self, split: split})())
    with pytest.raises(Stop):
        stat_queries.tuning_trees(None, "")
    usual = {k: p.default for k, p in inspect.signature(forecast.gbt_fit).parameters.items() if k in ("max_depth", "max_iter", "learning_rate")}
    assert usual == {"max_depth": 4, "max_iter": 150, "learning_rate": 0.1}
    assert {t: {k: v for k, v in (usual | s).items() if v != usual[k]} for t, s in asked.items()} == {
        "depth2": {"max_depth": 2}, "slow": {"learning_rate": 0.05}}


def test_trees_of_variables_fitted_together_are_those_fitted_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(s, v, *map(float, rng.normal(size=4)), 3, {0: float(rng.normal()), 1: float(rng.normal())}) for s in range(30) for v in ("a", "b")]
    summary = spark.createDataFrame(rows, "stay_id long, variable string, last double, mean double, std double, slope double, n_obs long, truth map<int, double>")
    both, w = [Variable("a", CHART_SOURCE), Variable("b", CHART_SOURCE)], Windows(2, 2)
    together = forecast.gbt_fit(summary, both, w, max_depth=2, max_iter=3)
    assert list(together.models) == ["a", "b"]
    assert all(m.getNumTrees == 3 for m in together.models.values())
    # The residuals are stored: no reader runs the trees again.
    assert "UDF" not in together.residuals._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.variable, r.hour) for r in together.residuals.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    alone = forecast.gbt_fit(summary.withColumn("truth", F.expr("if(variable = 'b', truth, map())")), both, w, max_depth=2, max_iter=3)
    assert list(alone.models) == ["b"]
    assert alone.models["b"].toDebugString.split("\n")[1:] == together.models["b"].toDebugString.split("\n")[1:]
