"""Ranks, tests, bootstrap and calibration against direct computation."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretrace.functions import pvalues, ranks
from foretrace.functions.draws import digest, long_word
from foretrace.operators import calibrate, critic, metrics, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, and one key holds most rows."""
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(0, 3, 3000), 2)
    v[:1000] = 0.25
    k = np.where(rng.random(3000) < 0.8, "big", "small")
    return spark.createDataFrame([(str(a), float(b)) for a, b in zip(k, v)], "k string, v double"), k, v


@pytest.mark.parametrize("limit", [ranks.GROUP_LIMIT, 50])
def test_quantiles_and_ranks_by_both_ways(skewed, limit):
    df, k, v = skewed
    got = {r.k: r for r in ranks.quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.9}, limit).collect()}
    for key in ("big", "small"):
        np.testing.assert_allclose([got[key].a, got[key].m, got[key].z], np.percentile(v[k == key], [10, 50, 90]), atol=1e-12)
    third = ranks.at_ranks(df, [], "v", {"x": F.lit(3)}, limit).first()
    assert third.x == np.sort(v)[2] and third.n_rows == 3000


@pytest.mark.parametrize("limit", [None, 40])
def test_two_sample_distance(skewed, limit):
    df, k, v = skewed
    row = metrics.two_sample_ks(
        df.withColumn("g", F.lit(1)), ["g"], "v", F.col("k") == "big", limit).first()
    a, b = np.sort(v[k == "big"]), np.sort(v[k == "small"])
    grid = np.concatenate([a, b])
    want = np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max()
    assert np.isclose(row.ks_statistic, want)


def brute_ranks(x):
    return np.array([(x < y).sum() + ((x == y).sum() + 1) / 2 for y in x])


@pytest.mark.parametrize("limit", [None, 30])
def test_signed_rank_statistic(skewed, limit):
    df, _, v = skewed
    got = stats.wilcoxon(df, [], "v", True, limit).first()
    d = v[v != 0]
    r = brute_ranks(np.abs(d))
    w = r[d > 0].sum()
    _, t = np.unique(np.abs(d), return_counts=True)
    m = len(d)
    z = (min(w, m * (m + 1) / 2 - w) - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - (t**3 - t).sum() / 48)
    assert got.w_plus == w and np.isclose(got.z, z) and np.isclose(got.p_value, math.erfc(abs(z) / math.sqrt(2)))


def test_signed_rank_exact_small(spark):
    d = [1.5, -0.5, 2.5, 3.5, -1.0, 4.0, 0.25]
    got = stats.wilcoxon(spark.createDataFrame([(x,) for x in d], "d double"), [], "d", law="exact").first()
    r = brute_ranks(np.abs(np.array(d)))
    w = min(sum(r[i] for i, x in enumerate(d) if x > 0), sum(r[i] for i, x in enumerate(d) if x < 0))
    hits = sum(sum(rr for rr, s in zip(r, signs) if s) <= w for signs in itertools.product((0, 1), repeat=len(d)))
    assert np.isclose(got.p_value, min(1, 2 * hits / 2 ** len(d)))


def test_rank_sum(spark):
    a, b = [1.0, 4.0, 6.0, 9.0], [2.0, 3.0, 5.0, 7.0, 8.0, 10.0]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b], "v double, first boolean")
    got = stats.mann_whitney(df.withColumn("g", F.lit(0)), ["g"], "v", F.col("first"), law="exact").first()
    u = sum(x > y for x in a for y in b)
    assert got.u == u
    every = [sum(x > y for x in c for y in set(a + b) - set(c)) for c in itertools.combinations(a + b, len(a))]
    low = min(u, 24 - u)
    assert np.isclose(got.p_value, min(1, 2 * sum(e <= low for e in every) / len(every)))


def test_ties_of_millions_of_rows(spark):
    """The cube of a group's size, and the sum of such cubes, pass the range of a long."""
    n = 4_000_000
    df = spark.range(n).select(F.lit(0).alias("g"), (F.col("id") % 2 + 1).cast("double").alias("v"), (F.col("id") % 4 < 2).alias("first"))
    got = stats.mann_whitney(df, ["g"], "v", F.col("first")).first()
    assert (got.n1, got.n2, got.u, got.has_ties) == (n / 2, n / 2, n * n / 8, True)
    ties, m = 2 * ((n // 2) ** 3 - n // 2), n / 2
    assert math.isclose(got.z, -0.5 / math.sqrt(m * m / 12 * (n + 1 - ties / (n * (n - 1)))), rel_tol=1e-12)
    three = spark.range(3 * n).select(F.lit(3.0).alias("v"))
    got = stats.wilcoxon(three, [], "v").first()
    c = 3 * n
    assert math.isclose(got.z, -c * (c + 1) / 4 / math.sqrt(c * (c + 1) * (2 * c + 1) / 24 - (c**3 - c) / 48), rel_tol=1e-12)


def test_normal_and_limit_laws_are_resolved(spark):
    zs = [0.0, 1e-4, 0.05, 0.1, 0.7, -2.5, 6.0, 10.5, 25.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(pvalues.normal_two_sided("z").alias("p")).collect()]
    np.testing.assert_allclose(got, [math.erfc(abs(z) / math.sqrt(2)) for z in zs], rtol=1e-8)
    xs = [0.05, 0.2, 0.5, 0.99, 1.0, 1.5, 4.0, 9.0]
    df = spark.createDataFrame([(x / math.sqrt(5000.0), 10_000, 10_000) for x in xs], "d double, a long, b long")
    got = [r.p for r in df.select(pvalues.kolmogorov_p("d", "a", "b").alias("p")).collect()]
    want = [min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2.0 * (k * x) ** 2) for k in range(1, 400)))) for x in xs]
    np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-12)


def test_exact_laws_count_orders():
    rng = np.random.default_rng(1)
    for n1, n2 in ((3, 3), (3, 5), (4, 6)):
        values = rng.permutation(n1 + n2).astype(float)
        gap = lambda c: max(abs(sum(v in c for v in values if v <= x) / n1 - sum(v not in c for v in values if v <= x) / n2) for x in values)
        every = [gap(set(c)) for c in itertools.combinations(values, n1)]
        for d in set(np.round(every, 9)):
            assert np.isclose(pvalues.exact_kolmogorov(d, n1, n2), np.mean([e >= d - 1e-9 for e in every]))
    assert pvalues.exact_kolmogorov(0.0, 5, 5) == 1.0
    # Unequal sizes beyond any threshold still follow the exact law, close to the limit.
    assert np.isclose(pvalues.exact_kolmogorov(0.12, 300, 450), 0.0108, atol=0.003)


def test_draws_reach_every_position_of_huge_groups(spark):
    n = 3_000_000_000
    df = spark.range(20_000).select((long_word(digest(42, "b", F.lit(0), F.col("id"))) % n).alias("p"))
    counts = [r.n for r in df.groupBy(F.floor(F.col("p") * 10 / n).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(counts) == 10 and min(counts) > 1800 and max(counts) < 2200


def test_bootstrap_interval_behaves(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0.11, 0.03, 300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(999, None)], "stay_id long, e double")
    se = x.std() / math.sqrt(300)
    for method in ("multinomial", "poisson"):
        r = stats.bootstrap_ci(df, [], "e", 400, 0.05, 1, method=method).first()
        assert r.n == 300 and np.isclose(r.mean, x.mean())
        assert abs((r.mean - r.ci_lo) / se - 1.96) < 0.4 and abs((r.ci_hi - r.mean) / se - 1.96) < 0.4
    again = stats.bootstrap_ci(df.repartition(7), [], "e", 400, 0.05, 1).first()
    assert np.isclose(again.ci_lo, stats.bootstrap_ci(df, [], "e", 400, 0.05, 1).first().ci_lo)
    with pytest.raises(ValueError):
        stats.bootstrap_ci(df, ["stay_id"], "e", method="other")


def forecasts(spark, n=60, condition="c"):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        for h in range(4):
            t, p = rng.normal(50, 5), rng.normal(50, 4)
            rows.append((condition, i, "v", h, float(t), float(p), float(p - 3), float(p + 3)))
    return spark.createDataFrame(rows, "condition string, stay_id long, variable string, hour int, y_true double, y_pred double, y_lower double, y_upper double")


@pytest.mark.parametrize("limit", [ranks.GROUP_LIMIT, 20])
def test_conformal_factor_and_its_guarantee(spark, limit):
    df = forecasts(spark)
    f = calibrate.conformal_factors(df, percent=90, group_limit=limit).first()
    pdf = df.toPandas()
    s = np.sort(np.abs(pdf.y_true - pdf.y_pred) / 3.0)
    rank = min(len(s), math.ceil((len(s) + 1) * 0.9))
    assert np.isclose(f.factor, s[rank - 1])
    out = calibrate.before_after(df, calibrate.conformal_factors(df)).first()
    assert out.coverage_after >= 0.9 and out.width_after > out.width_before


def test_factors_keep_asymmetric_sides(spark):
    df = spark.createDataFrame([("c", "v", 10.0, 8.0, 13.0), ("c", "w", 10.0, 8.0, 13.0)],
                               "condition string, variable string, y_pred double, y_lower double, y_upper double")
    factors = spark.createDataFrame([("c", "v", 2.0)], "condition string, variable string, factor double")
    got = {r.variable: (r.y_lower, r.y_upper) for r in calibrate.apply(df, factors).collect()}
    assert got == {"v": (6.0, 16.0), "w": (8.0, 13.0)}


def test_zero_width_cells_have_no_score(spark):
    df = spark.createDataFrame([("c", "v", 1.0, 2.0, 2.0, 2.0), ("c", "v", 1.0, 2.0, 1.0, 3.0)],
                               "condition string, variable string, y_true double, y_pred double, y_lower double, y_upper double")
    assert calibrate.conformal_factors(df).first().n == 1


def test_comparison_needs_ten_pairs(spark):
    few = forecasts(spark, 5, "a").unionByName(forecasts(spark, 5, "b"))
    row = stats.compare(few, "a", "b", resamples=20).first()
    assert row.n_pairs == 5 and row.z is None
    same = forecasts(spark, 20, "a").unionByName(forecasts(spark, 20, "b"))
    row = stats.compare(same, "a", "b", resamples=20).first()
    assert row.n_pairs == 20 and row.p_value is None  # all differences are zero
    assert stats.compare(same, "a", "missing", resamples=20).count() == 0


def test_pick_winner_rule(spark):
    schema = "round string, trial string, condition string, smape_mean double, fallback_rate double"
    rows = [("r1", "incumbent", "c", 0.20, 0.0), ("r1", "x", "c", 0.1995, 0.0), ("r1", "y", "c", 0.1, 0.5),
            ("r2", "incumbent", "c", 0.20, 0.9), ("r2", "x", "c", 0.30, 0.0), ("r3", "incumbent", "c", 0.2, 0.9), ("r3", "x", "c", 0.1, 0.9)]
    got = {r["round"]: r.winner for r in stats.pick_winner(spark.createDataFrame(rows, schema), 0.001).collect()}
    assert got == {"r1": "incumbent", "r2": "x", "r3": "incumbent"}


def test_metrics_ignore_missing_cells(spark):
    rows = [("c", 1, "v", 0, 10.0, 12.0, 9.0, 13.0), ("c", 1, "v", 1, None, 12.0, 9.0, 13.0), ("c", 1, "v", 2, 10.0, None, None, None)]
    df = spark.createDataFrame(rows, "condition string, stay_id long, variable string, hour int, y_true double, y_pred double, y_lower double, y_upper double")
    r = metrics.point_metrics(df).first()
    assert r.n_obs == 1 and r.mae == 2.0 and np.isclose(r.smape, 4 / 22)
    assert metrics.coverage(df).first().n_cells == 1


def test_deterioration_window_is_inclusive(spark):
    from datetime import datetime, timedelta

    from foretrace.settings import Windows

    t0 = datetime(2150, 1, 1)
    cohort = spark.createDataFrame([(i, t0) for i in range(1, 6)], "stay_id long, intime timestamp")
    starts = spark.createDataFrame([(i, t0 + timedelta(hours=h)) for i, h in enumerate((23.9, 24, 48, 48.1), 1)], "stay_id long, starttime timestamp")
    got = {r.stay_id: r.deteriorating for r in stats.deterioration_flags(cohort, starts, Windows(24, 24), 24).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False}


def test_release_removes_what_was_written(spark, monkeypatch):
    from foretrace.functions import durable

    monkeypatch.setattr(durable, "_written", [])
    kept = durable.durable(spark.range(3))
    path = kept.inputFiles()[0]
    assert kept.count() == 3 and durable.release(spark) == 1 and durable.release(spark) == 0
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def test_sides_of_a_pooled_comparison_have_to_forecast_the_same_stays(spark):
    rows = [("s", c, i, "a", 0, 1.0, 2.0) for c in ("x", "y") for i in range(3) if (c, i) != ("y", 2)]
    df = spark.createDataFrame(rows, "sample string, condition string, stay_id long, variable string, hour int, y_true double, y_pred double")
    flags = spark.createDataFrame([("s", 0, True)], "sample string, stay_id long, deteriorating boolean")
    assert [r.stay_id for r in stats.unpaired_stays(df, [("x", "y")], ("sample",)).collect()] == [2]
    with pytest.raises(ValueError):
        stats.pooled_compare(df, flags, [("x", "y")], 10, same_stays=True)


def differing(spark, seeds=(1,)):
    rng = np.random.default_rng(8)
    rows = [(s, c, i, "v", 0, 10.0, float(10 + rng.normal(k * (1 if s == 1 else -1), 1)))
            for s in seeds for k, c in enumerate(("x", "y")) for i in range(30)]
    return spark.createDataFrame(rows, "seed int, condition string, stay_id long, variable string, hour int, y_true double, y_pred double")


def test_differences_carry_their_own_interval_and_share(spark):
    df = differing(spark)
    wide = df.toPandas().assign(e=lambda p: 2 * (p.y_true - p.y_pred).abs() / (p.y_true.abs() + p.y_pred.abs() + 1e-8)).pivot(
        index="stay_id", columns="condition", values="e")
    d = (wide.x - wide.y).to_numpy()
    row, = stats.compare_differences(df, [("x", "y"), ("x", "gone")], 400).collect()
    assert (row.comparison, row.n_pairs, row.n_nonzero) == ("x_vs_y", 30, 30)
    np.testing.assert_allclose([row.mean_diff, row.share_a_better], [d.mean(), (d < 0).mean()], atol=1e-9)
    assert row.ci_lo < d.mean() < row.ci_hi
    same = df.filter("condition = 'x'").unionByName(df.filter("condition = 'x'").withColumn("condition", F.lit("y")))
    row, = stats.compare_differences(same, [("x", "y")], 50).collect()
    assert (row.mean_diff, row.share_a_better, row.p_value) == (0, 0, None)


def test_every_seed_has_its_comparison(spark):
    rows = {r.seed: r for r in stats.seed_sensitivity(differing(spark, (1, 2)), [("x", "y")], 50).collect()}
    assert set(rows) == {1, 2} and all(r.n_seeds == 2 and r.least_diff <= r.mean_diff <= r.largest_diff for r in rows.values())
    one = stats.compare_differences(differing(spark, (1, 2)).filter("seed = 2"), [("x", "y")], 50).first()
    assert abs(one.mean_diff - rows[2].mean_diff) < 1e-12


def test_the_final_arm_joins_the_replayed_ones(spark):
    arms = differing(spark).replace({"x": "no_critic", "y": "clip_raw"}, subset="condition")
    stored = differing(spark).filter("condition = 'x'")
    got = {r.comparison for r in critic.replay_pairs(critic.with_final(arms, stored), resamples=20).collect()}
    assert got == {"clip_raw_vs_no_critic", "no_critic_vs_critic_final", "clip_raw_vs_critic_final"}


def test_rounds_start_from_the_winners_before(spark):
    from foretrace.operators import tuning

    asked = []
    best = {"a": {"x": 2, "y": 1}, "b": {"x": 3, "y": 1}}

    def score(wanted):
        asked.append([(c, tuple(sorted(used.items()))) for c, _, used in wanted])
        rows = [(c, key, sum(abs(v - best[c][n]) for n, v in used.items()) + 0.5, 0.5 if used["x"] == 9 else 0.0) for c, key, used in wanted]
        return spark.createDataFrame(rows, "condition string, settings_key string, smape_mean double, fallback_rate double")

    rounds = [tuning.Round("both", ("a", "b"), {"two": {"x": 2}, "four": {"x": 4}}),
              tuning.Round("own", ("a", "b"), {"three": {"x": 3}, "bad": {"x": 9}}, per_condition=True),
              tuning.Round("other", ("a", "b"), {"one": {"y": 1}, "same": {"x": 2}})]
    uses = {"a": ("x", "y"), "b": ("x",)}
    out = tuning.search(spark, rounds, {"x": 7, "y": 5}, score, uses)
    got = {(r["round"], r["scope"]): (r["winner"], r["objective"], r["incumbent_objective"]) for r in out.rounds.collect()}
    # means of a and b: two (0 + 4 + 0.5, 1 + 0.5), incumbent (5 + 4 + 0.5, 4 + 0.5)
    assert got == {("both", "all"): ("two", 3.0, 7.0), ("own", "a"): ("incumbent", 4.5, 4.5), ("own", "b"): ("three", 0.5, 1.5),
                   ("other", "all"): ("one", 0.5, 2.5)}
    assert out.settings == {"x": 2, "y": 1, "b.x": 3}
    flat = [x for ask in asked for x in ask]
    assert len(flat) == len(set(flat)) and asked[2] == [("a", (("x", 2), ("y", 1)))]  # nothing is scored twice
    assert out.trials.count() == 6 + 6 + 6
    with pytest.raises(ValueError):
        tuning.search(spark, [tuning.Round("r", ("a", "b"), {}, True)], {"x": 1}, score, {"a": ("x",), "b": ("x",)}, {"a": "g", "b": "g"})
