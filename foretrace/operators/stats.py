"""Paired statistics over per-stay errors, all comparisons of a set in one job."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.cells import seconds_between, smape_cell
from foretrace.functions.draws import LONG_RANGE, digest, long_word
from foretrace.functions.durable import durable
from foretrace.functions.pvalues import rank_sum_p, wilcoxon_p
from foretrace.functions.ranks import running_totals
from foretrace.functions.resample import resampled_sums
from foretrace.operators import critic
from foretrace.operators.metrics import per_stay_smape, violation_rate
from foretrace.settings import MODEL_CONDITIONS, Variable, Windows, split_condition

DRAWS_PER_DIGEST = 2
MIN_PAIRS = 10
D_PLACES = 12


# --- bootstrap ------------------------------------------------------------

def bootstrap_interval(values: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Percentile interval of one value per resample."""
    ends = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return values.groupBy(*keys).agg(ends.alias("_q")).select(
        *keys, F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("ci_hi"))


def poisson_steps() -> list[float]:
    steps, term, total, k = [], 0.36787944117144233, 0.0, 0
    while total + term > total:
        total += term
        steps.append(total)
        k += 1
        term /= k
    return steps


def poisson_weight(u: Column) -> Column:
    """Poisson(1) quantile of a uniform draw; steps go on until a double can hold no more."""
    steps = poisson_steps()
    out = F.lit(len(steps))
    for k in reversed(range(len(steps))):
        out = F.when(u < steps[k], k).otherwise(out)
    return out


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, resamples: int = 2000, alpha: float = 0.05,
                 seed: int = 42, id_col: str = "stay_id", method: str = "multinomial") -> DataFrame:
    """(keys, n, mean, ci_lo, ci_hi) of the mean over resampled rows; nulls dropped.

    ``multinomial`` makes n draws per resample, split among hash leaves of the rows
    (see functions.resample); only sums are shuffled. ``poisson`` gives every row
    an independent Poisson(1) weight per resample.
    """
    if method not in ("multinomial", "poisson"):
        raise ValueError(f"unknown method {method!r}")
    keys = list(keys)
    if not keys:
        one = bootstrap_ci(df.withColumn("_g", F.lit(0)), ["_g"], value, resamples, alpha, seed, id_col, method)
        return one.drop("_g")
    # Read for the mean and the draws: its history runs once.
    known = durable(df.filter(F.col(value).isNotNull()).select(*keys, id_col, F.col(value).alias("_v")))
    point = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    if method == "poisson":
        one = known.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // DRAWS_PER_DIGEST))))
        one = one.withColumn("_h", digest(seed, "p", F.col("_k"), F.col(id_col)))
        draws = F.explode(F.array(*[
            F.struct((F.col("_k") * DRAWS_PER_DIGEST + i).alias("b"), (long_word(F.col("_h"), i) / LONG_RANGE).alias("u"))
            for i in range(DRAWS_PER_DIGEST)]))
        weighted = one.select(*keys, "_v", draws.alias("_d")).filter(F.col("_d.b") < resamples).select(
            *keys, "_v", F.col("_d.b").alias("b"), poisson_weight(F.col("_d.u")).alias("w"))
        means = weighted.groupBy(*keys, "b").agg(
            F.try_divide(F.sum(F.col("_v") * F.col("w")), F.sum("w")).alias("value"))
    else:
        sums = resampled_sums(known, keys, id_col, ["_v"], resamples, seed)
        means = sums.select(*keys, "b", (F.col("_v") / F.col("draws")).alias("value"))
    return point.join(bootstrap_interval(means, keys, alpha), keys)


# --- rank tests -----------------------------------------------------------

def _tie_term(count: str) -> Column:
    """Sum of c^3 - c over the groups of equal values. A group of 2.1 million rows passes the range of
    a long; as decimals of 38 digits the sum stays exact."""
    c = F.col(count).cast("decimal(19,0)")
    square = (c * c).cast("decimal(38,0)") - 1
    return F.sum((square.cast("decimal(27,0)") * F.col(count).cast("decimal(13,0)")).cast("decimal(38,0)")).cast("double")


def wilcoxon(df: DataFrame, keys: list[str], d: str, p_value: bool = True, group_limit: int | None = None,
             law: str = "normal") -> DataFrame:
    """Signed-rank statistics of paired differences: zeros dropped, average ranks. ``law`` of the
    p-value: "normal" or "exact" (see pvalues).

    Equal |d| are combined first, so the ranks, W+ and the tie term are sums
    over distinct values.
    """
    keys = list(keys)
    if not keys:
        return wilcoxon(df.withColumn("_g", F.lit(0)), ["_g"], d, p_value, group_limit, law).drop("_g")
    limit = {"group_limit": group_limit} if group_limit else {}
    known = df.filter(F.col(d).isNotNull()).select(*keys, d).withColumn("_a", F.abs(F.col(d)))
    zeros = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_a") == 0, 1)).alias("zeros"))
    cum = running_totals(known.filter(F.col("_a") > 0), keys, "_a", {
        "c": F.lit(1), "pos": F.when(F.col(d) > 0, 1).otherwise(0)}, **limit)
    rank = F.col("c_cum") - (F.col("c") - 1) / 2.0
    sums = cum.groupBy(*keys).agg(
        F.sum("c").alias("m"), F.sum(rank * F.col("pos")).alias("w_plus"),
        _tie_term("c").alias("ties"))
    m = F.col("m").cast("double")
    mean = m * (m + 1) / 4
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    out = zeros.join(sums, keys, "left")
    w_minus = m * (m + 1) / 2 - F.col("w_plus")
    out = out.select(
        *keys, "n", F.coalesce("m", F.lit(0)).alias("n_nonzero"), "w_plus",
        F.least(F.col("w_plus"), w_minus).alias("statistic"),
        F.try_divide(F.least(F.col("w_plus"), w_minus) - mean, sd).alias("z"),
        ((F.col("ties") > 0) | (F.col("zeros") > 0)).alias("has_ties"))
    if not p_value:
        return out
    return out.withColumn("p_value", wilcoxon_p("n_nonzero", "w_plus", "has_ties", "z", law))


def mann_whitney(df: DataFrame, keys: list[str], value: str, is_first: Column, p_value: bool = True,
                 group_limit: int | None = None, law: str = "normal") -> DataFrame:
    """Rank-sum test between two samples told apart by ``is_first``."""
    keys = list(keys)
    limit = {"group_limit": group_limit} if group_limit else {}
    known = df.filter(F.col(value).isNotNull() & is_first.isNotNull())
    cum = running_totals(known, keys, value, {"c": F.lit(1), "a": F.when(is_first, 1).otherwise(0)}, **limit)
    rank = F.col("c_cum") - (F.col("c") - 1) / 2.0
    sums = cum.groupBy(*keys).agg(
        F.sum("a").alias("n1"), (F.sum("c") - F.sum("a")).alias("n2"), F.sum(rank * F.col("a")).alias("r1"),
        _tie_term("c").alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * F.greatest(n - 1, F.lit(1.0)))))
    gap = F.abs(u - n1 * n2 / 2) - 0.5
    out = sums.filter((F.col("n1") > 0) & (F.col("n2") > 0)).select(
        *keys, "n1", "n2", u.alias("u"), F.try_divide(gap, sd).alias("z"), (F.col("ties") > 0).alias("has_ties"))
    return out.withColumn("p_value", rank_sum_p("n1", "n2", "u", "has_ties", "z", law)) if p_value else out


# --- paired comparisons ---------------------------------------------------

def _pair_roles(pairs: list[tuple[str, str]]) -> Column:
    """For a condition column: the (comparison, role) entries it takes part in."""
    entries = [
        F.when(F.col("condition") == c, F.struct(F.lit(f"{a}_vs_{b}").alias("comparison"), F.lit(role).alias("role")))
        for a, b in pairs for c, role in ((a, "a"), (b, "b"))]
    return F.explode(F.array_compact(F.array(*entries)))


def _sides(forecasts: DataFrame, pairs: list[tuple[str, str]], keys: tuple[str, ...] = ()) -> DataFrame:
    """Both sides' errors by comparison and stay, and ``_n``, how many sides forecast the stay."""
    involved = sorted({c for p in pairs for c in p})
    errors = per_stay_smape(forecasts.filter(F.col("condition").isin(involved)), (*keys, "condition"))
    roles = errors.withColumn("_r", _pair_roles(pairs)).select(
        *keys, F.col("_r.comparison").alias("comparison"), F.col("_r.role").alias("role"), "stay_id", "smape")
    side = lambda r: F.max(F.when(F.col("role") == r, F.col("smape")))
    return roles.groupBy(*keys, "comparison", "stay_id").agg(
        side("a").alias("smape_a"), side("b").alias("smape_b"), F.countDistinct("role").alias("_n"))


def unpaired_stays(forecasts: DataFrame, pairs: list[tuple[str, str]], keys: tuple[str, ...] = ()) -> DataFrame:
    """Stays that only one side of a comparison forecasts."""
    return _sides(forecasts, pairs, keys).filter(F.col("_n") < 2).select(*keys, "comparison", "stay_id")


def paired_errors(forecasts: DataFrame, pairs: list[tuple[str, str]], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, comparison, stay_id, smape_a, smape_b, d) over the stays common to
    both conditions. The pair list is configuration; stays are matched by one
    grouped pass, not by a join. Differences are rounded far below any of interest, so that
    equal forecasts differ by 0 in whatever order their errors were added."""
    return _sides(forecasts, pairs, keys).filter(F.col("_n") == 2).drop("_n").withColumn(
        "d", F.round(F.col("smape_a") - F.col("smape_b"), D_PLACES))


def compare_many(forecasts: DataFrame, pairs: list[tuple[str, str]], resamples: int = 2000, alpha: float = 0.05,
                 seed: int = 42, p_value: bool = True) -> DataFrame:
    """Every listed pair: paired count, both means with bootstrap intervals and
    the signed-rank test (ten pairs or more, not all equal). A pair with a
    missing condition has no row."""
    paired = durable(paired_errors(forecasts, pairs))
    long = paired.select("comparison", "stay_id", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("smape_a").alias("smape")),
        F.struct(F.lit("b").alias("side"), F.col("smape_b").alias("smape")))).alias("s")).select(
        "comparison", "stay_id", "s.side", "s.smape")
    ci = bootstrap_ci(long, ["comparison", "side"], "smape", resamples, alpha, seed)
    wide = ci.groupBy("comparison").agg(*[
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
        for s in ("a", "b") for c in ("mean", "ci_lo", "ci_hi")])
    close = F.max(F.abs(F.col("d")) - (F.lit(1e-8) + 1e-5 * F.abs(F.col("smape_b")))).alias("_far")
    counts = paired.groupBy("comparison").agg(F.count("d").alias("n_pairs"), close)
    test = wilcoxon(paired, ["comparison"], "d", p_value).drop("n")
    fit = (F.col("n_pairs") >= MIN_PAIRS) & (F.col("_far") > 0)
    tested = ["statistic", "z"] + (["p_value"] if p_value else [])
    return counts.join(wide, "comparison", "left").join(test, "comparison", "left").select(
        "comparison", "n_pairs", *[f"{s}_{c}" for s in ("a", "b") for c in ("mean", "ci_lo", "ci_hi")],
        *[F.when(fit, F.col(c)).alias(c) for c in tested])


def compare_differences(forecasts: DataFrame, pairs: list[tuple[str, str]], resamples: int = 2000, alpha: float = 0.05,
                        seed: int = 42, p_value: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every listed pair, within each of the ``keys``, by its differences: paired count, mean difference with its bootstrap interval,
    share of stays where the first is better, and the signed-rank test (null where no stay differs).
    A pair with a missing condition has no row."""
    by = [*keys, "comparison"]
    paired = durable(paired_errors(forecasts, pairs, keys).filter(F.col("d").isNotNull()))
    share = paired.groupBy(*by).agg(F.avg((F.col("d") < 0).cast("double")).alias("share_a_better"))
    ci = bootstrap_ci(paired, by, "d", resamples, alpha, seed).withColumnRenamed("mean", "mean_diff")
    test = wilcoxon(paired, by, "d", p_value).drop("n")
    tested = ["n_nonzero", "statistic", "z"] + (["p_value"] if p_value else [])
    return ci.join(share, by).join(test, by, "left").select(
        *by, F.col("n").alias("n_pairs"), "mean_diff", "ci_lo", "ci_hi", "share_a_better", *tested)


def compare(forecasts: DataFrame, a: str, b: str, **options) -> DataFrame:
    return compare_many(forecasts, [(a, b)], **options)


def compare_plausibility(forecasts: DataFrame, pairs: list[tuple[str, str]], variables: list[Variable],
                         records: DataFrame | None = None) -> DataFrame:
    """Per comparison and side: mean of the per-variable violation rates, the rate
    of the raw forecasts, and the critic's record where there is one."""
    involved = sorted({c for p in pairs for c in p})
    chosen = forecasts.filter(F.col("condition").isin(involved))
    overall = violation_rate(chosen, variables).groupBy("condition").agg(F.avg("violation_rate").alias("violation_rate"))
    if "y_raw" in forecasts.columns:
        raw = critic.raw_rate(chosen, variables, per_variable=False).select(
            "condition", F.col("violation_rate").alias("raw_rate"), F.col("violations").alias("raw_violations"))
        overall = overall.join(raw, "condition", "left")
    if records is not None:
        overall = overall.join(records, "condition", "left")
    return overall.withColumn("_r", _pair_roles(pairs)).select(
        F.col("_r.comparison").alias("comparison"), F.col("_r.role").alias("side"), *overall.columns)


def all_pairs(conditions: list[str]) -> list[tuple[str, str]]:
    """Pairs of variants of the same model condition, in the given order."""
    by_base: dict[str, list[str]] = {}
    for c in conditions:
        base, _ = split_condition(c)
        if base in MODEL_CONDITIONS:
            by_base.setdefault(base, []).append(c)
    return [pair for group in by_base.values() for pair in combinations(group, 2)]


# --- deterioration subgroup ------------------------------------------------

def deterioration_flags(cohort: DataFrame, drug_events: DataFrame, windows: Windows, lookahead: int,
                        time_col: str = "starttime") -> DataFrame:
    """(stay_id, deteriorating): a drug start within ``lookahead`` bins after the
    observation window, both ends included. The matches of a stay with very many
    starts are reduced to one row inside each task before the shuffle."""
    starts = drug_events.select("stay_id", time_col)
    offset = seconds_between("intime", time_col) / float(windows.bin_seconds)
    flagged = (
        cohort.select("stay_id", "intime").join(starts, "stay_id")
        .filter(offset.between(windows.obs, windows.obs + lookahead)).select("stay_id").distinct()
        .withColumn("deteriorating", F.lit(True)))
    return cohort.select("stay_id").join(flagged, "stay_id", "left").select(
        "stay_id", F.coalesce("deteriorating", F.lit(False)).alias("deteriorating"))


def subgroup_report(forecasts: DataFrame, flags: DataFrame, keys: tuple[str, ...] = ("condition",)) -> DataFrame:
    """n, mean and population std of the per-stay sMAPE per subgroup."""
    label = F.when(F.coalesce("deteriorating", F.lit(False)), "deteriorating").otherwise("stable")
    return per_stay_smape(forecasts, keys).join(flags, "stay_id", "left").withColumn("subgroup", label).groupBy(
        *keys, "subgroup").agg(F.count(F.lit(1)).alias("n"), F.avg("smape").alias("smape_mean"),
                               F.stddev_pop("smape").alias("smape_std"))


def question_pairs(variant: str | None = None) -> list[tuple[str, str]]:
    """Single model against the orchestrated one, and the critic ablation."""
    suffix = f"@{variant}" if variant else ""
    return [(f"single_model_llm{suffix}", f"full_pipeline{suffix}"),
            (f"full_pipeline_no_critic{suffix}", f"full_pipeline{suffix}")]


def question_report(forecasts: DataFrame, flags: DataFrame, variables: list[Variable], variants=(None,),
                    records: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Accuracy, plausibility and subgroup tables for every model at once."""
    pairs = [p for v in variants for p in question_pairs(v)]
    ablation = [p for p in pairs if p[0].startswith("full_pipeline_no_critic")]
    reported = sorted({c for p in pairs if not p[0].startswith("full_pipeline_no_critic") for c in p})
    return {
        "accuracy": compare_many(forecasts, pairs, **options),
        "plausibility": compare_plausibility(forecasts, ablation, variables, records),
        "subgroup": subgroup_report(forecasts.filter(F.col("condition").isin(reported)), flags),
    }


# --- pooled samples ---------------------------------------------------------

def pooled_scopes(paired: DataFrame, flags: DataFrame) -> DataFrame:
    """Each difference in its four memberships: its sample or pooled, its
    subgroup or all. ``paired`` has a ``sample`` column, ``flags`` too."""
    joined = paired.join(flags, ["sample", "stay_id"], "left").filter(F.col("d").isNotNull())
    group = F.when(F.coalesce("deteriorating", F.lit(False)), "deteriorating").otherwise("stable")
    scopes = F.explode(F.array(*[
        F.struct(s.alias("scope"), g.alias("subgroup"))
        for s in (F.col("sample"), F.lit("pooled")) for g in (group, F.lit("all"))]))
    return joined.withColumn("_s", scopes).select(
        "comparison", "sample", "stay_id", "d", F.col("_s.scope").alias("scope"), F.col("_s.subgroup").alias("subgroup"))


def pooled_compare(forecasts: DataFrame, flags: DataFrame, pairs: list[tuple[str, str]], resamples: int = 2000,
                   alpha: float = 0.05, seed: int = 42, p_value: bool = True, same_stays: bool = False) -> DataFrame:
    """(comparison, scope, subgroup): n, mean difference, share where the first
    is better, signed-rank test, and the pooled bootstrap interval. ``same_stays``: sides that
    forecast different stays of a sample are an error (runs a small job)."""
    if same_stays and unpaired_stays(forecasts, pairs, ("sample",)).head(1):
        raise ValueError("the sides of a comparison forecast different stays")
    scoped = durable(pooled_scopes(paired_errors(forecasts, pairs, ("sample",)), flags))
    keys = ["comparison", "scope", "subgroup"]
    base = scoped.groupBy(*keys).agg(
        F.avg("d").alias("mean_diff"), F.avg((F.col("d") < 0).cast("double")).alias("share_a_better"))
    tests = wilcoxon(scoped, keys, "d", p_value)
    whole = scoped.filter((F.col("scope") == "pooled") & (F.col("subgroup") == "all")).withColumn(
        "_id", F.concat_ws("/", "sample", "stay_id"))
    ci = bootstrap_ci(whole, keys, "d", resamples, alpha, seed, id_col="_id").drop("n", "mean")
    return tests.join(base, keys).join(ci, keys, "left")


def subgroup_interaction(forecasts: DataFrame, flags: DataFrame, pairs: list[tuple[str, str]],
                         p_value: bool = True) -> DataFrame:
    """Rank-sum test of the pooled differences, stable against deteriorating."""
    scoped = pooled_scopes(paired_errors(forecasts, pairs, ("sample",)), flags).filter(
        (F.col("scope") == "pooled") & (F.col("subgroup") != "all"))
    return mann_whitney(scoped, ["comparison"], "d", F.col("subgroup") == "stable", p_value)


def shared_stays(forecasts: DataFrame, samples: list[str]) -> DataFrame:
    """Number of stays each pair of samples has in common (0 is reported)."""
    members = forecasts.select("sample", "stay_id").distinct().groupBy("stay_id").agg(
        *[F.max(F.when(F.col("sample") == s, 1).otherwise(0)).alias(f"s{i}") for i, s in enumerate(samples)])
    pairs = list(combinations(range(len(samples)), 2))
    one = members.agg(*[F.coalesce(F.sum(F.col(f"s{i}") * F.col(f"s{j}")), F.lit(0)).alias(f"n{i}_{j}") for i, j in pairs])
    rows = F.explode(F.array(*[
        F.struct(F.lit(samples[i]).alias("sample_a"), F.lit(samples[j]).alias("sample_b"), F.col(f"n{i}_{j}").alias("n_shared"))
        for i, j in pairs]))
    return one.select(rows.alias("r")).select("r.*")


# --- selection --------------------------------------------------------------

def select_model(errors: DataFrame, fallback: DataFrame, primary: str, max_fallback: float = 0.05,
                 resamples: int = 2000, seed: int = 42) -> DataFrame:
    """One row per candidate: mean, paired difference from the primary with its
    interval, eligibility, and ``chosen``. The best eligible candidate replaces
    the primary only if its interval lies below zero.

    ``errors``: condition, stay_id, smape. ``fallback``: condition, fallback_rate.
    """
    base = errors.filter(F.col("condition") == primary).select("stay_id", F.col("smape").alias("_p"))
    diffs = errors.join(base, "stay_id").withColumn("d", F.col("smape") - F.col("_p"))
    ci = bootstrap_ci(diffs, ["condition"], "d", resamples, 0.05, seed).withColumnRenamed("mean", "diff")
    means = errors.groupBy("condition").agg(F.avg("smape").alias("smape_mean"))
    rows = means.join(ci, "condition").join(fallback, "condition", "left").withColumn(
        "fallback_rate", F.coalesce("fallback_rate", F.lit(0.0))).withColumn(
        "eligible", F.col("fallback_rate") <= max_fallback)
    # A handful of candidates: one global ordering of configuration-sized rows.
    everyone = Window.partitionBy(F.lit(0))
    best = F.min(F.when(F.col("eligible"), F.struct("smape_mean", "condition"))).over(everyone)
    beats = F.max(F.when((F.col("condition") == F.col("_best")) & (F.col("ci_hi") < 0), F.col("condition"))).over(everyone)
    return rows.withColumn("_best", best.getField("condition")).withColumn(
        "_winner", F.coalesce(beats, F.lit(primary))).withColumn(
        "chosen", F.col("condition") == F.col("_winner")).drop("_best", "_winner")


def pick_winner(trials: DataFrame, min_improvement: float = 0.0, max_fallback: float = 0.05,
                keys: tuple[str, ...] = ("round",)) -> DataFrame:
    """Winner of each round. A trial's objective is the mean of its conditions'
    mean sMAPE; it is eligible when every fallback rate is low enough. The best
    eligible trial wins if it gains enough or the incumbent is ineligible.
    Put ``condition`` into the keys for per-condition rounds."""
    scored = trials.groupBy(*keys, "trial").agg(
        F.avg("smape_mean").alias("objective"), F.bool_and(F.col("fallback_rate") <= max_fallback).alias("eligible"))
    incumbent = F.col("trial") == "incumbent"
    best = F.min(F.when(F.col("eligible"), F.struct(F.col("objective"), (~incumbent).alias("_x"), F.col("trial"))))
    rounds = scored.groupBy(*keys).agg(
        best.alias("_b"), F.max(F.when(incumbent, F.col("objective"))).alias("incumbent_objective"),
        F.max(F.when(incumbent, F.col("eligible"))).alias("_ok"), F.count(F.lit(1)).alias("n_trials"))
    gain = F.col("incumbent_objective") - F.col("_b.objective")
    takes = F.col("_b").isNotNull() & (~F.coalesce("_ok", F.lit(False)) | (gain >= min_improvement))
    return rounds.select(
        *keys, F.when(takes, F.col("_b.trial")).otherwise("incumbent").alias("winner"),
        F.when(takes, F.col("_b.objective")).otherwise(F.col("incumbent_objective")).alias("objective"),
        "incumbent_objective", "n_trials")


def seed_sensitivity(forecasts: DataFrame, pairs: list[tuple[str, str]], resamples: int = 2000, alpha: float = 0.05,
                     seed: int = 42) -> DataFrame:
    """The same comparisons for each retrained model: the rows of ``compare_differences`` per ``seed`` column
    of the forecasts, with how the mean difference spreads over the seeds and whether all agree on its sign."""
    rows = durable(compare_differences(forecasts, pairs, resamples, alpha, seed, keys=("seed",)))
    over = rows.groupBy("comparison").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.min("mean_diff").alias("least_diff"), F.max("mean_diff").alias("largest_diff"),
        (F.countDistinct(F.signum("mean_diff")) == 1).alias("same_sign"))
    return rows.join(over, "comparison")


def reproduction_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """Do two stored forecasts agree: stays on one side only, largest difference
    of the forecasts and both mean per-stay sMAPEs."""
    a = first.select("stay_id", "variable", "hour", F.col("y_true").alias("t1"), F.col("y_pred").alias("p1"))
    b = second.select("stay_id", "variable", "hour", F.col("y_true").alias("t2"), F.col("y_pred").alias("p2"))
    cells = a.join(b, ["stay_id", "variable", "hour"], "full").groupBy("stay_id").agg(
        F.max(F.abs(F.col("p1") - F.col("p2"))).alias("gap"),
        F.avg(smape_cell("t1", "p1")).alias("s1"), F.avg(smape_cell("t2", "p2")).alias("s2"),
        F.count("p1").alias("c1"), F.count("p2").alias("c2"))
    return cells.agg(
        F.count(F.when((F.col("c1") == 0) | (F.col("c2") == 0), 1)).alias("unmatched_stays"),
        F.max("gap").alias("max_abs_diff"), F.avg("s1").alias("smape_first"), F.avg("s2").alias("smape_second"))
