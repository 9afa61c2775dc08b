"""Trials over the operators Spark itself runs, and rescoring of stored runs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.functions.durable import durable
from foretrace.operators import calibrate, forecast, metrics, postprocess, similarity, stats
from foretrace.settings import Variable, Windows


def neighbour_trials(queries: DataFrame, train: DataFrame, horizons: DataFrame, truth: DataFrame, ks: list[int],
                     variables: list[Variable], windows: Windows) -> DataFrame:
    """(trial, condition, stay_id, variable, hour, y_true, y_pred): the neighbour
    mean for several k from one join with the largest k.

    ``horizons``: ``similarity.packed_horizons`` of the training stays; ``truth``: stay_id, variable,
    hour, y_true of the query stays.
    """
    found = similarity.outcomes(similarity.knn_join(queries, train, max(ks)), horizons)
    means = similarity.mean_trajectory(found, variables, windows, tuple(sorted(ks))).withColumnRenamed("query_id", "stay_id")
    return means.join(truth, ["stay_id", "variable", "hour"]).select(
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("trial"), F.lit("neighbour_mean").alias("condition"),
        "stay_id", "variable", "hour", "y_true", F.col("mean_value").alias("y_pred"))


def window_trials(cut_grid: DataFrame, windows: Windows, recents: list[int], fill: DataFrame | None = None) -> DataFrame:
    """The recent-mean forecast for several window lengths from one summary pass."""
    from foretrace.operators.features import summarize

    summary = summarize(cut_grid, windows, recents[0], keep_truth=True, recents=tuple(recents)).drop("recent_mean")
    settings = F.explode(F.array(*[
        F.struct(F.lit(f"window{r}").alias("trial"), F.col(f"recent_mean_{r}").alias("recent_mean")) for r in recents]))
    trials = summary.withColumn("_t", settings).select("*", "_t.trial", "_t.recent_mean").drop("_t")
    return forecast.persistence(trials, windows, ("recent_mean",), fill, carry=("trial",))


def tree_trials(train_summary: DataFrame, eval_summary: DataFrame, variables: list[Variable], windows: Windows,
                grid: dict[str, dict]) -> DataFrame:
    """One distributed fit per grid point."""
    out = None
    for name, settings in grid.items():
        fitted = forecast.gbt_fit(train_summary, variables, windows, **settings)
        one = forecast.gbt_predict(fitted, eval_summary, variables, windows).withColumn("trial", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Round:
    """One round of a trial search: all its conditions are scored under the settings of each trial.
    With ``per_condition`` every condition has its own winner, whose settings then hold for the
    condition's group alone."""

    name: str
    conditions: tuple[str, ...]
    trials: dict[str, dict]
    per_condition: bool = False


@dataclass
class Search:
    """What a search has come to: settings, one row per round and scope, and the scored trials."""

    settings: dict
    rounds: DataFrame | None = None
    trials: DataFrame | None = None
    scored: list[tuple[str, str]] = field(default_factory=list)


def group_settings(settings: dict, group: str) -> dict:
    """Settings that hold for one group only."""
    return {f"{group}.{name}": value for name, value in settings.items()}


def effective(settings: dict, group: str, uses: tuple[str, ...]) -> dict:
    """The settings that a condition of this group depends on; its group's own ones come first."""
    return {name: settings.get(f"{group}.{name}", settings.get(name)) for name in uses}


def search(spark: SparkSession, rounds: list[Round], fixed: dict, score: Callable[[list[tuple[str, str, dict]]], DataFrame],
           uses: dict[str, tuple[str, ...]], groups: dict[str, str] | None = None, min_improvement: float = 0.0,
           max_fallback: float = 0.05) -> Search:
    """Coordinate search: each round starts from the settings that the rounds before it left.

    ``score`` takes (condition, settings_key, effective settings) of what was never scored before, all of a round at
    once, and returns condition, settings_key, smape_mean, fallback_rate. ``uses`` names the settings each condition depends
    on, so a trial that changes others is not scored again. Winners are those of ``stats.pick_winner``. The
    driver holds settings and one winner per round and scope.
    """
    groups = {c: (groups or {}).get(c, c) for c in uses}
    state, known = Search(dict(fixed)), None
    for rnd in rounds:
        if "incumbent" in rnd.trials:
            raise ValueError(f"round {rnd.name}: 'incumbent' is no name for a trial")
        if rnd.per_condition and len({groups[c] for c in rnd.conditions}) < len(rnd.conditions):
            raise ValueError(f"round {rnd.name}: conditions of one group cannot have winners of their own")
        trials = {"incumbent": {}} | rnd.trials
        rows, wanted = [], {}
        for trial, changed in trials.items():
            for c in rnd.conditions:
                own = group_settings(changed, groups[c]) if rnd.per_condition else changed
                used = effective(state.settings | own, groups[c], uses[c])
                key = json.dumps(used, sort_keys=True)
                rows.append((rnd.name, trial, c, key))
                if (c, key) not in state.scored:
                    wanted[c, key] = used
        if wanted:
            fresh = durable(score([(c, key, used) for (c, key), used in wanted.items()]).select(
                "condition", "settings_key", "smape_mean", "fallback_rate"))
            if fresh.count() != len(wanted):
                raise ValueError(f"round {rnd.name}: {len(wanted)} settings were to be scored, not {fresh.count()}")
            known = fresh if known is None else known.unionByName(fresh)
            state.scored += list(wanted)
        of_round = durable(spark.createDataFrame(rows, "round string, trial string, condition string, settings_key string").join(
            known, ["condition", "settings_key"]))
        keys = ("round", "condition") if rnd.per_condition else ("round",)
        winners = durable(stats.pick_winner(of_round, min_improvement, max_fallback, keys))
        for row in winners.collect():
            changed = trials[row["winner"]]
            state.settings |= group_settings(changed, groups[row["condition"]]) if rnd.per_condition else changed
        scope = F.col("condition") if rnd.per_condition else F.lit("all")
        winners = winners.select("round", scope.alias("scope"), "winner", "objective", "incumbent_objective", "n_trials")
        state.rounds = winners if state.rounds is None else state.rounds.unionByName(winners)
        state.trials = of_round if state.trials is None else state.trials.unionByName(of_round)
    return state


def rescore(calibration: DataFrame, test: DataFrame, recent: DataFrame, variables: list[Variable],
            strategy: str = "global", grid: str = "standard", percent: int = 90,
            critic_stage: str | None = "final") -> dict[str, DataFrame]:
    """Fit on the calibration stays, apply to the test stays, refit the factors
    and report error and calibrated coverage before and after."""
    settings = durable(postprocess.fit(calibration, recent, variables, strategy, grid, critic_stage))
    cal_new = postprocess.apply(calibration, recent, variables, settings, critic_stage)
    test_new = postprocess.apply(test, recent, variables, settings, critic_stage)
    parts = []
    for label, cal, new in (("run", calibration, test), ("rescored", cal_new, test_new)):
        factors = calibrate.conformal_factors(cal, percent=percent)
        covered = calibrate.apply(new, factors).groupBy("condition").agg(F.avg(metrics.inside()).alias("coverage"))
        means = [
            metrics.per_stay_smape(df).groupBy("condition").agg(F.avg("smape").alias(name))
            for name, df in (("calibration_smape", cal), ("test_smape", new))]
        parts.append(means[0].join(means[1], "condition").join(covered, "condition").withColumn("version", F.lit(label)))
    return {"settings": settings, "forecasts": test_new, "report": parts[0].unionByName(parts[1])}


def reproduces(settings: DataFrame, stored: DataFrame) -> DataFrame:
    """Per condition: does the fit equal the stored settings (one row per condition)."""
    same = (F.abs(F.col("drift_damping") - F.col("_d")) < 1e-8) & (F.abs(F.col("level_anchor_weight") - F.col("_w")) < 1e-8)
    return settings.join(stored.select("condition", F.col("drift_damping").alias("_d"),
                                       F.col("level_anchor_weight").alias("_w")), "condition").groupBy("condition").agg(
        F.bool_and(same).alias("reproduces"))
