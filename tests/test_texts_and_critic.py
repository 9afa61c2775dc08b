"""Post-processing, critic, answers, stores."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretrace.functions.durable import shared_folder
from foretrace.operators import critic, postprocess, prompts, responses
from foretrace.settings import PostprocessParams, PromptOptions, Variable, Windows, split_condition, validate_conditions
from foretrace.sources import forecast_store, sinks, tables

VS = [Variable("a", plausible_range=(10, 100), unit="x"), Variable("b", plausible_range=(0, 50), hard_range=(0, 60))]
W = Windows(4, 3)


def raw(spark, values, condition="single_model_llm", variable="a"):
    rows = [(condition, 1, variable, h, 50.0, float(v), float(v) - 2, float(v) + 2) for h, v in enumerate(values)]
    return spark.createDataFrame(rows, "condition string, stay_id long, variable string, hour int, y_true double, y_raw double, y_lower double, y_upper double")


def recent(spark, value):
    return spark.createDataFrame([(1, "a", value), (1, "b", value)], "stay_id long, variable string, recent_mean double")


def test_anchor_and_damping_closed_form(spark):
    y, w, lam, r = np.array([40.0, 60.0, 90.0]), 0.5, 0.25, 50.0
    out = postprocess.apply(raw(spark, y), recent(spark, r), VS, PostprocessParams(lam, w)).orderBy("hour").toPandas()
    moved = y + w * (r - y[0])
    np.testing.assert_allclose(out.y_pred, moved[0] + lam * (moved - moved[0]))
    np.testing.assert_allclose(out.y_upper - out.y_lower, 4.0)
    none = postprocess.apply(raw(spark, y), recent(spark, None), VS, PostprocessParams(1.0, w)).orderBy("hour").toPandas()
    np.testing.assert_allclose(none.y_pred, y)


def test_hard_range_and_final_clip(spark):
    y = [-5.0, 70.0, 120.0]
    hard = postprocess.apply(raw(spark, y, variable="b"), recent(spark, None), VS).orderBy("hour").toPandas()
    assert hard.y_pred.tolist() == [0.0, 60.0, 60.0]
    ended = postprocess.apply(raw(spark, y, "full_pipeline@x", "b"), recent(spark, None), VS, critic_stage="final").orderBy("hour").toPandas()
    assert ended.y_pred.tolist() == [0.0, 50.0, 50.0]
    open_end = postprocess.apply(raw(spark, [-5.0, 1e6], variable="a"), recent(spark, None), VS).orderBy("hour").toPandas()
    assert open_end.y_pred.tolist() == [0.0, 1e6]


@pytest.mark.parametrize("kwargs", [{"drift_damping": 1.2}, {"level_anchor_weight": -0.1}, {"level_window": 0}])
def test_settings_are_checked(kwargs):
    with pytest.raises(ValueError):
        PostprocessParams(**kwargs)


def test_fit_takes_the_first_of_equal_settings(spark):
    """A flat forecast equal to the recent mean: every setting scores the same."""
    best = postprocess.fit(raw(spark, [50.0, 50.0, 50.0]), recent(spark, 50.0), VS)
    assert {(r.drift_damping, r.level_anchor_weight) for r in best.collect()} == {(0.1, 0.0)}


def test_clip_leaves_no_violation(spark):
    out = critic.clip_series(raw(spark, [5.0, 50.0, 500.0]), VS, "y_raw")
    assert critic.count_violations(out, VS, ("variable",), "y_raw").first().violations == 0
    rec = critic.record(out).first()
    assert (rec.violations, rec.clipped, rec.fixed_share) == (2, 2, 0.0)


def test_corrections_attempt_by_attempt(spark):
    df = raw(spark, [5.0, 50.0, 500.0])
    schema = "condition string, stay_id long, variable string, attempt int, values array<double>"
    make = lambda *tries: spark.createDataFrame([("single_model_llm", 1, "a", i, v) for i, v in tries], schema)
    values = lambda d: [r.y_raw for r in d.orderBy("hour").collect()]
    first = critic.apply_corrections(df, make((1, [11.0, 51.0, 99.0])), VS, 1, "y_raw")
    assert values(first) == [11.0, 51.0, 99.0] and critic.record(first).first().fixed_share == 1.0
    short = critic.apply_corrections(df, make((1, [11.0])), VS, 1, "y_raw")
    assert values(short) == [10.0, 50.0, 100.0] and short.first().failed_corrections == 1
    two = make((1, [9.0, 50.0, 99.0]), (2, [12.0, 50.0, 98.0]))
    assert values(critic.apply_corrections(df, two, VS, 1, "y_raw")) == [10.0, 50.0, 99.0]
    assert values(critic.apply_corrections(df, two, VS, 2, "y_raw")) == [12.0, 50.0, 98.0]
    untouched = critic.apply_corrections(raw(spark, [20.0, 30.0, 40.0]), two, VS, 2, "y_raw")
    assert values(untouched) == [20.0, 30.0, 40.0]


# --- answers ---------------------------------------------------------------------------

def answer(spark, text, status="ok", done="stop", tokens=10):
    df = spark.createDataFrame([("c", 1, text, status, done, tokens, tokens)],
                               "condition string, stay_id long, text string, status string, done_reason string, prompt_tokens int, answer_tokens int")
    summary = spark.createDataFrame([(1, "a", 70.0, 70.0, 2.0, 0.0, 4, 70.0), (1, "b", 55.0, 55.0, 2.0, 0.0, 4, 55.0)],
                                    "stay_id long, variable string, last double, mean double, std double, slope double, n_obs long, recent_mean double")
    return {r.variable: r for r in responses.resolve(df, summary, VS, W, context_tokens=1000).collect()}


def body(a=(1, 2, 3), b=(4, 5, 6), wa=1.0, wb=2.0, **extra):
    f = {k: list(v) for k, v in (("a", a), ("b", b)) if v is not None}
    w = {k: v for k, v in (("a", wa), ("b", wb)) if v is not None}
    return json.dumps({"forecast": f, "interval_halfwidth": w, **extra})


def test_good_answer_with_prose(spark):
    got = answer(spark, "Sure! " + body(wa=-1.5) + " done")
    assert got["a"].y == [1.0, 2.0, 3.0] and got["a"].widths == [1.5] * 3 and got["a"].source == "model"


def test_width_shapes(spark):
    got = answer(spark, body(wa=[1, 0, 3], wb={"start": 1, "end": 3}))
    assert got["a"].widths == [1.0, 1.0, 3.0] and got["a"].zero_fixed
    assert got["b"].widths == [1.0, 2.0, 3.0]
    zero = answer(spark, body(wa=0))
    assert zero["a"].widths == [3.0] * 3 and zero["a"].zero_fixed  # the naive width


@pytest.mark.parametrize("text,kind", [
    ("no json", "malformed_forecast"), ("{broken", "malformed_forecast"), (body(a=(1, 2)), "malformed_forecast"),
    (body(wa="wide"), "malformed_forecast"), (body(wa=[1, 2]), "malformed_forecast"), (body(wb=None), "malformed_forecast"),
    (json.dumps({"forecast": {"a": [1, 2, 3]}}), "malformed_forecast"), (body(a=None, b=None), "malformed_forecast"),
    (body(a=(1, 2, 1e9), b=(1, 2, -1e9)), "malformed_forecast"), (body(wa=True), "malformed_forecast")])
def test_unusable_answers_fall_back(spark, text, kind):
    got = answer(spark, text)
    assert {r.error_kind for r in got.values()} == {kind} and {r.source for r in got.values()} == {"fallback"}
    assert got["b"].y == [55.0] * 3


GOOD = '{"forecast": {"a": [1, 2, 3], "b": [4, 5, 6]}, "interval_halfwidth": {"a": %s, "b": 2}}'


def test_what_counts_as_json(spark):
    rows = {
        "trailing": body() + " and {more}", "single": body().replace('"', "'"), "suffix": GOOD % '"1d"', "quoted": GOOD % '"1"',
        "listed": GOOD % '[1, "2", 3]', "boolean": GOOD % "true", "null": GOOD % "null", "nan": GOOD % "NaN",
        "half": body()[: len(body()) // 2], "prose": "it will be fine", "words": body().replace("[1, 2, 3]", '["1", "two", 3]'),
        "strings": body().replace("[1, 2, 3]", '["1", 2.5, "3e0"]'), "double": GOOD % 1 + "",
        "doubled": '{"forecast": {"a": [9, 9, 9], "b": [4, 5, 6], "a": [1, 2, 3]}, "interval_halfwidth": {"a": 7, "b": 2, "a": 1}}'}
    df = spark.createDataFrame(list(rows.items()), "condition string, text string")
    got = {(r.condition, r.variable): r for r in responses.validate(df, VS, W).collect()}
    bad = {k for k in rows if got[k, "a"].malformed}
    assert bad == {"trailing", "single", "suffix", "quoted", "boolean", "null", "half", "prose", "words"}
    assert got["listed", "a"].widths == [1.0, 2.0, 3.0] and got["strings", "a"]["values"] == [1.0, 2.5, 3.0]
    assert got["doubled", "a"]["values"] == [1.0, 2.0, 3.0] and got["doubled", "a"].widths == [1.0] * 3
    assert all(x != x for x in got["nan", "a"].widths) and got["nan", "a"].usable
    parses = {r.condition: r.parses for r in responses.audit(df, VS, W).collect()}
    assert {k for k, v in parses.items() if not v} == {"trailing", "single", "half", "prose"}


def test_members_have_to_forecast_the_same_stays(spark):
    rows = [("x", 1, "a", 0, 1.0, 2.0, 1.0, 3.0), ("y", 1, "a", 0, 1.0, 4.0, 3.0, 5.0), ("x", 2, "a", 0, 1.0, 2.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "condition string, stay_id long, variable string, hour int, y_true double, y_pred double, y_lower double, y_upper double")
    from foretrace.operators import forecast

    assert forecast.ensemble(df, ["x", "y"]).count() == 2
    with pytest.raises(ValueError):
        forecast.ensemble(df, ["x", "y"], same_stays=True)


def test_failures_before_parsing(spark):
    assert answer(spark, "", status="timeout")["a"].error_kind == "llm_timeout"
    assert answer(spark, "", status="server_error")["a"].error_kind == "llm_server_error"
    assert answer(spark, body(), done="length")["a"].error_kind == "truncated_forecast"
    assert answer(spark, body(), tokens=600)["a"].error_kind == "context_overflow"


def test_missing_and_absurd_variables_are_filled(spark):
    got = answer(spark, body(b=None, wb=None))
    assert got["b"].source == "filled" and got["b"].y == [55.0] * 3 and got["a"].source == "model"
    wild = answer(spark, body(b=(1, 1e9, 1)))
    assert wild["b"].source == "filled" and wild["b"].absurd
    nan = answer(spark, body(b=(1, float("nan"), 1)))
    assert nan["b"].source == "filled"
    hard = answer(spark, body(b=(1, 70, -3)))
    assert hard["b"].y == [1.0, 60.0, 0.0]


def test_number_printing_is_half_even_on_the_binary_value(spark):
    xs = [0.25, 0.35, 2.5, 1234.56, -0.04, 1e-9]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(prompts.one_decimal("x"), prompts.signed_two("x")).collect()
    assert [tuple(r) for r in got] == [(f"{x:.1f}", f"{x:+.2f}") for x in xs]


def test_prompt_options_are_checked():
    for bad in ({"trend_hint": "x"}, {"interval": "x"}, {"similarity_context": "x"}):
        with pytest.raises(ValueError):
            PromptOptions(**bad)


def test_condition_names():
    assert split_condition("full_pipeline@m") == ("full_pipeline", "m") and split_condition("naive") == ("naive", None)
    validate_conditions(["naive", "full_pipeline@m"], [["naive", "full_pipeline@m"]], ["m"])
    for bad in ((["x"],), (["full_pipeline@z"], (), ["m"]), (["naive"], [["naive"]])):
        with pytest.raises(ValueError):
            validate_conditions(*bad)


# --- stores ---------------------------------------------------------------------------------

def test_tolerant_scan_prefers_gzip(spark, tmp_path):
    import gzip

    from foretrace import schemas

    text = "itemid,label,category,extra\n1,Heart Rate,Vital,9\nbad,Oops,Vital,9\n2,\"SpO2, left\",Vital,9\n"
    with gzip.open(tmp_path / "d_items.csv.gz", "wt") as f:
        f.write(text)
    (tmp_path / "d_items.csv").write_text("itemid,label,category,extra\n7,x,y,z\n")
    from pyspark.sql import types as T

    schema = T.StructType([schemas.CHART_ITEMS["itemid"], schemas.CHART_ITEMS["label"]])
    got = {(r.itemid, r.label) for r in tables.read_table(spark, str(tmp_path), "d_items", schema).collect()}
    assert got == {(1, "Heart Rate"), (2, "SpO2, left")}
    with pytest.raises(FileNotFoundError):
        tables.find_table(spark, str(tmp_path), "nothing")


def test_store_is_pruned_by_partition(spark, tmp_path):
    path = str(tmp_path / "f")
    df = raw(spark, [1.0, 2.0]).withColumn("y_pred", F.col("y_raw"))
    forecast_store.write(df, path, "r1")
    forecast_store.write(df, path, "r2")
    back = forecast_store.read(spark, path, "r1", ["single_model_llm", "missing"])
    assert back.count() == 2
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan


def test_resume_by_fingerprint(spark):
    stays = spark.createDataFrame([(1,), (2,), (3,)], "stay_id long")
    done = spark.createDataFrame([("c", 1), ("c", 2), ("d", 3)], "condition string, stay_id long").withColumn(
        "fingerprint", forecast_store.fingerprint({"k": 1}))
    assert {r.stay_id for r in forecast_store.pending(stays, done, "c", {"k": 1}).collect()} == {3}
    forecast_store.check_fingerprint(done, "c", {"k": 1})
    with pytest.raises(ValueError):
        forecast_store.check_fingerprint(done, "c", {"k": 2})


def test_window_is_part_of_the_event_path(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "stay_id long, valuenum double")
    sinks.write_events(df, str(tmp_path), "chart", 48, "stay_id")
    assert sinks.read_events(spark, str(tmp_path), "chart", 48).count() == 1
    with pytest.raises(Exception):
        sinks.read_events(spark, str(tmp_path), "chart", 24).count()


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
