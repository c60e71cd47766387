"""Panel: restartable training, scores side by side, records of several stays and windows, method switch, record blocks."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from wardline.operators import events as ev
from wardline.operators import matrix as mx
from wardline.operators import models as md
from wardline.operators import profiles
from wardline.operators import tree_paths as tp
from wardline.operators.concepts import Task, task_dim
from wardline.plans import panel as pl
from wardline.session import finished, scratch_path
from wardline.sources import sinks

T0 = datetime(2024, 3, 1)
TASKS = (
    Task("bad", "binary", "forward", "Bad outcome", "bad", "soon", None, ()),
    Task("quick", "binary", "forward", "Quick outcome", "quick", "soon", 24, ()),
    Task("days", "regression", "forward", "Days", "", "stay", 24, ()),
    Task("dx", "binary", "chronic", "Condition", "yes", "now", None, ("DX/D",)),
)
PARAMS = {"maxIter": 3, "maxDepth": 3}


@pytest.fixture(scope="module")
def tables(spark):
    """Two stays each for 90 patients; label times differ between the windows."""
    events, labels = [], []
    for p in range(90):
        for stay in range(2):
            start = T0 + timedelta(days=40 * stay + p % 5)
            ends = {"discharge": start + timedelta(days=3), "24h": start + timedelta(days=1)}
            for tag, end in ends.items():
                events.append((f"p{p}", end, "LAB/X", float((p * 7 + stay * 3) % 11), None, tag))
                if p % 3 == 0:
                    events.append((f"p{p}", end, "DX/D", None, "history", tag))
            values = {"bad": p % 2, "quick": (p * 7 + stay * 3) % 11 > 5, "days": (p * 7 + stay * 3) % 11 / 2, "dx": p % 3 == 0}
            for t in TASKS:
                labels.append((t.name, f"p{p}", ends[t.tag], float(values[t.name]), 30.0 + p, "female" if p % 2 else "male"))
    return (
        spark.createDataFrame(events, "patient_id string, time timestamp_ntz, code string, value double, description string, obs_window string"),
        spark.createDataFrame(labels, "task string, patient_id string, label_time timestamp_ntz, value double, age double, sex string"),
    )


@pytest.fixture(scope="module")
def matrices(tables):
    return pl.window_matrices(*tables, tasks=TASKS, lookback_days=30)


def train(matrices, tables, run, **options):
    return pl.train_panel(*matrices, tables[1], tasks=TASKS, params=PARAMS, run=run, **options)


@pytest.fixture(scope="module")
def trained(spark, matrices, tables):
    run = scratch_path(spark, "run")
    return run, train(matrices, tables, run)


def rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.collect())


def test_a_killed_run_goes_on_and_gives_the_same_panel(spark, matrices, tables, trained, monkeypatch):
    _, (models, table, manifest) = trained
    run, fit, fitted = scratch_path(spark, "run"), pl.fit_vectors, []

    def dying(*args, **options):
        if len(fitted) == 2:
            raise RuntimeError("killed")
        fitted.append(args[2])
        return fit(*args, **options)

    monkeypatch.setattr(pl, "fit_vectors", dying)
    with pytest.raises(RuntimeError, match="killed"):
        train(matrices, tables, run, parallel=1)
    done = [t.name for t in TASKS if finished(spark, f"{run}/tasks/{t.name}/metrics")]
    assert len(done) == 2
    again = []
    monkeypatch.setattr(pl, "fit_vectors", lambda *a, **o: again.append(a[2]) or fit(*a, **o))
    models2, table2, manifest2 = train(matrices, tables, run, parallel=2)
    assert len(again) == 2  # only what was missing
    assert rows(table) == rows(table2) and rows(manifest) == rows(manifest2)
    a, b = (rows(pl.score_panel(m, matrices[0], tasks=TASKS)) for m in (models, models2))
    assert a == b
    with pytest.raises(ValueError, match="other settings"):
        train(matrices, tables, run, calibration=None)


def test_tasks_see_only_the_slots_they_may(trained, matrices):
    _, (models, _, manifest) = trained
    kept = {r["task"]: json.loads(r["columns_json"]) for r in manifest.collect()}
    assert "count__DX/D" in kept["bad"] and "count__DX/D" not in kept["dx"]
    assert kept["dx"] == models["dx"].features and models["dx"].booster.numFeatures == len(md.vector_names(kept["dx"]))


@pytest.mark.parametrize("method", ["auto", "tree", "approx"])
def test_scores_side_by_side_are_those_of_each_model(trained, matrices, method):
    _, (models, _, _) = trained
    got = {(r["task"], r["patient_id"], r["label_time"]): r for r in pl.score_panel(models, matrices[0], tasks=TASKS, method=method).collect()}
    for t in TASKS:
        own = models[t.name].score(matrices[0][t.window], ["patient_id", "label_time"]).collect()
        assert len(own) == 180
        for r in own:
            other = got[(t.name, r["patient_id"], r["label_time"])]
            for c in ("probability", "raw_probability", "point_estimate", "uncertainty"):
                assert other[c] == pytest.approx(r[c]) if r[c] is not None else other[c] is None
            assert {v["method"] for v in [*other["contributors"], *other["protective_factors"]]} <= {"approx" if method == "approx" else "tree"}


def test_two_stays_of_a_patient_are_two_panels(spark, tables, trained, matrices):
    _, (models, table, _) = trained
    got = pl.panel_profiles(models, matrices[0], table, events=tables[0], labels=tables[1], tasks=TASKS, lookback_days=30).collect()
    assert len(got) == 180 and {(r["patient_id"], r["stay"]) for r in got} == {(f"p{p}", s) for p in range(90) for s in (1, 2)}
    for r in got:
        assert sorted(t["name"] for t in r["forward"]) == ["bad", "days", "quick"] and [t["name"] for t in r["chronic"]] == ["dx"]
        p = int(r["patient_id"][1:])
        assert r["demographics"].asDict() == {"age": 30.0 + p, "sex": "female" if p % 2 else "male"}
        assert r["snapshot"]["recent_observations"] == {"LAB/X": float((p * 7 + (r["stay"] - 1) * 3) % 11)}
        assert r["attribution_method"] == "tree" and r["notes"] == []


def test_windows_meet_by_stay(matrices):
    both = mx.cross_window_align(matrices[0])
    assert both.count() == 180 and both.where("`value__LAB/X@discharge` <> `value__LAB/X@24h`").count() == 0
    inputs = {(r["patient_id"], r["stay"]): r["features"] for r in pl.record_inputs(*matrices).collect()}
    assert len(inputs) == 180 and set(inputs[("p3", 2)]) == {"discharge", "24h"}
    assert inputs[("p3", 2)]["24h"]["value__LAB/X"] == 2.0 and inputs[("p3", 2)]["24h"]["count__DX/D"] == 1.0


def test_method_switch(spark, trained):
    _, (models, _, _) = trained
    assert pl.attribution_method(models) == "tree" and pl.attribution_method(models, "approx") == "approx"
    data = spark.range(20).selectExpr("double(id) as x", "double(id % 2) as label")
    md.register_model("plain", lambda kind, params: LogisticRegression(featuresCol="features", labelCol="label", **params))
    linear = {**models, "bad": md.fit_model(data, None, ["x"], "binary", name="plain")}
    assert pl.attribution_method(linear) == "approx"
    with pytest.warns(UserWarning, match="forests"):
        assert pl.attribution_method(linear, "tree") == "approx"
    with pytest.raises(ValueError, match="not 'shap'"):
        pl.attribution_method(models, "shap")


def test_response_records_hold_the_prediction_block_and_texts_come_back_whole(spark, tables, trained, matrices):
    _, (models, table, _) = trained
    nested = pl.panel_profiles(models, matrices[0], table, events=tables[0], labels=tables[1], tasks=TASKS, lookback_days=30).where("stay = 1")
    said = profiles.prediction_block(nested).select("patient_id", "predictions", "snapshot", *[F.lit(f"line\n\ntext {i}").alias(f"s{i}") for i in range(1, 6)])
    records = profiles.response_records(said, predictions="predictions", inputs="snapshot", generated_at=F.lit("now"))
    one = json.loads(records.where("patient_id = 'p3'").first()["predictions"])
    entry = next(t for t in one["forward"] if t["task"] == "bad")
    assert entry["group"] == "forward" and 0 <= entry["probability"] <= 1 and len(entry["top_contributors"]) <= 5
    assert set(entry["top_contributors"][0]) == {"concept", "phrase", "direction", "magnitude", "observed_value", "feature"}
    days = next(t for t in one["forward"] if t["task"] == "days")
    assert "probability" not in days and days["point_estimate"] >= 0
    path = scratch_path(spark, "records")
    for fmt, name in (("md", "markdown"), ("txt", "text")):
        out = sinks.write_records(records, path, fmt, dataset="d", provider="p", variant="v")
        sinks.write_records(records, path, fmt, dataset="d", provider="p", variant="v")  # replaces
        back = sinks.read_texts(spark, out)
        want = (profiles.render_markdown if fmt == "md" else profiles.render_text)(records)
        assert sorted(r["value"] for r in back.collect()) == sorted(r[name] for r in want.collect())
        assert {(r["dataset"], r["provider"]) for r in back.select("dataset", "provider").distinct().collect()} == {("d", "p-v")}
    plain = profiles.response_records(said, generated_at=F.lit("now")).first()
    assert json.loads(plain["predictions"]) == {"note": profiles.BASELINE_NOTE}


def test_single_task_profile_has_its_task_and_payload(spark, tables):
    record = "patient_id string, label_time timestamp_ntz"
    scores = spark.createDataFrame([("p1", T0, 0.4, 0.5, 0.2)], f"{record}, probability double, raw_probability double, uncertainty double")
    views = spark.createDataFrame([], f"{record}, contributors {profiles.VIEW}, protective_factors {profiles.VIEW}")
    shots = ev.snapshot(tables[0].drop("obs_window"), scores.select("patient_id", "label_time", F.lit(0.0).alias("value")), lookback_days=3)
    made = profiles.risk_profile(scores, views, shots, task=TASKS[0])
    row = made.first()
    assert row["task"].asDict() == {"name": "bad", "description": "Bad outcome", "positive_label": "bad", "horizon": "soon"}
    payload = json.loads(profiles.single_payload(made).first()["payload_json"])
    assert payload["probability_pct"] == 40 and payload["task"]["name"] == "bad" and payload["notes"] == [profiles.APPROX_NOTE]
    block = profiles.single_prediction_block(made).first()["predictions"]
    assert (block["logit"], block["risk_tier"], block["task"]["horizon"]) == (0.0, row["risk_tier"], "soon")


def test_panel_of_records_without_stays_is_one_per_patient(spark):
    scores = spark.createDataFrame(
        [("a", "bad", 0.2), ("a", "dx", 0.3)], "patient_id string, task string, probability double"
    ).withColumns({c: F.col("probability") for c in ("raw_probability", "point_estimate", "uncertainty")}).withColumns(
        {c: F.array().cast(profiles.VIEW) for c in ("contributors", "protective_factors")}
    )
    metrics = spark.createDataFrame([], "task string, auroc double, r2 double")
    got = profiles.panel(scores, task_dim(spark, TASKS), metrics).collect()
    assert len(got) == 1 and [t["reliability"] for t in got[0]["forward"]] == ["unknown"]
    with_stay = scores.withColumn("stay", F.when(F.col("task") == "bad", 1).otherwise(2))
    assert profiles.panel(with_stay, task_dim(spark, TASKS), metrics).count() == 2


def test_strongest_impacts_come_from_the_batch_and_a_row_is_scored_once(spark, trained, matrices, monkeypatch):
    _, (models, _, _) = trained
    own = {n: models[n] for n in ("bad", "dx")}
    whole, picked = (tp.with_tree_impacts(own, matrices[0][None], **options) for options in ({}, {"top_k": 2}))
    key = lambda r: (r["patient_id"], r["label_time"])
    some = {key(r): r for r in picked.collect()}
    for r in whole.collect():
        for n, m in own.items():
            impacts = r[n]["impacts"]
            want = sorted(range(len(impacts)), key=lambda i: (-abs(impacts[i]), i))[:2]
            assert [(c["pos"], c["value"] or 0.0, c["impact"]) for c in some[key(r)][n]] == [(i, r[m.features[i]] or 0.0, impacts[i]) for i in want]
    plans = []
    keep = md.materialize
    monkeypatch.setattr(md, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    assert pl.score_panel(models, matrices[0], tasks=TASKS).count() == 180 * len(TASKS)
    assert len(plans) == 2 and not any("Filter" in p for p in plans)


def test_the_registered_panel_is_trained_with_the_librarys_own_parameters(spark, monkeypatch):
    from types import SimpleNamespace

    from wardline.catalog import models

    asked = []
    monkeypatch.setattr(models, "stored", lambda v: {"events": None, "labels": None})
    monkeypatch.setattr(models, "window_matrices", lambda *a: ({}, {}))
    monkeypatch.setattr(models, "train_panel", lambda *a, params, run: asked.append(params) or ({}, None, None))
    models.trained(SimpleNamespace(spark=spark, sf_dir="x"))
    used = md.get_estimator("gbt", "binary", asked[0])
    assert len(asked) == 1 and (used.getMaxIter(), used.getMaxDepth()) == (300, 5)
