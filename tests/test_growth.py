"""Work that must not grow beyond the input: what is shuffled, sent through the driver, or worked out again per element."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wardline.catalog.registry import Views
from wardline.catalog.scoring import panels
from wardline.operators import explain
from wardline.operators import measurements as ms
from wardline.operators import profiles
from wardline.plans import panel as pl
from wardline.plans.build import store

T0 = datetime(2024, 3, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


class Columns:
    feature_names = ["age"]


def test_record_inputs_joins_nothing(spark):
    rows = [(f"p{p}", T0 + timedelta(days=s), float(p)) for p in range(5) for s in range(2)]
    wide = {h: spark.createDataFrame(rows, "patient_id string, label_time timestamp_ntz, age double") for h in (None, 24)}
    got = pl.record_inputs(wide, dict.fromkeys(wide, Columns))
    assert "Join" not in plan_of(got)
    found = {(r["patient_id"], r["stay"]): r["features"] for r in got.collect()}
    assert len(found) == 10 and found[("p3", 2)] == {"discharge": {"age": 3.0}, "24h": {"age": 3.0}}


def test_the_pick_stands_once_in_the_views(spark):
    cells = spark.sql("SELECT array(struct(0 AS pos, 'a' AS feature, 1.0D AS value, 0.5D AS impact), struct(1 AS pos, 'b' AS feature, 2.0D AS value, -1D AS impact)) AS c")
    up, down = explain.views_in_row(explain.top_k_array(F.col("c"), 5), {"a": ("A", "your a"), "b": ("B", "your b")})
    one = cells.select(up.alias("up"))
    assert one._jdf.queryExecution().analyzed().toString().count("array_sort(") == 1
    row = cells.select(up.alias("up"), down.alias("down")).first()
    assert [(x["rank"], x["phrase"], x["magnitude"]) for x in row["up"]] == [(2, "your a", 0.5)]
    assert [(x["rank"], x["phrase"], x["magnitude"]) for x in row["down"]] == [(1, "your b", 1.0)]


def test_panels_are_shuffled_before_their_views_are_made(spark, sf_dir):
    plan = plan_of(panels(Views(spark, sf_dir)))
    assert plan.index("array_sort(") < plan.index("RepartitionByExpression [patient_id")  # the plan's top comes first


def test_a_payload_keeps_the_method_beside_it(spark, sf_dir):
    text = profiles.health_payload(panels(Views(spark, sf_dir)), keep=("attribution_method",))
    assert {r[0] for r in text.select("attribution_method").distinct().collect()} == {"approx"}


def test_labels_are_stored_without_events(spark, tmp_path):
    labels = spark.createDataFrame([("t", "p", 1.0)], "task string, patient_id string, value double")
    assert [r["value"] for r in store({"labels": labels}, str(tmp_path))["labels"].collect()] == [1.0]
    assert not (tmp_path / "events").exists()


def test_facts_without_hot_stays_are_joined_as_they_lie(spark):
    chart = spark.createDataFrame([(h, 1, float(h), T0) for h in range(50)], "hadm_id bigint, itemid bigint, valuenum double, charttime timestamp_ntz")
    cohort = spark.createDataFrame([(h, T0, T0 + timedelta(days=2)) for h in range(10)], "hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz")
    got = ms.lab_latest(chart, cohort, items=((1, "X"),), windows=(None, 24))
    assert "_salt" not in plan_of(got)
    assert {(r["hadm_id"], r["obs_window"]): r["last"] for r in got.collect()} == {(h, w): float(h) for h in range(10) for w in ("discharge", "24h")}


def test_a_raw_payload_takes_no_row_apart(spark):
    rows = [("p1", T0, 50.0, 2.5, None, 1.0), ("p2", T0, None, None, None, 0.0)]
    wide = spark.createDataFrame(rows, "patient_id string, label_time timestamp_ntz, age double, `value__VITAL/B` double, `value__VITAL/A` double, `count__DX/D` double")
    concepts = spark.createDataFrame([("VITAL/B", "Bee"), ("DX/D", "Dee")], "code string, name string")
    got = pl.mx.raw_payload(wide, [c for c in wide.columns if c not in ("patient_id", "label_time")], concepts)
    assert "Generate" not in plan_of(got)
    found = {r["patient_id"]: (r["age"], r["vital_signs"], r["lab_results"], r["past_conditions"], r["prior_admissions"]) for r in got.collect()}
    assert found == {"p1": (50.0, {"Bee": 2.5}, {}, ["Dee"], None), "p2": (None, {}, {}, [], None)}
