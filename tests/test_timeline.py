"""Edge rows of the events + labels contract, sources and sinks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.operators import events as ev
from wardline.operators import matrix as mx
from wardline.operators.concepts import builtin_concepts, concept_dim, get_task, override_concepts, resolve_concepts
from wardline.operators.split import assign_split
from wardline.session import inline_table, scratch_path
from wardline.sources import sinks
from wardline.sources.star import read_star, resolve_root
from wardline.sources.tables import EVENT_REQUIRED, read_table

T0 = datetime(2024, 1, 20)
EV = "patient_id string, time timestamp_ntz, code string, value double, description string"
LB = "patient_id string, label_time timestamp_ntz, value double, age double, sex string"


def day(n, **kw):
    return T0 + timedelta(days=n, **kw)


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(
        [
            ("a", day(-10), "LAB/HbA1c", 7.0, None), ("a", day(0), "LAB/HbA1c", 8.0, None),
            ("a", day(0), "LAB/HbA1c", None, None), ("a", day(-5), "ICD10/I10", float("nan"), "Hypertension"),
            ("a", day(-11), "LAB/HbA1c", 1.0, None), ("a", day(0, seconds=1), "LAB/HbA1c", 99.0, None),
            ("a", day(-3), "LAB/HbA1c", 8.0, None), ("b", day(-1), "ENC/ED", None, ""), ("b", day(-1), "ICD10/I10", None, None),
            ("z", day(-1), "LAB/eGFR", 5.0, None),
        ],
        EV,
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [("a", T0, 1.0, 60.0, "female"), ("a", day(-4), 0.0, 60.0, "female"), ("b", T0, 0.0, None, None), ("c", T0, float("nan"), 30.0, "male")],
        LB,
    )


def test_loader_keeps_patients_without_events_and_drops_events_without_label(events, labels):
    got = ev.labelled_events(events, labels)
    assert got.filter("patient_id = 'c'").count() == 1
    assert got.filter("patient_id = 'z'").count() == 0
    assert got.filter("patient_id = 'a'").count() == 14
    assert got.filter("patient_id = 'c'").first()["label"] is None


def test_window_ends_count_and_two_label_rows_give_two_matrix_rows(events, labels):
    vocab = mx.fit_vocab(events, labels, lookback_days=10, numeric="auto")
    assert vocab.codes == ("ICD10/I10", "LAB/HbA1c", "ENC/ED") and vocab.numeric == ("LAB/HbA1c",)
    wide = {(r["patient_id"], r["label_time"]): r for r in mx.matrix(events, labels, vocab, lookback_days=10).collect()}
    assert len(wide) == 4
    now = wide[("a", T0)]
    assert now["count__LAB/HbA1c"] == 4.0 and now["value__LAB/HbA1c"] == 8.0 and now["n_events"] == 5.0
    earlier = wide[("a", day(-4))]
    assert earlier["count__LAB/HbA1c"] == 2.0 and earlier["value__LAB/HbA1c"] == 7.0
    empty = wide[("c", T0)]
    assert (empty["n_events"], empty["count__ENC/ED"], empty["value__LAB/HbA1c"], empty["sex_female"]) == (0.0, 0.0, None, 0.0)


def test_codes_outside_the_vocabulary_count_in_n_events_only(events, labels):
    vocab = mx.fit_vocab(events, labels, lookback_days=10, max_features=1)
    assert vocab.codes == ("ICD10/I10",) and vocab.numeric == ()
    row = mx.matrix(events, labels, vocab, lookback_days=10).filter((F.col("patient_id") == "a") & (F.col("label_time") == T0)).first()
    assert row["n_events"] == 5.0 and row["count__ICD10/I10"] == 1.0


def test_whitelist_keeps_its_order(events, labels):
    vocab = mx.fit_vocab(events, labels, lookback_days=10, numeric=("ENC/ED", "LAB/nope", "ICD10/I10"))
    assert vocab.numeric == ("ENC/ED", "ICD10/I10")


def test_snapshot(events, labels):
    got = {(r["patient_id"], r["label_time"]): r for r in ev.snapshot(events, labels, lookback_days=10).collect()}
    a = got[("a", T0)]
    assert a["active_conditions"] == ["Hypertension"] and a["recent_observations"] == {"LAB/HbA1c": 8.0}
    b = got[("b", T0)]
    assert b["active_conditions"] == ["ICD10/I10"] and b["n_recent_encounters"] == 1
    assert got[("c", T0)]["recent_observations"] == {} and got[("c", T0)]["n_recent_encounters"] == 0


def test_matrix_row_without_a_label_is_an_error(spark, events, labels):
    vocab = mx.fit_vocab(events, labels, lookback_days=10)
    wide = mx.matrix(events, labels, vocab, lookback_days=10)
    some = labels.filter("patient_id = 'b'")
    with pytest.raises(Exception, match="no label or split"):
        mx.align(wide, some, assign_split(labels)).select("split").collect()


def test_leakage_columns():
    names = ["count__DX/DIABETES", "value__LAB/HBA1C", "count__LAB/GLUCOSE", "value__LAB/SODIUM", "age"]
    assert mx.allowed_features(names, get_task("dx_diabetes").exclude_prefixes) == ["value__LAB/SODIUM", "age"]
    assert mx.allowed_features(names, get_task("los_days").exclude_prefixes) == names


def test_concepts(spark):
    names = ["count__ICD10/I10", "age", "value__XX/1", "value__LAB/eGFR", "VITAL/SPO2_std", "count__DX/DIABETES"]
    features = inline_table(spark, [(n,) for n in names], "feature string")
    got = {r["feature"]: r for r in resolve_concepts(features, concept_dim(spark)).collect()}
    assert got["count__ICD10/I10"]["phrase"] == "high blood pressure on record"
    assert got["age"]["concept"] == "Age"
    assert got["value__XX/1"]["phrase"] == "a clinical factor recorded as 'XX/1'"
    assert got["value__LAB/eGFR"]["higher_is_concerning"] is False
    assert got["VITAL/SPO2_std"]["phrase"] == "the variability in your oxygen saturation (spo2)"
    over = inline_table(spark, [("age", "Years", None, None)], "code string, name string, phrase string, higher_is_concerning boolean")
    dim = {r["code"]: r for r in override_concepts(builtin_concepts(spark), over).collect()}
    assert dim["age"]["phrase"] == "Years" and dim["age"]["higher_is_concerning"] is True and len(dim) == 16


def test_read_table(spark, events, labels):
    path = scratch_path(spark, "t")
    sinks.export_csv(events, labels, path)
    back = read_table(spark, f"{path}/events.csv", required=EVENT_REQUIRED)
    assert ev.standard_events(back).count() == 10
    assert {r["time"] for r in ev.standard_events(back).collect()} == {r["time"] for r in events.collect()}
    with pytest.raises(ValueError, match=r"missing required columns \['code', 'time'\]"):
        read_table(spark, f"{path}/labels.csv", required=EVENT_REQUIRED)
    with pytest.raises(FileNotFoundError):
        read_table(spark, f"{path}/none.parquet")


def test_mixed_text_values_keep_their_numbers(spark):
    mixed = spark.createDataFrame([("a", T0, "X", "1.5"), ("a", T0, "X", "positive")], "patient_id string, time timestamp_ntz, code string, value string")
    assert sorted(r["value"] or 0 for r in ev.standard_events(mixed).collect()) == [0, 1.5]


def test_missing_star(spark):
    with pytest.raises(FileNotFoundError):
        resolve_root(spark, scratch_path(spark, "nothing"))
    root = scratch_path(spark, "star")
    for sub in ("hosp/patients", "icu/icustays"):
        spark.range(1).write.csv(f"{root}/{sub}.csv.gz")
    with pytest.raises((FileNotFoundError, ValueError)):
        read_star(spark, root)


def test_raw_payload_keeps_the_later_of_two_columns_with_one_name(spark):
    wide = spark.createDataFrame([("a", T0, 1.0, 2.0, 3.0, 1.0, 40.0)], "patient_id string, label_time timestamp_ntz, v1 double, v2 double, v3 double, d double, age double")
    names = {"v1": "value__LAB/X", "v2": "value__LAB/Y", "v3": "value__LAB/Z", "d": "count__DX/Q"}
    for old, new in names.items():
        wide = wide.withColumnRenamed(old, new)
    concepts = inline_table(spark, [("LAB/X", "Same"), ("LAB/Y", "Same")], "code string, name string")
    got = mx.raw_payload(wide, [*names.values(), "age"], concepts).first()
    assert got["lab_results"] == {"Same": 2.0, "LAB/Z": 3.0} and got["past_conditions"] == ["DX/Q"] and got["age"] == 40.0


def test_training_table_needs_every_label(spark):
    tasks = [get_task("mortality_1y"), get_task("readmission_30d")]
    wide = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "patient_id string, age double")
    rows = [("mortality_1y", "a", 1.0), ("readmission_30d", "a", 0.0), ("mortality_1y", "b", 0.0)]
    labels = spark.createDataFrame(rows, "task string, patient_id string, value double")
    splits = spark.createDataFrame([("a", "train"), ("b", "test")], "patient_id string, split string")
    ok = mx.align_tasks(wide.filter("patient_id = 'a'"), labels, splits, tasks).first()
    assert (ok["label__mortality_1y"], ok["label__readmission_30d"], ok["split"]) == (1.0, 0.0, "train")
    with pytest.raises(Exception, match="no label or split for patient b"):
        mx.align_tasks(wide, labels, splits, tasks).select("split").collect()
