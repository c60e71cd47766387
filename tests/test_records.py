"""Records with several labels, codes that differ in case, loose JSON, unknown times, and models of any kind."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from wardline.operators import guardrails as gr
from wardline.operators import matrix as mx
from wardline.operators import models
from wardline.operators.cohort import first_admission
from wardline.operators.metrics import binary_metrics
from wardline.operators.skew import hot_keys
from wardline.session import clean_up, materialize, run_dir, scratch_path
from wardline.sources.star import resolve_root

EVENTS = "patient_id string, time timestamp_ntz, code string, value double, description string"
LABELS = "patient_id string, label_time timestamp_ntz, value double, age double, sex string"


def day(n):
    from datetime import datetime

    return datetime(2024, 1, n)


def small(spark):
    events = [
        ("a", day(2), "LAB/HbA1c", 6.0, None), ("a", day(2), "LAB/HBA1C", 7.0, None), ("a", day(9), "LAB/HbA1c", 8.0, None),
        ("b", day(3), "ENC/ED", None, None),
    ]
    labels = [("a", day(5), 0.0, 50.0, "female"), ("a", day(10), 1.0, 50.0, "female"), ("b", day(10), 1.0, 60.0, "male")]
    return spark.createDataFrame(events, EVENTS), spark.createDataFrame(labels, LABELS)


def test_codes_that_differ_in_case_are_columns_of_their_own(spark):
    events, labels = small(spark)
    vocab = mx.fit_vocab(events, labels, numeric="auto")
    wide = mx.matrix(events, labels, vocab)
    assert len({n.lower() for n in wide.columns}) == len(wide.columns)
    row = wide.where("patient_id = 'a' and label_time = timestamp_ntz'2024-01-05'").first().asDict()
    named = vocab.labels
    assert row[f"value__{named['LAB/HbA1c']}"] == 6.0 and row[f"value__{named['LAB/HBA1C']}"] == 7.0 and row["n_events"] == 2.0
    materialize(wide, "wide").count()


def test_a_label_belongs_to_its_time(spark):
    events, labels = small(spark)
    wide = mx.matrix(events, labels, mx.fit_vocab(events, labels))
    splits = spark.createDataFrame([("a", "train"), ("b", "test")], "patient_id string, split string")
    rows = mx.align(wide, labels, splits).collect()
    assert sorted((r["patient_id"], r["label_time"].day, r["label"]) for r in rows) == [("a", 5, 0.0), ("a", 10, 1.0), ("b", 10, 1.0)]

    class Task:
        name = "t"

    both = mx.align_tasks(wide, labels.withColumn("task", F.lit("t")), splits, [Task]).collect()
    assert sorted((r["patient_id"], r["label_time"].day, r["label__t"]) for r in both) == [("a", 5, 0.0), ("a", 10, 1.0), ("b", 10, 1.0)]


@pytest.mark.parametrize(
    "text,error,first",
    [
        ('{"What we found":"a"} trailing garbage', True, None), ('{"What we found":"a"}{"x":"b"}', True, None),
        ('{"What we found":"a","What we found":"b"}', False, "b"), ('{"What we found":" a "}', False, "a"),
        ("[]", True, None), ("{}, {}", True, None), ("", True, None), (None, True, None),
    ],
)
def test_only_one_json_object_is_an_answer(spark, text, error, first):
    names = ["What we found", "b", "c", "d", "e"]
    row = gr.parse_sections(spark.createDataFrame([(text,)], "t string"), "t", names).first()
    assert row["parse_error"] is error and (error or row["s1"] == first)


def test_an_admission_without_a_time_comes_last(spark):
    rows = [(1, 10, None), (1, 11, day(3)), (1, 12, day(4)), (2, 20, None)]
    got = first_admission(spark.createDataFrame(rows, "subject_id long, hadm_id long, admittime timestamp_ntz")).collect()
    assert sorted((r["subject_id"], r["hadm_id"]) for r in got) == [(1, 11), (2, 20)]


def test_two_thousand_groups_have_their_metrics(spark):
    df = spark.range(200_000).selectExpr("id % 2000 as g", "double((id * 7919) % 100003) / 100003 as p", "int(id % 3 = 0) as y")
    got = binary_metrics(df, by=["g"])
    assert got.count() == 2000 and got.where("auroc is null").count() == 0


def test_every_hot_key_is_found(spark):
    df = spark.range(30_000).selectExpr("id % 1500 as k")
    assert hot_keys(df, "k", rows_per_salt=10).count() == 1500


def test_a_registered_model_of_any_kind_scores_and_loads(spark, tmp_path):
    models.register_model("plain", lambda kind, params: LogisticRegression(featuresCol="features", labelCol="label", **params))
    rows = spark.range(200).selectExpr("id", "double(id % 10) as x", "double(id % 10 > 4) as label")
    model = models.fit_model(rows, rows, ["x"], "binary", name="plain")
    path = scratch_path(spark, "plain")
    model.save(path)
    again = models.RiskModel.load(spark, path)
    one, two = (
        {r["id"]: r["probability"] for r in m.score(rows, ["id"]).collect()} for m in (model, again)
    )
    assert one == two and one[9] > one[0]
    assert {r["feature"]: r["importance"] for r in again.importance(spark).collect()} == {"x": 1.0}


def test_a_stored_panel_is_the_same_panel(spark):
    from wardline.plans.panel import load_panel, store_panel

    models.register_model("plain", lambda kind, params: LogisticRegression(featuresCol="features", labelCol="label", **params))
    rows = spark.range(100).selectExpr("id", "double(id % 10) as x", "double(id % 10 > 4) as label")
    model = models.fit_model(rows, rows, ["x"], "binary", name="plain")
    vocab = {None: mx.Vocabulary(("A", "a'\\b"), ("A",)), 24: mx.Vocabulary((), ())}
    table = spark.createDataFrame([("t", 0.5)], "task string, auroc double")
    path = scratch_path(spark, "panel")
    for _ in range(2):  # the second replaces the first
        store_panel(path, {"t": model}, vocab, table, table)
    again, words, metrics, manifest = load_panel(spark, path)
    assert words == vocab and metrics.collect() == manifest.collect() == table.collect()
    ids = ["id"]
    assert again["t"].score(rows, ids).orderBy("id").collect() == model.score(rows, ids).orderBy("id").collect()


def test_the_root_is_found_at_any_depth(spark, tmp_path):
    for name in ("hosp", "icu"):
        (tmp_path / "a/b/c/d/mimiciv/3.1" / name).mkdir(parents=True)
    assert resolve_root(spark, str(tmp_path)).endswith("a/b/c/d/mimiciv/3.1")
    with pytest.raises(FileNotFoundError):
        resolve_root(spark, str(tmp_path / "a/b/c/d/mimiciv/3.1/hosp"))


def test_what_is_written_lies_in_the_runs_folder(spark, monkeypatch):
    import wardline.session as session

    assert scratch_path(spark, "x").startswith(run_dir(spark) + "/")

    class Cluster:
        master = "spark://elsewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Session())
    assert callable(clean_up)
