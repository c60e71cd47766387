"""Windows of patients with many label rows, and medians by selection, against brute force."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from wardline.operators import events as ev
from wardline.operators import matrix as mx
from wardline.operators.ranking import exact_median

T0 = datetime(2024, 1, 20)
EV = "patient_id string, time timestamp_ntz, code string, value double, description string"
LB = "patient_id string, label_time timestamp_ntz, value double, age double, sex string"


def history(seed=1):
    rng = random.Random(seed)
    when = lambda: T0 + timedelta(days=rng.randint(-120, 120), hours=rng.choice([0, 0, 6]), microseconds=rng.choice([0, 0, 1]))
    value = lambda: rng.choice([None, float("nan"), 1.0, 2.0, 3.5])
    events = [(p, when(), rng.choice(["A", "B", "ENC/ED", "ICD10/I10"]), value(), rng.choice([None, "", "words"])) for p in "abc" for _ in range(300)]
    events += [("a", None, "A", 1.0, None), (None, T0, "A", 1.0, None)]
    labels = [("a", when(), 0.0, 1.0, "male") for _ in range(60)] + [("b", when(), 0.0, 1.0, "male") for _ in range(3)]
    labels += [("z", T0, 0.0, 1.0, "male"), ("c", T0, 0.0, 1.0, "male"), ("a", None, 0.0, 1.0, "male")]
    labels += [("c", T0 + timedelta(days=d), 0.0, 1.0, "male") for d in range(-20, 20)]
    return events, labels


def by_hand(events, labels, days):
    out = {}
    for p, at, *_ in set(labels):
        own = [e for e in events if e[0] == p and None not in (at, e[1]) and e[1] <= at and (days is None or e[1] >= at - timedelta(days=days))]
        for code in {e[2] for e in own}:
            mine = [e for e in own if e[2] == code]
            real = [(e[1], e[3]) for e in mine if e[3] is not None and e[3] == e[3]]
            out[(p, at, code)] = (len(mine), max(real, default=(None, None)))
    return out


@pytest.mark.parametrize("days", [None, 0, 10, 45])
@pytest.mark.parametrize("few,slice_days", [(10**6, 30), (8, 30), (0, 30), (0, 1), (0, 400)])
def test_windows_are_those_of_all_pairs(spark, days, few, slice_days):
    events, labels = history()
    got = ev.windowed_totals(
        spark.createDataFrame(events, EV), spark.createDataFrame(labels, LB), days, {"code": F.col("code")}, few=few, slice_days=slice_days
    ).collect()
    assert len(got) == len({(r["patient_id"], r["label_time"], r["code"]) for r in got})
    assert {(r["patient_id"], r["label_time"], r["code"]): (r["n"], (r["seen"], r["last"])) for r in got} == by_hand(events, labels, days)


def test_matrix_and_snapshot_of_a_crowded_patient(spark):
    events, labels = history(2)
    df, lb = spark.createDataFrame(events, EV), spark.createDataFrame(labels, LB)
    crowded = [r for r in labels if r[0] == "a" and r[1]]
    few = [lb.where(F.col("patient_id") == "a").where(F.col("label_time") == F.lit(r[1]).cast("timestamp_ntz")) for r in crowded[:3]]
    vocab = mx.fit_vocab(df, lb, lookback_days=30, numeric="auto")
    whole = {(r["patient_id"], r["label_time"]): r for r in mx.matrix(df, lb, vocab, lookback_days=30).collect()}
    shots = {(r["patient_id"], r["label_time"]): r for r in ev.snapshot(df, lb, lookback_days=30).collect()}
    for r, one in zip(crowded[:3], few, strict=True):
        assert mx.matrix(df, one, vocab, lookback_days=30).first() == whole[("a", r[1])]
        assert ev.snapshot(df, one, lookback_days=30).first() == shots[("a", r[1])]


def test_many_label_rows_are_not_paired_with_every_event(spark):
    """20,000 events and 2,000 label rows of one patient: the rows of every step stay far below 40 million."""
    events = spark.range(20_000).select(
        F.lit("a").alias("patient_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") * 13)).alias("time"),
        F.concat(F.lit("C"), F.col("id") % 5).alias("code"), F.col("id").cast("double").alias("value"),
    )
    labels = spark.range(2_000).select(
        F.lit("a").alias("patient_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int") * 2)).alias("label_time"), F.lit(0.0).alias("value")
    )
    out = ev.windowed_totals(events, labels, 30, {"code": F.col("code")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.agg(F.sum("n")).first()[0] == ev.in_lookback(events, labels, 30).count()
    assert "_salt" in plan and "Window" in plan


@pytest.mark.parametrize("few,bins", [(100_000, 65_536), (5, 4), (0, 3), (50, 64)])
def test_medians_by_selection(spark, few, bins):
    rng = random.Random(few)
    rows = [("a", rng.gauss(0, 1)) for _ in range(700)] + [("b", float(rng.randint(0, 3))) for _ in range(401)]
    rows += [("c", rng.choice([1e300, -1e300, 1e-300, 0.0, -0.0, 7.0])) for _ in range(64)] + [("d", 5.0)] * 300 + [("e", 1.0), ("e", 2.0)]
    rows += [("far", float(i)) for i in range(99)] + [("far", 1e18), (None, 3.0), ("none", None), ("a", float("nan"))]
    rows += [("close", 1e15 + i % 7) for i in range(50)] + [("inf", float("inf")), ("inf", 1.0), ("inf", float("-inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v", few=few, bins=bins).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert got == {g: median(vs) for g, vs in groups.items()}
    assert exact_median(df.where("false"), ["g"], "v").count() == 0
