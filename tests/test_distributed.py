"""The operators that cut groups apart give what the plain form gives."""

import random
from statistics import median

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.operators import metrics
from wardline.operators.ranking import exact_median, hash_rank, running_totals
from wardline.operators.skew import hot_keys, salted_join
from wardline.operators.split import assign_split
from wardline.session import shared_dir


def test_salted_join_equals_join_with_a_key_that_holds_a_third(spark):
    big = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("x")
    )
    small = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y"))
    hot = {r["k"]: r["_salts"] for r in hot_keys(big, "k", rows_per_salt=500).collect()}
    assert hot == {7: 5}
    joined = salted_join(big, small, "k", rows_per_salt=500)
    want = big.join(small, "k")
    assert joined.count() == want.count()
    assert joined.select("k", "x", "y").exceptAll(want.select("k", "x", "y")).count() == 0


def test_salted_join_spreads_the_hot_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("x"))
        small = spark.range(5).select(F.col("id").alias("k"), F.col("id").alias("y"))
        out = salted_join(big, small, "k", rows_per_salt=100)
        used = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(used) >= 6 and sum(r["count"] for r in used) == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_hash_rank_is_a_permutation_and_stable(spark):
    ids = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("id"))
    a = {r["id"]: r["rank"] for r in hash_rank(ids, "id", seed=1).collect()}
    b = {r["id"]: r["rank"] for r in hash_rank(ids.repartition(5), "id", seed=1).collect()}
    other = {r["id"]: r["rank"] for r in hash_rank(ids, "id", seed=2).collect()}
    assert sorted(a.values()) == list(range(1, 3001)) and a == b and a != other


def test_split_sizes_are_exact_and_disjoint(spark):
    ids = spark.range(1001).select(F.col("id").cast("string").alias("patient_id"))
    split = {r["patient_id"]: r["split"] for r in assign_split(ids.union(ids)).collect()}
    sizes = {s: list(split.values()).count(s) for s in ("train", "val", "test")}
    assert sizes == {"test": 150, "val": 150, "train": 701}


def test_running_totals_equal_one_window(spark):
    rng = random.Random(3)
    data = [(g, v, rng.randint(1, 9)) for g in "ab" for v in rng.sample(range(100000), 800)]
    df = spark.createDataFrame(data, "g string, v int, n int")
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("c", F.coalesce(F.sum("n").over(w), F.lit(0)))
    got = running_totals(df, ["g"], "v", {"n": "c"}, slices=7)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_exact_median_of_any_list(spark, values):
    df = spark.createDataFrame([("f", v) for v in values] + [("f", None), ("f", float("nan"))], "f string, v double")
    assert exact_median(df, ["f"], "v").first()["median"] == pytest.approx(median(values), rel=1e-12, abs=1e-12)


def test_exact_median_when_one_value_fills_a_third(spark):
    rng = random.Random(5)
    values = [float(rng.choice([0, rng.random(), 4])) for _ in range(20001)]
    df = spark.createDataFrame([("f", v) for v in values], "f string, v double")
    assert exact_median(df, ["f"], "v").first()["median"] == median(values)


def brute_auroc(y, p):
    pairs = [(a > b) + 0.5 * (a == b) for a, i in zip(p, y) if i for b, j in zip(p, y) if not j]
    return sum(pairs) / len(pairs)


def brute_auprc(y, p):
    total, area, last = sum(y), 0.0, 0.0
    for cut in sorted(set(p), reverse=True):
        hit = sum(i for i, a in zip(y, p) if a >= cut)
        n = sum(1 for a in p if a >= cut)
        area += (hit / total - last) * hit / n
        last = hit / total
    return area


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=4, max_size=60))
def test_ranking_metrics_against_all_pairs(spark, data):
    y, p = [a for a, _ in data], [b / 12 for _, b in data]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    got = metrics.ranking_metrics(df).first()
    if sum(y) in (0, len(y)):
        assert got["auroc"] is None and got["auprc"] is None
    else:
        assert got["auroc"] == pytest.approx(brute_auroc(y, p))
        assert got["auprc"] == pytest.approx(brute_auprc(y, p))


def test_perfect_separation(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, p double")
    got = metrics.binary_metrics(df).first()
    assert (got["auroc"], got["auprc"], got["n"], got["positives"]) == (1.0, 1.0, 4, 2)


def test_ece_bins_on_the_edges(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.1, 0.3, 0.6, 0.7, 1.0)], "p double")
    assert [r[0] for r in df.select(metrics.ece_bin(F.col("p"))).collect()] == [0, 1, 2, 5, 6, 9]


def test_regression_metrics_edges(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "y double, pred double")
    assert metrics.regression_metrics(one).first()["r2"] is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, pred double")
    assert metrics.regression_metrics(flat).first()["r2"] == 0.0


@pytest.mark.parametrize("rate", [0.02, 0.18, 0.9])
def test_solve_intercept_hits_the_rate(spark, rate):
    df = spark.range(500).select(((F.col("id") % 37) / 5.0 - 3).alias("x"))
    b = metrics.solve_intercept(df, "x", rate)
    mean = df.agg(F.avg(1 / (1 + F.exp(-(F.col("x") + b))))).first()[0]
    assert mean == pytest.approx(rate, abs=1e-9)


def test_shared_dir_is_the_clusters(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark) == (named or shared_dir(spark))


def test_median_rounds_read_a_row_per_distinct_value(spark, monkeypatch):
    from wardline.operators import ranking

    kept, own = {}, ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, name: kept.setdefault(name, own(df, name)) if name == "cells" else own(df, name))
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 'a', null) as f", "double(id % 7) as v")
    got = {r["f"]: r["median"] for r in exact_median(df, ["f"], "v", few=100).collect()}
    assert got == {"a": 3.0, None: 3.0} and kept["cells"].count() == 14


def test_facts_in_many_files_are_converted_without_a_shuffle(spark, tmp_path, monkeypatch):
    from wardline.sources import star

    spread, own = [], star.read_star

    def watched(spark, root):
        tables = own(spark, root)
        for name in ("chartevents", "labevents"):
            before = tables[name].repartition
            monkeypatch.setattr(tables[name], "repartition", lambda *a, name=name, before=before: spread.append(name) or before(*a))
        return tables

    monkeypatch.setattr(star, "read_star", watched)
    rows = spark.range(200).selectExpr(
        "id % 40 as hadm_id", "id as itemid", "double(id) as valuenum", "timestamp_ntz'2024-01-01 00:00:00' as charttime",
        "id as subject_id", "'F' as gender", "50 as anchor_age", "2000 as anchor_year", "date'2024-01-01' as dod",
        "timestamp_ntz'2024-01-01 00:00:00' as admittime", "timestamp_ntz'2024-01-02 00:00:00' as dischtime",
        "0 as hospital_expire_flag", "'I10' as icd_code", "'10' as icd_version",
    )
    for table in star.STAR_SCHEMAS:
        files = 1 if table == "hosp/labevents" else spark.sparkContext.defaultParallelism
        rows.repartition(files).write.option("header", True).option("compression", "gzip").csv(f"{tmp_path}/in/{table}.csv.gz")
    star.convert_star(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert spread == ["labevents"]
    for name in ("chartevents", "labevents"):
        back = spark.read.parquet(f"{tmp_path}/out/{name}")
        assert back.exceptAll(rows.select(back.columns)).count() == 0 and back.count() == 200
