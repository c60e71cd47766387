"""The star in buckets: the same events, and no fact is shuffled or counted again."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from wardline.catalog.registry import CHART_ITEMS, Views
from wardline.operators import measurements as ms
from wardline.plans.build import build_all
from wardline.sources.star import bucket_by_stay, bucket_star

WINDOWS = (None, 24)


@pytest.fixture(scope="module")
def bucketed(spark, sf_dir, tmp_path_factory):
    v = Views(spark, sf_dir)
    name = f"star_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path_factory.mktemp(name)}'")
    star = bucket_star(v.star, name, buckets=4)
    yield v, name, star, bucket_by_stay(v.cohort, f"{name}.cohort", 4, ["hadm_id"])
    spark.sql(f"DROP DATABASE {name} CASCADE")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fact", ["chartevents", "labevents"])
def test_no_exchange_and_one_scan_of_the_fact(spark, bucketed, fact):
    v, _, star, cohort = bucketed
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # the item dimension, but not the cohort
    try:
        if fact == "chartevents":
            out = ms.vital_summary(star[fact], cohort, items=CHART_ITEMS, windows=WINDOWS, hot=star[f"{fact}_hot"])
        else:
            out = ms.lab_latest(star[fact], cohort, items=v.lab_items, windows=WINDOWS, hot=star[f"{fact}_hot"])
        plan = plan_of(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(rf"FileScan parquet \S*{fact}\[", plan)) == 1
    assert not re.search(r"(?<!Broadcast)Exchange hashpartitioning", plan), plan


def test_events_are_the_same(spark, bucketed):
    v, name, star, _ = bucketed
    options = {"vital_items": CHART_ITEMS, "lab_items": v.lab_items}
    one = build_all(v.star, **options)["events"]
    two = build_all(star, buckets=(name, 4), **options)["events"]
    rounded = lambda df: df.withColumn("value", F.round("value", 6))  # sums meet in another order
    assert one.count() == two.count() and rounded(one).exceptAll(rounded(two)).isEmpty()


def test_hot_stays_go_apart(spark, bucketed):
    v, name, star, _ = bucketed
    cohort = spark.table(f"{name}.cohort")
    hot = star["chartevents"].where("hadm_id IS NOT NULL").groupBy("hadm_id").count().where("count > 6").selectExpr("hadm_id", "3 as _salts")
    assert not hot.isEmpty()
    plain, spread = (
        ms.vital_summary(star["chartevents"], cohort, items=CHART_ITEMS, windows=WINDOWS, hot=h) for h in (star["chartevents_hot"], hot)
    )
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.fillna(-1.0).collect())
    assert rounded(plain) == rounded(spread)
