"""Sort keys against Python's own order, and plans without a sort for the latest value."""

import random
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.catalog import QUERIES
from wardline.functions.ordered import double_key, latest_key, time_key


def place(x: float) -> int:
    """Order of a double's bits, both zeros alike."""
    bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -bits if x < 0 else bits


def test_double_key_orders_as_the_bits_do(spark):
    rng = random.Random(7)
    powers = [2.0**e for e in range(-1074, 1024)]
    near = [struct.unpack("<d", struct.pack("<q", place(p) + d))[0] for p in powers for d in (-1, 1) if 0 <= place(p) + d]
    drawn = [struct.unpack("<d", struct.pack("<q", rng.getrandbits(63)))[0] for _ in range(2000)]
    values = {x for v in [*powers, *near, *drawn, 0.0, 37.2, 1.7976931348623157e308] for x in (v, -v) if x == x}
    values |= {float("inf"), float("-inf"), float("nan")}
    got = [(r["v"], r["k"]) for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", double_key(F.col("v")).alias("k")).collect()]
    numbers = [(v, k) for v, k in got if v == v]
    assert len(numbers) == len(got) - 1
    assert all(k == place(v) for v, k in numbers)
    assert max(k for _, k in numbers) < next(k for v, k in got if v != v)


def test_time_key_is_the_wall_clock_whatever_the_zone(spark):
    start = datetime(1899, 12, 31, 23, 59, 59, 999_999)
    times = [start, datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59, 999_999), datetime(2024, 10, 27, 2, 30)]
    times += [start + timedelta(days=d * 373, microseconds=d * 7_654_321) for d in range(150)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = df.select("t", time_key(F.col("t"), "timestamp_ntz").alias("k")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert all(r["k"] == (r["t"] - datetime(1970, 1, 1)) // timedelta(microseconds=1) for r in got)


def test_latest_is_that_of_the_struct(spark):
    rng = random.Random(3)
    at = [datetime(1960, 1, 1), datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 1), None]
    values = [None, float("nan"), float("-inf"), -2.5, -1e-310, 0.0, 1e-310, 3.0, 3.0000000000000004, float("inf")]
    rows = [(rng.randint(0, 150), rng.choice(at), rng.choice(values)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g int, t timestamp_ntz, v double").where("t is not null and v is not null")
    both = df.groupBy("g").agg(
        F.max_by("v", latest_key(df, "t", "v")).alias("packed"), F.max(F.struct("t", "v"))["v"].alias("sorted")
    )
    assert both.count() > 100 and both.where("not packed <=> sorted").count() == 0


@pytest.mark.parametrize("name", ["vital_summary", "lab_latest", "value_features"])
def test_latest_values_are_hash_aggregates(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    latest = [line for line in plan.splitlines() if "max_by(" in line and "Aggregate" in line]
    assert latest and all("HashAggregate" in line for line in latest)
    # the first admission of a patient is the one struct left
    assert all("min(struct(" in line for line in plan.splitlines() if "SortAggregate" in line)
