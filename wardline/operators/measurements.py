"""Vital-sign statistics and latest laboratory values per stay and observation window.

Both read their fact table once for all windows: a row feeds the aggregates of every window it lies
in, so nothing is multiplied before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import clinical as fn
from wardline.functions.ordered import latest_key
from wardline.operators.concepts import LAB_ITEMS, LAB_NAMES, VITAL_ITEMS, VITAL_NAMES, VITAL_STATS, window_tag
from wardline.operators.skew import hot_keys, salted_join
from wardline.session import inline_table, materialize

FACT_COLUMNS = ["hadm_id", "itemid", "valuenum", "charttime"]


def measured(fact: DataFrame, items) -> DataFrame:
    """Rows of the wanted items that carry a value; both tests reach the scan."""
    ids = [row[0] for row in items]
    return fact.select(*FACT_COLUMNS).filter(F.col("itemid").isin(ids) & F.col("valuenum").isNotNull())


def coded_vitals(chart: DataFrame, items=VITAL_ITEMS) -> DataFrame:
    """Item id to vital code, Fahrenheit items converted."""
    dim = inline_table(chart.sparkSession, items, "itemid bigint, vital string, is_f int")
    value = fn.fahrenheit_to_celsius(F.col("valuenum").cast("double"), F.col("is_f"))
    return measured(chart, items).join(dim, "itemid").select("hadm_id", "vital", value.alias("value"), "charttime")


def coded_labs(lab: DataFrame, items=LAB_ITEMS) -> DataFrame:
    dim = inline_table(lab.sparkSession, items, "itemid bigint, lab string")
    value = F.col("valuenum").cast("double").alias("value")
    return measured(lab, items).join(dim, "itemid").select("hadm_id", "lab", value, "charttime")


def _latest(condition: Column) -> Column:
    """Value at the latest time; on equal times the larger value. A hash aggregate, as key and value have fixed widths."""
    return F.max_by("value", F.when(condition, F.col("latest_key")))


def _per_window(aggregated: DataFrame, keys: list[str], windows, fields: list[str]) -> DataFrame:
    """Wide columns `<field>@<window>` to one row per window; windows without a reading give no row."""
    rows = [
        F.struct(
            F.lit(window_tag(w)).alias("obs_window"),
            *[F.col(f"`{f}@{window_tag(w)}`").alias(f) for f in ["n", *fields]],
        )
        for w in windows
    ]
    return (
        aggregated.select(*keys, F.explode(F.array(*rows)).alias("w"))
        .select(*keys, "w.*")
        .filter(F.col("n") > 0)
        .select(keys[0], "obs_window", *keys[1:], *fields)
    )


def _stays(cohort: DataFrame, windows) -> DataFrame:
    ends = [
        fn.window_cutoff(F.col("admittime"), F.col("dischtime"), w).alias(f"end@{window_tag(w)}") for w in windows
    ]
    return cohort.select("hadm_id", "admittime", *ends)


def _joined(coded: DataFrame, stays: DataFrame, windows, hot: DataFrame | None) -> tuple[DataFrame, dict]:
    """`hot` as it was counted before (see `bucket_star`), or None to count it now, among the rows of the cohort's stays.
    Where no stay is hot the join is a plain one: rows that lie by stay already are not shuffled for it, nor for the
    aggregate above; else the rows of hot stays go apart."""
    inside = {w: F.col("charttime") <= F.col(f"`end@{window_tag(w)}`") for w in windows}
    if hot is None:
        coded = coded.join(stays.select("hadm_id"), "hadm_id", "left_semi")
        hot = materialize(hot_keys(coded, "hadm_id"), "hot-stays")
    if hot.isEmpty():
        return coded.join(stays, "hadm_id"), inside
    spread = salted_join(coded.join(hot, "hadm_id", "left_semi"), stays.join(hot, "hadm_id", "left_semi"), "hadm_id", hot=hot)
    return coded.join(hot, "hadm_id", "left_anti").join(stays, "hadm_id").unionByName(spread), inside


def vital_summary(
    chart: DataFrame, cohort: DataFrame, *, items=VITAL_ITEMS, windows=(None,), hot: DataFrame | None = None
) -> DataFrame:
    """mean, min, max, last and sample std per (stay, window, vital) over [admission, cutoff]."""
    joined, inside = _joined(coded_vitals(chart, items), _stays(cohort, windows), windows, hot)
    joined = joined.filter(F.col("charttime") >= F.col("admittime"))
    joined = joined.withColumn("latest_key", latest_key(joined, "charttime", "value"))
    value = F.col("value")
    aggs = []
    for w, cond in inside.items():
        tag, kept = window_tag(w), F.when(cond, value)
        aggs += [
            F.count(kept).alias(f"n@{tag}"),
            F.avg(kept).alias(f"mean@{tag}"),
            F.min(kept).alias(f"min@{tag}"),
            F.max(kept).alias(f"max@{tag}"),
            _latest(cond).alias(f"last@{tag}"),
            F.stddev_samp(kept).alias(f"std@{tag}"),
        ]
    return _per_window(joined.groupBy("hadm_id", "vital").agg(*aggs), ["hadm_id", "vital"], windows, list(VITAL_STATS))


def vital_events(summary: DataFrame, names=VITAL_NAMES) -> DataFrame:
    """Long rows (hadm_id, obs_window, code, value, description), one per statistic that exists."""
    dim = inline_table(summary.sparkSession, names.items(), "vital string, _name string")
    return (
        summary.unpivot(["hadm_id", "obs_window", "vital"], list(VITAL_STATS), "stat", "value")
        .filter(F.col("value").isNotNull())
        .join(dim, "vital")
        .select(
            "hadm_id",
            "obs_window",
            F.concat(F.lit("VITAL/"), "vital", F.lit("_"), "stat").alias("code"),
            "value",
            F.concat("_name", F.lit(" ("), "stat", F.lit(")")).alias("description"),
        )
    )


def lab_latest(
    lab: DataFrame, cohort: DataFrame, *, items=LAB_ITEMS, windows=(None,), hot: DataFrame | None = None
) -> DataFrame:
    """Latest value per (stay, window, lab) up to the cutoff; no lower bound in time."""
    joined, inside = _joined(coded_labs(lab, items), _stays(cohort, windows).drop("admittime"), windows, hot)
    joined = joined.withColumn("latest_key", latest_key(joined, "charttime", "value"))
    aggs = []
    for w, cond in inside.items():
        tag = window_tag(w)
        aggs += [
            F.count(F.when(cond, F.col("value"))).alias(f"n@{tag}"),
            _latest(cond).alias(f"last@{tag}"),
        ]
    return _per_window(joined.groupBy("hadm_id", "lab").agg(*aggs), ["hadm_id", "lab"], windows, ["last"])


def lab_events(latest: DataFrame, names=LAB_NAMES) -> DataFrame:
    dim = inline_table(latest.sparkSession, names.items(), "lab string, description string")
    return latest.join(dim, "lab").select(
        "hadm_id", "obs_window", F.concat(F.lit("LAB/"), "lab").alias("code"), F.col("last").alias("value"), "description"
    )
