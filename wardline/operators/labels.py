"""Targets of the prediction tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import clinical as fn
from wardline.operators.concepts import ALL_TASKS, ICD_GROUPS


def chronic_flags(cohort: DataFrame, dx_index: DataFrame) -> DataFrame:
    """(hadm_id, dx_<group>...) as 0/1 for every index stay."""
    flags = [F.max((F.col("grp") == g.code).cast("int")).alias(f"dx_{g.code.lower()}") for g in ICD_GROUPS]
    seen = dx_index.groupBy("hadm_id").agg(*flags)
    names = [f"dx_{g.code.lower()}" for g in ICD_GROUPS]
    return cohort.select("hadm_id").join(seen, "hadm_id", "left").fillna(0, subset=names)


def stay_targets(
    cohort: DataFrame, history: DataFrame, dx_index: DataFrame, *, los_long_days: float = 7.0, mortality_days: int = 365
) -> DataFrame:
    """One row per index stay with a column per task."""
    return (
        cohort.join(history.select("hadm_id", "readmit"), "hadm_id", "left")
        .join(chronic_flags(cohort, dx_index), "hadm_id")
        .withColumn("mortality_1y", fn.died_within(F.col("dod"), F.col("dischtime"), mortality_days))
        .withColumn("readmission_30d", F.coalesce("readmit", F.lit(0)))
        .withColumn("prolonged_stay", (F.col("hosp_los_days") >= F.lit(float(los_long_days))).cast("int"))
        .withColumn("los_days", F.col("hosp_los_days"))
    )


def labels_long(cohort: DataFrame, history: DataFrame, dx_index: DataFrame, *, tasks=ALL_TASKS, **limits) -> DataFrame:
    """(task, patient_id, label_time, value, age, sex): one row per task and index stay.

    `label_time` is the cutoff of the task's own observation window.
    """
    wide = stay_targets(cohort, history, dx_index, **limits)
    rows = [
        F.struct(
            F.lit(t.name).alias("task"),
            fn.window_cutoff(F.col("admittime"), F.col("dischtime"), t.window).alias("label_time"),
            F.col(t.name).cast("double").alias("value"),
        )
        for t in tasks
    ]
    return wide.select(
        F.col("hadm_id").cast("string").alias("patient_id"),
        F.col("age_at_admit").cast("double").alias("age"),
        fn.sex_word(F.col("gender")).alias("sex"),
        F.explode(F.array(*rows)).alias("r"),
    ).select("r.task", "patient_id", "r.label_time", "r.value", "age", "sex")


def label_stats(labels: DataFrame) -> DataFrame:
    return labels.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")
    )
