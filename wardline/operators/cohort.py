"""Index admissions: the first intensive-care admission of each adult survivor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import clinical as fn
from wardline.operators.concepts import window_tag


def icu_admissions(adm: DataFrame, icu: DataFrame) -> DataFrame:
    """Admissions with at least one intensive-care stay.

    The stays are reduced to one row per admission inside each task first, so an admission with very
    many stays costs one row in the shuffle.
    """
    return adm.join(icu.select("hadm_id").distinct(), "hadm_id", "left_semi")


def first_admission(adm: DataFrame) -> DataFrame:
    """Earliest admission per subject, lowest `hadm_id` on a tie.

    A minimum over a struct, not `row_number`: it combines map-side, so no task has to sort all
    admissions of one subject.
    """
    rest = [c for c in adm.columns if c not in ("subject_id", "admittime", "hadm_id")]
    undated = F.col("admittime").isNull().alias("_undated")  # an unknown time comes after every known one
    first = F.min(F.struct(undated, "admittime", "hadm_id", *rest)).alias("a")
    return adm.groupBy("subject_id").agg(first).select("subject_id", "a.*").drop("_undated")


def cohort(adm: DataFrame, pat: DataFrame, icu: DataFrame, *, min_age: int = 18, limit: int | None = None) -> DataFrame:
    """One index admission per subject. Survival, age and stay are tested after the pick: a subject
    whose first intensive-care admission fails a test is out."""
    adm = adm.select("subject_id", "hadm_id", "admittime", "dischtime", "hospital_expire_flag")
    pat = pat.select("subject_id", "gender", "dod", "anchor_year", "anchor_age")
    picked = (
        first_admission(icu_admissions(adm, icu))
        .filter(F.col("hospital_expire_flag") == 0)
        .withColumn("hosp_los_days", fn.los_days(F.col("admittime"), F.col("dischtime")))
        .filter(F.col("hosp_los_days") > 0)
    )
    out = (
        picked.join(pat, "subject_id")
        .withColumn("age_at_admit", fn.age_at(F.col("admittime"), F.col("anchor_year"), F.col("anchor_age")))
        .filter(F.col("age_at_admit") >= min_age)
        .select(
            "subject_id", "hadm_id", "admittime", "dischtime", "gender", "dod", "age_at_admit", "hosp_los_days",
            F.col("dischtime").alias("prediction_time"),
        )
    )
    # the development cap of the cohort: a sorted prefix by request only
    return out if limit is None else out.orderBy("subject_id").limit(limit)


def with_cutoff(cohort: DataFrame, hours: int | None, name: str = "cutoff") -> DataFrame:
    return cohort.withColumn(name, fn.window_cutoff(F.col("admittime"), F.col("dischtime"), hours))


def stay_windows(cohort: DataFrame, windows) -> DataFrame:
    """One row per stay and observation window with its cutoff: (hadm_id, obs_window, cutoff)."""
    ends = [
        F.struct(
            F.lit(window_tag(w)).alias("obs_window"),
            fn.window_cutoff(F.col("admittime"), F.col("dischtime"), w).alias("cutoff"),
        )
        for w in windows
    ]
    return cohort.select("hadm_id", F.explode(F.array(*ends)).alias("w")).select("hadm_id", "w.*")
