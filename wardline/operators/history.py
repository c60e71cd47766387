"""What happened to a subject before, and after, the index admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import clinical as fn
from wardline.operators.concepts import ICD_GROUPS, UTIL_CODE, UTIL_DESCRIPTION
from wardline.operators.skew import salted_join
from wardline.session import inline_table


def _with_admissions(cohort: DataFrame, adm: DataFrame) -> DataFrame:
    """Index stays joined to all admissions of their subject. The cohort has one row per subject, so
    this is no many-to-many join; a subject with very many admissions is spread over tasks."""
    index = cohort.select(
        "subject_id",
        F.col("hadm_id").alias("index_hadm"),
        F.col("admittime").alias("index_admit"),
        F.col("dischtime").alias("index_disch"),
    )
    return salted_join(adm.select("subject_id", "hadm_id", "admittime"), index, "subject_id", spread_by=["hadm_id"])


def prior_admissions(cohort: DataFrame, adm: DataFrame, *, include_index: bool = False) -> DataFrame:
    """(index_hadm, index_admit, hadm_id, admittime) of admissions before the index one, or up to and with it."""
    before = F.col("admittime") <= F.col("index_admit") if include_index else F.col("admittime") < F.col("index_admit")
    return _with_admissions(cohort, adm).filter(before).select("index_hadm", "index_admit", "hadm_id", "admittime")


def admission_history(cohort: DataFrame, adm: DataFrame, *, readmit_days: int = 30) -> DataFrame:
    """(hadm_id, n_prior, readmit) in one pass over the admissions.

    Readmission: any admission later than discharge and no later than `readmit_days` after it.
    """
    limit = F.col("index_disch") + F.expr(f"INTERVAL {int(readmit_days)} DAYS")
    again = (F.col("admittime") > F.col("index_disch")) & (F.col("admittime") <= limit)
    return (
        _with_admissions(cohort, adm)
        .groupBy(F.col("index_hadm").alias("hadm_id"))
        .agg(
            F.count_if(F.col("admittime") < F.col("index_admit")).alias("n_prior"),
            F.max(F.when(again, 1).otherwise(0)).alias("readmit"),
        )
    )


def utilization_events(history: DataFrame) -> DataFrame:
    return history.select(
        "hadm_id",
        F.lit(UTIL_CODE).alias("code"),
        F.col("n_prior").cast("double").alias("value"),
        F.lit(UTIL_DESCRIPTION).alias("description"),
    )


def _slots(dx: DataFrame, groups) -> DataFrame:
    cleaned = dx.select(
        "hadm_id",
        fn.icd_normalize(F.col("icd_code")).alias("norm"),
        fn.icd_version_number(F.col("icd_version")).alias("version"),
    )
    return cleaned.withColumn("slots", fn.icd_group_slots(F.col("norm"), F.col("version"), groups))


def classified(dx: DataFrame, groups=ICD_GROUPS) -> DataFrame:
    """(hadm_id, norm, version, groups) per diagnosis row."""
    return _slots(dx, groups).withColumn("groups", F.array_compact("slots")).drop("slots")


def icd_groups(dx: DataFrame) -> DataFrame:
    """Distinct (hadm_id, grp): at most one row per stay and group, combined before the shuffle."""
    # the outer form: before a plain explode Spark tests the array's size, which works it out twice
    hits = _slots(dx, ICD_GROUPS).select("hadm_id", F.explode_outer("slots").alias("grp"))
    return hits.filter(F.col("grp").isNotNull()).distinct()


def dx_by_index(cohort: DataFrame, adm: DataFrame, dx: DataFrame) -> DataFrame:
    """(hadm_id, grp, in_prior): groups seen up to and in the index stay.

    `in_prior` marks those seen in an earlier stay already: the history features. All rows together
    are the label side, which includes the index stay. Keeping the two apart is the leakage boundary.
    """
    pairs = prior_admissions(cohort, adm, include_index=True)
    return (
        pairs.join(icd_groups(dx), "hadm_id")
        .groupBy(F.col("index_hadm"), F.col("grp"))
        .agg(F.max(F.col("admittime") < F.col("index_admit")).alias("in_prior"))
        .withColumnRenamed("index_hadm", "hadm_id")
    )


def dx_history_events(dx_index: DataFrame) -> DataFrame:
    names = inline_table(
        dx_index.sparkSession, [(g.code, g.description) for g in ICD_GROUPS], "grp string, _name string"
    )
    return (
        dx_index.filter("in_prior")
        .join(names, "grp")
        .select(
            "hadm_id",
            F.concat(F.lit("DX/"), "grp").alias("code"),
            F.lit(None).cast("double").alias("value"),
            F.concat(F.lit("History of "), F.lower("_name")).alias("description"),
        )
    )
