"""Reproducible train / validation / test split with exact sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.ranking import hash_rank


def assign_split(
    ids: DataFrame, id_col: str = "patient_id", *, seed: int = 42, val: float = 0.15, test: float = 0.15
) -> DataFrame:
    """(id, split): by hash rank, the first int(n * test) test, the next int(n * val) val, the rest train.

    The hash depends on id and seed alone, so one patient falls into one part in every window.
    """
    unique = ids.select(id_col).distinct()
    n = unique.agg(F.count(F.lit(1)).alias("n")).scalar()
    sized = hash_rank(unique, id_col, seed=seed).withColumn("_n", n)
    n_test, n_val = F.floor(F.col("_n") * F.lit(float(test))), F.floor(F.col("_n") * F.lit(float(val)))
    rank = F.col("rank")
    return sized.select(
        id_col, F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train").alias("split")
    )
