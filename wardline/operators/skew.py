"""Joins to a one-row-per-key table that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task may get before the key is spread over several.
ROWS_PER_SALT = 1_000_000


def hot_keys(df: DataFrame, key: str, *, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(key, salts) for every key with more than `rows_per_salt` rows.

    A count over one column: the scan is pruned to it and map-side combine leaves one row per key
    and task to shuffle, however hot the key is.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > rows_per_salt).select(
        key, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts")
    )


def salted_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    *,
    spread_by: list[str] | None = None,
    hot: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Inner equi-join on `key`; rows of a hot key go to several tasks, each with a copy of the small row.

    Neither `small` nor the hot keys carry a broadcast hint: Spark broadcasts what is below the session's
    threshold at run time and sort-merges otherwise, splitting the rows of a hot key. Only rows of `small`
    whose key is hot are copied. A `groupBy` on top is not satisfied by this partitioning, so Spark
    combines inside each task before it shuffles.
    """
    hot = hot_keys(big, key, rows_per_salt=rows_per_salt) if hot is None else hot
    spread = spread_by or [c for c in big.columns if c != key]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), F.col("_salts")).cast("int")
    left = big.join(hot, key, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = small.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")
