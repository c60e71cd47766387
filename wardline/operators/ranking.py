"""Ranks and running sums over whole tables, without a global window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import materialize

HASH_DIGITS = 4  # 16**4 bins of a uniform hash


def hash_order(key: Column, seed: int) -> Column:
    """Pseudo-random but reproducible sort key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def hash_rank(ids: DataFrame, id_col: str, *, seed: int) -> DataFrame:
    """Exact 1-based rank of every id in the order of its hash; ids must be distinct.

    The hash is uniform, so its first digits cut the ids into even bins. Bin sizes (a fixed 65,536
    rows) are summed up once; the ranking itself runs per bin.
    """
    keyed = ids.select(id_col, hash_order(F.col(id_col), seed).alias("_h")).withColumn(
        "_bin", F.substring("_h", 1, HASH_DIGITS)
    )
    sizes = keyed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bin").orderBy("_h", id_col)
    # broadcast: one row per bin, 16**HASH_DIGITS at most
    return keyed.join(F.broadcast(offsets), "_bin").select(
        id_col, (F.col("_offset") + F.row_number().over(within)).alias("rank")
    )


# Rows that one task sorts, on average, when a whole table is put in order.
ROWS_PER_SLICE = 500_000


def running_totals(
    df: DataFrame, by: list[str], order: str, sums: dict[str, str], *, slices: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Per group, the sum of each column over all rows with a smaller `order` value.

    `sums` maps a column to the name of its running sum (the row itself is not included). `df` holds
    one row per (by, order). The rows are cut into ranges of (by, order), as many as the table's size asks
    for (`slices` sets the number), and written; a range's sums are added to those of the ranges before
    it. Neither many groups nor a group with the whole table makes a large task.
    """
    spark = df.sparkSession
    kept = materialize(df, "ordered")
    count = slices or max(1, -(-kept.count() // rows_per_slice))
    # written: the range of a row must not depend on a second drawing of the bounds
    sliced = materialize(
        kept.repartitionByRange(count, *by, order).withColumn("_slice", F.spark_partition_id()), "sliced"
    )
    totals = sliced.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_slice", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    within = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sliced.join(offsets, [*by, "_slice"]).select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for c, name in sums.items()],
    )


#: Rows of a group from which on its median is narrowed down by counts, and bins of such a count.
FEW_ROWS, SELECTION_BINS = 100_000, 65_536


def exact_median(
    long: DataFrame, by: list[str], value: str, *, few: int = FEW_ROWS, bins: int = SELECTION_BINS
) -> DataFrame:
    """Median per group, nulls and NaN skipped, for groups that may hold the whole table. No group is sorted.

    Equal values of a group are folded first, so the rounds read a row per distinct value, and columns of counts are a few
    rows however long the table is.
    A round counts a group's rows in even bins between its bounds, combined before the shuffle, and goes on with the bin
    that the middle rank falls in. Bins are even in the logarithm of the value, so a few far values cost no more
    rounds. When a group's bounds hold `few` rows or a single place, the value of the rank is read off them.
    """
    x = F.col(value).cast("double")
    place = F.greatest(F.lit(-800.0), F.least(F.lit(800.0), F.signum("_x") * F.log1p(F.abs("_x"))))  # infinity is at the end
    present = long.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, x.alias("_x"))
    folded = present.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_k"))
    cells = materialize(folded.withColumn("_at", place), "cells")
    count = F.sum("_k")
    ranges = cells.groupBy(*by).agg(count.alias("_n"), F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    rank = F.floor((F.col("_n") + 1) / 2)
    state = materialize(ranges.withColumns({"_rank": rank, "_even": (F.col("_n") % 2 == 0).cast("int")}), "ranges")
    wide_open = (F.col("_n") > few) & (F.col("_low") < F.col("_high"))
    inside = F.col("_at").between(F.col("_low"), F.col("_high"))
    meet = lambda groups: _beside(cells, groups, by)
    while state.where(wide_open).limit(1).count():
        spot = F.floor((F.col("_at") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins)
        counted = meet(state.where(wide_open)).where(inside).groupBy(*by, "_rank", "_even", F.least(spot, F.lit(bins - 1)).alias("_bin")).agg(
            count.alias("_n"), F.min("_at").alias("_low"), F.max("_at").alias("_high")
        )
        upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin"))  # as many rows as there are bins
        before = F.col("_upto") - F.col("_n")
        hit = counted.withColumn("_upto", upto).where((before < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
        narrowed = hit.select(*by, "_n", "_low", "_high", (F.col("_rank") - before).alias("_rank"), "_even")
        state = materialize(state.where(~wide_open).unionByName(narrowed), "ranges")
    met = meet(state)
    folded = met.where(inside).select(*by, "_rank", "_even", "_x", "_k")
    upto = F.sum("_k").over(Window.partitionBy(*by).orderBy("_x"))
    at_rank = lambda r: F.min(F.when(F.col("_upto") >= r, F.col("_x")))
    picked = folded.withColumn("_upto", upto).groupBy(*by).agg(
        at_rank(F.col("_rank")).alias("_a"), at_rank(F.col("_rank") + F.col("_even")).alias("_b")
    )
    above = met.where(F.col("_at") > F.col("_high")).groupBy(*by).agg(F.min("_x").alias("_next"))
    middle = ((F.col("_a") + F.coalesce("_b", "_next")) / 2.0).alias("median")
    return _beside(picked, above, by, "left").select(*by, middle)


def _beside(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on groups of which one may be null; columns of `left` first."""
    other = right.select(*[F.col(c).alias(f"_g_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = [left[c].eqNullSafe(other[f"_g_{c}"]) for c in by]
    return left.join(other, same, how).drop(*[f"_g_{c}" for c in by])
