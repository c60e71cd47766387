"""Fixed-width sort keys: the latest value of a group as a hash aggregate.

The maximum of a struct has no fixed width, so Spark sorts the rows for it. A time of 64 bits and a value of 64 bits fit one
decimal of 38 digits, whose maximum is kept in the hash table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDTH = "18446744073709551616"  # 2**64


def double_key(value: Column) -> Column:
    """A long that orders as the double does: exponent and mantissa, negated below zero. Both zeros are one key; the
    infinities come next to the largest numbers, NaN after all, as in Spark's own order."""
    size = F.abs(value)
    rough = F.floor(F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.coalesce(F.log2(size), F.lit(-1022.0)))))
    # the logarithm may be off by its last bit next to a power of two
    low = ((F.pow(F.lit(2.0), rough) > size) & (rough > -1022)).cast("bigint")
    high = ((size / F.pow(F.lit(2.0), rough) >= 2.0) & (rough < 1023)).cast("bigint")
    power = rough - low + high
    steps = F.lit(2.0**52)
    key = (power + 1022) * F.lit(2**52) + (size / F.pow(F.lit(2.0), power) * steps).cast("bigint")
    infinite, none = F.lit(2047 * 2**52), F.lit(2047 * 2**52 + 1)
    return F.when(F.isnan(value), none).otherwise(
        F.when(size == F.lit(float("inf")), infinite).otherwise(key) * F.when(value < 0, F.lit(-1)).otherwise(F.lit(1))
    )


def time_key(time: Column, kind: str) -> Column:
    """Microseconds since 1970. `kind` is the column's type; without a time zone they are those of the wall clock, the
    session's zone and its clock changes play no part."""
    if kind == "timestamp":
        return F.unix_micros(time)
    wall = time.cast("timestamp_ntz")
    within = F.hour(wall) * F.lit(3_600_000_000) + F.minute(wall).cast("bigint") * F.lit(60_000_000)
    second = (F.extract(F.lit("SECOND"), wall) * F.lit(1_000_000)).cast("bigint")
    return F.unix_date(F.to_date(wall)) * F.lit(86_400_000_000) + within + second


def latest_key(df: DataFrame, time: str, value: str) -> Column:
    """(time, value) as one decimal: later times are larger, on equal times larger values. Null where one of them is."""
    kind = df.schema[time].dataType.typeName()
    whole = F.lit(_WIDTH).cast("decimal(20,0)")
    parts = [time_key(F.col(time), kind).cast("decimal(18,0)"), double_key(F.col(value).cast("double")).cast("decimal(20,0)")]
    return parts[0] * whole + parts[1]
