"""Joins that hold up under a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 200_000  # most rows a broadcast side may hold
SALTS = 32


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    condition: Column | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join of a large table with a lookup table on one key.

    The lookup side is broadcast when a bounded count proves it small. Beyond that both sides are
    salted: left rows spread over `SALTS` buckets, right rows are copied to each, so one key held
    by a third of the left rows is split over `SALTS` tasks. Both ways give the same rows.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        joined = left.join(F.broadcast(right), key)
    else:
        spread = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        joined = (
            left.withColumn("_salt", spread.cast("int"))
            .join(right.withColumn("_salt", salts), [key, "_salt"])
            .drop("_salt")
        )
    return joined if condition is None else joined.where(condition)
