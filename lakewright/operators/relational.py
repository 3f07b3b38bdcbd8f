"""Small helpers over DataFrames: orderings with nulls last, joins that broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if Spark's own estimate of it stays below this many bytes.
BROADCAST_BYTES = 32 << 20


def order_nulls_last(df: DataFrame, *keys: str) -> DataFrame:
    """Order by keys, "-" before a name meaning descending; nulls come last either way."""
    return df.orderBy(*(F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_small(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join with right broadcast while its estimate is below most; else as Spark plans it."""
    return left.join(F.broadcast(right) if estimated_bytes(right) < most else right, on, how)
