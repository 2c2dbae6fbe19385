"""Positions in a global order, without sorting any group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import written

_LOCAL = 33  # bits of monotonically_increasing_id that count rows inside a partition


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """The rows with ``position`` (from 0, long) inside their keys and ``total``, the keys' row count.

    Rows are dealt out by ranges of (keys, order, row number) and sorted inside each range, so a
    key with any share of the rows is split, repeated rows too; counts per range give the offsets.
    NULL is a key like any other and comes first.
    """
    stem = written(df.withColumn("__row", F.monotonically_increasing_id()), f"{name}-rows")
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col("__row").asc()]
    dealt = stem.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    dealt = written(dealt.drop("__row"), f"{name}-dealt").withColumn("__part", F.shiftright("__at", _LOCAL))
    own = Window.partitionBy(*keys)
    parts = dealt.groupBy("__part", *keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(
        F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(own).alias("total"),
    )
    same = reduce(lambda c, ik: c & F.col(ik[1]).eqNullSafe(F.col(f"__k{ik[0]}")), enumerate(keys), F.col("__part") == F.col("__p"))
    out = dealt.join(parts, same).withColumn("position", F.col("__at") + F.col("__shift"))
    return out.select(*df.columns, "position", "total")
