"""Stamps, category orders and unions that keep track of where a row came from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.scalar import C


def stamp(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def category_rank(col, order: Sequence[str]) -> Column:
    """Position in a given order; unlisted categories come last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(C(col) == v, F.lit(i)).otherwise(out)
    return out


def union_tagged(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union of tables with differing columns, each row tagged with its source."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_by_priority(parts: Mapping[str, DataFrame], keys: Sequence[str], tag: str) -> DataFrame:
    """One row per key from the first source that has it.

    Sources must be unique by key.  Without this step all sources' rows stay
    (``union_tagged``).
    """
    u = union_tagged(parts, tag)
    rest = [c for c in u.columns if c not in keys]
    best = u.groupBy(*keys).agg(F.min_by(F.struct(*rest), category_rank(tag, list(parts))).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
