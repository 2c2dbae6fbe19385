"""Scene catalog as a table: one row per scene with footprint and cloud cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scene_catalog(obs: DataFrame, scene: Sequence[str], x: str, y: str, cloud: str) -> DataFrame:
    return obs.groupBy(*scene).agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
        F.avg(cloud).alias("cloud"), F.count(F.lit(1)).alias("n"),
    )


def search(cat: DataFrame, bbox, day: str, start: str, end: str, max_cloud: float, per: str, limit: int) -> DataFrame:
    """Scenes whose footprint meets the box in the date range, first ``limit`` per group by day."""
    x0, y0, x1, y1 = bbox
    hit = (
        (F.col("x1") >= x0) & (F.col("x0") <= x1) & (F.col("y1") >= y0) & (F.col("y0") <= y1)
        & F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & (F.col("cloud") < max_cloud)
    )
    # rn <= limit becomes a per-task group limit ahead of the shuffle
    rn = F.row_number().over(Window.partitionBy(per).orderBy(day))
    return cat.where(hit).withColumn("rn", rn).where(F.col("rn") <= limit)
