"""Ordered fixes of moving systems; one system may own any share of the fixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.ranking import exact_row_number, join_on

PART_POINTS = 500


def numbered(fixes: DataFrame, sid: str, ts: str, tie: str) -> DataFrame:
    """Position of each fix in its track, ordered inside hours only."""
    return exact_row_number(fixes, [sid], [ts, tie], F.date_trunc("hour", ts), "seq")


def segments(fixes: DataFrame, sid: str, ts: str, tie: str) -> DataFrame:
    """Consecutive fix pairs as (lon1, lat1, lon2, lat2): an equi join on position."""
    n = numbered(fixes, sid, ts, tie).select(sid, "seq", "lon", "lat")
    nxt = n.select(sid, (F.col("seq") - 1).alias("seq"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return n.withColumnsRenamed({"lon": "lon1", "lat": "lat1"}).join(nxt, [sid, "seq"])


def track_summary(fixes: DataFrame, sid: str, ts: str, winds: Sequence[str], min_fixes: int = 2) -> DataFrame:
    """First and last time, number of fixes and greatest wind; short tracks dropped."""
    wind = F.greatest(*winds) if len(winds) > 1 else F.col(winds[0])
    return (
        fixes.groupBy(sid)
        .agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n_fixes"), F.max(wind).alias("max_wind"))
        .where(F.col("n_fixes") >= min_fixes)
    )


def track_parts(fixes: DataFrame, sid: str, ts: str, tie: str, size: int = PART_POINTS) -> DataFrame:
    """The line as consecutive parts of at most ``size`` points.

    A whole line per row would gather an unbounded group; parts keep the order
    and join end to end.
    """
    n = numbered(fixes, sid, ts, tie).withColumn("part", F.floor((F.col("seq") - 1) / size).cast("int"))
    pts = F.sort_array(F.collect_list(F.struct("seq", "lon", "lat")))
    return n.groupBy(sid, "part").agg(F.transform(pts, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))


def nearest_fix(fixes: DataFrame, sid: str, order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """One fix per system, least by ``order``."""
    best = fixes.groupBy(sid).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__r"))
    return best.select(sid, *[F.col(f"__r.{c}").alias(c) for c in cols])


def until_landfall(fixes: DataFrame, sid: str, ts: str, anchor: DataFrame, hours: int) -> DataFrame:
    """Fixes up to ``hours`` after the system's anchor time."""
    j = join_on(fixes, anchor.select(sid, F.col(ts).alias("__t0")), [sid])
    return j.where(F.col(ts) <= F.col("__t0") + F.expr(f"INTERVAL {hours} HOURS")).drop("__t0")


def breakpoint_segments(breaks: DataFrame, metric: str, point: str, value: str) -> DataFrame:
    """Half-open pieces (metric, lo, hi, p_lo, p_hi) between the published points of a metric, open at both ends.

    Points of one value are one step: the piece below ends at the least of their percentiles, the
    piece above starts at the greatest.
    """
    at = breaks.groupBy(metric, F.col(value).cast("double").alias("lo")).agg(F.max(point).cast("double").alias("p_lo"), F.min(point).cast("double").alias("__below"))
    w = Window.partitionBy(metric).orderBy("lo")
    inner = at.select(metric, "lo", F.lead("lo").over(w).alias("hi"), "p_lo", F.lead("__below").over(w).alias("p_hi"))
    first = at.groupBy(metric).agg(F.min("lo").alias("hi"), F.min_by("__below", "lo").alias("p_hi"))
    return inner.unionByName(first.select(metric, F.lit(None).cast("double").alias("lo"), "hi", F.lit(None).cast("double").alias("p_lo"), "p_hi"))


def breakpoint_ranks(values: DataFrame, metric: str, value: str, breaks: DataFrame, point: str, at: str, name: str = "pct") -> DataFrame:
    """Percentile of every (metric, value) row by its metric's table of (percentile, value) points.

    One equi join on the metric, narrowed to the piece that holds the value: linear between points,
    the end point's percentile beyond them, NULL for a NULL or NaN value or a metric without points.
    Give values on an inverted scale negated, together with negated points.
    """
    s = breakpoint_segments(breaks, metric, point, at).withColumnsRenamed({c: f"__{c}" for c in (metric, "lo", "hi", "p_lo", "p_hi")})
    v = F.col(value)
    held = (F.col("__lo").isNull() | (v >= F.col("__lo"))) & (F.col("__hi").isNull() | (v < F.col("__hi"))) & ~F.isnan(v.cast("double"))
    j = values.join(s, (F.col(metric) == F.col(f"__{metric}")) & held, "left")
    share = (v - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    rank = F.when(F.col("__lo").isNull(), F.col("__p_hi")).when(F.col("__hi").isNull(), F.col("__p_lo")).otherwise(F.col("__p_lo") + share * (F.col("__p_hi") - F.col("__p_lo")))
    return j.select(*[values[c] for c in values.columns], rank.alias(name))
