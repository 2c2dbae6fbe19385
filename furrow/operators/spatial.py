"""Points, segments and cell sets; every spatial predicate is an equi join on cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.ranking import join_on
from furrow.functions.scalar import (
    EARTH_RADIUS_M,
    KM_PER_DEGREE,
    grid_cell,
    hash_uniform,
    haversine,
    point_segment_km,
)


def in_box(lon: str, lat: str, box: Sequence[float]) -> Column:
    x0, y0, x1, y1 = box
    return F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1)


CROWD = 50_000
LEVELS = 5


def crowd_cells(points: DataFrame, cell: float, crowd: int = CROWD, levels: int = LEVELS) -> DataFrame:
    """Leaves of a quadtree over the occupied cells: a cell with more than ``crowd`` points is cut in four.

    One row per finest cell (fx, fy) with its base cell, the leaf it belongs to (level, lx, ly) and
    the number of lots that the points of a leaf still crowded at the last level are dealt into.
    A cell's counts come from its at most 4^levels finest cells, never from its points.
    """
    n = 1 << levels
    fine = points.groupBy(F.floor(F.col("lon") / cell * n).cast("long").alias("fx"), F.floor(F.col("lat") / cell * n).cast("long").alias("fy")).agg(F.count(F.lit(1)).alias("c"))
    at = lambda c, i: F.shiftright(c, levels - i)
    fine = fine.withColumn("bx", at("fx", 0)).withColumn("by", at("fy", 0))
    level, count = F.lit(levels), F.col("c")
    for i in reversed(range(levels)):
        held = F.sum("c").over(Window.partitionBy("bx", "by", at("fx", i), at("fy", i)))
        fine = fine.withColumn(f"c{i}", held)
        level, count = F.when(F.col(f"c{i}") <= crowd, i).otherwise(level), F.when(F.col(f"c{i}") <= crowd, F.col(f"c{i}")).otherwise(count)
    leaf = fine.select("bx", "by", "fx", "fy", level.alias("level"), F.ceil(count / crowd).cast("int").alias("lots"))
    down = F.lit(levels) - F.col("level")
    return leaf.withColumn("lx", F.call_function("shiftright", "fx", down)).withColumn("ly", F.call_function("shiftright", "fy", down))


def cut_segments(segments: DataFrame, longest: float) -> DataFrame:
    """Distinct segments as pieces of at most ``longest`` degrees along either axis; pieces join end to end."""
    s = segments.select("lon1", "lat1", "lon2", "lat2").where("lon1 IS NOT NULL AND lat1 IS NOT NULL AND lon2 IS NOT NULL AND lat2 IS NOT NULL").distinct()
    dx, dy = F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")
    s = s.withColumn("n", F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / longest)).cast("int"))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    end = lambda a, b, i: F.when(i == F.col("n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * i / F.col("n"))
    i = F.col("i")
    return s.select(end("lon1", "lon2", i).alias("lon1"), end("lat1", "lat2", i).alias("lat1"), end("lon1", "lon2", i + 1).alias("lon2"), end("lat1", "lat2", i + 1).alias("lat2"))


#: Pieces of one base cell that are compared with its fine cells in one share.
SHARE = 50_000


def near_segments(points: DataFrame, segments: DataFrame, radius_km: float, cell: float = 0.5, crowd: int = CROWD, share: int = SHARE) -> DataFrame:
    """Points within ``radius_km`` of at least one segment (lon1, lat1, lon2, lat2).

    Segments are cut into pieces no longer than a cell. Where many pieces meet one cell they are dealt
    into shares of about ``share``, each compared with the cell's occupied fine cells, at most 4^levels
    however many points there are. A fine cell that lies wholly within the radius of a piece settles all
    its points; the points of the others are compared only with the pieces that may reach their fine
    cell. The semi joins stop at the first hit. Points without coordinates are near nothing.
    """
    pad_y = radius_km / KM_PER_DEGREE * 1.01
    top = F.greatest(F.abs("lat1"), F.abs("lat2")) + pad_y
    pad_x = F.lit(pad_y) / F.cos(F.radians(F.least(top, F.lit(89.0))))
    base = lambda v: F.floor(v / cell).cast("long")
    ends = ["lon1", "lat1", "lon2", "lat2"]
    piece = cut_segments(segments, cell).select(
        "*", (F.least("lon1", "lon2") - pad_x).alias("x0"), (F.greatest("lon1", "lon2") + pad_x).alias("x1"), (F.least("lat1", "lat2") - pad_y).alias("y0"), (F.greatest("lat1", "lat2") + pad_y).alias("y1")
    )
    piece = piece.withColumn("bx", F.explode(F.sequence(base(F.col("x0")), base(F.col("x1"))))).withColumn("by", F.explode(F.sequence(base(F.col("y0")), base(F.col("y1")))))

    somewhere = points.where("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)")
    cells = crowd_cells(somewhere, cell, crowd).select("bx", "by", "fx", "fy", "lots")
    shares = piece.groupBy("bx", "by").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("shares"))
    shares = shares.join(cells.select("bx", "by").distinct(), ["bx", "by"])
    there = F.pmod(F.xxhash64(*ends), F.col("shares")).cast("int")
    piece = piece.join(shares, ["bx", "by"]).select(*ends, F.struct("bx", "by", there.alias("share")).alias("__there"))

    n = 1 << LEVELS
    size, half = cell / n, cell / n / 2
    spread = cells.join(shares, ["bx", "by"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    spread = spread.select("fx", "fy", "lots", ((F.col("fx") + 0.5) * size).alias("lon"), ((F.col("fy") + 0.5) * size).alias("lat"), F.struct("bx", "by", "share").alias("__here"))
    # how far a point's distance may lie from that of its cell's centre, up to this latitude
    most = 88.0
    slack = 1.01 * math.sqrt(2) * half * KM_PER_DEGREE + math.radians(half) * radius_km / math.cos(math.radians(most))
    sound = F.abs("lat") + half < most
    spread = spread.withColumn("wide", F.when(sound, pad_y / F.cos(F.radians(F.abs("lat") + half)) + size).otherwise(math.inf))
    band = F.lit(pad_y + size)
    touches = (F.greatest("lat1", "lat2") >= F.col("lat") - band) & (F.least("lat1", "lat2") <= F.col("lat") + band)
    touches = touches & (F.greatest("lon1", "lon2") >= F.col("lon") - F.col("wide")) & (F.least("lon1", "lon2") <= F.col("lon") + F.col("wide"))
    meets = (F.col("__here") == F.col("__there")) & touches
    away = point_segment_km("lon", "lat", *ends)  # both joins have the same form, so that they share one exchange
    settled = spread.join(piece, meets & (away <= F.when(sound, radius_km - slack).otherwise(-1.0)), "left_semi").select("fx", "fy", "lots").distinct()
    reach = spread.join(settled, ["fx", "fy"], "left_anti").join(piece, meets & (away <= F.when(sound, radius_km + slack).otherwise(math.inf))).select("fx", "fy", "lots", *ends, F.lit(False).alias("all"))
    near = settled.select("fx", "fy", "lots", *[F.lit(None).cast("double").alias(c) for c in ends], F.lit(True).alias("all")).unionByName(reach)
    near = near.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select(*ends, F.col("all").alias("__all"), F.struct("fx", "fy", "lot").alias("__there"))

    p = somewhere.withColumn("__fx", F.floor(F.col("lon") / cell * n).cast("long")).withColumn("__fy", F.floor(F.col("lat") / cell * n).cast("long"))
    p = p.join(cells.select(F.col("fx").alias("__fx"), F.col("fy").alias("__fy"), F.col("lots").alias("__lots")), ["__fx", "__fy"])
    lot = F.pmod(F.xxhash64(*points.columns), F.col("__lots")).cast("int")
    p = p.withColumn("__here", F.struct(F.col("__fx").alias("fx"), F.col("__fy").alias("fy"), lot.alias("lot")))
    close = point_segment_km("lon", "lat", *ends) <= radius_km
    return p.join(near, (F.col("__here") == F.col("__there")) & (F.col("__all") | close), "left_semi").select(*points.columns)


def groups_within(df: DataFrame, keys: Sequence[str], lon: float, lat: float, radius_km: float) -> DataFrame:
    """Groups whose nearest row lies within the radius of a fixed point."""
    dist = haversine("lon", "lat", F.lit(lon), F.lit(lat))
    return df.groupBy(*keys).agg(F.min(dist).alias("min_dist_km")).where(F.col("min_dist_km") <= radius_km)


def block_folds(points: DataFrame, size: float, folds: int, seed: int = 42) -> DataFrame:
    """Covering blocks with a reproducible fold number each."""
    b = points.select(grid_cell("lon", size).alias("bx"), grid_cell("lat", size).alias("by")).distinct()
    return b.withColumn("fold", F.least(F.floor(hash_uniform("bx", "by", seed=seed) * folds), F.lit(folds - 1)).cast("int"))


def with_fold(points: DataFrame, blocks: DataFrame, size: float) -> DataFrame:
    """Attach the fold of the block a point falls in; 0 outside every block."""
    p = points.withColumn("bx", grid_cell("lon", size)).withColumn("by", grid_cell("lat", size))
    return p.join(blocks, ["bx", "by"], "left").withColumn("fold", F.coalesce("fold", F.lit(0)))


def overlay_share(footprint: DataFrame, zones: DataFrame, keys: Sequence[str], zone: Sequence[str], cell: Sequence[str], cell_area: float) -> DataFrame:
    """Area and share of each zone covered by each footprint; uncovered pairs are absent."""
    area = zones.groupBy(*zone).agg((F.count(F.lit(1)) * cell_area).alias("zone_area"))
    hit = (
        footprint.dropDuplicates([*keys, *cell]).join(zones, list(cell)).groupBy(*keys, *zone)
        .agg((F.count(F.lit(1)) * cell_area).alias("covered_area"))
    )
    return join_on(hit, area, list(zone)).withColumn("share", F.col("covered_area") / F.col("zone_area"))


def near_duplicates(points: DataFrame, keys: Sequence[str], point_id: str, radius_m: float) -> DataFrame:
    """Points that have another point of the same group closer than ``radius_m``.

    Cells are small enough that two points in one cell are always too close, so
    a crowded cell is settled by its count.  Only points alone in their cell are
    compared with the cells around them, at most a fixed number of candidates
    looking at any one point: work stays linear however many copies a spot has.
    """
    deg_m = math.pi * EARTH_RADIUS_M / 180.0
    dlat = radius_m / math.sqrt(2) * 0.999 / deg_m
    reach_lat = radius_m / deg_m * 1.001

    def row_of(lat: Column) -> Column:
        return F.floor(lat / dlat).cast("long")

    def width(row: Column) -> Column:
        low = F.when((row >= 0), row * dlat).otherwise(-(row + 1) * dlat)
        return F.lit(dlat) / F.cos(F.radians(low))

    p = points.withColumn("__row", row_of(F.col("lat")))
    p = p.withColumn("__cx", F.floor(F.col("lon") / width(F.col("__row"))).cast("long"))
    cell = [*keys, "__row", "__cx"]
    counts = p.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    crowded = p.join(counts.where("__n > 1"), cell, "left_semi")
    single = p.join(counts.where("__n = 1"), cell, "left_semi")
    reach_lon = F.lit(reach_lat) / F.cos(F.radians(F.least(F.abs("lat") + reach_lat, F.lit(89.9))))
    rows = single.withColumn(
        "__nrow", F.explode(F.sequence(row_of(F.col("lat") - reach_lat), row_of(F.col("lat") + reach_lat)))
    )
    w = width(F.col("__nrow"))
    probe = rows.withColumn(
        "__ncx", F.explode(F.sequence(F.floor((F.col("lon") - reach_lon) / w).cast("long"), F.floor((F.col("lon") + reach_lon) / w).cast("long")))
    )
    other = p.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col(point_id).alias("__oid"), F.col("lon").alias("__olon"),
                     F.col("lat").alias("__olat"), F.col("__row").alias("__orow"), F.col("__cx").alias("__ocx"))
    cond = (F.col("__nrow") == F.col("__orow")) & (F.col("__ncx") == F.col("__ocx")) & (F.col(point_id) != F.col("__oid"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__o_{k}"))
    cond = cond & (haversine("lon", "lat", "__olon", "__olat", EARTH_RADIUS_M) < radius_m)
    hit = probe.join(other, cond, "left_semi")
    cols = points.columns
    return crowded.select(*cols).unionByName(hit.select(*cols).dropDuplicates([point_id]))
