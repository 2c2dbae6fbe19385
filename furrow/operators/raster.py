"""Pixel-table operators: masks, composites, focal filters, zonal summaries, regions.

A raster is a table keyed by integer cell (x, y); a masked pixel is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.ranking import column_medians, exact_quantiles, join_on
from furrow.functions.scalar import C, dekad_index
from furrow.session import cut_lineage


# --- masks -------------------------------------------------------------------

def apply_mask(df: DataFrame, keep: Column, bands: Sequence[str]) -> DataFrame:
    """Null the bands where ``keep`` is not true; the row itself stays."""
    return df.withColumns({b: F.when(keep, F.col(b)) for b in bands})


# --- composites ----------------------------------------------------------------

def composite(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], median: bool = True) -> DataFrame:
    """min, max, mean, first and latest value per pixel (and the exact median)."""
    pos = F.struct(*[F.col(c) for c in order])
    out = df.groupBy(*keys).agg(
        F.min(value).alias("v_min"),
        F.max(value).alias("v_max"),
        F.avg(value).alias("v_mean"),
        F.min_by(value, pos).alias("v_first"),
        F.max_by(value, pos).alias("v_latest"),
        F.count(value).alias("n_obs"),
    )
    if median:
        out = join_on(out, exact_quantiles(df, keys, value, {"v_median": 0.5}), list(keys), "left")
    return out


def with_period_grid(df: DataFrame, unit: Sequence[str], period: str, periods: Sequence[int]) -> DataFrame:
    """Every unit gets every period; periods without data are kept as NULL rows."""
    grid = df.select(*unit).distinct().withColumn(period, F.explode(F.array(*[F.lit(int(p)) for p in periods])))
    return join_on(grid, df, [*unit, period], "left")


def period_medians(df: DataFrame, unit: Sequence[str], period: str, periods: Sequence[int], value: str) -> DataFrame:
    keys = [*unit, period]
    n = df.groupBy(*keys).agg(F.count(value).alias("n_obs"))
    med = join_on(n, exact_quantiles(df, keys, value, {"v_median": 0.5}), keys, "left")
    return with_period_grid(med, unit, period, periods).withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))


def dekad_means(df: DataFrame, unit: Sequence[str], ts: str, values: Sequence[str], scene: str, min_obs: int = 1) -> DataFrame:
    """Ten-day means with centre day and scene count; thin dekads are dropped."""
    year = F.year(ts)
    out = (
        df.withColumn("dekad", dekad_index(ts))
        .groupBy(*unit, year.alias("year"), "dekad")
        .agg(*[F.avg(v).alias(f"{v}_mean") for v in values], F.count_distinct(scene).alias("n_scenes"), F.count(F.lit(1)).alias("n_obs"))
        .where(F.col("n_obs") >= min_obs)
    )
    centre = (F.col("dekad") * 10 + 5).cast("int")
    return out.withColumn("doy_centre", centre).withColumn(
        "date_centre", F.date_add(F.make_date(F.col("year"), F.lit(1), F.lit(1)), centre - 1)
    )


def windowed_aggregates(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, tuple[str, Column, str]]) -> DataFrame:
    """Conditional aggregates over named windows in one grouping.

    ``aggs`` maps an output to (function, condition, value); medians take the
    exact-quantile path, all others share one aggregation.
    """
    plain, medians = [], {}
    for name, (fn, cond, value) in aggs.items():
        v = F.when(cond, F.col(value))
        if fn == "median":
            medians[name] = v
        else:
            plain.append(getattr(F, fn)(v).alias(name))
    out = df.groupBy(*keys).agg(*(plain or [F.count(F.lit(1)).alias("__n")]))
    if medians:
        wide = column_medians(df.withColumns({f"__{n}": v for n, v in medians.items()}), keys, {f"__{n}": n for n in medians})
        out = join_on(out, wide, list(keys), "left")
    return out.drop("__n")


def balanced_pixels(valid: DataFrame, pixel: Sequence[str], year: str, months_needed: int, years: int) -> DataFrame:
    """Pixels with enough valid months in every one of ``years`` years."""
    return (
        valid.groupBy(*pixel, year)
        .agg(F.sum(F.col("valid").cast("int")).alias("months"))
        .where(F.col("months") >= months_needed)
        .groupBy(*pixel)
        .agg(F.count(F.lit(1)).alias("n_years"))
        .where(F.col("n_years") == years)
        .select(*pixel)
    )


def coarsen(df: DataFrame, factor: int, valid: Column, share: float) -> DataFrame:
    """Coarse cells whose share of valid fine cells reaches ``share``."""
    return (
        df.groupBy(F.floor(F.col("x") / factor).cast("long").alias("cx"), F.floor(F.col("y") / factor).cast("long").alias("cy"))
        .agg(F.avg(valid.cast("double")).alias("share_valid"), F.count(F.lit(1)).alias("n_fine"))
        .withColumn("kept", F.col("share_valid") >= share)
    )


# --- focal -----------------------------------------------------------------------

def focal_moments(df: DataFrame, value: str, radius: int) -> DataFrame:
    """Square-window count, mean and population variance around every cell.

    The window is separable: sums along x, then along y, so a cell is copied
    2*(2r+1) times and not (2r+1)^2 times; both passes combine map-side.
    """
    offs = F.array(*[F.lit(i) for i in range(-radius, radius + 1)])
    src = df.where(F.col(value).isNotNull()).select(
        "x", "y", F.lit(1).alias("n"), F.col(value).alias("s"), (F.col(value) * F.col(value)).alias("ss")
    )
    sums = [F.sum(c).alias(c) for c in ("n", "s", "ss")]
    along_x = src.withColumn("o", F.explode(offs)).groupBy((F.col("x") + F.col("o")).alias("x"), "y").agg(*sums)
    both = along_x.withColumn("o", F.explode(offs)).groupBy("x", (F.col("y") + F.col("o")).alias("y")).agg(*sums)
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))
    return both.select("x", "y", F.col("n").cast("long").alias("n_win"), mean.alias("w_mean"), var.alias("w_var"))


def lee_filter(df: DataFrame, value: str, radius: int, noise_var: float) -> DataFrame:
    """Adaptive speckle filter: mean + gain*(v - mean), gain = (var - noise*mean^2)/var."""
    m = focal_moments(df, value, radius)
    j = df.where(F.col(value).isNotNull()).join(m, ["x", "y"])
    gain = F.try_divide(F.col("w_var") - noise_var * F.col("w_mean") * F.col("w_mean"), F.col("w_var"))
    return j.withColumn("gain", gain).withColumn(
        "filtered", F.coalesce(F.col("w_mean") + F.col("gain") * (F.col(value) - F.col("w_mean")), F.col(value))
    )


# --- zones -------------------------------------------------------------------------

def area_funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], cell_area: float) -> DataFrame:
    """Area left after each cumulative condition, in one pass over the cells."""
    acc, aggs = F.lit(True), []
    for i, (name, cond) in enumerate(steps):
        acc = acc & F.coalesce(cond, F.lit(False))
        aggs.append(F.sum(F.when(acc, 1).otherwise(0)).cast("long").alias(f"n{i}"))
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("cells"))
        for i, (n, _) in enumerate(steps)
    ]))
    return one.select(rows.alias("r")).select("r.step", "r.name", "r.cells", (F.col("r.cells") * cell_area).alias("area"))


def dissolve(cells: DataFrame, keys: Sequence[str], cell: Sequence[str], cell_area: float) -> DataFrame:
    """Union of footprints per key: a cell covered many times counts once."""
    return cells.dropDuplicates([*keys, *cell]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) * F.lit(cell_area)).alias("area")
    )


# --- connected regions --------------------------------------------------------------

TILE = 128


def _label_tile(tile: int):
    """Flood labels within one tile; a tile never holds more than tile*tile cells."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        x0, y0 = (xs[0] // tile) * tile, (ys[0] // tile) * tile
        lab = np.full((tile + 2, tile + 2), np.iinfo(np.int64).max)
        ix, iy = xs - x0 + 1, ys - y0 + 1
        order = np.lexsort((xs, ys))
        lab[ix[order], iy[order]] = np.arange(len(order))
        on = lab < np.iinfo(np.int64).max
        while True:
            best = lab
            for dx in (0, 1, 2):
                for dy in (0, 1, 2):
                    sh = np.full_like(lab, np.iinfo(np.int64).max)
                    sh[1:-1, 1:-1] = lab[dx : dx + tile, dy : dy + tile]
                    best = np.minimum(best, sh)
            best = np.where(on, best, np.iinfo(np.int64).max)
            # follow the label of the label: halves the remaining distance
            flat = np.empty(len(order), dtype=np.int64)
            flat[:] = best[ix[order], iy[order]]
            while True:
                nxt = flat[flat]
                if (nxt == flat).all():
                    break
                flat = nxt
            new = np.full_like(lab, np.iinfo(np.int64).max)
            new[ix[order], iy[order]] = flat
            if (new == lab).all():
                break
            lab = new
        root = order[lab[ix, iy]]
        out = pdf[["x", "y"]].copy()
        out["rx"], out["ry"] = xs[root], ys[root]
        return out

    return fn


def _encode(x, y) -> Column:
    """Label order: row first, then column."""
    return F.struct(C(y).alias("ly"), C(x).alias("lx"))


def merge_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a, b): rows (node, root), root = least node.

    Alternates the large-star and small-star steps, which need a number of
    rounds logarithmic in the diameter.  Each round is checkpointed, and a graph
    that has not settled within ``max_rounds`` raises instead of returning a
    partial answer.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = cut_lineage(e)

    def star(e: DataFrame, large: bool) -> DataFrame:
        sym = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        j = sym.join(low, "a")
        if large:
            out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def settled(e: DataFrame) -> bool:
        """Every node hangs on exactly one root that hangs on nothing itself."""
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        deg = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return deg.where("up + down > 1 and up > 0").isEmpty()

    for _ in range(max_rounds):
        if settled(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        e = cut_lineage(star(star(e, True), False))
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def connected_regions(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """8-connected regions of a cell set: rows (x, y, region_x, region_y).

    Cells are labelled inside fixed tiles first; only label pairs that touch
    across a tile border enter the iterative merge, so its size follows the
    region borders and not the cells.
    """
    cells = cells.select(F.col("x").cast("long"), F.col("y").cast("long")).distinct()
    tiled = (
        cells.groupBy(F.floor(F.col("x") / tile), F.floor(F.col("y") / tile))
        .applyInPandas(_label_tile(tile), "x long, y long, rx long, ry long")
    )
    tiled = cut_lineage(tiled)
    edge = (F.pmod("x", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("y", F.lit(tile)).isin(0, tile - 1))
    rim = tiled.where(edge)
    near = F.explode(F.array(*[
        F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy
    ]))
    pairs = rim.select(near.alias("c"), _encode("rx", "ry").alias("a")).select("c.x", "c.y", "a")
    pairs = pairs.join(rim.select("x", "y", _encode("rx", "ry").alias("b")), ["x", "y"]).where("a <> b")
    roots = merge_labels(pairs.select("a", "b"))
    out = tiled.withColumn("node", _encode("rx", "ry")).join(roots, "node", "left")
    root = F.coalesce(F.col("root"), F.col("node"))
    return out.select("x", "y", root["lx"].alias("region_x"), root["ly"].alias("region_y"))


def region_table(cells: DataFrame, cell_area: float, min_area: float, tile: int = TILE) -> DataFrame:
    return (
        connected_regions(cells, tile)
        .groupBy("region_x", "region_y")
        .agg(F.count(F.lit(1)).alias("n_cells"))
        .withColumn("area", F.col("n_cells") * F.lit(cell_area))
        .where(F.col("area") >= min_area)
    )


# --- interval join --------------------------------------------------------------------

def interval_join(obs: DataFrame, windows: DataFrame, keys: Sequence[str], ts: str, start: str, end: str) -> DataFrame:
    """Rows whose time lies in [start, end) of a window with the same keys.

    Windows are spread over the days they touch, so the join is an equi join on
    (keys, day): a busy key is split by day and nothing is compared twice.
    """
    last = F.greatest(F.to_date(start), F.to_date(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")))
    w = windows.where(F.col(start) < F.col(end)).withColumn("__day", F.explode(F.sequence(F.to_date(start), last)))
    o = obs.withColumn("__day", F.to_date(ts))
    j = o.join(w, [*keys, "__day"])
    return j.where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("__day")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order``: an aggregate, not a window sort."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in cols])
