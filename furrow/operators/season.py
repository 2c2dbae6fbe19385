"""Season dates from per-unit period series.

A series is one row per (unit, period); the number of periods per unit is fixed
and small, so per-unit arrays and windows stay bounded whatever the input size.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.ranking import join_on
from furrow.functions.scalar import C

# The search grid of the double-logistic fit.
RISE_DAYS = [165, 180, 195, 210, 225, 240]
RISE_RATES = [0.05, 0.12, 0.20, 0.30]
FALL_DAYS = [255, 270, 285, 300, 315, 330]
FALL_RATES = [0.05, 0.12, 0.20, 0.30]

# Smoothing strengths tried by cross-validation.
LAMBDAS = [1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1000.0, 5000.0]


# --- period dates ---------------------------------------------------------------

def period_dates(series: DataFrame, unit: Sequence[str], period: str, v: str, threshold: float, strict: bool = False) -> DataFrame:
    """Start, peak and end periods of each unit.

    start: first period at or above the threshold (``strict`` also asks that the
    period before lies below it); peak: first greatest period; end: first period
    after the peak below the threshold.  Missing values are NULL only; a unit
    without any value has NULL dates.
    """
    w = Window.partitionBy(*unit)
    x = F.col(v)
    up = x >= threshold
    if strict:
        prev = F.lag(v).over(w.orderBy(period))
        up = up & (prev < threshold)
    s = series.withColumn("__up", up)
    s = s.withColumn("__peak", F.min_by(period, F.when(x.isNotNull(), F.struct(-x, F.col(period)))).over(w))
    return s.groupBy(*unit).agg(
        F.min(F.when(F.col("__up"), F.col(period))).alias("sos"),
        F.first("__peak").alias("pos"),
        F.min(F.when((F.col(period) > F.col("__peak")) & (x < threshold), F.col(period))).alias("eos"),
        F.max(v).alias("v_max"),
        F.count(v).alias("n_valid"),
    )


def crossing_date(series: DataFrame, unit: Sequence[str], day: str, v: str, fraction: float, lo: float, hi: float,
                  min_points: int = 4, min_amplitude: float = 0.05) -> DataFrame:
    """Last rising crossing of min + fraction*amplitude before the peak, interpolated.

    A crossing outside [lo, hi] is passed over; without any crossing the first
    day at or above the level is used.  Too few points, too little amplitude or
    a peak on the first point give NULL.
    """
    s = series.where(F.col(v).isNotNull())
    w = Window.partitionBy(*unit)
    o = w.orderBy(day)
    s = s.withColumns({
        "__v2": F.lead(v).over(o), "__d2": F.lead(day).over(o), "__n": F.count(F.lit(1)).over(w),
        "__lo": F.min(v).over(w), "__hi": F.max(v).over(w), "__first": F.min(day).over(w),
        "__pk": F.min_by(day, F.struct(-F.col(v), F.col(day))).over(w),
    })
    thr = F.col("__lo") + F.lit(fraction) * (F.col("__hi") - F.col("__lo"))
    flat = F.col("__v2") == F.col(v)
    at = F.when(flat, F.col(day).cast("double")).otherwise(
        F.col(day) + (thr - F.col(v)) * (F.col("__d2") - F.col(day)) / F.when(~flat, F.col("__v2") - F.col(v))
    )
    crosses = (F.col(v) <= thr) & (thr <= F.col("__v2")) & (F.col(day) < F.col("__pk")) & at.between(lo, hi)
    ok = (F.col("n_points") >= min_points) & (F.col("amplitude") >= min_amplitude) & (F.col("pk") > F.col("first_day"))
    g = s.groupBy(*unit).agg(
        F.max_by(at, F.when(crosses, F.col(day))).alias("cross"),
        F.min(F.when(F.col(v) >= thr, F.col(day))).alias("fallback"),
        F.max("__n").alias("n_points"),
        F.max(F.col("__hi") - F.col("__lo")).alias("amplitude"),
        F.max("__pk").alias("pk"),
        F.max("__first").alias("first_day"),
    )
    return g.select(*unit, "n_points", F.when(ok, F.coalesce("cross", F.col("fallback").cast("double"))).alias("sos"))


# --- arrays ----------------------------------------------------------------------

def series_array(series: DataFrame, unit: Sequence[str], period: str, v: str, periods: Sequence[int], name: str = "ys") -> DataFrame:
    """One row per unit with its values in period order, NULL where missing."""
    return series.groupBy(*unit).agg(
        F.array(*[F.max(F.when(F.col(period) == int(p), F.col(v))).cast("double") for p in periods]).alias(name)
    )


def gaussian_smooth(ys: Column, n: int, sigma: float, weights: Column | None = None) -> Column:
    """Kernel-weighted mean over period distance; missing and zero-weight periods drop out."""
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    pairs = F.arrays_zip(ys.alias("y"), (weights if weights is not None else F.transform(idx, lambda i: F.lit(1.0))).alias("w"), idx.alias("j"))

    def at(i: Column) -> Column:
        def add(acc: Column, e: Column) -> Column:
            k = F.when(e["y"].isNotNull(), e["w"] * F.exp(-F.pow(i - e["j"], F.lit(2)) / (2 * sigma * sigma))).otherwise(0.0)
            return F.struct(
                (acc["num"] + k * F.coalesce(e["y"], F.lit(0.0))).alias("num"), (acc["den"] + k).alias("den")
            )

        zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
        return F.aggregate(pairs, zero, add, lambda a: F.try_divide(a["num"], a["den"]))

    return F.transform(idx, at)


# --- double-logistic grid fit -------------------------------------------------------

def curve_basis(days: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Parameters (rise rate, rise day, fall rate, fall day) and unit curves, one row each."""
    t = np.asarray(days, dtype=float)
    params = np.array([(ms, s, ma, a) for s in RISE_DAYS for ms in RISE_RATES for a in FALL_DAYS for ma in FALL_RATES], dtype=float)
    return params, unit_curve(params, t)


def unit_curve(params: np.ndarray, t: np.ndarray) -> np.ndarray:
    ms, s, ma, a = (params[..., i, None] for i in range(4))
    return 1 / (1 + np.exp(-ms * (t - s))) + 1 / (1 + np.exp(ma * (t - a))) - 1


FIT_TYPE = "struct<p:int,m_rise:double,d_rise:double,m_fall:double,d_fall:double,vmin:double,vmax:double,ssr:double,n:int>"


def _matrix(ys: pd.Series, n: int) -> np.ndarray:
    """One row per series, NaN where a value is NULL."""
    return np.array(ys.tolist(), dtype=float).reshape(len(ys), n)


def least_of_copies(y: np.ndarray, ok: np.ndarray, basis: np.ndarray, digits: int) -> np.ndarray:
    """The best curve for each row of y, as ``least_curves`` has it, where all rows lack the same points.

    What all curves share is left out of the comparison and the squares of the curves, alike for
    all rows, ride along in the product: one product and two readings of it are all the work.
    """
    y, b = y[:, ok], basis[:, ok]
    lo, hi = y.min(axis=1, keepdims=True), y.max(axis=1, keepdims=True)
    z, amp = y - lo, hi - lo
    curves = np.vstack([-2 * b.T, (b * b).sum(axis=1)])
    best = np.zeros(len(y), dtype=np.int32)
    for a in range(0, len(y), 250):  # a product of some megabytes stays in the cache
        r = slice(a, a + 250)
        s = np.hstack([z[r], amp[r]]) @ curves
        zz = (z[r] * z[r]).sum(axis=1)
        least = np.round(zz + amp[r, 0] * s.min(axis=1), digits)
        top = np.divide(least + 0.5 * 10.0**-digits - zz, amp[r, 0], out=np.full(len(zz), np.inf), where=amp[r, 0] > 0)
        best[r] = (s < top[:, None]).argmax(axis=1)  # the first that rounds to the least
    return best


def least_curves(y: np.ndarray, basis: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(curve, squared error, floor, ceiling) of the best curve for each row of y, NaN being missing.

    A curve is scaled to the row's floor and amplitude, so its squared error follows from three
    products of rows and curves: one product serves all rows and all curves.
    """
    ok = np.isfinite(y)
    some = ok.any(axis=1)
    lo = np.where(some, np.where(ok, y, np.inf).min(axis=1, initial=np.inf), np.nan)
    hi = np.where(some, np.where(ok, y, -np.inf).max(axis=1, initial=-np.inf), np.nan)
    z = np.where(ok, y - lo[:, None], 0.0)
    best, low = np.zeros(len(y), dtype=np.int32), np.full(len(y), np.inf)
    for a in range(0, len(y), 2_000):
        r = slice(a, a + 2_000)
        amp = (hi - lo)[r, None]
        s = (z[r] * z[r]).sum(axis=1, keepdims=True) - 2 * amp * (z[r] @ basis.T) + amp * amp * (ok[r].astype(float) @ (basis * basis).T)
        least = np.round(s.min(axis=1), digits)
        best[r] = (s < (least + 0.5 * 10.0**-digits)[:, None]).argmax(axis=1)  # the first that rounds to the least
        low[r] = np.where(np.isfinite(least), least + 0.0, np.inf)
    return best, low, lo, hi


def _fit_frame(y: np.ndarray, params: np.ndarray, best: np.ndarray, ssr: np.ndarray, lo, hi, n_ok, min_points: int) -> pd.DataFrame:
    bad = n_ok < min_points
    out = pd.DataFrame({
        "p": pd.array(best, dtype="Int32"), "m_rise": params[:, 0], "d_rise": params[:, 1], "m_fall": params[:, 2], "d_fall": params[:, 3],
        "vmin": lo, "vmax": hi, "ssr": ssr, "n": n_ok.astype("int32"),
    })
    out.loc[bad, ["m_rise", "d_rise", "m_fall", "d_fall", "vmin", "vmax", "ssr"]] = np.nan
    out.loc[bad, "p"] = pd.NA
    return out


def grid_fit(days: Sequence[float], min_points: int = 6, digits: int = 9):
    """Pandas UDF: best of the 576 grid curves for each series array.

    Squared errors are compared at ``digits`` decimals and the earliest curve
    wins a tie, so the answer does not hang on the last bit of a sum.
    """
    n = len(days)
    params, basis = curve_basis(days)

    @F.pandas_udf(FIT_TYPE)
    def fit(ys: pd.Series) -> pd.DataFrame:
        y = _matrix(ys, n)
        best, low, lo, hi = least_curves(y, basis, digits)
        return _fit_frame(y, params[best], best, low, lo, hi, np.isfinite(y).sum(axis=1), min_points)

    # declared non-deterministic so that a filter on the result does not run the fit twice
    return fit.asNondeterministic()


def refine_fit(days: Sequence[float], day_steps=(-10, -5, 0, 5, 10), rate_factors=(0.8, 1.0, 1.25), min_points: int = 6, digits: int = 9):
    """Pandas UDF: second, finer grid around a fitted curve, with its RMSR."""
    n = len(days)
    t = np.asarray(days, dtype=float)
    offs = [(ds, fr, da, fa) for ds in day_steps for fr in rate_factors for da in day_steps for fa in rate_factors]

    @F.pandas_udf("struct<q:int,m_rise:double,d_rise:double,m_fall:double,d_fall:double,ssr:double,rmsr:double>")
    def refine(ys: pd.Series, m_rise: pd.Series, d_rise: pd.Series, m_fall: pd.Series, d_fall: pd.Series) -> pd.DataFrame:
        y = _matrix(ys, n)
        ok = np.isfinite(y)
        n_ok = ok.sum(axis=1)
        lo = np.where(ok, y, np.inf).min(axis=1, initial=np.inf)
        hi = np.where(ok, y, -np.inf).max(axis=1, initial=-np.inf)
        base = np.column_stack([m_rise, d_rise, m_fall, d_fall]).astype(float)
        out = np.full((len(y), 4), np.nan)
        best, low = np.full(len(y), -1, dtype=np.int32), np.full(len(y), np.inf)
        for q, (ds, fr, da, fa) in enumerate(offs):
            par = np.column_stack([base[:, 0] * fr, base[:, 1] + ds, base[:, 2] * fa, base[:, 3] + da])
            pred = lo[:, None] + (hi - lo)[:, None] * unit_curve(par, t)
            with np.errstate(invalid="ignore"):
                e = np.where(ok, np.where(ok, y, 0.0) - pred, 0.0)
            s = np.round((e * e).sum(axis=1), digits)
            better = (s < low) & (n_ok >= min_points)
            best[better], low[better], out[better] = q, s[better], par[better]
        none = best < 0
        low[none] = np.nan
        return pd.DataFrame({
            "q": pd.array(np.where(none, 0, best), dtype="Int32").astype("Int32"), "m_rise": out[:, 0], "d_rise": out[:, 1], "m_fall": out[:, 2], "d_fall": out[:, 3],
            "ssr": low, "rmsr": np.sqrt(low / np.where(n_ok > 0, n_ok, 1)),
        }).assign(q=lambda f: f["q"].mask(none))

    return refine.asNondeterministic()


def fitted_dates(fit: Column, rise_fraction: float = 0.70, fall_fraction: float = 0.20) -> dict[str, Column]:
    """Dates at fractions of the rising and falling curve; the peak lies midway."""
    return {
        "sos": fit["d_rise"] - F.lit(float(np.log(1 / rise_fraction - 1))) / fit["m_rise"],
        "pos": (fit["d_rise"] + fit["d_fall"]) / 2,
        "eos": fit["d_fall"] + F.lit(float(np.log(1 / fall_fraction - 1))) / fit["m_fall"],
    }


def replicate_intervals(days: Sequence[float], n_rep: int, seed: int = 42, probs: tuple[float, float] = (0.025, 0.975), shared: bool = False, min_points: int = 6, digits: int = 9):
    """Pandas UDF of (key, series, squared error of its fit): quantiles of the dates over noisy copies.

    A copy adds uniform noise scaled by the residual deviation, from a hash of (key, replicate,
    period).  All copies of a series are fitted in one product with the curves.  ``shared`` uses one
    draw for all periods of a copy; that shifts floor and ceiling alike and leaves the fitted curve
    unchanged, so it is only for comparison.
    """
    n = len(days)
    params, basis = curve_basis(days)
    dates = {d: np.array(v) for d, v in zip(("sos", "eos"), _curve_dates(params))}
    cols = [f"{d}_{t}" for d in dates for t in ("lo", "hi")]

    @F.pandas_udf(", ".join(f"{c} double" for c in cols) + ", n_rep long")
    def intervals(keys: pd.Series, ys: pd.Series, ssr: pd.Series) -> pd.DataFrame:
        out = []
        tails = [f"|{r}|{0 if shared else j}|{seed}".encode() for r in range(n_rep) for j in range(n)]
        for key, y, s in zip(keys, _matrix(ys, n), ssr):
            ok = np.isfinite(y)
            if ok.sum() < min_points or not np.isfinite(s):
                out.append((*[None] * len(cols), 0))
                continue
            head = f"{key}".encode()
            raw = b"".join([h.digest() for h in map(md5, map(head.__add__, tails))])
            u = (np.frombuffer(raw, ">u8")[::2] >> np.uint64(12)).astype(float).reshape(n_rep, n) / 16.0**13  # 13 hex digits
            best = least_of_copies(y + (u - 0.5) * 2 * np.sqrt(s / n), ok, basis, digits)
            out.append((*[float(q) for d in dates.values() for q in np.quantile(d[best], probs)], n_rep))
        return pd.DataFrame(out, columns=[*cols, "n_rep"])

    return intervals.asNondeterministic()


def _curve_dates(params: np.ndarray, rise_fraction: float = 0.70, fall_fraction: float = 0.20) -> tuple[np.ndarray, np.ndarray]:
    """Rising and falling date of every curve of the grid, as ``fitted_dates`` has them."""
    m_rise, d_rise, m_fall, d_fall = params.T
    return d_rise - np.log(1 / rise_fraction - 1) / m_rise, d_fall + np.log(1 / fall_fraction - 1) / m_fall


# --- penalised smoother --------------------------------------------------------------

def penalised_smooth(n: int, min_gcv: int = 8, min_points: int = 5, fixed_lambda: float = 100.0):
    """Pandas UDF: second-difference penalised fit with its strength chosen by GCV.

    Fewer than ``min_gcv`` points use the fixed strength; fewer than
    ``min_points`` fail (NULL).
    """
    d2 = np.diff(np.eye(n), n=2, axis=0)
    pen = d2.T @ d2

    @F.pandas_udf("struct<z:array<double>,lam:double,n:int>")
    def smooth(ys: pd.Series) -> pd.DataFrame:
        y = _matrix(ys, n)
        ok = np.isfinite(y)
        n_ok = ok.sum(axis=1)
        wy = np.where(ok, y, 0.0)
        w = ok.astype(float)
        z = np.full_like(y, np.nan)
        lam_of = np.full(len(y), np.nan)
        best = np.full(len(y), np.inf)
        eye = np.eye(n)
        rows = np.flatnonzero(n_ok >= min_points)
        for lam in LAMBDAS if len(rows) else []:
            inv = np.linalg.inv(w[rows][:, :, None] * eye + lam * pen)
            zz = np.einsum("nij,nj->ni", inv, wy[rows])
            trace = np.einsum("nii,ni->n", inv, w[rows])
            rss = (w[rows] * (wy[rows] - zz) ** 2).sum(axis=1)
            m = n_ok[rows]
            gcv = np.where(m - trace > 1e-9, m * rss / np.maximum(m - trace, 1e-9) ** 2, np.inf)
            gcv = np.where(m >= min_gcv, np.round(gcv, 12), 0.0 if lam == fixed_lambda else np.inf)
            better = gcv < best[rows]
            hit = rows[better]
            best[hit], z[hit], lam_of[hit] = gcv[better], zz[better], lam
        return pd.DataFrame({
            "z": [None if np.isnan(r).all() else list(r) for r in z], "lam": lam_of, "n": n_ok.astype("int32"),
        })

    return smooth.asNondeterministic()


# --- comparisons -----------------------------------------------------------------------

def baseline_delta(df: DataFrame, unit: Sequence[str], year: str, v: str, pre: Sequence[int], post: int) -> DataFrame:
    """Post-year value minus the null-safe mean of the pre years, per unit."""
    return (
        df.where(F.col(year).isin(*pre, post))
        .groupBy(*unit)
        .agg(
            F.avg(F.when(F.col(year).isin(*pre), F.col(v))).alias("baseline"),
            F.max(F.when(F.col(year) == post, F.col(v))).alias("post"),
        )
        .withColumn("delta", F.col("post") - F.col("baseline"))
    )


def fuse_dates(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Arithmetic mean of two sources' dates; NULL if either is missing."""
    r = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in cols])
    j = join_on(a.select(*keys, *cols), r, list(keys))
    return j.select(*keys, *[((F.col(c) + F.col(f"__{c}")) / 2).alias(c) for c in cols])
