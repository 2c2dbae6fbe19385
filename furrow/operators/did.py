"""Fixed-effects estimators with cluster-robust errors.

Two routes:

* ``balanced_did``: on a balanced unit x period table everything follows from
  one number per unit, A_u = sum_t (post_t - mean post) * y_ut, so the estimate,
  its error, placebo assignments and leave-one-out refits are plain aggregates.
* ``panel_ols``: any panel.  Rows are first reduced to sums per (cluster, unit,
  period); units are absorbed exactly while the cross products of all regressors
  are added up per cluster, so nothing after the first aggregation grows with
  the data.  Coefficients, errors and the bootstrap need only those blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.distributions import chi2_p, normal_p2, t_p2
from furrow.functions.ranking import join_on
from furrow.functions.scalar import C
from furrow.operators.panel import deviation
from furrow.session import cut_lineage

Z95 = 1.959963984540054
MAX_TERMS = 1500


# --- balanced tables ----------------------------------------------------------------


def unit_contrasts(df: DataFrame, cell: Sequence[str], unit: str, period: str, y: str, post: str, treat: str | None = None) -> DataFrame:
    """Per (cell, unit): A, plus the cell's period moments and a balance flag.

    ``post`` is a 0/1 column that depends on the period only, ``treat`` one that
    depends on the unit only.
    """
    cell = list(cell)
    more = [F.max(treat).alias(treat)] if treat else []
    t = df.groupBy(*cell, unit, period).agg(F.avg(y).alias("__y"), F.max(post).alias("__p"), F.count(F.lit(1)).alias("__rows"), *more)
    per = t.groupBy(*cell, period).agg(F.max("__p").alias("__p")).groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_periods"), F.avg("__p").alias("pbar")
    )
    g = t.groupBy(*cell, unit).agg(
        F.sum(F.col("__p") * F.col("__y")).alias("__py"), F.sum("__y").alias("__sy"), F.count("__y").alias("__n"), F.sum("__rows").alias("n_rows"), *more
    )
    g = join_on(g, per, cell)
    return g.select(
        *cell, unit, *([treat] if treat else []), (F.col("__py") - F.col("pbar") * F.col("__sy")).alias("A"), "n_periods", "n_rows",
        (F.col("n_periods") * F.col("pbar") * (1 - F.col("pbar"))).alias("Q"), (F.col("__n") == F.col("n_periods")).alias("complete"),
    )


def did_from_contrasts(c: DataFrame, keys: Sequence[str], treat: str, small_sample: str = "cr1") -> DataFrame:
    """Estimate and clustered error from per-unit contrasts grouped by ``keys``.

    ``cr1`` = G/(G-1)*(n-1)/(n-K) with K counting all absorbed effects; ``g`` =
    G/(G-1) only.  A group without treated units, controls, period variation or
    a complete panel gives status ``not_estimable`` and NULL numbers.
    """
    keys = list(keys)
    s = F.col(treat).cast("double")
    m = c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("A").alias("__abar"), F.avg(s).alias("__sbar"), F.max("Q").alias("Q"), F.max("n_periods").alias("n_periods"),
        F.min("complete").alias("__full"), F.sum(s * F.col("A")).alias("__sa"), F.sum("A").alias("__a"),
    )
    sxx = F.col("n_units") * F.col("__sbar") * (1 - F.col("__sbar")) * F.col("Q")
    m = m.withColumn("__sxx", sxx).withColumn("tau", F.when(sxx > 1e-10, (F.col("__sa") - F.col("__sbar") * F.col("__a")) / F.when(sxx > 1e-10, sxx)))
    j = join_on(c.select(*keys, "A", s.alias("__s")), m, keys)
    w = F.col("__s") - F.col("__sbar")
    score = w * (F.col("A") - F.col("__abar")) - F.col("tau") * w * w * F.col("Q")
    e = j.groupBy(*keys).agg(F.sum(score * score).alias("__meat"))
    r = join_on(m, e, keys)
    g, n = F.col("n_units"), F.col("n_units") * F.col("n_periods")
    k = g + F.col("n_periods")
    factor = g / (g - 1)
    if small_sample == "cr1":
        factor = factor * (n - 1) / (n - k)
    ok = F.col("__full") & F.col("tau").isNotNull() & (g > 1) & (n > k)
    se = F.sqrt(F.col("__meat") * factor) / F.col("__sxx")
    return r.select(
        *keys, F.when(ok, F.col("tau")).alias("tau"), F.when(ok, se).alias("se"), n.alias("n_obs"), g.alias("n_units"),
        F.when(ok, "ok").otherwise("not_estimable").alias("status"),
    )


def balanced_did(df: DataFrame, cell: Sequence[str], unit: str, period: str, y: str, treat: str, post: str, small_sample: str = "cr1") -> DataFrame:
    return did_from_contrasts(unit_contrasts(df, cell, unit, period, y, post, treat), cell, treat, small_sample)


def with_inference(df: DataFrame, est: str = "tau", se: str = "se", dist: str = "normal", df_col: Column | None = None) -> DataFrame:
    """t, two-sided p and 95 % interval; NULL where the error is zero."""
    t = F.try_divide(F.col(est), F.col(se))
    p = normal_p2(t) if dist == "normal" else t_p2(t, df_col.cast("double"))
    return df.withColumns({"t_stat": t, "p_value": p, "ci_lo": F.col(est) - Z95 * F.col(se), "ci_hi": F.col(est) + Z95 * F.col(se)})


# --- general panels -----------------------------------------------------------------


def _block_partials(keys: list[str], p: int, n_periods: int, absorb: bool):
    """Arrow task: cross products per (cell, cluster) over the units of a batch.

    Column order: regressors, period dummies, intercept (only when units are not
    absorbed), outcome; then the numbers of rows and units.
    """
    k = p + n_periods + (0 if absorb else 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            col = b.column(b.schema.get_field_index("stats"))
            off = np.asarray(col.offsets)
            flat = col.flatten()
            unit = np.repeat(np.arange(b.num_rows), np.diff(off))
            get = lambda name: np.asarray(flat.field(name).to_numpy(zero_copy_only=False), dtype=float)
            pid = np.asarray(flat.field("t").to_numpy(zero_copy_only=False)).astype(int)
            n, y, yy = get("n"), get("y"), get("yy")
            x = np.stack([get(f"x{i}") for i in range(p)], axis=1) if p else np.zeros((len(n), 0))
            xy = np.stack([get(f"xy{i}") for i in range(p)], axis=1) if p else np.zeros((len(n), 0))
            frame = pd.DataFrame({c: b.column(i).to_pandas() for i, c in enumerate(b.schema.names) if c in keys})
            code = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            groups = code.max() + 1
            gid = code[unit]
            raw = np.zeros((groups, k, k))
            last = k - 1
            for i in range(p):
                for j in range(i, p):
                    np.add.at(raw[:, i, j], gid, get(f"x{i}x{j}"))
                np.add.at(raw[:, i, last], gid, xy[:, i])
                if n_periods:
                    np.add.at(raw, (gid, np.full(len(gid), i), p + pid), x[:, i])
            if n_periods:
                np.add.at(raw, (gid, p + pid, p + pid), n)
                np.add.at(raw, (gid, p + pid, np.full(len(gid), last)), y)
            np.add.at(raw[:, last, last], gid, yy)
            sums = np.zeros((b.num_rows, k))
            rows = np.zeros(b.num_rows)
            np.add.at(rows, unit, n)
            for i in range(p):
                np.add.at(sums[:, i], unit, x[:, i])
            if n_periods:
                np.add.at(sums, (unit, p + pid), n)
            np.add.at(sums[:, last], unit, y)
            iu = np.triu_indices(k)
            out = []
            for g in range(groups):
                mine = code == g
                m = np.triu(raw[g]) + np.triu(raw[g], 1).T
                if absorb:
                    m = m - (sums[mine] / rows[mine][:, None]).T @ sums[mine]
                else:
                    s = sums[mine].sum(axis=0)
                    s[last - 1] = rows[mine].sum()
                    m[last - 1, :], m[:, last - 1] = s, s
                out.append(np.concatenate([m[iu], [rows[mine].sum(), mine.sum()]]))
            first = pd.Series(np.arange(b.num_rows)).groupby(code).first().to_numpy()
            arrays = [b.column(b.schema.get_field_index(c)).take(pa.array(first)) for c in keys]
            arrays.append(pa.array([o.tolist() for o in out], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "block"])

    return run


class Blocks:
    """Cross products per (cell, cluster), as rows (cell, cluster, pos, val)."""

    def __init__(self, long: DataFrame, cell: list[str], cluster: str, terms: list[str], n_periods: int, absorb: bool):
        self.long, self.cell, self.cluster, self.terms = long, cell, cluster, terms
        self.n_periods, self.absorb = n_periods, absorb
        self.k = len(terms) + n_periods + (0 if absorb else 1) + 1
        self.size = self.k * (self.k + 1) // 2

    def gather(self, keys: Sequence[str]) -> DataFrame:
        """One array per key; its length is fixed by the design, not by the data."""
        s = self.long.groupBy(*keys, "pos").agg(F.sum("val").alias("val"))
        return s.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "val"))), lambda e: e["val"]).alias("block"))

    def replace(self, long: DataFrame, cell: list[str]) -> Blocks:
        return Blocks(long, cell, self.cluster, self.terms, self.n_periods, self.absorb)


def panel_blocks(df: DataFrame, cell: Sequence[str], unit: str, cluster: str, period: str | None, periods: Sequence[int], y: str,
                 regressors: Mapping[str, Column], absorb: bool = True) -> Blocks:
    """Reduce a panel to cross-product blocks.

    ``periods`` lists the levels of the period effects (empty: none); a
    row of another period is an error.  Rows with a NULL outcome, regressor or
    period drop out.  A unit must lie in one cluster.
    """
    cell, terms = list(cell), list(regressors)
    if len(terms) + len(periods) > MAX_TERMS:
        raise ValueError(f"{len(terms) + len(periods)} explicit terms; absorb the larger effect as the unit")
    if not cell:
        df, cell = df.withColumn("cell", F.lit("all")), ["cell"]
    p = len(terms)
    base = df.select(*cell, F.col(unit).alias("__u"), F.col(cluster).alias("__c"), (F.col(period) if period else F.lit(0)).alias("__t"),
                     C(y).cast("double").alias("__y"), *[r.cast("double").alias(f"__x{i}") for i, r in enumerate(regressors.values())])
    need = F.col("__y").isNotNull() & ~F.isnan("__y")
    for i in range(p):
        need = need & F.col(f"__x{i}").isNotNull()
    if periods:
        unlisted = F.raise_error(F.concat(F.lit("period outside the roster: "), F.col("__t").cast("string"))).cast("boolean")
        need = need & F.when(F.col("__t").isin(*[int(v) for v in periods]), True).when(F.col("__t").isNull(), False).otherwise(unlisted)
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("__y").alias("y"), F.sum(F.col("__y") * F.col("__y")).alias("yy")]
    for i in range(p):
        aggs += [F.sum(f"__x{i}").alias(f"x{i}"), F.sum(F.col(f"__x{i}") * F.col("__y")).alias(f"xy{i}")]
        aggs += [F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"x{i}x{j}") for j in range(i, p)]
    stats = base.where(need).groupBy(*cell, "__c", "__u", "__t").agg(*aggs)
    pos = {int(v): i for i, v in enumerate(periods)}
    idx = F.lit(0) if not periods else F.element_at(F.create_map(*[F.lit(z) for kv in pos.items() for z in kv]), F.col("__t").cast("int"))
    names = [c for c in stats.columns if c not in (*cell, "__c", "__u", "__t")]
    # at most one entry per period: the list is as long as the period roster
    units = stats.groupBy(*cell, "__c", "__u").agg(F.collect_list(F.struct(idx.alias("t"), *names)).alias("stats")).drop("__u")
    keys = [*cell, "__c"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields if f.name in keys)
    part = units.mapInArrow(_block_partials(keys, p, len(periods), absorb), f"{kinds}, block array<double>")
    long = part.select(*keys, F.posexplode("block").alias("pos", "val")).groupBy(*keys, "pos").agg(F.sum("val").alias("val"))
    # solving and scoring both start here: written once, so the panel itself is read once
    long = cut_lineage(long)
    return Blocks(long, cell, "__c", terms, len(periods), absorb)


def _unpack(block: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = block[: k * (k + 1) // 2]
    return m + np.triu(m, 1).T


def _pinv(a: np.ndarray) -> tuple[np.ndarray, int]:
    """Pseudo-inverse after scaling to unit diagonal, and the rank."""
    d = np.sqrt(np.maximum(np.diag(a), 0))
    s = np.where(d > 1e-12 * max(d.max(initial=0.0), 1e-300), 1 / np.where(d > 0, d, 1), 0.0)
    w, v = np.linalg.eigh(a * s[:, None] * s[None, :])
    keep = w > 1e-9
    inv = (v[:, keep] / w[keep]) @ v[:, keep].T
    return inv * s[:, None] * s[None, :], int(keep.sum())


def own_variation(x: np.ndarray, inv: np.ndarray, p: int) -> list[bool]:
    """For the first p regressors: does each carry something that the others do not explain?"""
    proj = inv @ x
    scale = np.sqrt(np.maximum(np.diag(x), 0))
    out = []
    for i in range(p):
        others = np.abs(np.delete(proj[i], i) * scale[i] / np.maximum(np.delete(scale, i), 1e-300)).max(initial=0.0)
        out.append(bool(scale[i] > 1e-9 and abs(proj[i, i] - 1) < 1e-6 and others < 1e-5))
    return out


def _solve(k: int, p: int, absorb: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for blk in f["block"]:
                a = np.asarray(blk, dtype=float)
                m = _unpack(a, k)
                x, b, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
                inv, rank = _pinv(x)
                beta = inv @ b
                own = own_variation(x, inv, p)
                # residual cross products without the regressors of interest: for the within R-squared
                rest, _ = _pinv(x[p:, p:])
                ssy = yy - b[p:] @ rest @ b[p:]
                ssr = yy - b @ beta
                n, units = a[-2], a[-1]
                out.append((beta[:p].tolist(), beta.tolist(), inv[:p].ravel().tolist(), own, rank + (int(units) if absorb else 0), int(n), int(units), max(ssr, 0.0),
                            1 - ssr / ssy if ssy > 1e-12 * max(yy, 1e-300) else None))
            keys = f.drop(columns="block").reset_index(drop=True)
            cols = ["coef", "beta", "bread", "own", "rank", "n_obs", "n_units", "ssr", "r2_within"]
            yield pd.concat([keys, pd.DataFrame(out, columns=cols)], axis=1)

    return run


def _cell_schema(df: DataFrame, keys: Sequence[str], more: str) -> str:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    return f"{kinds}, {more}" if kinds else more


def solve_cells(b: Blocks) -> DataFrame:
    """Coefficients per cell; one fixed-size block per cell reaches the solver."""
    whole = b.gather(b.cell)
    more = "coef array<double>, beta array<double>, bread array<double>, own array<boolean>, rank int, n_obs long, n_units long, ssr double, r2_within double"
    return whole.mapInPandas(_solve(b.k, len(b.terms), b.absorb), _cell_schema(whole, b.cell, more))


def _scores(k: int, p: int, keys: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for blk, beta, bread in zip(f["block"], f["beta"], f["bread"]):
                m = _unpack(np.asarray(blk, dtype=float), k)
                s = m[:-1, -1] - m[:-1, :-1] @ np.asarray(beta, dtype=float)
                out.append((np.asarray(bread, dtype=float).reshape(p, k - 1) @ s).tolist())
            yield f[keys].assign(u=out)

    return run


def cluster_scores(b: Blocks, sol: DataFrame) -> DataFrame:
    """Per (cell, cluster): its contribution to each coefficient, as an array ``u``."""
    per = b.gather([*b.cell, b.cluster])
    j = join_on(per, sol.select(*b.cell, "beta", "bread"), b.cell)
    keys = [*b.cell, b.cluster]
    return j.mapInPandas(_scores(b.k, len(b.terms), keys), _cell_schema(j, keys, "u array<double>"))


def panel_ols(b: Blocks, small_sample: str = "cr1", redundant: int = 0) -> DataFrame:
    """One row per (cell, term): estimate, cluster-robust error, counts, status.

    K is the rank of the full design; ``redundant`` adds columns that a design
    counted although they carry nothing.  A term whose regressor has no
    variation left after the other effects is ``not_estimable``.
    """
    p = len(b.terms)
    sol = solve_cells(b)
    sc = cluster_scores(b, sol)
    meat = sc.groupBy(*b.cell).agg(F.count(F.lit(1)).alias("n_clusters"), F.array(*[F.sum(F.col("u")[i] * F.col("u")[i]) for i in range(p)]).alias("meat"))
    r = join_on(sol, meat, b.cell)
    g, n, k = F.col("n_clusters"), F.col("n_obs"), F.col("rank") + redundant
    factor = g / (g - 1)
    if small_sample == "cr1":
        factor = factor * (n - 1) / F.nullif(n - k, F.lit(0))
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(t).alias("term"), F.col("coef")[i].alias("est"), F.col("meat")[i].alias("meat"), F.col("own")[i].alias("own"))
        for i, t in enumerate(b.terms)
    ]))
    r = r.withColumn("r", rows)
    ok = F.col("r.own") & (g > 1) & (n > k)
    return r.select(
        *b.cell, F.col("r.term").alias("term"), F.when(ok, F.col("r.est")).alias("est"), F.when(ok, F.sqrt(F.col("r.meat") * factor)).alias("se"),
        "n_obs", "n_units", "n_clusters", k.alias("k"), "r2_within", "ssr", F.when(ok, "ok").otherwise("not_estimable").alias("status"),
    )


def classical_within(b: Blocks) -> DataFrame:
    """Homoskedastic error of a single regressor after absorbing both effects.

    Degrees of freedom count the absorbed effects only: n - G - T + 1.
    """
    sol = solve_cells(b)
    dof = F.greatest(F.col("n_obs") - F.col("rank") + 1, F.lit(1))
    ok = F.col("own")[0]
    se = F.sqrt(F.col("ssr") / dof * F.col("bread")[0])
    return sol.select(*b.cell, F.when(ok, F.col("coef")[0]).alias("est"), F.when(ok, se).alias("se"), "n_obs", dof.alias("dof"), F.when(ok, "ok").otherwise("not_estimable").alias("status"))


# --- designs -------------------------------------------------------------------------


def static_did(df: DataFrame, cell: Sequence[str], unit: str, period: str, periods: Sequence[int], y: str, treat: str, post: str, cluster: str | None = None, small_sample: str = "cr1") -> DataFrame:
    d = F.col(treat) * F.col(post)
    b = panel_blocks(df, cell, unit, cluster or unit, period, periods, y, {"did": d})
    return panel_ols(b, small_sample).drop("term").withColumnRenamed("est", "tau")


def event_blocks(df: DataFrame, cell: Sequence[str], unit: str, period: str, periods: Sequence[int], y: str, treat: str, reference: int, cluster: str | None = None) -> Blocks:
    regs = {str(t): F.col(treat) * (F.col(period) == int(t)).cast("int") for t in periods if t != reference}
    return panel_blocks(df, cell, unit, cluster or unit, period, periods, y, regs)


def event_study(df: DataFrame, cell: Sequence[str], unit: str, period: str, periods: Sequence[int], y: str, treat: str, reference: int, cluster: str | None = None, redundant: int = 0) -> DataFrame:
    """Treatment x period coefficients against a reference period, which is kept as a zero row.

    Several rows of a unit in one period all count; reduce them first if they
    are repeats of one measurement.
    """
    r = panel_ols(event_blocks(df, cell, unit, period, periods, y, treat, reference, cluster), redundant=redundant)
    out = r.select(*cell, F.col("term").cast("int").alias("period"), F.col("est").alias("beta"), "se", "n_obs", "status")
    ref = out.select(*cell, "n_obs").distinct().select(*cell, F.lit(int(reference)).alias("period"), F.lit(0.0).alias("beta"), F.lit(0.0).alias("se"), "n_obs", F.lit("reference").alias("status"))
    return out.unionByName(ref)


def wald_diagonal(rows: DataFrame, cell: Sequence[str], before: int) -> DataFrame:
    """Sum of squared t over the leads, with its chi-square tail."""
    lead = rows.where((F.col("status") == "ok") & (F.col("period") < before))
    z = F.try_divide(F.col("beta"), F.col("se"))
    g = lead.groupBy(*cell).agg(F.sum(z * z).alias("chi2"), F.count(z).alias("dof"))
    return g.withColumn("p_value", chi2_p("chi2", F.col("dof").cast("double")))


def wald_joint(b: Blocks, terms: Sequence[str]) -> DataFrame:
    """Joint test of several terms with their full clustered covariance."""
    idx = [b.terms.index(t) for t in terms]
    sol = solve_cells(b)
    sc = cluster_scores(b, sol)
    outer = F.array(*[F.sum(F.col("u")[i] * F.col("u")[j]) for i in idx for j in idx])
    r = join_on(sol, sc.groupBy(*b.cell).agg(F.count(F.lit(1)).alias("n_clusters"), outer.alias("v")), b.cell)
    keep = list(b.cell)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for coef, v, g, n, k in zip(f["coef"], f["v"], f["n_clusters"], f["n_obs"], f["rank"]):
                beta = np.asarray(coef, dtype=float)[idx]
                cov = np.asarray(v, dtype=float).reshape(len(idx), -1) * g / (g - 1) * (n - 1) / (n - k)
                inv, rank = _pinv(cov)
                out.append((float(beta @ inv @ beta), rank))
            yield pd.concat([f[keep].reset_index(drop=True), pd.DataFrame(out, columns=["chi2", "dof"])], axis=1)

    w = r.mapInPandas(solve, _cell_schema(r, keep, "chi2 double, dof int"))
    return w.withColumn("p_value", chi2_p("chi2", F.col("dof").cast("double")))


def one_pass_did(df: DataFrame, cell: Sequence[str], unit: str, period: str, y: str, d: str, cluster: str) -> DataFrame:
    """Effect after one round of unit and period demeaning.

    Exact for balanced panels only; kept to reproduce results computed that way
    on unbalanced ones.
    """
    cell = list(cell)
    x = df.select(*cell, unit, period, cluster, F.col(y).cast("double").alias("__y"), F.col(d).cast("double").alias("__d")).where("__y is not null")
    x = deviation(x, [*cell, unit], ["__y", "__d"], "1")
    x = deviation(x, [*cell, period], ["__y1", "__d1"], "2")
    x = x.select(*cell, unit, cluster, F.col("__y12").alias("yd"), F.col("__d12").alias("dd"))
    per = x.groupBy(*cell, cluster).agg(F.sum(F.col("yd") * F.col("dd")).alias("xy"), F.sum(F.col("dd") * F.col("dd")).alias("xx"), F.count(F.lit(1)).alias("n"))
    tot = per.groupBy(*cell).agg(F.sum("xy").alias("sxy"), F.sum("xx").alias("sxx"), F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("n_clusters"))
    tot = tot.withColumn("tau", F.when(F.col("sxx") > 1e-10, F.try_divide("sxy", "sxx")))
    sc = F.col("xy") - F.col("tau") * F.col("xx")
    meat = join_on(per.drop("n"), tot, cell).groupBy(*cell).agg(F.sum(sc * sc).alias("meat"))
    g = F.col("n_clusters")
    return join_on(tot, meat, cell).select(*cell, "tau", (F.sqrt(F.col("meat") * g / (g - 1)) / F.col("sxx")).alias("se"), "n_obs", "n_clusters", F.when(F.col("tau").isNull(), "not_estimable").otherwise("ok").alias("status"))


def missingness_verdict(est: str, p_value: str, small: float = 0.05, alpha: float = 0.10) -> Column:
    """Is the failure rate unrelated to treatment?"""
    return F.when((F.abs(est) < small) & (F.col(p_value) > alpha), "ignorable").otherwise("possibly selective")


def pretrend_slope(df: DataFrame, cell: Sequence[str], unit: str, period: str, y: str, treat: str, first_post: int, min_rows: int = 6, min_dof: int = 2) -> DataFrame:
    """Slope difference before treatment, with unit effects; thin cells keep a row and a note."""
    pre = df.where((F.col(period) < first_post) & F.col(y).isNotNull())
    b = panel_blocks(pre, cell, unit, unit, None, [], y, {"t": F.col(period), "t_treat": F.col(period) * F.col(treat)})
    r = panel_ols(b).where("term = 't_treat'")
    dof = F.col("n_obs") - (F.col("n_units") + 3)
    enough = (F.col("n_obs") >= min_rows) & (dof >= min_dof) & (F.col("status") == "ok")
    note = F.when(F.col("n_obs") < min_rows, "too few rows").when(dof < min_dof, "too few degrees of freedom").when(F.col("status") != "ok", "too few periods").otherwise("cluster")
    return r.select(*cell, F.when(enough, F.col("est")).alias("slope"), F.when(enough, F.col("se")).alias("se"), F.col("n_obs").alias("n_pre"), note.alias("note"))
