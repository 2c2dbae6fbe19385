"""Placebo assignments, leave-one-out refits, the wild cluster bootstrap, power.

All of them start from per-unit contrasts or per-cluster blocks: the panel is
read once and replicates multiply only those small tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.distributions import t_quantile
from furrow.functions.ranking import exact_quantiles, join_on
from furrow.functions.scalar import hash_key, hash_uniform
from furrow.operators.did import (
    Blocks,
    _cell_schema,
    _pinv,
    _unpack,
    did_from_contrasts,
    own_variation,
    unit_contrasts,
)

MAX_ENUMERATED = 20


def indexed_units(c: DataFrame, cell: Sequence[str], unit: str, max_units: int = MAX_ENUMERATED) -> DataFrame:
    """Number units 0.. within a cell and stop the query where enumeration is out of reach."""
    w = Window.partitionBy(*cell).orderBy(unit)
    idx = c.withColumn("idx", F.row_number().over(w) - 1).withColumn("g", F.count(F.lit(1)).over(Window.partitionBy(*cell)))
    guard = F.when(F.col("g") <= max_units, F.col("idx")).otherwise(F.raise_error(F.concat(F.lit("too many units to enumerate: "), F.col("g").cast("string"))))
    return idx.withColumn("idx", guard.cast("int"))


def in_space_placebo(df: DataFrame, cell: Sequence[str], unit: str, period: str, y: str, treat: str, post: str, assignments: str = "enumerated", draws: int = 9999, seed: int = 42) -> DataFrame:
    """Effect under assignments of as many treated units as there are; the real one is flagged.

    ``enumerated`` takes every assignment: after the panel has shrunk to one row per unit, each is
    repeated once per bit mask (2^G of them, G guarded). ``hashed`` takes the real one and as many
    drawn ones as asked for, at any number of units; ``mask`` is then the draw, 0 the real one.
    """
    cell = list(cell)
    c = unit_contrasts(df, cell, unit, period, y, post, treat).withColumn("real", F.col(treat).cast("int"))
    if assignments == "hashed":
        return _hashed_assignments(c, cell, unit, draws, seed)
    if assignments != "enumerated":
        raise ValueError(f"assignments: {assignments}")
    c = indexed_units(c, cell, unit)
    wc = Window.partitionBy(*cell)
    c = c.withColumn("n_treated", F.sum("real").over(wc)).withColumn("real_mask", F.sum(F.call_function("shiftleft", F.col("real"), F.col("idx"))).over(wc))
    masks = F.filter(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("g").cast("int")) - 1), lambda m: F.bit_count(m) == F.col("n_treated"))
    e = c.withColumn("mask", F.explode(masks)).withColumn("s", F.expr("shiftright(mask, idx) & 1"))
    return _assigned(e, cell, unit, F.col("mask") == F.col("real_mask"))


def _hashed_assignments(c: DataFrame, cell: list[str], unit: str, draws: int, seed: int) -> DataFrame:
    """The real assignment and ``draws`` others, each the units of least hash."""
    e = c.withColumn("n_treated", F.sum("real").over(Window.partitionBy(*cell))).withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    order = Window.partitionBy(*cell, "mask").orderBy(hash_key(unit, "mask", seed=seed), unit)
    drawn = (F.row_number().over(order) <= F.col("n_treated")).cast("int")
    return _assigned(e.withColumn("s", F.when(F.col("mask") == 0, F.col("real")).otherwise(drawn)), cell, unit, F.col("mask") == 0)


def _assigned(e: DataFrame, cell: list[str], unit: str, is_real: Column) -> DataFrame:
    est = did_from_contrasts(e, [*cell, "mask"], "s", small_sample="g")
    info = e.groupBy(*cell, "mask").agg(
        F.max(is_real).alias("is_real"),
        F.concat_ws("|", F.sort_array(F.collect_list(F.when(F.col("s") == 1, F.col(unit).cast("string"))))).alias("treated"),
    )
    return join_on(est, info, [*cell, "mask"])


def summarise_placebo(p: DataFrame, cell: Sequence[str], alpha: float = 0.10) -> DataFrame:
    """p = (extreme + 1)/assignments, the real one among them; no estimate, no verdict."""
    real, other = F.col("is_real"), ~F.col("is_real")
    w = p.withColumn("tau_real", F.max(F.when(real, F.col("tau"))).over(Window.partitionBy(*cell)))
    t = F.when(other, F.col("tau"))
    # the group is the assignments, bounded by the unit guard or the draws
    g = w.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_perm"), F.max("tau_real").alias("tau_real"), F.percentile(t, F.lit(0.5)).alias("median"), F.percentile(t, F.lit(0.05)).alias("p05"),
        F.percentile(t, F.lit(0.95)).alias("p95"), F.max(F.abs(t)).alias("max_abs"), F.count(F.when(F.abs(t) >= F.abs("tau_real") - 1e-9, 1)).alias("n_extreme"),
    )
    pv = F.when(F.col("tau_real").isNotNull(), (F.col("n_extreme") + 1) / F.col("n_perm"))
    verdict = F.when(pv.isNull(), "not_estimable").when(pv <= alpha, "passes").otherwise("fails")
    return g.withColumn("p_perm", pv).withColumn("verdict", verdict)


# --- leave one out ------------------------------------------------------------------


def leave_unit_out(df: DataFrame, cell: Sequence[str], unit: str, period: str, y: str, treat: str, post: str) -> DataFrame:
    """Balanced refits without one unit each, from sums less that unit's share.

    Scores of the rest depend on the dropped unit only through two means, so the
    squared scores expand into cell-level sums: no unit pairs are formed.
    """
    cell = list(cell)
    c = unit_contrasts(df, cell, unit, period, y, post, treat).withColumn("s", F.col(treat).cast("double")).drop(treat)
    a, s = F.col("A"), F.col("s")
    m = c.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("G"), F.max("n_periods").alias("T"), F.max("Q").alias("q"), F.min("complete").alias("full"),
        F.sum(s).alias("S1"), F.sum((1 - s)).alias("S0"), F.sum(s * a).alias("A1"), F.sum((1 - s) * a).alias("A0"), F.sum(s * a * a).alias("AA1"), F.sum((1 - s) * a * a).alias("AA0"),
    )
    j = join_on(c.drop("n_periods", "Q", "complete", "n_rows"), m, cell)
    n1, n0 = F.col("S1") - s, F.col("S0") - (1 - s)
    a1, a0 = F.col("A1") - s * a, F.col("A0") - (1 - s) * a
    aa1, aa0 = F.col("AA1") - s * a * a, F.col("AA0") - (1 - s) * a * a
    g = F.col("G") - 1
    sbar, abar, q = n1 / g, (a1 + a0) / g, F.col("q")
    sxx = g * sbar * (1 - sbar) * q
    ok = F.col("full") & (n1 > 0) & (n0 > 0) & (q > 1e-12) & (g > 1)
    tau = (a1 - sbar * (a1 + a0)) / F.when(ok, sxx)

    def squares(w: Column, aa: Column, asum: Column, n: Column) -> Column:
        shift = abar + tau * w * q
        return w * w * (aa - 2 * shift * asum + n * shift * shift)

    meat = squares(1 - sbar, aa1, a1, n1) + squares(-sbar, aa0, a0, n0)
    n = g * F.col("T")
    k = g + F.col("T")
    se = F.sqrt(F.greatest(meat, F.lit(0.0)) * g / (g - 1) * (n - 1) / (n - k)) / sxx
    full_bar = F.col("S1") / F.col("G")
    full = (F.col("A1") - full_bar * (F.col("A1") + F.col("A0"))) / F.nullif(F.col("G") * full_bar * (1 - full_bar) * q, F.lit(0.0))
    out = j.select(*cell, F.col(unit).alias("dropped"), s.cast("int").alias("treated"), F.when(ok, tau).alias("tau_loo"), F.when(ok, se).alias("se_loo"), full.alias("tau_full"), F.when(ok, "ok").otherwise("not_estimable").alias("note"))
    return out.withColumn("delta_pct", F.when(F.abs("tau_full") > 1e-9, 100 * (F.col("tau_loo") - F.col("tau_full")) / F.abs("tau_full")))


def leave_period_out(df: DataFrame, cell: Sequence[str], unit: str, period: str, y: str, treat: str, post: str) -> DataFrame:
    """Balanced refits without one period each: every row carries its own drop, nothing is replicated."""
    cell = list(cell)
    t = df.groupBy(*cell, unit, period).agg(F.avg(y).alias("y"), F.max(post).cast("double").alias("p"), F.max(treat).cast("double").alias("s"))
    per = t.groupBy(*cell, period).agg(F.max("p").alias("p")).groupBy(*cell).agg(F.count(F.lit(1)).alias("T"), F.sum("p").alias("M"))
    tot = t.groupBy(*cell, unit).agg(F.sum(F.col("p") * F.col("y")).alias("sum_py"), F.sum("y").alias("sum_y"), F.count("y").alias("n"))
    j = join_on(join_on(t, tot, [*cell, unit]), per, cell)
    left, m = F.col("T") - 1, F.col("M") - F.col("p")
    pbar = m / left
    c = j.select(
        *cell, unit, F.col(period).alias("dropped"), F.col("s"), (F.col("sum_py") - F.col("p") * F.col("y") - pbar * (F.col("sum_y") - F.col("y"))).alias("A"),
        (left * pbar * (1 - pbar)).alias("Q"), left.alias("n_periods"), F.col("n").alias("n_rows"), (F.col("n") == F.col("T")).alias("complete"),
    )
    est = did_from_contrasts(c, [*cell, "dropped"], "s")
    return est.select(*cell, "dropped", F.col("tau").alias("tau_loo"), F.col("se").alias("se_loo"), F.when(F.col("status") == "ok", "ok").otherwise("not_estimable").alias("note"))


def leave_cluster_out(b: Blocks, small_sample: str = "cr1") -> DataFrame:
    """Refits of a panel, balanced or not, without one cluster each; the clusters are those of the data.

    A refit's cross products are the cell's less the cluster's own block, so nothing is copied. Its
    scores are linear in the blocks of the clusters that stay, and are one product with all of them.
    """
    cells = cell_clusters(b)
    more = "dropped string, term string, est double, se double, n_obs long, n_units long, n_clusters long, k int, status string"
    out = cells.mapInPandas(_left_out(b.k, b.terms, b.absorb, b.cell, small_sample), _cell_schema(cells, b.cell, more))
    kind = b.long.schema[b.cluster].dataType
    return out.withColumn("dropped", F.col("dropped").cast(kind))


def _left_out(k: int, terms: list[str], absorb: bool, cell: list[str], small_sample: str):
    p = len(terms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, clusters in enumerate(f["clusters"]):
                raw, stack = _stack(clusters, k)
                whole, counts = stack.sum(axis=0), raw[:, -2:].sum(axis=0)
                g, out = len(stack) - 1, []
                for c, own in enumerate(clusters):
                    m, (n, units) = whole - stack[c], counts - raw[c, -2:]
                    x, xy = m[:-1, :-1], m[:-1, -1]
                    inv, rank = _pinv(x)
                    beta = inv @ xy
                    score = (stack[:, :-1, -1] - stack[:, :-1, :-1] @ beta) @ inv[:p].T
                    meat = (score * score).sum(axis=0) - score[c] ** 2
                    used = rank + (int(units) if absorb else 0)
                    for i, (term, fine) in enumerate(zip(terms, own_variation(x, inv, p))):
                        fine = fine and g > 1 and n > used
                        factor = g / (g - 1) * ((n - 1) / (n - used) if small_sample == "cr1" else 1.0) if fine else np.nan
                        out.append((own["name"], term, beta[i] if fine else None, np.sqrt(max(meat[i], 0.0) * factor) if fine else None, int(n), int(units), g, used, "ok" if fine else "not_estimable"))
                keys = pd.concat([f[cell].iloc[[at]]] * len(out), ignore_index=True)
                yield pd.concat([keys, pd.DataFrame(out, columns=["dropped", "term", "est", "se", "n_obs", "n_units", "n_clusters", "k", "status"])], axis=1)

    return run


def verdicts(loo: DataFrame, cell: Sequence[str], leverage_pct: float = 25.0) -> DataFrame:
    """fragile (a sign flips), leverage (one unit moves the estimate far), or stable."""
    ok = loo.where("note = 'ok'")
    flip = F.signum("tau_loo") != F.signum("tau_full")
    g = ok.groupBy(*cell).agg(
        F.max("tau_full").alias("tau_full"), F.max(F.abs("delta_pct")).alias("max_abs_delta_pct"), F.max(flip.cast("int")).alias("__flip"),
        F.max_by("dropped", F.struct(F.abs("delta_pct"), -F.col("dropped") if dict(loo.dtypes)["dropped"] != "string" else F.lit(0))).alias("driver"),
    )
    v = F.when(F.col("__flip") == 1, "fragile").when(F.col("max_abs_delta_pct") > leverage_pct, "leverage").otherwise("stable")
    return g.select(*cell, "tau_full", "max_abs_delta_pct", "driver", v.alias("verdict"))


# --- wild cluster bootstrap -------------------------------------------------------------

DRAWS_PER_TASK = 512


def cell_clusters(b: Blocks) -> DataFrame:
    """One row per cell: its clusters in order, each with its block. A cell's clusters, not its rows, must fit a task."""
    per = b.gather([*b.cell, b.cluster]).withColumn("name", F.col(b.cluster).cast("string"))
    return per.groupBy(*b.cell).agg(F.sort_array(F.collect_list(F.struct(F.col(b.cluster).alias("at"), "name", "block"))).alias("clusters"))


def _stack(clusters: Sequence, k: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.array([c["block"] for c in clusters], dtype=float)
    return raw, np.stack([_unpack(r, k) for r in raw])


def signs_of(names: Sequence[str], start: int, stop: int, signs: str, seed: int) -> np.ndarray:
    """Sign vectors of the draws start..stop, one row each: the bits of the draw, or of a hash of (cluster, draw)."""
    draws = np.arange(start, stop)
    if signs == "enumerated":
        up = (draws[:, None] >> np.arange(len(names))) & 1
    else:  # hash_uniform(cluster, draw) in the upper half
        up = np.array([[md5(f"{c}|{d}|{seed}".encode()).hexdigest()[0] >= "8" for c in names] for d in draws.tolist()], dtype=int).reshape(len(draws), len(names))
    return 2.0 * up - 1.0


class Influence:
    """What one cell's clusters contribute to estimate and scores, from which any replicate is a product.

    A restricted replicate with signs w has, for a tested value tau0, the estimate tau0 + shift0.w -
    tau0 shift1.w and the scores s0 - tau0 s1, both linear in w; s0 and s1 are products with the
    clusters' influence matrix, kept as its two thin factors.
    """

    def __init__(self, raw: np.ndarray, stack: np.ndarray, absorb: bool):
        whole, (n, units) = stack.sum(axis=0), raw[:, -2:].sum(axis=0)
        x, xy, m = whole[:-1, :-1], whole[:-1, -1], stack[:, :-1, :-1]
        inv, rank = _pinv(x)
        rest, _ = _pinv(x[1:, 1:])
        row, beta = inv[0], inv @ xy
        b0, b1 = (np.concatenate([[0.0], rest @ v[1:]]) for v in (xy, x[:, 0]))
        self.q0, self.q1 = stack[:, :-1, -1] - m @ b0, m[:, :, 0] - m @ b1
        self.shift0, self.shift1 = self.q0 @ row, self.q1 @ row
        self.r = np.einsum("i,gij,jk->gk", row, m, inv)
        g, k = len(stack), rank + (int(units) if absorb else 0)
        self.ok = own_variation(x, inv, 1)[0] and g > 1 and n > k
        self.factor = g / (g - 1) * (n - 1) / (n - k) if self.ok else np.nan
        score = (stack[:, :-1, -1] - m @ beta) @ row
        self.tau, self.se = beta[0], np.sqrt((score * score).sum() * self.factor)

    def replicates(self, w: np.ndarray, tau0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate less tau0, error) of every draw and tested value."""
        s0 = w * self.shift0 - (w @ self.q0) @ self.r.T
        s1 = w * self.shift1 - (w @ self.q1) @ self.r.T
        s00, s01, s11 = ((a * b).sum(axis=1)[:, None] for a, b in ((s0, s0), (s0, s1), (s1, s1)))
        ss = s00 - 2 * tau0 * s01 + tau0 * tau0 * s11
        return (w @ self.shift0)[:, None] - tau0 * (w @ self.shift1)[:, None], np.sqrt(np.maximum(ss, 0.0) * self.factor)


def _draw_ranges(k: int, absorb: bool, cell: list[str], offsets: Sequence[float] | None, studentise_at: str, signs: str, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, (clusters, start, total) in enumerate(zip(f["clusters"], f["start"], f["total"])):
                inf = Influence(*_stack(clusters, k), absorb)
                tau0 = np.zeros(1) if offsets is None else inf.tau + np.array(offsets) * inf.se
                w = signs_of([c["name"] for c in clusters], start, min(start + DRAWS_PER_TASK, total), signs, seed)
                shift, se = inf.replicates(w, tau0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(se > 0, (shift if studentise_at == "tau0" else tau0 + shift) / se, np.nan)
                    t_obs = (inf.tau - tau0 if studentise_at == "tau0" else np.full(len(tau0), inf.tau)) / (inf.se if inf.se > 0 else np.nan)
                known = np.isfinite(t)
                out = pd.DataFrame({
                    "gi": np.arange(len(tau0), dtype="int32"), "tau": inf.tau, "se": inf.se, "tau0": tau0, "t_obs": t_obs, "n": known.sum(axis=0),
                    "m": (known & (np.abs(np.where(known, t, 0.0)) >= np.abs(t_obs) - 1e-9)).sum(axis=0),
                })
                if not inf.ok or not inf.se > 0:
                    out[["tau0", "t_obs"]] = None
                    out[["tau", "se"]] = (inf.tau, inf.se) if inf.ok else None
                yield pd.concat([pd.concat([f[cell].iloc[[at]]] * len(out), ignore_index=True), out], axis=1)

    return run


def _bootstrap(b: Blocks, draws: int, seed: int, signs: str, offsets: Sequence[float] | None = None, studentise_at: str = "tau0") -> DataFrame:
    """Per (cell, tested value): draws and how many of them are as extreme as the observed statistic.

    The cell's block is paired with ranges of draws; each range is one product, and only its counts
    leave the task.
    """
    if signs not in ("enumerated", "hashed"):
        raise ValueError(f"signs: {signs}")
    g = F.size("clusters")
    total = F.lit(draws)
    if signs == "enumerated":
        stop = F.raise_error(F.concat(F.lit("too many clusters to enumerate: "), g.cast("string"))).cast("int")
        total = F.when(g <= MAX_ENUMERATED, F.call_function("shiftleft", F.lit(1), g)).otherwise(stop)
    c = cell_clusters(b).withColumn("total", total).withColumn("start", F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(DRAWS_PER_TASK))))
    c = c.repartition(*b.cell, "start")
    more = "gi int, tau double, se double, tau0 double, t_obs double, n long, m long"
    r = c.mapInPandas(_draw_ranges(b.k, b.absorb, b.cell, offsets, studentise_at, signs, seed), _cell_schema(c, b.cell, more))
    s = r.groupBy(*b.cell, "gi").agg(*[F.max(x).alias(x) for x in ("tau", "se", "tau0", "t_obs")], F.sum("n").alias("n"), F.sum("m").alias("m"))
    p = F.try_divide("m", "n") if signs == "enumerated" else (F.col("m") + 1) / (F.col("n") + 1)
    return s.withColumn("p", F.when(F.col("t_obs").isNotNull(), p))


def wild_bootstrap_p(b: Blocks, draws: int = 9999, seed: int = 42, signs: str = "enumerated") -> DataFrame:
    """Two-sided p of the restricted bootstrap at zero.

    ``enumerated`` signs divide by the number of sign vectors and do not use ``draws``;
    ``hashed`` ones, for many clusters, use (1 + extreme)/(1 + draws).
    """
    r = _bootstrap(b, draws, seed, signs)
    return r.select(*b.cell, "tau", "t_obs", F.col("n").alias("n_draws"), F.col("m").alias("n_extreme"), F.lit(signs == "enumerated").alias("exact"), F.col("p").alias("p_wcb"))


def wild_bootstrap_ci(b: Blocks, draws: int = 999, seed: int = 42, alpha: float = 0.05, n_grid: int = 41, half_width: float = 8.0, studentise_at: str = "tau0", signs: str = "enumerated") -> DataFrame:
    """Interval of values the bootstrap test does not reject, on a grid of +-half_width errors.

    ``signs`` as in wild_bootstrap_p.  ``studentise_at='zero'`` centres both statistics at
    zero and only serves to reproduce intervals computed that way.
    """
    step = 2.0 * half_width / (n_grid - 1)
    acc = _bootstrap(b, draws, seed, signs, [i * step - half_width for i in range(n_grid)], studentise_at).where("se > 0")
    ok = F.col("p") >= alpha
    return acc.groupBy(*b.cell).agg(
        F.max("tau").alias("tau"), F.max("se").alias("se"), F.min(F.when(ok, F.col("tau0"))).alias("ci_lo"), F.max(F.when(ok, F.col("tau0"))).alias("ci_hi"),
        F.max(F.when(F.col("gi") == 0, ok)).alias("ci_open_lo"), F.max(F.when(F.col("gi") == n_grid - 1, ok)).alias("ci_open_hi"),
    ).withColumn("studentised", F.lit(studentise_at))


# --- power --------------------------------------------------------------------------


def minimum_detectable(est: DataFrame, tau: str, se: str, clusters: str, alpha: float = 0.05, power: float = 0.80) -> DataFrame:
    """(t_{1-a/2} + t_power) * se with G-1 degrees of freedom, two- and one-sided."""
    d = (F.col(clusters) - 1).cast("double")
    q = lambda p: t_quantile(F.lit(p), d)
    two, one = (q(1 - alpha / 2) + q(power)) * F.col(se), (q(1 - alpha) + q(power)) * F.col(se)
    good = F.coalesce(F.col(se) > 1e-9, F.lit(False))
    out = est.withColumn("mde_two", F.when(good, two)).withColumn("mde_one", F.when(good, one))
    flag = F.when(~good, "not_estimable").when(F.abs(tau) >= F.col("mde_two"), "yes").otherwise("no")
    return out.withColumn("tau_over_mde", F.try_divide(F.abs(tau), F.col("mde_two"))).withColumn("detectable", flag)


def rule_of_thumb_mde(se: Column, factor: float = 2.8) -> Column:
    return F.when(se > 1e-9, se * factor)


def power_curve(df: DataFrame, cell: Sequence[str], unit: str, period: str, y: str, post: str, taus: Sequence[float], sizes: Sequence[int], reps: int, t_crit: dict[int, float], seed: int = 42) -> DataFrame:
    """Rejection rate when clusters are redrawn from the observed panel and an effect is added.

    A replicate draws G units with replacement by hash; the first half is treated.  It is used
    through four numbers, mean and variance of the contrasts of either half.  An effect added to
    treated post cells moves the estimate by its own size and leaves the scores as they are, so
    every effect is read off the same replicate.  A replicate without error rejects nothing.
    """
    cell = list(cell)
    c = unit_contrasts(df, cell, unit, period, y, post)
    w = Window.partitionBy(*cell)
    c = c.withColumn("idx", F.row_number().over(w.orderBy(unit)) - 1).withColumn("n_pool", F.count(F.lit(1)).over(w))
    cells = c.groupBy(*cell).agg(F.max("n_pool").alias("n_pool"))
    plan = cells.withColumn("G", F.explode(F.array(*[F.lit(int(g)) for g in sizes]))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    slots = plan.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("G") - 1)))
    slots = slots.withColumn("idx", F.floor(hash_uniform("G", "rep", "slot", seed=seed) * F.col("n_pool")).cast("int")).drop("n_pool")
    drawn = join_on(slots, c.drop("n_pool"), [*cell, "idx"])
    half = F.floor(F.col("G") / 2)
    in_half = lambda agg, first: agg(F.when((F.col("slot") < half) == F.lit(first), F.col("A")))
    r = drawn.groupBy(*cell, "G", "rep").agg(
        in_half(F.avg, True).alias("m1"), in_half(F.avg, False).alias("m0"), in_half(F.var_pop, True).alias("v1"), in_half(F.var_pop, False).alias("v0"), F.max("Q").alias("q"), F.min("complete").alias("full")
    )
    g, n1 = F.col("G").cast("double"), half.cast("double")
    s = n1 / g
    meat = (1 - s) * (1 - s) * n1 * F.col("v1") + s * s * (g - n1) * F.col("v0")
    se = F.sqrt(meat * g / (g - 1)) / (g * s * (1 - s) * F.col("q"))
    r = r.where(F.col("full") & (F.col("q") > 1e-12)).select(*cell, "G", ((F.col("m1") - F.col("m0")) / F.col("q")).alias("tau"), se.alias("se"))
    crit = F.create_map(*[F.lit(z) for kv in t_crit.items() for z in kv])[F.col("G")]
    e = r.withColumn("tau_true", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    rejected = (F.col("se") > 1e-9) & (F.abs(F.col("tau") + F.col("tau_true")) > crit * F.col("se"))
    return e.groupBy(*cell, "G", "tau_true").agg(F.avg(rejected.cast("double")).alias("power"), F.count("tau").alias("n_reps"))


# --- transferability and bounds -----------------------------------------------------------


def transferability(deltas: DataFrame, unit: str, tau: float | Column, se: float | Column, sd: float | Column = 0.0) -> DataFrame:
    """Observed change against the predicted one with a 95 % prediction interval."""
    t, s, d = (x if isinstance(x, Column) else F.lit(float(x)) for x in (tau, se, sd))
    half = 1.96 * F.sqrt(s * s + d * d)
    out = deltas.withColumn("residual", F.col("delta") - t).withColumn("pi_lo", t - half).withColumn("pi_hi", t + half)
    return out.withColumn("inside", F.col("delta").between(F.col("pi_lo"), F.col("pi_hi")))


def transfer_verdict(rows: DataFrame, sd: str = "sd") -> DataFrame:
    g = rows.agg(
        F.count("delta").alias("n"), F.count(F.when(F.col("inside"), 1)).alias("n_in"), F.avg("residual").alias("mean_residual"), F.stddev_samp("residual").alias("sd_residual"), F.max(sd).alias("sd")
    )
    good = (F.col("n_in") >= F.ceil(0.83 * F.col("n"))) & (F.abs("mean_residual") < 1.96 * F.col("sd"))
    return g.withColumn("verdict", F.when(good, "pass").when(F.col("n_in") < F.floor(F.col("n") / 2), "fail").otherwise("ambiguous"))


def selection_bounds(est: DataFrame, tau: str, missing: str, sigma: str) -> DataFrame:
    """Worst-case tau -+ f*sigma and the narrower tau -+ sqrt(f)*sigma, with zero-coverage flags."""
    wide, narrow = F.col(missing) * F.col(sigma), F.sqrt(missing) * F.col(sigma)
    out = est.withColumns({
        "worst_lo": F.col(tau) - wide, "worst_hi": F.col(tau) + wide, "narrow_lo": F.col(tau) - narrow, "narrow_hi": F.col(tau) + narrow,
    })
    covers = lambda lo, hi: (F.col(lo) < 0) & (F.col(hi) > 0)
    return out.withColumn("null_worst", covers("worst_lo", "worst_hi")).withColumn("null_narrow", covers("narrow_lo", "narrow_hi"))


def trimmed(df: DataFrame, cell: Sequence[str], y: str, group: Column, share: float, side: str) -> DataFrame:
    """Drop the top (``lower`` bound) or bottom (``upper`` bound) share of a group's outcomes."""
    q = 1 - share if side == "lower" else share
    cut = exact_quantiles(df.where(group), cell, y, {"__cut": q})
    j = df.join(cut, list(cell), "left")
    keep = F.col(y) <= F.col("__cut") if side == "lower" else F.col(y) >= F.col("__cut")
    return j.where(~group | keep).drop("__cut")


def baci_contrast(df: DataFrame, cell: Sequence[str], y: str, treat: str, post: str) -> DataFrame:
    """(treated after - treated before) - (control after - control before) of group means."""
    m = lambda a, b: F.avg(F.when((F.col(treat) == a) & (F.col(post) == b), F.col(y)))
    g = df.groupBy(*cell).agg(m(1, 1).alias("m11"), m(1, 0).alias("m10"), m(0, 1).alias("m01"), m(0, 0).alias("m00"), F.count(y).alias("n_obs"))
    return g.withColumn("contrast", (F.col("m11") - F.col("m10")) - (F.col("m01") - F.col("m00")))

