"""Queries of the effect estimators and their resampling checks."""

from __future__ import annotations

from math import prod

from pyspark.sql import functions as F

from furrow.functions.distributions import t_ppf
from furrow.functions.ranking import attach_scalar, join_on
from furrow.operators import did as D
from furrow.operators import panel as P
from furrow.operators import resampling as R
from furrow.operators.season import baseline_delta
from furrow.plans.base import (
    LOCATED,
    LONG_PANEL,
    NATION_PANEL,
    POST,
    TIER_PANEL,
    complete,
    complete_sql,
    long_panel,
    nation_panel,
    orders_located,
    rnd,
    stored,
    tier_panel,
    years,
)
from furrow.plans.registry import query

CELL = ["product", "metric"]
# the balanced estimator needs whole years
NATION_WHOLE, LONG_WHOLE, TIER_WHOLE = map(complete_sql, (NATION_PANEL, LONG_PANEL, TIER_PANEL))


def did_sql(src: str, keys: str, out: str = "did", unit: str = "unit", extra: str = "(n - 1) / (n - k)", score_by: str | None = None) -> str:
    """Text of the balanced estimator: contrasts per unit, then estimate and error per key."""
    score_by = score_by or unit
    return f""", {out}_t AS (SELECT {keys}, count(DISTINCT year) AS tt, count(DISTINCT {unit}) AS g, avg(post) AS pb, avg(treat) AS sb FROM {src} GROUP BY {keys}),
    {out}_c AS (SELECT {keys}, {unit}, {score_by} AS cl, any_value(treat) AS s, sum((post - pb) * y) AS a FROM {src} JOIN {out}_t USING ({keys}) GROUP BY {keys}, {unit}, {score_by}),
    {out}_m AS (SELECT {keys}, tt, g, sb, tt * pb * (1 - pb) AS q, avg(a) AS ab, sum((s - sb) * a) / (g * sb * (1 - sb) * tt * pb * (1 - pb)) AS tau FROM {out}_c JOIN {out}_t USING ({keys}) GROUP BY {keys}, tt, g, sb, pb),
    {out}_s AS (SELECT {keys}, cl, sum((s - sb) * (a - ab) - tau * (s - sb) * (s - sb) * q) AS sc FROM {out}_c JOIN {out}_m USING ({keys}) GROUP BY {keys}, cl),
    {out}_e AS (SELECT {keys}, sum(sc * sc) AS meat, count(*)::DOUBLE AS ng FROM {out}_s GROUP BY {keys}),
    {out}_n AS (SELECT *, (g * tt)::DOUBLE AS n, (g + tt)::DOUBLE AS k FROM {out}_m JOIN {out}_e USING ({keys})),
    {out} AS (SELECT {keys}, tau, sqrt(meat * ng / (ng - 1) * ({extra})) / (g * sb * (1 - sb) * q) AS se, n::BIGINT AS n_obs, g AS n_units, ng::BIGINT AS n_clusters FROM {out}_n)"""


def one_cell(panel_of):
    """A panel as a single cell; stored, so that the cell is a data column and joins on it stay equi joins."""
    return lambda s, d: panel_of(s, d).withColumn("cell", F.lit("all"))


ALL = "SELECT 'all' AS cell, * FROM panel"


@query("e02_did_balanced", f"WITH {NATION_WHOLE}, pc AS ({ALL}) {did_sql('pc', 'cell')} SELECT cell, round(tau + 1e-9, 4) + 0.0 AS tau, round(se + 1e-9, 4) + 0.0 AS se, n_obs, n_units, 'ok' AS status FROM did")
def e02(s, d):
    r = D.balanced_did(stored(one_cell(complete(nation_panel)), s, d), ["cell"], "unit", "year", "y", "treat", "post")
    return r.select("cell", rnd("tau", 4).alias("tau"), rnd("se", 4).alias("se"), "n_obs", "n_units", "status")


def long_blocks(s, d, y="y"):
    return D.panel_blocks(long_panel(s, d), CELL, "unit", "unit", "year", years(s, d), y, {"did": F.col("treat") * F.col("post")})


@query(
    "e01_static_two_way_did",
    f"WITH {LONG_PANEL} {did_sql('long', 'product, metric')} SELECT product, metric, round(tau + 1e-9, 3) + 0.0 AS tau, round(se + 1e-9, 3) + 0.0 AS se, round(tau / se + 1e-9, 5) + 0.0 AS t_stat, n_obs, n_units, n_clusters, 'ok' AS status FROM did",
)
def e01(s, d):
    r = D.panel_ols(long_blocks(s, d))
    return r.select(*CELL, rnd("est", 3).alias("tau"), rnd("se", 3).alias("se"), rnd(F.col("est") / F.col("se"), 5).alias("t_stat"), "n_obs", "n_units", "n_clusters", "status")


#: Coefficients 2^n / (2n + 1)!! of the error function's series of positive terms.
ERF_TERMS = [2.0**n / prod(range(1, 2 * n + 2, 2)) for n in range(100)]


def normal_p_sql(t: str) -> str:
    """Two-sided normal tail of t."""
    x = f"abs({t}) / sqrt(2.0)"
    terms = f"list_sum(list_transform(range({len(ERF_TERMS)}), lambda i: ({ERF_TERMS}::DOUBLE[])[i + 1] * pow({x}, 2 * i + 1)))"
    return f"(CASE WHEN abs({t}) > 8 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-pow({x}, 2)) * {terms} END)"


@query(
    "e01_static_did_inference",
    f"""WITH {LONG_PANEL} {did_sql('long', 'product, metric')}, dd AS (SELECT product, metric, unit, year, y, treat * post * 1.0 AS x FROM long),
    dm AS (SELECT product, metric, y - avg(y) OVER (PARTITION BY product, metric, unit) - avg(y) OVER (PARTITION BY product, metric, year) + avg(y) OVER (PARTITION BY product, metric) AS yw,
      x - avg(x) OVER (PARTITION BY product, metric, unit) - avg(x) OVER (PARTITION BY product, metric, year) + avg(x) OVER (PARTITION BY product, metric) AS xw FROM dd),
    r2 AS (SELECT product, metric, pow(sum(xw * yw), 2) / sum(xw * xw) / sum(yw * yw) AS r2 FROM dm GROUP BY 1, 2)
    SELECT product, metric, round(tau + 1e-9, 3) + 0.0 AS est, round(se + 1e-9, 3) + 0.0 AS se, round(tau / se + 1e-9, 5) + 0.0 AS t_stat, round({normal_p_sql('(tau / se)')} + 1e-9, 6) + 0.0 AS p_value,
      round(tau - {D.Z95} * se + 1e-9, 3) + 0.0 AS ci_lo, round(tau + {D.Z95} * se + 1e-9, 3) + 0.0 AS ci_hi, round(r2 + 1e-9, 6) + 0.0 AS r2_within, n_obs, 'ok' AS status FROM did JOIN r2 USING (product, metric)""",
)
def e01_p(s, d):
    r = D.with_inference(D.panel_ols(long_blocks(s, d)), "est", "se")
    digits = {"est": 3, "se": 3, "t_stat": 5, "p_value": 6, "ci_lo": 3, "ci_hi": 3, "r2_within": 6}
    return r.select(*CELL, *[rnd(c, k).alias(c) for c, k in digits.items()], "n_obs", "status")


def es_sql(src: str, keys: str, ref: int) -> str:
    return f""", z AS (SELECT a.*, a.y - b.y AS z FROM {src} a JOIN {src} b ON {' AND '.join(f'a.{k} = b.{k}' for k in [*keys.split(', '), 'unit'])} AND b.year = {ref}),
    gm AS (SELECT {keys}, year, treat, avg(z) AS zb, count(*)::DOUBLE AS ng FROM z GROUP BY {keys}, year, treat),
    iv AS (SELECT {keys}, year, treat, sum((z - zb) * (z - zb)) / any_value(ng * ng) AS v, any_value(zb) AS zb, any_value(ng) AS ng FROM z JOIN gm USING ({keys}, year, treat) GROUP BY {keys}, year, treat),
    nn AS (SELECT {keys}, count(DISTINCT unit)::DOUBLE AS g, count(DISTINCT year)::DOUBLE AS tt FROM {src} GROUP BY {keys}),
    es AS (SELECT {keys}, year, sum(CASE WHEN treat = 1 THEN zb ELSE -zb END) AS beta, sqrt(sum(v) * any_value(g / (g - 1) * (g * tt - 1) / (g * tt - (g + 2 * (tt - 1))))) AS se, any_value((g * tt)::BIGINT) AS n_obs FROM iv JOIN nn USING ({keys}) GROUP BY {keys}, year)"""


@query(
    "e03_event_study",
    f"WITH {LONG_PANEL} {es_sql('long', 'product, metric', 1996)} SELECT product, metric, CAST(year - 1997 AS INTEGER) AS event_k, round(beta + 1e-9, 2) + 0.0 AS beta, round(CASE WHEN year = 1996 THEN 0 ELSE se END + 1e-9, 2) + 0.0 AS se, n_obs FROM es",
)
def e03(s, d):
    r = D.event_study(long_panel(s, d), CELL, "unit", "year", years(s, d), "y", "treat", 1996)
    return r.select(*CELL, (F.col("period") - 1997).alias("event_k"), rnd("beta", 2).alias("beta"), rnd("se", 2).alias("se"), "n_obs")


@query(
    "e04_calendar_leads_lags",
    f"WITH {TIER_PANEL}, pc AS ({ALL}) {es_sql('pc', 'cell', 1997)} SELECT CAST(year AS INTEGER) AS year, CASE WHEN year < 1997 THEN 'pre' ELSE 'post' END AS label, round(beta + 1e-9, 3) + 0.0 AS beta, round(CASE WHEN year = 1997 THEN 0 ELSE se END + 1e-9, 3) + 0.0 AS se FROM es",
)
def e04(s, d):
    r = D.event_study(one_cell(tier_panel)(s, d), ["cell"], "unit", "year", years(s, d), "y", "treat", 1997)
    return r.select(F.col("period").alias("year"), F.when(F.col("period") < 1997, "pre").otherwise("post").alias("label"), rnd("beta", 3).alias("beta"), rnd("se", 3).alias("se"))


@query(
    "e05_joint_lead_test",
    f"WITH {LONG_PANEL} {es_sql('long', 'product, metric', 1997)} SELECT product, metric, round(sum(pow(beta / se, 2)) + 1e-9, 5) + 0.0 AS chi2, count(*) AS dof FROM es WHERE year < 1997 GROUP BY 1, 2",
)
def e05(s, d):
    r = D.event_study(long_panel(s, d), CELL, "unit", "year", years(s, d), "y", "treat", 1997)
    return D.wald_diagonal(r, CELL, 1997).select(*CELL, rnd("chi2", 5).alias("chi2"), "dof")


@query(
    "e06_pretrend_slope",
    f"""WITH {LONG_PANEL}, pre AS (SELECT *, year - 1996.5 AS tc FROM long WHERE year < 1999), sl AS (SELECT product, metric, unit, any_value(treat) AS treat, sum(tc * y) / sum(tc * tc) AS b FROM pre GROUP BY 1, 2, 3),
    g AS (SELECT product, metric, treat, avg(b) AS bb, count(*)::DOUBLE AS ng FROM sl GROUP BY 1, 2, 3), v AS (SELECT product, metric, treat, any_value(bb) AS bb, sum(pow(b - bb, 2)) / any_value(ng * ng) AS v FROM sl JOIN g USING (product, metric, treat) GROUP BY 1, 2, 3)
    SELECT product, metric, round(sum(CASE WHEN treat = 1 THEN bb ELSE -bb END) + 1e-9, 3) + 0.0 AS slope, round(sqrt(sum(v) * 25 / 24.0 * 99.0 / (100 - 27)) + 1e-9, 3) + 0.0 AS se, 100::BIGINT AS n_pre FROM v GROUP BY 1, 2""",
)
def e06(s, d):
    r = D.pretrend_slope(long_panel(s, d), CELL, "unit", "year", "y", "treat", 1999)
    return r.select(*CELL, rnd("slope", 3).alias("slope"), rnd("se", 3).alias("se"), "n_pre")


def tier_blocks(s, d):
    return D.panel_blocks(one_cell(tier_panel)(s, d), ["cell"], "unit", "unit", "year", years(s, d), "y", {"did": F.col("treat") * F.col("post")})


SIGNS = f""", pc AS ({ALL}) {did_sql('pc', 'cell')}, u AS (SELECT row_number() OVER (ORDER BY unit) - 1 AS i, unit, s, a, ab, sb, q, g, tt FROM did_c JOIN did_m USING (cell)),
    w AS (SELECT range AS draw FROM range(1024))"""


@query(
    "e07_wild_cluster_bootstrap",
    f"""WITH {TIER_PANEL} {SIGNS}, b AS (SELECT draw, s, sb, q, g, tt, ab + (CASE WHEN (draw >> i) & 1 = 1 THEN 1 ELSE -1 END) * (a - ab) AS a2 FROM u, w),
    m AS (SELECT draw, avg(a2) AS ab2, sum((s - sb) * a2) / any_value(g * sb * (1 - sb) * q) AS tau FROM b GROUP BY 1),
    e AS (SELECT b.draw, any_value(tau) AS tau, sqrt(sum(pow((s - sb) * (a2 - ab2) - tau * (s - sb) * (s - sb) * q, 2)) * any_value(g / (g - 1.0) * (g * tt - 1.0) / (g * tt - g - tt))) / any_value(g * sb * (1 - sb) * q) AS se FROM b JOIN m USING (draw) GROUP BY 1)
    SELECT round(any_value(did.tau) + 1e-9, 4) + 0.0 AS tau, round(any_value(did.tau / did.se) + 1e-9, 6) + 0.0 AS t_obs, count(*) AS n_draws, count(CASE WHEN abs(e.tau / e.se) >= abs(did.tau / did.se) - 1e-9 THEN 1 END) AS n_extreme,
      round(count(CASE WHEN abs(e.tau / e.se) >= abs(did.tau / did.se) - 1e-9 THEN 1 END) / count(*) + 1e-9, 6) + 0.0 AS p_wcb FROM e, did""",
)
def e07(s, d):
    r = R.wild_bootstrap_p(tier_blocks(s, d), draws=9999)
    return r.select(rnd("tau", 4).alias("tau"), rnd("t_obs").alias("t_obs"), "n_draws", "n_extreme", rnd("p_wcb").alias("p_wcb"))


@query(
    "e08_bootstrap_interval",
    f"""WITH {TIER_PANEL} {SIGNS}, gr AS (SELECT range AS gi, did.tau + (range * 0.4 - 8.0) * did.se AS tau0 FROM range(41), did),
    b AS (SELECT gi, tau0, draw, s, sb, q, g, tt, ab + tau0 * (s - sb) * q + (CASE WHEN (draw >> i) & 1 = 1 THEN 1 ELSE -1 END) * ((a - ab) - tau0 * (s - sb) * q) AS a2 FROM u, w, gr),
    m AS (SELECT gi, draw, avg(a2) AS ab2, sum((s - sb) * a2) / any_value(g * sb * (1 - sb) * q) AS tau FROM b GROUP BY 1, 2),
    e AS (SELECT gi, draw, any_value(tau0) AS tau0, any_value(tau) AS tau, sqrt(sum(pow((s - sb) * (a2 - ab2) - tau * (s - sb) * (s - sb) * q, 2)) * any_value(g / (g - 1.0) * (g * tt - 1.0) / (g * tt - g - tt))) / any_value(g * sb * (1 - sb) * q) AS se FROM b JOIN m USING (gi, draw) GROUP BY 1, 2),
    p AS (SELECT gi, any_value(tau0) AS tau0, count(CASE WHEN abs((e.tau - tau0) / e.se) >= abs((did.tau - tau0) / did.se) - 1e-9 THEN 1 END) / count(e.se) AS p FROM e, did GROUP BY 1)
    SELECT round(min(CASE WHEN p >= 0.05 THEN tau0 END) + 1e-9, 3) + 0.0 AS ci_lo, round(max(CASE WHEN p >= 0.05 THEN tau0 END) + 1e-9, 3) + 0.0 AS ci_hi, max(CASE WHEN gi = 0 THEN p >= 0.05 END) AS ci_open_lo, max(CASE WHEN gi = 40 THEN p >= 0.05 END) AS ci_open_hi FROM p""",
)
def e08(s, d):
    r = R.wild_bootstrap_ci(tier_blocks(s, d), draws=1024)
    return r.select(rnd("ci_lo", 3).alias("ci_lo"), rnd("ci_hi", 3).alias("ci_hi"), "ci_open_lo", "ci_open_hi")


LOO_U = f""", lu AS (SELECT l.*, x.unit AS dropped FROM long l JOIN (SELECT DISTINCT unit FROM long) x ON x.unit <> l.unit) {did_sql('lu', 'product, metric, dropped', 'lo')} {did_sql('long', 'product, metric', 'fl')},
    lr AS (SELECT lo.*, fl.tau AS tau_full, 100 * (lo.tau - fl.tau) / abs(fl.tau) AS delta_pct FROM lo JOIN fl USING (product, metric))"""


def loo_units(s, d):
    return R.leave_unit_out(stored(complete(long_panel), s, d), CELL, "unit", "year", "y", "treat", "post")


@query(
    "e09_leave_one_unit_out",
    f"WITH {LONG_WHOLE} {LOO_U} SELECT product, metric, dropped, round(tau + 1e-9, 3) + 0.0 AS tau_loo, round(se + 1e-9, 3) + 0.0 AS se_loo, round(delta_pct + 1e-9, 4) + 0.0 AS delta_pct, 'ok' AS note FROM lr",
)
def e09(s, d):
    return loo_units(s, d).select(*CELL, "dropped", rnd("tau_loo", 3).alias("tau_loo"), rnd("se_loo", 3).alias("se_loo"), rnd("delta_pct", 4).alias("delta_pct"), "note")


@query(
    "e09_leave_one_period_out",
    f"""WITH {LONG_WHOLE}, lu AS (SELECT l.*, x.year AS dropped FROM long l JOIN (SELECT DISTINCT year FROM long) x ON x.year <> l.year) {did_sql('lu', 'product, metric, dropped', 'lo')}
    SELECT product, metric, dropped, round(tau + 1e-9, 3) + 0.0 AS tau_loo, round(se + 1e-9, 3) + 0.0 AS se_loo, 'ok' AS note FROM lo""",
)
def e09_period(s, d):
    r = R.leave_period_out(stored(complete(long_panel), s, d), CELL, "unit", "year", "y", "treat", "post")
    return r.select(*CELL, "dropped", rnd("tau_loo", 3).alias("tau_loo"), rnd("se_loo", 3).alias("se_loo"), "note")


@query(
    "e09_leave_one_cluster_out_blocks",
    f"""WITH {TIER_PANEL}, lu AS (SELECT l.*, x.unit AS dropped FROM panel l JOIN (SELECT DISTINCT unit FROM panel) x ON x.unit <> l.unit) {did_sql('lu', 'dropped', 'lo')}
    SELECT dropped, round(tau + 1e-9, 3) + 0.0 AS tau_loo, round(se + 1e-9, 3) + 0.0 AS se_loo, n_obs, 'ok' AS status FROM lo""",
)
def e09_blocks(s, d):
    r = R.leave_cluster_out(tier_blocks(s, d))
    return r.select("dropped", rnd("est", 3).alias("tau_loo"), rnd("se", 3).alias("se_loo"), "n_obs", "status")


@query(
    "e10_sensitivity_verdict",
    f"""WITH {LONG_WHOLE} {LOO_U} SELECT product, metric, round(any_value(tau_full) + 1e-9, 3) + 0.0 AS tau_full, round(max(abs(delta_pct)) + 1e-9, 4) + 0.0 AS max_abs_delta_pct, arg_max(dropped, (abs(delta_pct), -dropped)) AS driver,
      CASE WHEN max(CASE WHEN sign(tau) <> sign(tau_full) THEN 1 ELSE 0 END) = 1 THEN 'fragile' WHEN max(abs(delta_pct)) > 25 THEN 'leverage' ELSE 'stable' END AS verdict FROM lr GROUP BY 1, 2""",
)
def e10(s, d):
    v = R.verdicts(loo_units(s, d), CELL)
    return v.select(*CELL, rnd("tau_full", 3).alias("tau_full"), rnd("max_abs_delta_pct", 4).alias("max_abs_delta_pct"), "driver", "verdict")


PLACEBO = f""", pm AS (SELECT r.range AS mask, p.year, p.unit, p.y, p.post, CAST((r.range >> p.unit) & 1 AS INTEGER) AS treat FROM panel p, range(1024) r WHERE bit_count(r.range) = 5) {did_sql('pm', 'mask', 'pl', extra='1')}"""


def placebo(s, d):
    return R.in_space_placebo(stored(one_cell(complete(tier_panel)), s, d), ["cell"], "unit", "year", "y", "treat", "post")


@query("e11_in_space_placebo", f"WITH {TIER_WHOLE} {PLACEBO} SELECT CAST(mask AS INTEGER) AS mask, round(tau + 1e-9, 3) + 0.0 AS tau, round(se + 1e-9, 3) + 0.0 AS se, mask = 31 AS is_real FROM pl")
def e11(s, d):
    return placebo(s, d).select("mask", rnd("tau", 3).alias("tau"), rnd("se", 3).alias("se"), "is_real")


@query(
    "e12_placebo_summary",
    f"""WITH {TIER_WHOLE} {PLACEBO}, r AS (SELECT tau AS tr FROM pl WHERE mask = 31), o AS (SELECT tau, tr FROM pl, r WHERE mask <> 31)
    SELECT count(*) + 1 AS n_perm, round(any_value(tr) + 1e-9, 3) + 0.0 AS tau_real, round(quantile_cont(tau, 0.5) + 1e-9, 3) + 0.0 AS median, round(quantile_cont(tau, 0.05) + 1e-9, 3) + 0.0 AS p05, round(quantile_cont(tau, 0.95) + 1e-9, 3) + 0.0 AS p95, round(max(abs(tau)) + 1e-9, 3) + 0.0 AS max_abs,
      count(CASE WHEN abs(tau) >= abs(tr) - 1e-9 THEN 1 END) AS n_extreme, round((count(CASE WHEN abs(tau) >= abs(tr) - 1e-9 THEN 1 END) + 1) / (count(*) + 1) + 1e-9, 6) + 0.0 AS p_perm,
      CASE WHEN (count(CASE WHEN abs(tau) >= abs(tr) - 1e-9 THEN 1 END) + 1) / (count(*) + 1) <= 0.1 THEN 'passes' ELSE 'fails' END AS verdict FROM o""",
)
def e12(s, d):
    r = R.summarise_placebo(placebo(s, d), ["cell"])
    return r.select("n_perm", *[rnd(c, 3).alias(c) for c in ("tau_real", "median", "p05", "p95", "max_abs")], "n_extreme", rnd("p_perm").alias("p_perm"), "verdict")


@query(
    "e13_in_time_placebo",
    f"""WITH {LONG_WHOLE}, fp AS (SELECT * EXCLUDE (post), CASE WHEN year = 1996 THEN 1 ELSE 0 END AS post FROM long WHERE year NOT IN (1997, 1998, 1999)) {did_sql('fp', 'product, metric', extra='1')}
    SELECT product, metric, '1996' AS fake_post, round(tau + 1e-9, 3) + 0.0 AS tau_pseudo, round(se + 1e-9, 3) + 0.0 AS se_pseudo FROM did""",
)
def e13(s, d):
    p = stored(complete(long_panel), s, d).where(~F.col("year").isin(POST)).withColumn("post", (F.col("year") == 1996).cast("int"))
    r = D.balanced_did(p, CELL, "unit", "year", "y", "treat", "post", small_sample="g")
    return r.select(*CELL, F.lit("1996").alias("fake_post"), rnd("tau", 3).alias("tau_pseudo"), rnd("se", 3).alias("se_pseudo"))


def customer_panel(s, d):
    return orders_located(s, d).groupBy(F.col("o_custkey").alias("unit"), F.col("n_nationkey").alias("cluster"), F.col("n_regionkey").alias("region"), "year").agg(F.avg("o_totalprice").alias("y")).withColumns(
        {"treat": (F.col("region") <= 1).cast("int"), "post": F.col("year").isin(POST).cast("int")}
    )


@query("e14_cell_level_did_unbalanced")
def e14(s, d):
    r = D.static_did(customer_panel(s, d), [], "unit", "year", years(s, d), "y", "treat", "post", cluster="cluster")
    return r.select("tau", "se", "n_obs", "n_units", "n_clusters", "k", "status")


@query(
    "e14_cell_level_did_balanced",
    f"""WITH {LOCATED}, cp AS (SELECT 'all' AS cell, o_custkey AS unit, n_nationkey AS cluster, year, avg(o_totalprice) AS y, CASE WHEN n_regionkey <= 1 THEN 1 ELSE 0 END AS treat, CASE WHEN year IN (1997, 1998, 1999) THEN 1 ELSE 0 END AS post FROM loc GROUP BY 2, 3, 4, 6),
    full_ AS (SELECT unit FROM cp GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT year) FROM cp)), bp AS (SELECT cp.* FROM cp JOIN full_ USING (unit)) {did_sql('bp', 'cell', score_by='cluster')}
    SELECT round(tau + 1e-9, 3) + 0.0 AS tau, round(se + 1e-9, 3) + 0.0 AS se, n_obs, n_units, n_clusters FROM did""",
)
def e14_balanced(s, d):
    p = customer_panel(s, d)
    full = p.groupBy("unit").agg(F.count("*").alias("c")).where(F.col("c") == len(years(s, d))).select("unit")
    r = D.static_did(p.join(full, "unit"), [], "unit", "year", years(s, d), "y", "treat", "post", cluster="cluster")
    return r.select(rnd("tau", 3).alias("tau"), rnd("se", 3).alias("se"), "n_obs", "n_units", "n_clusters")


@query(
    "e15_minimum_detectable_effect",
    f"""WITH {LONG_WHOLE} {did_sql('long', 'product, metric')} SELECT product, metric, round(tau + 1e-9, 3) + 0.0 AS tau, round(se + 1e-9, 3) + 0.0 AS se, round(2.8 * se + 1e-9, 2) + 0.0 AS mde, CASE WHEN abs(tau) >= 2.8 * se THEN 'yes' ELSE 'no' END AS detectable FROM did""",
)
def e15(s, d):
    r = D.balanced_did(stored(complete(long_panel), s, d), CELL, "unit", "year", "y", "treat", "post").withColumn("mde", R.rule_of_thumb_mde(F.col("se")))
    return r.select(*CELL, rnd("tau", 3).alias("tau"), rnd("se", 3).alias("se"), rnd("mde", 2).alias("mde"), F.when(F.abs("tau") >= F.col("mde"), "yes").otherwise("no").alias("detectable"))


#: t quantiles by degrees of freedom, for panels of up to 60 units.
T_POINTS = {p: [round(t_ppf(p, k), 9) for k in range(1, 60)] for p in (0.975, 0.95, 0.80)}
T_SQL = {p: f"({v}::DOUBLE[])[g - 1]" for p, v in T_POINTS.items()}


@query(
    "e15_minimum_detectable_effect_t",
    f"""WITH {LONG_WHOLE} {did_sql('long', 'product, metric')}, md AS (SELECT product, metric, tau, se, ({T_SQL[0.975]} + {T_SQL[0.80]}) * se AS two, ({T_SQL[0.95]} + {T_SQL[0.80]}) * se AS one FROM (SELECT *, n_units AS g FROM did))
    SELECT product, metric, round(tau + 1e-9, 3) + 0.0 AS tau, round(se + 1e-9, 3) + 0.0 AS se, round(two + 1e-9, 2) + 0.0 AS mde_two, round(one + 1e-9, 2) + 0.0 AS mde_one, round(abs(tau) / two + 1e-9, 5) + 0.0 AS tau_over_mde, CASE WHEN abs(tau) >= two THEN 'yes' ELSE 'no' END AS detectable FROM md""",
)
def e15_t(s, d):
    r = D.balanced_did(stored(complete(long_panel), s, d), CELL, "unit", "year", "y", "treat", "post")
    m = R.minimum_detectable(r, "tau", "se", "n_units")
    return m.select(*CELL, *[rnd(c, k).alias(c) for c, k in {"tau": 3, "se": 3, "mde_two": 2, "mde_one": 2, "tau_over_mde": 5}.items()], "detectable")


SIZES = [4, 6, 8, 12]
EFFECTS = [0.0, 5000.0, 10000.0, 15000.0, 20000.0, 30000.0, 40000.0, 60000.0, 80000.0, 100000.0]
REPS = 999
CRIT = {g: round(t_ppf(0.975, g - 1), 9) for g in SIZES}


@query(
    "e16_power_curve",
    f"""WITH {TIER_WHOLE}, pc AS ({ALL}) {did_sql('pc', 'cell')}, u AS (SELECT row_number() OVER (ORDER BY unit) - 1 AS idx, a, q, count(*) OVER () AS pool FROM did_c JOIN did_m USING (cell)),
    sl AS (SELECT g.g, r.range AS rep, t.range AS slot, floor(CAST('0x' || substr(md5(concat_ws('|', g.g, r.range, t.range, '42')), 1, 13) AS BIGINT) / pow(16, 13) * (SELECT max(pool) FROM u)) AS idx
      FROM (VALUES {', '.join(f'({g}, {CRIT[g]}::DOUBLE)' for g in SIZES)}) g(g, crit), range({REPS}) r, range({max(SIZES)}) t WHERE t.range < g.g),
    m AS (SELECT g, rep, avg(a) FILTER (slot < g // 2) AS m1, avg(a) FILTER (slot >= g // 2) AS m0, any_value(q) AS q FROM sl JOIN u USING (idx) GROUP BY 1, 2),
    v AS (SELECT g, rep, any_value((m1 - m0) / m.q) AS tau, sqrt(sum(0.25 * pow(a - CASE WHEN slot < g // 2 THEN m1 ELSE m0 END, 2)) * any_value(g / (g - 1.0))) / any_value(g * 0.25 * m.q) AS se FROM sl JOIN u USING (idx) JOIN m USING (g, rep) GROUP BY 1, 2)
    SELECT CAST(g AS INTEGER) AS "G", e.tau AS tau_true, round(avg(CASE WHEN se > 1e-9 AND abs(v.tau + e.tau) > CASE g {' '.join(f'WHEN {g} THEN {CRIT[g]}' for g in SIZES)} END * se THEN 1.0 ELSE 0.0 END) + 1e-9, 6) + 0.0 AS power, count(*) AS n_reps
    FROM v, (SELECT unnest({EFFECTS}::DOUBLE[]) AS tau) e GROUP BY 1, 2""",
)
def e16(s, d):
    r = R.power_curve(stored(one_cell(complete(tier_panel)), s, d), ["cell"], "unit", "year", "y", "post", EFFECTS, SIZES, REPS, CRIT)
    return r.select("G", "tau_true", rnd("power").alias("power"), "n_reps")


def nation_deltas(s, d):
    p = stored(one_cell(complete(nation_panel)), s, d)
    est = D.balanced_did(p, ["cell"], "unit", "year", "y", "treat", "post").select("tau", "se")
    return attach_scalar(baseline_delta(p, ["unit"], "year", "y", [1995, 1996], 1998), est)


DELTAS = f"""WITH {NATION_WHOLE}, pc AS ({ALL}) {did_sql('pc', 'cell')}, dl AS (SELECT unit, avg(CASE WHEN year IN (1995, 1996) THEN y END) AS baseline, max(CASE WHEN year = 1998 THEN y END) - avg(CASE WHEN year IN (1995, 1996) THEN y END) AS delta FROM panel GROUP BY 1)"""


@query(
    "e17_transferability",
    DELTAS + """ SELECT unit, round(delta + 1e-9, 3) + 0.0 AS delta, round(delta - tau + 1e-9, 3) + 0.0 AS residual, round(tau - 1.96 * se + 1e-9, 3) + 0.0 AS pi_lo, round(tau + 1.96 * se + 1e-9, 3) + 0.0 AS pi_hi, delta BETWEEN tau - 1.96 * se AND tau + 1.96 * se AS inside FROM dl, did""",
)
def e17(s, d):
    r = R.transferability(nation_deltas(s, d), "unit", F.col("tau"), F.col("se"))
    return r.select("unit", *[rnd(c, 3).alias(c) for c in ("delta", "residual", "pi_lo", "pi_hi")], "inside")


@query(
    "e18_transferability_verdict",
    DELTAS + """, sd AS (SELECT stddev_samp(baseline) AS sd FROM dl WHERE unit NOT IN (3, 7)), x AS (SELECT dl.*, tau, se, sd, delta BETWEEN tau - 1.96 * sqrt(se * se + sd * sd) AND tau + 1.96 * sqrt(se * se + sd * sd) AS inside FROM dl, did, sd WHERE unit NOT IN (3, 7)),
    g AS (SELECT count(delta) AS n, count(CASE WHEN inside THEN 1 END) AS n_in, avg(delta - tau) AS mr, stddev_samp(delta - tau) AS sr, max(sd) AS sd FROM x)
    SELECT n, n_in, round(mr + 1e-9, 3) + 0.0 AS mean_residual, round(sr + 1e-9, 3) + 0.0 AS sd_residual, CASE WHEN n_in >= ceil(0.83 * n) AND abs(mr) < 1.96 * sd THEN 'pass' WHEN n_in < floor(n / 2) THEN 'fail' ELSE 'ambiguous' END AS verdict FROM g""",
)
def e18(s, d):
    kept = nation_deltas(s, d).where(~F.col("unit").isin(3, 7))
    rows = R.transferability(attach_scalar(kept, kept.agg(F.stddev_samp("baseline").alias("sd"))), "unit", F.col("tau"), F.col("se"), F.col("sd"))
    return R.transfer_verdict(rows).select("n", "n_in", rnd("mean_residual", 3).alias("mean_residual"), rnd("sd_residual", 3).alias("sd_residual"), "verdict")


@query(
    "e19_dose_response",
    f"""WITH {LONG_PANEL}, t AS (SELECT *, y - avg(y) OVER (PARTITION BY metric, unit) AS y1, share - avg(share) OVER (PARTITION BY metric, unit) AS f1 FROM long WHERE product = 'raw' AND treat = 1 AND post = 1),
    w AS (SELECT *, y1 - avg(y1) OVER (PARTITION BY metric, year) AS yw, f1 - avg(f1) OVER (PARTITION BY metric, year) AS fw FROM t), b AS (SELECT metric, sum(yw * fw) / sum(fw * fw) AS beta, sum(fw * fw) AS sxx, count(*) AS nb, count(DISTINCT unit) AS g, count(DISTINCT year) AS ty FROM w GROUP BY 1),
    r AS (SELECT metric, any_value(beta) AS beta, any_value(nb) AS n, any_value(nb - g - ty + 1) AS dof, sqrt(sum(pow(yw - beta * fw, 2)) / any_value(nb - g - ty + 1) / any_value(sxx)) AS se FROM w JOIN b USING (metric) GROUP BY 1)
    SELECT metric, round(beta + 1e-9, 3) + 0.0 AS beta, round(se + 1e-9, 3) + 0.0 AS se, n AS n_obs, CAST(dof AS BIGINT) AS dof, beta - 2 * se <= 14 AND 14 <= beta + 2 * se AS consistent FROM r""",
)
def e19(s, d):
    p = long_panel(s, d).where("product = 'raw' and treat = 1 and post = 1")
    r = D.classical_within(D.panel_blocks(p, ["metric"], "unit", "unit", "year", POST, "y", {"share": F.col("share")}))
    ok = (F.col("est") - 2 * F.col("se") <= 14) & (F.col("est") + 2 * F.col("se") >= 14)
    return r.select("metric", rnd("est", 3).alias("beta"), rnd("se", 3).alias("se"), "n_obs", "dof", ok.alias("consistent"))


@query(
    "e20_failure_rate_effect",
    f"""WITH {LOCATED}, fr AS (SELECT 'all' AS cell, n_nationkey AS unit, year, avg(CASE WHEN o_totalprice > 400000 THEN 1.0 ELSE 0.0 END) AS y, CASE WHEN n_regionkey <= 1 THEN 1 ELSE 0 END AS treat, CASE WHEN year IN (1997, 1998, 1999) THEN 1 ELSE 0 END AS post FROM loc GROUP BY 2, 3, 5) {did_sql('fr', 'cell')}
    SELECT round(tau + 1e-9, 6) + 0.0 AS tau, round(se + 1e-9, 6) + 0.0 AS se, n_obs FROM did""",
)
def e20(s, d):
    fr = orders_located(s, d).groupBy(F.col("n_nationkey").alias("unit"), "n_regionkey", "year").agg(F.avg((F.col("o_totalprice") > 400000).cast("double")).alias("y"))
    fr = fr.withColumns({"treat": (F.col("n_regionkey") <= 1).cast("int"), "post": F.col("year").isin(POST).cast("int")})
    return D.static_did(fr, [], "unit", "year", years(s, d), "y", "treat", "post").select(rnd("tau").alias("tau"), rnd("se").alias("se"), "n_obs")


@query(
    "e21_selection_bounds",
    f"""WITH {LONG_PANEL} {did_sql('long', 'product, metric')}, sg AS (SELECT product, metric, stddev_samp(y) AS sigma, avg(share) AS f FROM long GROUP BY 1, 2)
    SELECT product, metric, round(tau - f * sigma + 1e-9, 2) + 0.0 AS worst_lo, round(tau + f * sigma + 1e-9, 2) + 0.0 AS worst_hi, round(tau - sqrt(f) * sigma + 1e-9, 2) + 0.0 AS narrow_lo, round(tau + sqrt(f) * sigma + 1e-9, 2) + 0.0 AS narrow_hi,
      tau - f * sigma < 0 AND tau + f * sigma > 0 AS null_worst, tau - sqrt(f) * sigma < 0 AND tau + sqrt(f) * sigma > 0 AS null_narrow FROM did JOIN sg USING (product, metric)""",
)
def e21(s, d):
    lp = stored(long_panel, s, d)
    est = D.balanced_did(lp, CELL, "unit", "year", "y", "treat", "post")
    sg = lp.groupBy(*CELL).agg(F.stddev_samp("y").alias("sigma"), F.avg("share").alias("f"))
    r = R.selection_bounds(join_on(est, sg, CELL), "tau", "f", "sigma")
    return r.select(*CELL, *[rnd(c, 2).alias(c) for c in ("worst_lo", "worst_hi", "narrow_lo", "narrow_hi")], "null_worst", "null_narrow")


@query(
    "e22_interaction_contrast",
    f"""WITH {LONG_PANEL} SELECT product, metric, count(y) AS n_obs, round((avg(CASE WHEN treat = 1 AND post = 1 THEN y END) - avg(CASE WHEN treat = 1 AND post = 0 THEN y END)) - (avg(CASE WHEN treat = 0 AND post = 1 THEN y END) - avg(CASE WHEN treat = 0 AND post = 0 THEN y END)) + 1e-9, 3) + 0.0 AS contrast FROM long GROUP BY 1, 2""",
)
def e22(s, d):
    return R.baci_contrast(long_panel(s, d), CELL, "y", "treat", "post").select(*CELL, "n_obs", rnd("contrast", 3).alias("contrast"))


HASHED_DRAWS = 9999


@query(
    "e22_contrast_with_components",
    f"""WITH {LONG_PANEL} {did_sql('long', 'product, metric')}, u AS (SELECT product, metric, unit, s, a, ab, sb, q, g, tt FROM did_c JOIN did_m USING (product, metric)),
    w AS (SELECT unit, range AS draw, CASE WHEN substr(md5(concat_ws('|', unit, range, '42')), 1, 1) >= '8' THEN 1 ELSE -1 END AS w FROM (SELECT DISTINCT unit FROM long), range({HASHED_DRAWS})),
    b AS (SELECT product, metric, draw, s, sb, q, g, tt, ab + w * (a - ab) AS a2 FROM u JOIN w USING (unit)),
    mm AS (SELECT product, metric, draw, avg(a2) AS ab2, sum((s - sb) * a2) / any_value(g * sb * (1 - sb) * q) AS tau FROM b GROUP BY 1, 2, 3),
    e AS (SELECT product, metric, draw, any_value(tau) AS tau, sqrt(sum(pow((s - sb) * (a2 - ab2) - tau * (s - sb) * (s - sb) * q, 2)) * any_value(g / (g - 1.0) * (g * tt - 1.0) / (g * tt - g - tt))) / any_value(g * sb * (1 - sb) * q) AS se FROM b JOIN mm USING (product, metric, draw) GROUP BY 1, 2, 3),
    p AS (SELECT product, metric, (count(CASE WHEN abs(e.tau / e.se) >= abs(did.tau / did.se) - 1e-9 THEN 1 END) + 1) / (count(*) + 1) AS p FROM e JOIN did USING (product, metric) GROUP BY 1, 2),
    um AS (SELECT product, metric, unit, avg(y) AS um FROM long GROUP BY 1, 2, 3), pm AS (SELECT product, metric, year, avg(y) AS pm FROM long GROUP BY 1, 2, 3),
    c AS (SELECT product, metric, count(y) AS n_obs, (avg(CASE WHEN treat = 1 AND post = 1 THEN y END) - avg(CASE WHEN treat = 1 AND post = 0 THEN y END)) - (avg(CASE WHEN treat = 0 AND post = 1 THEN y END) - avg(CASE WHEN treat = 0 AND post = 0 THEN y END)) AS contrast FROM long GROUP BY 1, 2),
    vu AS (SELECT product, metric, var_samp(um) AS v FROM um GROUP BY 1, 2), vt AS (SELECT product, metric, var_samp(pm) AS v FROM pm GROUP BY 1, 2)
    SELECT product, metric, n_obs, round(contrast + 1e-9, 3) + 0.0 AS contrast, round(vu.v + 1e-9, 2) + 0.0 AS var_unit, round(vt.v + 1e-9, 2) + 0.0 AS var_period, round(p + 1e-9, 6) + 0.0 AS p_wcb
    FROM c JOIN p USING (product, metric) JOIN vu USING (product, metric) JOIN vt USING (product, metric)""",
)
def e22_full(s, d):
    lp = stored(long_panel, s, d)
    c = R.baci_contrast(lp, CELL, "y", "treat", "post").select(*CELL, "n_obs", rnd("contrast", 3).alias("contrast"))
    v = P.variance_components(lp, CELL, "unit", "year", "y").select(*CELL, rnd(F.col("sigma_u") ** 2, 2).alias("var_unit"), rnd(F.col("sigma_t") ** 2, 2).alias("var_period"))
    b = D.panel_blocks(lp, CELL, "unit", "unit", "year", years(s, d), "y", {"did": F.col("treat") * F.col("post")})
    w = R.wild_bootstrap_p(b, draws=HASHED_DRAWS, signs="hashed").select(*CELL, rnd("p_wcb").alias("p_wcb"))
    return join_on(join_on(c, v, CELL), w, CELL)


@query("e21_trimmed_bounds")
def e21_trimmed(s, d):
    lp = stored(long_panel, s, d)
    out = None
    for side in ("lower", "upper"):
        kept = R.trimmed(lp, CELL, "y", (F.col("treat") == 1) & (F.col("post") == 1), 0.1, side)
        r = D.static_did(kept, CELL, "unit", "year", years(s, d), "y", "treat", "post").select(*CELL, F.lit(side).alias("bound"), "tau", "se", "n_obs", "status")
        out = r if out is None else out.unionByName(r)
    return out


@query(
    "e14_one_pass_demeaning",
    f"""WITH {LOCATED}, cp AS (SELECT 'all' AS cell, o_custkey AS unit, n_nationkey AS cluster, year, avg(o_totalprice) AS y, CASE WHEN n_regionkey <= 1 AND year IN (1997, 1998, 1999) THEN 1.0 ELSE 0.0 END AS d FROM loc GROUP BY 2, 3, 4, 6),
    a AS (SELECT *, y - avg(y) OVER (PARTITION BY unit) AS y1, d - avg(d) OVER (PARTITION BY unit) AS d1 FROM cp), b AS (SELECT *, y1 - avg(y1) OVER (PARTITION BY year) AS yd, d1 - avg(d1) OVER (PARTITION BY year) AS dd FROM a),
    p AS (SELECT cluster, sum(yd * dd) AS xy, sum(dd * dd) AS xx, count(*) AS n FROM b GROUP BY 1), t AS (SELECT sum(xy) / sum(xx) AS tau, sum(xx) AS sxx, sum(n)::BIGINT AS n_obs, count(*) AS g FROM p)
    SELECT round(any_value(tau) + 1e-9, 3) + 0.0 AS tau, round(sqrt(sum(pow(xy - tau * xx, 2)) * any_value(g / (g - 1.0))) / any_value(sxx) + 1e-9, 3) + 0.0 AS se, any_value(n_obs) AS n_obs, any_value(g) AS n_clusters FROM p, t""",
)
def e14_one_pass(s, d):
    p = stored(one_cell(customer_panel), s, d).withColumn("d", F.col("treat") * F.col("post"))
    r = D.one_pass_did(p, ["cell"], "unit", "year", "y", "d", "cluster")
    return r.select(rnd("tau", 3).alias("tau"), rnd("se", 3).alias("se"), "n_obs", "n_clusters")


@query(
    "e05_joint_lead_test_full_covariance",
    f"""WITH {LONG_PANEL}, z AS (SELECT product, metric, unit, any_value(treat) AS treat, max(y) FILTER (year = 1995) - max(y) FILTER (year = 1997) AS z1, max(y) FILTER (year = 1996) - max(y) FILTER (year = 1997) AS z2 FROM long GROUP BY 1, 2, 3),
    g AS (SELECT product, metric, treat, avg(z1) AS m1, avg(z2) AS m2, covar_pop(z1, z1) / count(*) AS v11, covar_pop(z2, z2) / count(*) AS v22, covar_pop(z1, z2) / count(*) AS v12 FROM z GROUP BY 1, 2, 3),
    n AS (SELECT product, metric, count(DISTINCT unit)::DOUBLE AS g, count(DISTINCT year)::DOUBLE AS tt FROM long GROUP BY 1, 2),
    e AS (SELECT product, metric, sum(CASE WHEN treat = 1 THEN m1 ELSE -m1 END) AS b1, sum(CASE WHEN treat = 1 THEN m2 ELSE -m2 END) AS b2, any_value(g / (g - 1) * (g * tt - 1) / (g * tt - (g + 2 * (tt - 1)))) AS f, sum(v11) AS v11, sum(v22) AS v22, sum(v12) AS v12 FROM g JOIN n USING (product, metric) GROUP BY 1, 2),
    w AS (SELECT product, metric, (b1 * b1 * v22 - 2 * b1 * b2 * v12 + b2 * b2 * v11) / (v11 * v22 - v12 * v12) / f AS chi2 FROM e)
    SELECT product, metric, round(chi2 + 1e-9, 4) + 0.0 AS chi2, 2 AS dof, round(exp(-chi2 / 2) + 1e-9, 6) + 0.0 AS p_value FROM w""",
)
def e05_full(s, d):
    b = D.event_blocks(long_panel(s, d), CELL, "unit", "year", years(s, d), "y", "treat", 1997)
    r = D.wald_joint(b, ["1995", "1996"])
    return r.select(*CELL, rnd("chi2", 4).alias("chi2"), "dof", rnd("p_value").alias("p_value"))


@query(
    "e20_missingness_verdict",
    f"""WITH {LOCATED}, fr AS (SELECT 'all' AS cell, n_nationkey AS unit, year, avg(CASE WHEN o_totalprice > 400000 THEN 1.0 ELSE 0.0 END) AS y, CASE WHEN n_regionkey <= 1 THEN 1 ELSE 0 END AS treat, CASE WHEN year IN (1997, 1998, 1999) THEN 1 ELSE 0 END AS post FROM loc GROUP BY 2, 3, 5) {did_sql('fr', 'cell')},
    p AS (SELECT tau, se, {normal_p_sql('(tau / se)')} AS p FROM did)
    SELECT round(tau + 1e-9, 6) + 0.0 AS tau, round(se + 1e-9, 6) + 0.0 AS se, round(p + 1e-9, 6) + 0.0 AS p_value, CASE WHEN abs(tau) < 0.05 AND p > 0.1 THEN 'ignorable' ELSE 'possibly selective' END AS verdict FROM p""",
)
def e20_verdict(s, d):
    fr = orders_located(s, d).groupBy(F.col("n_nationkey").alias("unit"), "n_regionkey", "year").agg(F.avg((F.col("o_totalprice") > 400000).cast("double")).alias("y"))
    fr = fr.withColumns({"treat": (F.col("n_regionkey") <= 1).cast("int"), "post": F.col("year").isin(POST).cast("int")})
    r = D.with_inference(D.static_did(fr, [], "unit", "year", years(s, d), "y", "treat", "post"))
    return r.select(*[rnd(c).alias(c) for c in ("tau", "se", "p_value")], D.missingness_verdict("tau", "p_value").alias("verdict"))
