"""Queries over period series: season dates, smoothing, curve fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import scalar as S
from furrow.operators import season as N
from furrow.plans.base import OBS, SERIES, obs, periods, rnd, series, table
from furrow.plans.registry import query

FIRST_DAY, DAY_STEP = 150, 20
HEAD = f"WITH {OBS}, {SERIES} "


def days(s, d):
    """Day of the year that each period of the grid stands for."""
    return [FIRST_DAY + DAY_STEP * p for p in periods(s, d)]


@query(
    "w02_first_period_above_threshold",
    HEAD + "SELECT user_id, min(CASE WHEN v >= 0.4 THEN p END) AS sos, count(v) AS n_valid FROM series GROUP BY 1",
)
def w02(s, d):
    return N.period_dates(series(s, d), ["user_id"], "p", "v", 0.4).select("user_id", "sos", "n_valid")


@query(
    "w03_first_peak_period",
    HEAD + ", m AS (SELECT user_id, max(v) AS mx FROM series GROUP BY 1) SELECT s.user_id, min(p) AS pos FROM series s JOIN m ON s.user_id = m.user_id AND v = mx GROUP BY 1",
)
def w03(s, d):
    return N.period_dates(series(s, d), ["user_id"], "p", "v", 0.4).select("user_id", "pos")


@query(
    "w04_first_period_below_after_peak",
    HEAD + """, m AS (SELECT user_id, max(v) AS mx FROM series GROUP BY 1), k AS (SELECT s.user_id, min(p) AS pos FROM series s JOIN m ON s.user_id = m.user_id AND v = mx GROUP BY 1)
    SELECT s.user_id, min(CASE WHEN p > pos AND v < 0.4 THEN p END) AS eos FROM series s JOIN k USING (user_id) GROUP BY 1""",
)
def w04(s, d):
    return N.period_dates(series(s, d), ["user_id"], "p", "v", 0.4).select("user_id", "eos")


@query(
    "w02_strict_upward_crossing",
    HEAD + """, l AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY p) AS pv FROM series)
    SELECT user_id, min(CASE WHEN v >= 0.4 AND pv < 0.4 THEN p END) AS sos FROM l GROUP BY 1""",
)
def w02_strict(s, d):
    return N.period_dates(series(s, d), ["user_id"], "p", "v", 0.4, strict=True).select("user_id", "sos")


CROSS_SQL = """, a AS (SELECT *, 150 + 20 * p AS doy FROM series WHERE v IS NOT NULL),
    b AS (SELECT *, lead(v) OVER o AS v2, lead(doy) OVER o AS d2, count(*) OVER w AS nn, min(v) OVER w AS lo, max(v) OVER w AS hi, min(doy) OVER w AS f FROM a
      WINDOW w AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY doy)),
    pk AS (SELECT user_id, min(doy) AS pk FROM b WHERE v = hi GROUP BY 1),
    c AS (SELECT b.*, pk.pk, lo + 0.3 * (hi - lo) AS thr FROM b JOIN pk USING (user_id)),
    e AS (SELECT *, CASE WHEN v2 = v THEN doy ELSE doy + (thr - v) * (d2 - doy) / (v2 - v) END AS xd FROM c),
    g AS (SELECT user_id, max(nn) AS n_points, max(hi - lo) AS amp, max(pk) AS pk, max(f) AS f,
        arg_max(xd, doy) FILTER (v <= thr AND thr <= v2 AND doy < pk AND xd BETWEEN 140 AND 320) AS cr, min(CASE WHEN v >= thr THEN doy END) AS fb FROM e GROUP BY 1),
    dates AS (SELECT user_id, n_points, CASE WHEN n_points >= 4 AND amp >= 0.05 AND pk > f THEN coalesce(cr, fb) END AS sos FROM g)"""


def crossing(s, d):
    t = series(s, d).withColumn("doy", F.col("p") * 20 + 150)
    return N.crossing_date(t, ["user_id"], "doy", "v", 0.30, 140, 320)


@query("w05_threshold_crossing_date", HEAD + CROSS_SQL + " SELECT user_id, n_points, round(sos + 1e-9, 6) + 0.0 AS sos FROM dates")
def w05(s, d):
    return crossing(s, d).withColumn("sos", rnd("sos"))


SMOOTH_SQL = """, sm AS (SELECT i.user_id, i.p, sum(exp(-pow(i.p - j.p, 2) / 4.5) * j.wt * j.v) / sum(exp(-pow(i.p - j.p, 2) / 4.5) * j.wt) AS z
      FROM wser i JOIN wser j ON i.user_id = j.user_id WHERE j.v IS NOT NULL GROUP BY 1, 2)"""


@query(
    "w06_gaussian_smoothing",
    HEAD + """, fl AS (SELECT user_id, max(k) >= 98 AS flooded FROM obs GROUP BY 1),
      wser AS (SELECT s.*, CASE WHEN flooded AND p IN (2, 3) THEN 0.0 ELSE 1.0 END AS wt FROM series s JOIN fl USING (user_id))""" + SMOOTH_SQL + " SELECT user_id, CAST(p AS INTEGER) AS p, round(z + 1e-9, 6) + 0.0 AS z FROM sm",
)
def w06(s, d):
    flood = obs(s, d).groupBy("user_id").agg((F.max("k") >= 98).alias("flooded"))
    a = N.series_array(series(s, d), ["user_id"], "p", "v", periods(s, d)).join(flood, "user_id")
    z = N.gaussian_smooth(F.col("ys"), len(periods(s, d)), 1.5, weights(F.col("flooded"), periods(s, d)))
    return a.select("user_id", F.posexplode(z).alias("p", "z")).select("user_id", (F.col("p") + periods(s, d)[0]).alias("p"), rnd("z").alias("z"))


def weights(flooded, grid):
    return F.array(*[F.when(flooded & F.lit(i in (2, 3)), 0.0).otherwise(1.0) for i in grid])


@query(
    "w07_estimate_choice",
    HEAD + CROSS_SQL + """, pd AS (SELECT user_id, min(CASE WHEN v >= 0.9 AND p >= 3 THEN 150 + 20 * p END) AS prim, count(v) AS n_valid FROM series GROUP BY 1)
    SELECT user_id, n_valid, round(coalesce(prim, sos) + 1e-9, 6) + 0.0 AS sos_used, prim IS NOT NULL AS is_primary FROM pd LEFT JOIN dates USING (user_id)""",
)
def w07(s, d):
    prim = series(s, d).groupBy("user_id").agg(
        F.min(F.when((F.col("v") >= 0.9) & (F.col("p") >= 3), F.col("p") * 20 + 150)).alias("prim"), F.count("v").alias("n_valid")
    )
    j = prim.join(crossing(s, d).select("user_id", "sos"), "user_id", "left")
    return j.select("user_id", "n_valid", rnd(F.coalesce(F.col("prim").cast("double"), F.col("sos"))).alias("sos_used"), F.col("prim").isNotNull().alias("is_primary"))


# --- curve fits ----------------------------------------------------------------------------

BASIS_SQL = """sg AS (SELECT * FROM (VALUES (0, 165.0::DOUBLE), (1, 180), (2, 195), (3, 210), (4, 225), (5, 240)) t(i, s)),
  rg AS (SELECT * FROM (VALUES (0, 0.05::DOUBLE), (1, 0.12), (2, 0.20), (3, 0.30)) t(i, m)),
  ag AS (SELECT * FROM (VALUES (0, 255.0::DOUBLE), (1, 270), (2, 285), (3, 300), (4, 315), (5, 330)) t(i, a)),
  par AS (SELECT ((sg.i * 4 + r1.i) * 6 + ag.i) * 4 + r2.i AS pid, s, r1.m AS ms, a, r2.m AS ma FROM sg, rg r1, ag, rg r2),
  basis AS (SELECT pid, g.p, 1 / (1 + exp(-ms * (150 + 20 * g.p - s))) + 1 / (1 + exp(ma * (150 + 20 * g.p - a))) - 1 AS b FROM par, gr g)"""


def fit_sql(src: str, key: str, out: str) -> str:
    """Text of the grid fit over rows (key, p, v): the relational form of the array fit."""
    return f""", {out}_r AS (SELECT {key}, min(v) AS lo, max(v) AS hi, count(v) AS n FROM {src} GROUP BY {key} HAVING count(v) >= 6),
      {out}_s AS (SELECT {key}, pid, round(sum(pow(v - (lo + (hi - lo) * b), 2)), 9) AS ssr FROM {src} JOIN {out}_r USING ({key}) JOIN basis USING (p) WHERE v IS NOT NULL GROUP BY {key}, pid),
      {out}_m AS (SELECT {key}, min(ssr) AS ssr FROM {out}_s GROUP BY {key}),
      {out}_p AS (SELECT {key}, ssr, min(pid) AS pid FROM {out}_s JOIN {out}_m USING ({key}, ssr) GROUP BY {key}, ssr),
      {out} AS (SELECT {key}, CAST(pid AS INTEGER) AS pid, ssr, lo, hi, n, s, ms, a, ma, s - ln(1 / 0.7 - 1) / ms AS sos, (s + a) / 2 AS pos, a + ln(1 / 0.2 - 1) / ma AS eos FROM {out}_p JOIN par USING (pid) JOIN {out}_r USING ({key}))"""


def fitted(s, d):
    fit = N.grid_fit(days(s, d))
    a = N.series_array(series(s, d), ["user_id"], "p", "v", periods(s, d))
    return a.withColumn("fit", fit("ys")).where("fit.p is not null")


@query(
    "c01_double_logistic_grid_fit",
    f"WITH {OBS}, {SERIES}, {BASIS_SQL} {fit_sql('series', 'user_id', 'f')} SELECT user_id, pid AS p, round(ssr + 1e-9, 6) + 0.0 AS ssr, s AS d_rise, ms AS m_rise, a AS d_fall, ma AS m_fall FROM f",
)
def c01(s, d):
    return fitted(s, d).select("user_id", "fit.p", rnd("fit.ssr").alias("ssr"), "fit.d_rise", "fit.m_rise", "fit.d_fall", "fit.m_fall")


@query(
    "c02_dates_from_fit",
    f"WITH {OBS}, {SERIES}, {BASIS_SQL} {fit_sql('series', 'user_id', 'f')} SELECT user_id, round(sos + 1e-9, 6) + 0.0 AS sos, round(pos + 1e-9, 6) + 0.0 AS pos, round(eos + 1e-9, 6) + 0.0 AS eos FROM f",
)
def c02(s, d):
    return fitted(s, d).select("user_id", *[rnd(c).alias(n) for n, c in N.fitted_dates(F.col("fit")).items()])


@query(
    "c03_local_refinement",
    f"""WITH {OBS}, {SERIES}, {BASIS_SQL} {fit_sql('series', 'user_id', 'f')},
    st AS (SELECT * FROM (VALUES (0, -10), (1, -5), (2, 0), (3, 5), (4, 10)) t(i, o)), fc AS (SELECT * FROM (VALUES (0, 0.8::DOUBLE), (1, 1.0), (2, 1.25)) t(i, r)),
    off AS (SELECT ((st.i * 3 + fc.i) * 5 + s2.i) * 3 + f2.i AS q, st.o AS ds, fc.r AS fr, s2.o AS da, f2.r AS fa FROM st, fc, st s2, fc f2),
    e AS (SELECT f.user_id, q, round(sum(pow(v - (lo + (hi - lo) * (1 / (1 + exp(-(ms * fr) * (150 + 20 * p - (s + ds)))) + 1 / (1 + exp((ma * fa) * (150 + 20 * p - (a + da)))) - 1)), 2)), 9) AS ssr, max(f.n) AS n
      FROM f JOIN series USING (user_id), off WHERE v IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT user_id, min(ssr) AS ssr FROM e GROUP BY 1), w AS (SELECT user_id, ssr, min(q) AS q, max(n) AS n FROM e JOIN b USING (user_id, ssr) GROUP BY 1, 2)
    SELECT user_id, CAST(q AS INTEGER) AS q, round(s + ds + 1e-9, 6) AS d_rise, round(a + da + 1e-9, 6) AS d_fall, round(sqrt(w.ssr / w.n) + 1e-9, 6) + 0.0 AS rmsr FROM w JOIN off USING (q) JOIN f USING (user_id)""",
)
def c03(s, d):
    refine = N.refine_fit(days(s, d))
    r = fitted(s, d).withColumn("r", refine("ys", "fit.m_rise", "fit.d_rise", "fit.m_fall", "fit.d_fall"))
    return r.select("user_id", "r.q", rnd("r.d_rise").alias("d_rise"), rnd("r.d_fall").alias("d_fall"), rnd("r.rmsr").alias("rmsr"))


REPLICATES = 1000


@query(
    "c04_replicate_date_intervals",
    f"""WITH {OBS}, {SERIES}, {BASIS_SQL} {fit_sql('series', 'user_id', 'f')},
    noisy AS (SELECT user_id, r.rep, s.p, v + (CAST('0x' || substr(md5(concat_ws('|', user_id, r.rep, s.p - (SELECT min(p) FROM gr), '42')), 1, 13) AS BIGINT) / pow(16, 13) - 0.5) * 2 * sqrt(f.ssr / (SELECT count(*) FROM gr)) AS v
      FROM series s JOIN f USING (user_id), range({REPLICATES}) r(rep) WHERE v IS NOT NULL),
    nl AS (SELECT user_id, rep, min(v) AS lo, max(v) AS hi, list(v ORDER BY p) AS vs FROM noisy GROUP BY 1, 2),
    nz AS (SELECT user_id, rep, hi - lo AS amp, list_transform(vs, lambda x: x - lo) AS z FROM nl),
    ub AS (SELECT user_id, pid, list(b ORDER BY p) AS bl, sum(b * b) AS bb FROM series JOIN basis USING (p) WHERE v IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT user_id, rep, min({{'s': round(list_inner_product(z, z) - 2 * amp * list_inner_product(z, bl) + amp * amp * bb, 9), 'pid': pid}}) AS m FROM nz JOIN ub USING (user_id) GROUP BY 1, 2),
    dt AS (SELECT user_id, s - ln(1 / 0.7 - 1) / ms AS sos, a + ln(1 / 0.2 - 1) / ma AS eos FROM g JOIN par ON par.pid = g.m.pid)
    SELECT user_id, round(quantile_cont(sos, 0.025) + 1e-9, 6) + 0.0 AS sos_lo, round(quantile_cont(sos, 0.975) + 1e-9, 6) + 0.0 AS sos_hi,
      round(quantile_cont(eos, 0.025) + 1e-9, 6) + 0.0 AS eos_lo, round(quantile_cont(eos, 0.975) + 1e-9, 6) + 0.0 AS eos_hi, count(*) AS n_rep FROM dt GROUP BY 1""",
)
def c04(s, d):
    ci = N.replicate_intervals(days(s, d), REPLICATES)
    # few rows, much work each: dealt over all cores, which a coalesced shuffle would not do
    units = fitted(s, d).repartition(4 * s.sparkContext.defaultParallelism, "user_id")
    r = units.withColumn("r", ci("user_id", "ys", "fit.ssr"))
    return r.select("user_id", *[rnd(f"r.{c}").alias(c) for c in ("sos_lo", "sos_hi", "eos_lo", "eos_hi")], "r.n_rep")


BAND_SERIES = """bs0 AS (SELECT user_id, event_type, p, avg(value) AS m FROM obs WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3),
  bt AS (SELECT user_id, event_type, max(m) AS mx FROM bs0 GROUP BY 1, 2), fl AS (SELECT user_id, max(k) >= 98 AS flooded FROM obs GROUP BY 1),
  br AS (SELECT t.user_id, t.event_type, g.p, pr.product, bs0.m / t.mx AS v, CASE WHEN pr.product = 'corrected' AND flooded AND g.p IN (2, 3) THEN 0.0 ELSE 1.0 END AS wt,
      t.user_id * 4 + CASE WHEN t.event_type = 'view' THEN 0 ELSE 2 END + CASE WHEN pr.product = 'raw' THEN 0 ELSE 1 END AS bk
    FROM bt t JOIN fl USING (user_id) CROSS JOIN gr g CROSS JOIN (VALUES ('raw'), ('corrected')) pr(product)
    LEFT JOIN bs0 ON bs0.user_id = t.user_id AND bs0.event_type = t.event_type AND bs0.p = g.p),
  bsm AS (SELECT i.bk, i.p, sum(exp(-pow(i.p - j.p, 2) / 4.5) * j.wt * j.v) / sum(exp(-pow(i.p - j.p, 2) / 4.5) * j.wt) AS v FROM br i JOIN br j ON i.bk = j.bk WHERE j.v IS NOT NULL GROUP BY 1, 2)"""


@query(
    "c05_fused_products",
    f"""WITH {OBS}, {BAND_SERIES}, {BASIS_SQL} {fit_sql('bsm', 'bk', 'f')}
    SELECT a.bk // 4 AS user_id, CASE WHEN a.bk % 2 = 0 THEN 'raw' ELSE 'corrected' END AS product, round((a.sos + b.sos) / 2 + 1e-9, 6) + 0.0 AS sos, round((a.pos + b.pos) / 2 + 1e-9, 6) + 0.0 AS pos, round((a.eos + b.eos) / 2 + 1e-9, 6) + 0.0 AS eos
    FROM f a JOIN f b ON b.bk = a.bk + 2 WHERE a.bk % 4 < 2""",
)
def c05(s, d):
    fit = N.grid_fit(days(s, d))
    o = obs(s, d)
    m = o.where(F.col("event_type").isin("view", "click")).groupBy("user_id", "event_type", "p").agg(F.avg("value").alias("m"))
    arr = N.series_array(m, ["user_id", "event_type"], "p", "m", periods(s, d))
    flood = o.groupBy("user_id").agg((F.max("k") >= 98).alias("flooded"))
    top = F.array_max("ys")
    arr = arr.withColumn("ys", F.transform("ys", lambda y: F.try_divide(y, top))).join(flood, "user_id")
    both = arr.withColumn("product", F.explode(F.array(F.lit("raw"), F.lit("corrected"))))
    z = N.gaussian_smooth(F.col("ys"), len(periods(s, d)), 1.5, weights(F.col("flooded") & (F.col("product") == "corrected"), periods(s, d)))
    # the generator keeps the higher-order expression out of the UDF's argument list
    f = both.withColumn("z", F.explode(F.array(z))).withColumn("fit", fit("z")).where("fit.p is not null")
    f = f.select("user_id", "event_type", "product", *[c.alias(n) for n, c in N.fitted_dates(F.col("fit")).items()])
    fused = N.fuse_dates(f.where("event_type = 'view'"), f.where("event_type = 'click'"), ["user_id", "product"], ["sos", "pos", "eos"])
    return fused.select("user_id", "product", rnd("sos").alias("sos"), rnd("pos").alias("pos"), rnd("eos").alias("eos"))


# The penalised system is five-banded: one pass down eliminates, one pass up substitutes. Right-hand
# side -1 is the series; sides 0.. are unit vectors, whose solutions give the trace of the smoother.
SMOOTHER_SQL = """x AS (SELECT user_id, p - (SELECT min(p) FROM gr) AS i, v, (SELECT count(*) FROM gr) AS n FROM series),
  m AS (SELECT user_id, count(v) AS m, any_value(n) AS n FROM x GROUP BY 1),
  a AS (SELECT x.user_id, lam, k.k, i, x.n, CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END + lam * ((i <= x.n - 3)::INT + 4 * (i BETWEEN 1 AND x.n - 2)::INT + (i >= 2)::INT) AS a,
      -2.0 * lam * ((i <= x.n - 3)::INT + (i BETWEEN 1 AND x.n - 2)::INT) AS b, lam * (i <= x.n - 3)::INT AS c, CASE WHEN k.k = -1 THEN coalesce(v, 0.0) WHEN k.k = i AND v IS NOT NULL THEN 1.0 ELSE 0.0 END AS r
    FROM x JOIN m ON m.user_id = x.user_id AND m.m >= 5, (VALUES (1.0::DOUBLE), (5), (10), (50), (100), (500), (1000), (5000)) l(lam), range(-1, x.n) k(k)),
  dn AS (SELECT user_id, lam, k, n, 0 AS i, a AS d, b / a AS l1, c / a AS l2, r AS g, 0.0::DOUBLE AS pd, 0.0::DOUBLE AS pl2, 0.0::DOUBLE AS pg FROM a WHERE i = 0
    UNION ALL SELECT q.user_id, q.lam, q.k, q.n, a.i, q.dd, (a.b - q.d * q.l1 * q.l2) / q.dd, a.c / q.dd, a.r - q.l1 * q.g - q.pl2 * q.pg, q.d, q.l2, q.g
    FROM (SELECT dn.*, a.a - dn.d * dn.l1 * dn.l1 - dn.pd * dn.pl2 * dn.pl2 AS dd FROM dn JOIN a ON a.user_id = dn.user_id AND a.lam = dn.lam AND a.k = dn.k AND a.i = dn.i + 1) q
      JOIN a ON a.user_id = q.user_id AND a.lam = q.lam AND a.k = q.k AND a.i = q.i + 1),
  up AS (SELECT user_id, lam, k, n, i, g / d AS z, 0.0::DOUBLE AS z1 FROM dn WHERE i = n - 1
    UNION ALL SELECT up.user_id, up.lam, up.k, up.n, dn.i, dn.g / dn.d - dn.l1 * up.z - dn.l2 * up.z1, up.z FROM up JOIN dn ON dn.user_id = up.user_id AND dn.lam = up.lam AND dn.k = up.k AND dn.i = up.i - 1),
  tr AS (SELECT user_id, lam, sum(z) AS tr FROM up JOIN x USING (user_id, i) WHERE k = i AND v IS NOT NULL GROUP BY 1, 2),
  rs AS (SELECT user_id, lam, sum((v - z) * (v - z)) AS rss, list(round(z + 1e-9, 6) + 0.0 ORDER BY i) AS z FROM up JOIN x USING (user_id, i) WHERE k = -1 GROUP BY 1, 2),
  sc AS (SELECT user_id, lam, z, m.m, CASE WHEN m.m >= 8 THEN CASE WHEN m.m - tr > 1e-9 THEN round(m.m * rss / pow(m.m - tr, 2), 12) END WHEN lam = 100 THEN 0.0 END AS gcv FROM rs JOIN tr USING (user_id, lam) JOIN m USING (user_id)),
  pick AS (SELECT user_id, arg_min(lam, (gcv, lam)) AS lam, arg_min(z, (gcv, lam)) AS z FROM sc WHERE gcv IS NOT NULL GROUP BY 1)"""


@query("c06_penalised_smoother", f"WITH RECURSIVE {OBS}, {SERIES}, {SMOOTHER_SQL} SELECT user_id, CAST(m.m AS INTEGER) AS n, lam, z FROM m LEFT JOIN pick USING (user_id)")
def c06(s, d):
    smooth = N.penalised_smooth(len(periods(s, d)))
    a = N.series_array(series(s, d), ["user_id"], "p", "v", periods(s, d)).withColumn("r", smooth("ys"))
    return a.select("user_id", "r.n", "r.lam", F.transform("r.z", lambda z: rnd(z)).alias("z"))


@query(
    "c07_extended_season",
    """SELECT CAST(year(o_orderdate - INTERVAL 30 DAY) AS INTEGER) AS season, count(*) AS n,
      CAST(max(date_diff('day', make_date(CAST(year(o_orderdate - INTERVAL 30 DAY) AS INTEGER), 1, 1), CAST(o_orderdate AS DATE)) + 1) AS INTEGER) AS last_doy,
      CAST(min(date_diff('day', make_date(CAST(year(o_orderdate - INTERVAL 30 DAY) AS INTEGER), 1, 1), CAST(o_orderdate AS DATE)) + 1) AS INTEGER) AS first_doy,
      count(CASE WHEN dayofyear(o_orderdate) <= 30 THEN 1 END) AS n_overlap FROM orders GROUP BY 1""",
)
def c07(s, d):
    o = table(s, d, "orders")
    return o.groupBy(S.season_year("o_orderdate", 30).alias("season")).agg(
        F.count(F.lit(1)).alias("n"), F.max(S.season_doy("o_orderdate", 30)).alias("last_doy"), F.min(S.season_doy("o_orderdate", 30)).alias("first_doy"),
        F.count(F.when(F.dayofyear("o_orderdate") <= 30, 1)).alias("n_overlap"),
    )


@query(
    "w15_step_descriptors",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mo, CAST(dayofyear(make_date(CAST(year(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER), 15)) AS INTEGER) AS mid_doy,
      count(*) AS n, CAST(min(least((dayofyear(o_orderdate) - 1) // 10, 36)) AS INTEGER) AS first_dekad FROM orders GROUP BY 1, 2, 3""",
)
def w15(s, d):
    o = table(s, d, "orders").select("o_orderdate", F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo"))
    g = o.groupBy("yr", "mo").agg(F.count(F.lit(1)).alias("n"), F.min(S.dekad_index("o_orderdate")).alias("first_dekad"))
    return g.withColumn("mid_doy", S.mid_month_doy("yr", "mo"))
