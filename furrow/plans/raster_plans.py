"""Queries over pixel observations: scans, masks, indices, composites, zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import scalar as S
from furrow.functions.ranking import grouped_stats
from furrow.operators import raster as R
from furrow.plans.base import BANDS, OBS, obs, periods, rnd, stack, stack_sql, table, years
from furrow.plans.registry import query

STACK_D = stack_sql("user_id, d")
PIXEL = f"WITH {OBS}, {STACK_D} "


@query(
    "s05_scene_scan",
    f"""WITH {OBS} SELECT event_type, count(*) AS n, min(value) AS v_min, round(avg(value) + 1e-9, 6) + 0.0 AS v_mean FROM obs
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('view', 'click') AND k < 60 AND x BETWEEN 2 AND 12
    GROUP BY 1""",
)
def s05(s, d):
    o = obs(s, d).where(
        (F.col("ts") >= F.lit("2024-01-05").cast("timestamp"))
        & (F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
        & F.col("event_type").isin("view", "click")
        & (F.col("k") < 60)
        & F.col("x").between(2, 12)
    )
    return o.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("v_min"), rnd(F.avg("value")).alias("v_mean"))


@query(
    "s06_scene_catalog_search",
    f"""WITH {OBS}, cat AS (SELECT event_type, d, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(k) AS cloud, count(*) AS n
      FROM obs GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d) AS rn FROM cat
      WHERE x1 >= 3 AND x0 <= 9 AND y1 >= 1 AND y0 <= 5 AND d BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' AND cloud < 52)
    SELECT event_type, d, n, CAST(rn AS INTEGER) AS rn, round(cloud + 1e-9, 6) + 0.0 AS cloud FROM r WHERE rn <= 8""",
)
def s06(s, d):
    from furrow.sources.catalog import scene_catalog, search

    cat = scene_catalog(obs(s, d), ["event_type", "d"], "x", "y", "k")
    hits = search(cat, bbox=(3, 1, 9, 5), day="d", start="2024-01-03", end="2024-01-28", max_cloud=52, per="event_type", limit=8)
    return hits.select("event_type", "d", "n", "rn", rnd("cloud").alias("cloud"))


LAYER = """layer AS (SELECT user_id, avg(CASE WHEN k >= 50 THEN 100.0 ELSE 0.0 END) AS occurrence,
      count(DISTINCT p) AS seasonality, CAST(max(k) % 5 AS INTEGER) AS landcover FROM obs GROUP BY 1)"""


def layer(s, d):
    """Static per-pixel layers, derived once from the whole record."""
    o = obs(s, d)
    base = o.groupBy("user_id", "p").agg(
        F.sum(F.when(F.col("k") >= 50, 100.0).otherwise(0.0)).alias("hit"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k")
    )
    return base.groupBy("user_id").agg(
        (F.sum("hit") / F.sum("n")).alias("occurrence"),
        F.count(F.lit(1)).alias("seasonality"),
        (F.max("k") % 5).cast("int").alias("landcover"),
    )


@query(
    "s07_static_layer_lookup",
    f"""WITH {OBS}, {LAYER} SELECT l.landcover, count(*) AS n, round(avg(o.value) + 1e-9, 6) + 0.0 AS v_mean
    FROM obs o JOIN layer l USING (user_id) WHERE l.occurrence < 55 AND l.seasonality >= 6 GROUP BY 1""",
)
def s07(s, d):
    lay = layer(s, d).where((F.col("occurrence") < 55) & (F.col("seasonality") >= 6))
    return obs(s, d).join(lay, "user_id").groupBy("landcover").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("v_mean"))


@query(
    "p05_bit_and_class_mask",
    f"""WITH {OBS} SELECT user_id, count(*) AS n,
      count(CASE WHEN (k & 4) = 0 AND (k & 8) = 0 AND (k % 12) NOT IN (3, 8, 9, 10) THEN value END) AS n_flag,
      count(CASE WHEN (k % 12) IN (4, 5, 6) THEN value END) AS n_keep,
      count(CASE WHEN (k & 26) = 0 AND k < 80 THEN value END) AS n_qa,
      round(avg(CASE WHEN (k & 4) = 0 AND (k & 8) = 0 AND (k % 12) NOT IN (3, 8, 9, 10) THEN value END) + 1e-9, 6) + 0.0 AS v_flag
    FROM obs GROUP BY 1""",
)
def p05(s, d):
    o = obs(s, d)
    scl = F.col("k") % 12
    flag = S.bits_clear("k", 2, 3) & ~scl.isin(3, 8, 9, 10)
    m = o.withColumns({
        "a": F.when(flag, F.col("value")),
        "b": F.when(scl.isin(4, 5, 6), F.col("value")),
        "c": F.when(S.bits_clear("k", 1, 3, 4) & (F.col("k") < 80), F.col("value")),
    })
    return m.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("a").alias("n_flag"), F.count("b").alias("n_keep"), F.count("c").alias("n_qa"),
        rnd(F.avg("a")).alias("v_flag"),
    )


@query(
    "p06_band_scaling",
    f"""WITH {OBS} SELECT event_type, round(sum(value / 10000) + 1e-9, 6) + 0.0 AS s_refl, round(sum(value * 0.0000275 - 0.2) + 1e-9, 6) + 0.0 AS s_sr FROM obs GROUP BY 1""",
)
def p06(s, d):
    return obs(s, d).groupBy("event_type").agg(
        rnd(F.sum(S.scaled("value", 1.0 / 10000))).alias("s_refl"), rnd(F.sum(S.scaled("value", 0.0000275, -0.2))).alias("s_sr")
    )


@query(
    "p07_normalised_difference",
    PIXEL + """SELECT user_id, d, round((b8 - b4) / nullif(b8 + b4, 0) + 1e-9, 6) + 0.0 AS ndvi, round((b3 - b8) / nullif(b3 + b8, 0) + 1e-9, 6) + 0.0 AS ndwi,
      round((b8 - b11) / nullif(b8 + b11, 0) + 1e-9, 6) + 0.0 AS lswi, round((b11 - vh) / (b11 + vh + 0.000001) + 1e-9, 6) + 0.0 AS si FROM stack""",
)
def p07(s, d):
    st = stack(obs(s, d), ["user_id", "d"])
    nd = S.normalised_difference
    return st.select(
        "user_id", "d", rnd(nd("b8", "b4")).alias("ndvi"), rnd(nd("b3", "b8")).alias("ndwi"), rnd(nd("b8", "b11")).alias("lswi"),
        rnd(nd("b11", "vh", 1e-6)).alias("si"),
    )


HARM = {"click": (0.9723, 0.0235), "error": (0.9723, 0.0235)}
HARM_SQL = "CASE WHEN event_type IN ('click', 'error') THEN 0.9723 * value + 0.0235 ELSE value END"


@query(
    "p08_sensor_harmonisation",
    f"WITH {OBS} SELECT event_type AS sensor, count(*) AS n, round(avg({HARM_SQL}) + 1e-9, 6) + 0.0 AS v FROM obs GROUP BY 1",
)
def p08(s, d):
    h = S.harmonised("event_type", "value", HARM)
    return obs(s, d).groupBy(F.col("event_type").alias("sensor")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(h)).alias("v"))


@query(
    "p09_decibel_and_ratio",
    PIXEL + """SELECT user_id, d, round(10 * log10(b8) + 1e-9, 6) + 0.0 AS vh_db, round(10 * log10(b4) + 1e-9, 6) + 0.0 AS vv_db,
      round(10 * log10(b8) - 10 * log10(b4) + 1e-9, 6) + 0.0 AS cr_db, round(b8 / b4 + 1e-9, 6) + 0.0 AS cr_lin,
      round(pow(10, b8 / 1000) + 1e-9, 6) + 0.0 AS lin, round(sqrt(b3 * b3 + b11 * b11) + 1e-9, 6) + 0.0 AS wind FROM stack WHERE (b8 IS NULL OR b8 > 0) AND (b4 IS NULL OR b4 > 0)""",
)
def p09(s, d):
    st = stack(obs(s, d), ["user_id", "d"]).where("(b8 is null or b8 > 0) and (b4 is null or b4 > 0)")
    vh, vv = S.linear_to_db("b8"), S.linear_to_db("b4")
    return st.select(
        "user_id", "d", rnd(vh).alias("vh_db"), rnd(vv).alias("vv_db"), rnd(vh - vv).alias("cr_db"),
        rnd(F.try_divide(F.col("b8"), F.col("b4"))).alias("cr_lin"), rnd(S.db_to_linear(F.col("b8") / 100)).alias("lin"),
        rnd(S.wind_speed("b3", "b11")).alias("wind"),
    )


@query(
    "p10_threshold_mask",
    f"""WITH {OBS}, {LAYER}, st AS (SELECT user_id, avg(CASE WHEN event_type = 'view' THEN value END) AS b8, min(CASE WHEN event_type = 'click' THEN value END) AS b4 FROM obs GROUP BY 1)
    SELECT st.user_id, coalesce(b8 > 45 AND b4 < 5 AND occurrence < 60, FALSE) AS saline, coalesce(b4 < 8 AND seasonality BETWEEN 1 AND 9, FALSE) AS agronomic
    FROM st JOIN layer USING (user_id)""",
)
def p10(s, d):
    st = obs(s, d).groupBy("user_id").agg(
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b8"),
        F.min(F.when(F.col("event_type") == "click", F.col("value"))).alias("b4"),
    )
    j = st.join(layer(s, d), "user_id")
    saline = (F.col("b8") > 45) & (F.col("b4") < 5) & (F.col("occurrence") < 60)
    agro = (F.col("b4") < 8) & F.col("seasonality").between(1, 9)
    return j.select("user_id", F.coalesce(saline, F.lit(False)).alias("saline"), F.coalesce(agro, F.lit(False)).alias("agronomic"))


@query(
    "p11_mask_algebra",
    PIXEL + """, m AS (SELECT user_id, CASE WHEN b8 > 50 THEN 1 END AS m, b4 FROM stack)
    SELECT user_id, sum(coalesce(m, 0))::BIGINT AS n_unmasked, count(m) AS n_self, round(avg(CASE WHEN m = 1 THEN 0.0 ELSE b4 END) + 1e-9, 6) + 0.0 AS v_where FROM m GROUP BY 1""",
)
def p11(s, d):
    m = stack(obs(s, d), ["user_id", "d"]).withColumn("m", F.when(F.col("b8") > 50, 1))
    return m.groupBy("user_id").agg(
        F.sum(F.coalesce("m", F.lit(0))).alias("n_unmasked"), F.count("m").alias("n_self"),
        rnd(F.avg(F.when(F.col("m") == 1, 0.0).otherwise(F.col("b4")))).alias("v_where"),
    )


@query(
    "p12_empty_window_guard",
    f"""WITH {OBS}, g AS (SELECT u.user_id, p.p FROM (SELECT DISTINCT user_id FROM obs) u, gr p),
    c AS (SELECT user_id, p, avg(value) AS v FROM obs WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT g.user_id, CAST(g.p AS INTEGER) AS p, round(coalesce(v, -25.0) + 1e-9, 6) + 0.0 AS v, v IS NULL AS empty FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.p = c.p""",
)
def p12(s, d):
    o = obs(s, d)
    c = o.where("event_type = 'view'").groupBy("user_id", "p").agg(F.avg("value").alias("v"))
    g = o.select("user_id").distinct().withColumn("p", F.explode(F.array(*[F.lit(i) for i in periods(s, d)])))
    j = g.join(c, ["user_id", "p"], "left")
    return j.select("user_id", "p", rnd(F.coalesce("v", F.lit(-25.0))).alias("v"), F.col("v").isNull().alias("empty"))


@query(
    "p13_null_safe_metrics",
    f"""WITH {OBS}, u AS (SELECT user_id, count(CASE WHEN event_type = 'signup' THEN 1 END) AS n, max(CASE WHEN event_type = 'signup' THEN value END) AS top,
      arg_max(p, (value, -event_id)) FILTER (event_type = 'signup') AS pos FROM obs GROUP BY 1)
    SELECT user_id, n, CASE WHEN n > 8 THEN pos END AS pos, CASE WHEN n > 8 THEN top END AS top, CASE WHEN n > 8 THEN 'OK' ELSE 'excluded' END AS qa_flag FROM u""",
)
def p13(s, d):
    hit = F.col("event_type") == "signup"
    u = obs(s, d).groupBy("user_id").agg(
        F.count(F.when(hit, 1)).alias("n"), F.max(F.when(hit, F.col("value"))).alias("top"),
        F.max_by("p", F.when(hit, F.struct("value", -F.col("event_id")))).alias("pos"),
    )
    ok = F.col("n") > 8
    return u.select("user_id", "n", F.when(ok, F.col("pos")).alias("pos"), F.when(ok, F.col("top")).alias("top"), F.when(ok, "OK").otherwise("excluded").alias("qa_flag"))


# --- joins on pixels and scenes ---------------------------------------------------------

@query(
    "j01_scene_join_keep_first",
    f"""WITH {OBS}, a AS (SELECT user_id, d, avg(value) AS v FROM obs WHERE event_type = 'view' GROUP BY 1, 2),
    b AS (SELECT user_id, d, arg_min(k, event_id) AS prob FROM obs WHERE event_type = 'error' GROUP BY 1, 2)
    SELECT a.user_id, a.d, round(CASE WHEN prob <= 50 THEN v END + 1e-9, 6) + 0.0 AS v, prob FROM a JOIN b USING (user_id, d)""",
)
def j01(s, d):
    o = obs(s, d)
    a = o.where("event_type = 'view'").groupBy("user_id", "d").agg(F.avg("value").alias("v"))
    b = o.where("event_type = 'error'").groupBy("user_id", "d").agg(F.min_by("k", "event_id").alias("prob"))
    return a.join(b, ["user_id", "d"]).select("user_id", "d", rnd(F.when(F.col("prob") <= 50, F.col("v"))).alias("v"), "prob")


@query(
    "j03_multi_layer_stack",
    PIXEL + f""", {LAYER} SELECT s.user_id, s.d, {', '.join(f'round({b} + 1e-9, 6) + 0.0 AS {b}' for b in BANDS.values())},
      round(occurrence + 1e-9, 6) + 0.0 AS occurrence, seasonality FROM stack s JOIN layer l USING (user_id)""",
)
def j03(s, d):
    j = stack(obs(s, d), ["user_id", "d"]).join(layer(s, d), "user_id")
    return j.select("user_id", "d", *[rnd(b).alias(b) for b in BANDS.values()], rnd("occurrence").alias("occurrence"), "seasonality")


WINDOWS = """w AS (SELECT user_id, min(ts) AS t0 FROM obs WHERE event_type = 'signup' GROUP BY 1)"""


def windows(s, d):
    """Event time of each pixel: its first signup."""
    return obs(s, d).where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0"))


def around(w, before: int, after: int):
    return w.withColumn("w_start", F.col("t0") - F.expr(f"INTERVAL {before} DAYS")).withColumn(
        "w_end", F.col("t0") + F.expr(f"INTERVAL {after} DAYS")
    )


@query(
    "j04_interval_join",
    f"""WITH {OBS}, {WINDOWS} SELECT o.user_id, count(*) AS n, round(avg(value) + 1e-9, 6) + 0.0 AS v, max(value) AS v_max FROM obs o JOIN w USING (user_id)
    WHERE o.ts >= t0 - INTERVAL 3 DAY AND o.ts < t0 + INTERVAL 3 DAY GROUP BY 1""",
)
def j04(s, d):
    j = R.interval_join(obs(s, d), around(windows(s, d), 3, 3), ["user_id"], "ts", "w_start", "w_end")
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("v"), F.max("value").alias("v_max"))


# --- composites ---------------------------------------------------------------------------

@query(
    "a01_temporal_composite",
    f"""WITH {OBS} SELECT x, y, min(value) AS v_min, max(value) AS v_max, round(avg(value) + 1e-9, 6) + 0.0 AS v_mean, arg_min(value, event_id) AS v_first,
      arg_max(value, event_id) AS v_latest, count(value) AS n_obs, round(median(value) + 1e-9, 6) + 0.0 AS v_median FROM obs GROUP BY 1, 2""",
)
def a01(s, d):
    c = R.composite(obs(s, d), ["x", "y"], "value", ["ts", "event_id"])
    return c.withColumns({"v_mean": rnd("v_mean"), "v_median": rnd("v_median")})


@query(
    "a02_period_composite_with_gaps",
    f"""WITH {OBS}, c AS (SELECT user_id, p, median(value) AS m, count(*) AS n FROM obs WHERE event_type = 'view' GROUP BY 1, 2),
    u AS (SELECT DISTINCT user_id FROM c)
    SELECT u.user_id, CAST(g.p AS INTEGER) AS p, round(m + 1e-9, 6) + 0.0 AS v_median, coalesce(n, 0) AS n_obs FROM u CROSS JOIN gr g LEFT JOIN c ON c.user_id = u.user_id AND c.p = g.p""",
)
def a02(s, d):
    o = obs(s, d).where("event_type = 'view'")
    return R.period_medians(o, ["user_id"], "p", periods(s, d), "value").withColumn("v_median", rnd("v_median"))


@query(
    "a03_dekad_composite",
    f"""WITH {OBS} SELECT x, CAST(year(ts) AS INTEGER) AS year, CAST(least((dayofyear(ts) - 1) // 10, 36) AS INTEGER) AS dekad, round(avg(value) + 1e-9, 6) + 0.0 AS value_mean,
      count(DISTINCT d) AS n_scenes, count(*) AS n_obs, CAST(least((dayofyear(ts) - 1) // 10, 36) * 10 + 5 AS INTEGER) AS doy_centre,
      make_date(CAST(year(ts) AS INTEGER), 1, 1) + CAST(least((dayofyear(ts) - 1) // 10, 36) * 10 + 4 AS INTEGER) AS date_centre
    FROM obs GROUP BY x, 2, 3, 7, 8 HAVING count(*) >= 5""",
)
def a03(s, d):
    c = R.dekad_means(obs(s, d), ["x"], "ts", ["value"], "d", min_obs=5)
    return c.withColumn("value_mean", rnd("value_mean"))


@query(
    "a04_seasonal_composite",
    """WITH o AS (SELECT o_custkey % 25 AS cell, CAST(year(o_orderdate) AS INTEGER) AS yr, o_totalprice AS v FROM orders WHERE month(o_orderdate) IN (7, 8) AND year(o_orderdate) IN (1996, 1998, 2000))
    SELECT cell, yr, round(median(v) + 1e-9, 6) + 0.0 AS v_median, count(*) AS n FROM o GROUP BY 1, 2
    UNION ALL SELECT cell, NULL, round(median(v) + 1e-9, 6) + 0.0, count(*) FROM o GROUP BY 1""",
)
def a04(s, d):
    o = (
        table(s, d, "orders")
        .where(F.month("o_orderdate").isin(7, 8) & F.year("o_orderdate").isin(1996, 1998, 2000))
        .select((F.col("o_custkey") % 25).alias("cell"), F.year("o_orderdate").alias("yr"), F.col("o_totalprice").alias("v"))
    )
    n = F.count(F.lit(1)).alias("n")
    per_year = grouped_stats(o, ["cell", "yr"], "v", {"v_median": 0.5}, n)
    pooled = grouped_stats(o, ["cell"], "v", {"v_median": 0.5}, n).withColumn("yr", F.lit(None).cast("int"))
    return per_year.unionByName(pooled).withColumn("v_median", rnd("v_median"))


@query(
    "a05_change_detection",
    f"""WITH {OBS}, {WINDOWS}, {LAYER}, c AS (SELECT o.user_id, median(CASE WHEN ts < t0 THEN value END) AS pre, median(CASE WHEN ts >= t0 THEN value END) AS post
      FROM obs o JOIN w USING (user_id) WHERE ts >= t0 - INTERVAL 7 DAY AND ts < t0 + INTERVAL 2 DAY GROUP BY 1)
    SELECT user_id, round(pre + 1e-9, 6) + 0.0 AS pre, round(post + 1e-9, 6) + 0.0 AS post, coalesce(pre - post > 3 AND post < 30 AND occurrence < 60 AND seasonality >= 5, FALSE) AS flooded
    FROM c JOIN layer USING (user_id)""",
)
def a05(s, d):
    j = R.interval_join(obs(s, d), around(windows(s, d), 7, 2), ["user_id"], "ts", "w_start", "w_end")
    c = R.windowed_aggregates(j, ["user_id"], {
        "pre": ("median", F.col("ts") < F.col("t0"), "value"), "post": ("median", F.col("ts") >= F.col("t0"), "value"),
    }).join(layer(s, d), "user_id")
    flood = (F.col("pre") - F.col("post") > 3) & (F.col("post") < 30) & (F.col("occurrence") < 60) & (F.col("seasonality") >= 5)
    return c.select("user_id", rnd("pre").alias("pre"), rnd("post").alias("post"), F.coalesce(flood, F.lit(False)).alias("flooded"))


@query(
    "a06_event_window_features",
    f"""WITH {OBS}, {WINDOWS}, {LAYER}, f AS (SELECT o.user_id,
        median(CASE WHEN ts < t0 AND event_type = 'view' THEN value END) AS vh_pre, median(CASE WHEN ts >= t0 AND event_type = 'view' THEN value END) AS vh_evt,
        median(CASE WHEN ts < t0 AND event_type = 'click' THEN value END) AS vv_pre, median(CASE WHEN ts >= t0 AND event_type = 'click' THEN value END) AS vv_evt,
        min(CASE WHEN ts >= t0 AND event_type = 'click' THEN value END) AS vv_min, max(CASE WHEN ts >= t0 AND ts < t0 + INTERVAL 3 DAY AND event_type = 'error' THEN value END) AS wind,
        max(CASE WHEN ts >= t0 AND event_type = 'purchase' THEN value END) AS ndwi_max
      FROM obs o JOIN w USING (user_id) WHERE ts >= t0 - INTERVAL 7 DAY AND ts < t0 + INTERVAL 5 DAY GROUP BY 1)
    SELECT user_id, round(coalesce(vh_evt, 25) - coalesce(vh_pre, 25) + 1e-9, 6) + 0.0 AS delta_vh, round((coalesce(vv_evt, 15) - coalesce(vh_evt, 25)) - (coalesce(vv_pre, 15) - coalesce(vh_pre, 25)) + 1e-9, 6) + 0.0 AS delta_cr,
      coalesce(vv_min, 25) AS vv_min, coalesce(wind, 0) AS wind, coalesce(ndwi_max, 0) AS ndwi_max, round(occurrence + 1e-9, 6) + 0.0 AS occurrence FROM f JOIN layer USING (user_id)""",
)
def a06(s, d):
    j = R.interval_join(obs(s, d), around(windows(s, d), 7, 5), ["user_id"], "ts", "w_start", "w_end")
    pre, evt, ty = F.col("ts") < F.col("t0"), F.col("ts") >= F.col("t0"), F.col("event_type")
    three = evt & (F.col("ts") < F.col("t0") + F.expr("INTERVAL 3 DAYS"))
    f = R.windowed_aggregates(j, ["user_id"], {
        "vh_pre": ("median", pre & (ty == "view"), "value"), "vh_evt": ("median", evt & (ty == "view"), "value"),
        "vv_pre": ("median", pre & (ty == "click"), "value"), "vv_evt": ("median", evt & (ty == "click"), "value"),
        "vv_min": ("min", evt & (ty == "click"), "value"), "wind": ("max", three & (ty == "error"), "value"),
        "ndwi_max": ("max", evt & (ty == "purchase"), "value"),
    }).join(layer(s, d), "user_id")

    def guard(c, v):
        return F.coalesce(F.col(c), F.lit(float(v)))

    cr = (guard("vv_evt", 15) - guard("vh_evt", 25)) - (guard("vv_pre", 15) - guard("vh_pre", 25))
    return f.select(
        "user_id", rnd(guard("vh_evt", 25) - guard("vh_pre", 25)).alias("delta_vh"), rnd(cr).alias("delta_cr"),
        guard("vv_min", 25).alias("vv_min"), guard("wind", 0).alias("wind"), guard("ndwi_max", 0).alias("ndwi_max"),
        rnd("occurrence").alias("occurrence"),
    )


@query(
    "a07_season_feature_stack",
    PIXEL + f""", {WINDOWS}, {LAYER}, b AS (SELECT user_id, min(b8) AS vh_min, min(b4) AS vv_min, max((b3 - b8) / nullif(b3 + b8, 0)) AS ndwi_max, max((b8 - b11) / nullif(b8 + b11, 0)) AS lswi_max FROM stack GROUP BY 1),
    e AS (SELECT o.user_id, max(sqrt(value * value + k * k)) AS wind, min(31 - day(t0)) AS dsl FROM obs o JOIN w USING (user_id) WHERE ts >= t0 - INTERVAL 3 DAY AND ts < t0 + INTERVAL 4 DAY GROUP BY 1)
    SELECT b.user_id, round(vh_min + 1e-9, 6) + 0.0 AS vh_min, round(vv_min + 1e-9, 6) + 0.0 AS vv_min, round(pow(10, vh_min / 1000) / pow(10, vv_min / 1000) + 1e-9, 6) + 0.0 AS ratio,
      round(ndwi_max + 1e-9, 6) + 0.0 AS ndwi_max, round(lswi_max + 1e-9, 6) + 0.0 AS lswi_max, round(occurrence + 1e-9, 6) + 0.0 AS occurrence, round(coalesce(wind, 0) + 1e-9, 6) + 0.0 AS event_wind, coalesce(dsl, 999) AS days_since
    FROM b JOIN layer USING (user_id) LEFT JOIN e ON e.user_id = b.user_id""",
)
def a07(s, d):
    o = obs(s, d)
    nd = S.normalised_difference
    b = stack(o, ["user_id", "d"]).groupBy("user_id").agg(
        F.min("b8").alias("vh_min"), F.min("b4").alias("vv_min"), F.max(nd("b3", "b8")).alias("ndwi_max"), F.max(nd("b8", "b11")).alias("lswi_max")
    )
    e = R.interval_join(o, around(windows(s, d), 3, 4), ["user_id"], "ts", "w_start", "w_end").groupBy("user_id").agg(
        F.max(S.wind_speed("value", F.col("k").cast("double"))).alias("wind"), F.min((31 - F.dayofmonth("t0")).cast("long")).alias("dsl")
    )
    j = b.join(layer(s, d), "user_id").join(e, "user_id", "left")
    ratio = S.db_to_linear(F.col("vh_min") / 100) / S.db_to_linear(F.col("vv_min") / 100)
    return j.select(
        "user_id", rnd("vh_min").alias("vh_min"), rnd("vv_min").alias("vv_min"), rnd(ratio).alias("ratio"), rnd("ndwi_max").alias("ndwi_max"),
        rnd("lswi_max").alias("lswi_max"), rnd("occurrence").alias("occurrence"), rnd(F.coalesce("wind", F.lit(0.0))).alias("event_wind"),
        F.coalesce("dsl", F.lit(999)).alias("days_since"),
    )


MEANS = "img AS (SELECT x, y, avg(value) AS v FROM obs GROUP BY 1, 2)"


def image(s, d):
    return obs(s, d).groupBy("x", "y").agg(F.avg("value").alias("v"))


@query(
    "a08_focal_mean",
    f"""WITH {OBS}, {MEANS} SELECT a.x, a.y, count(*) AS n_win, round(avg(b.v) + 1e-9, 6) + 0.0 AS w_mean, round(var_pop(b.v) + 1e-9, 4) + 0.0 AS w_var
    FROM img a JOIN img b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY 1, 2""",
)
def a08(s, d):
    img = image(s, d)
    m = R.focal_moments(img, "v", 2)
    return img.select("x", "y").join(m, ["x", "y"]).withColumns({"w_mean": rnd("w_mean"), "w_var": rnd("w_var", 4)})


@query(
    "a08_lee_filter",
    f"""WITH {OBS}, {MEANS}, m AS (SELECT a.x, a.y, a.v, avg(b.v) AS mu, var_pop(b.v) AS va FROM img a JOIN img b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY 1, 2, 3)
    SELECT x, y, round(v + 1e-9, 6) + 0.0 AS v, round(mu + (va - 0.01 * mu * mu) / va * (v - mu) + 1e-9, 4) + 0.0 AS filtered FROM m""",
)
def a08_lee(s, d):
    f = R.lee_filter(image(s, d), "v", 2, 0.01)
    return f.select("x", "y", rnd("v").alias("v"), rnd("filtered", 4).alias("filtered"))


@query(
    "a09_zonal_statistics",
    f"""WITH {OBS} SELECT x AS zone, p, round(avg(value) + 1e-9, 6) + 0.0 AS v_mean, count(*) AS n, round(quantile_cont(value, 0.5) + 1e-9, 6) + 0.0 AS p50, round(quantile_cont(value, 0.25) + 1e-9, 6) + 0.0 AS p25,
      round(quantile_cont(value, 0.75) + 1e-9, 6) + 0.0 AS p75, round(quantile_cont(value, 0.02) + 1e-9, 6) + 0.0 AS p02, round(quantile_cont(value, 0.97) + 1e-9, 6) + 0.0 AS p97 FROM obs GROUP BY 1, 2""",
)
def a09(s, d):
    probs = {"p50": 0.5, "p25": 0.25, "p75": 0.75, "p02": 0.02, "p97": 0.97}
    z = grouped_stats(obs(s, d).withColumnRenamed("x", "zone"), ["zone", "p"], "value", probs, F.avg("value").alias("v_mean"), F.count(F.lit(1)).alias("n"))
    return z.withColumns({c: rnd(c) for c in ("v_mean", *probs)})


@query(
    "a10_area_funnel",
    f"""WITH {OBS}, {LAYER}, img AS (SELECT user_id, avg(value) AS v FROM obs GROUP BY 1), j AS (SELECT * FROM img JOIN layer USING (user_id)),
    c AS (SELECT count(*) AS a, count(CASE WHEN v > 40 THEN 1 END) AS b, count(CASE WHEN v > 40 AND occurrence < 55 THEN 1 END) AS c, count(CASE WHEN v > 40 AND occurrence < 55 AND landcover >= 2 THEN 1 END) AS e FROM j)
    SELECT 0 AS step, 'all' AS name, a AS cells, a * 0.01 AS area FROM c UNION ALL SELECT 1, 'bright', b, b * 0.01 FROM c
    UNION ALL SELECT 2, 'dry', c, c * 0.01 FROM c UNION ALL SELECT 3, 'cropland', e, e * 0.01 FROM c""".replace("* 0.01", "* 0.01::DOUBLE"),
)
def a10(s, d):
    j = obs(s, d).groupBy("user_id").agg(F.avg("value").alias("v")).join(layer(s, d), "user_id")
    return R.area_funnel(
        j, [("all", F.lit(True)), ("bright", F.col("v") > 40), ("dry", F.col("occurrence") < 55), ("cropland", F.col("landcover") >= 2)], 0.01
    )


@query(
    "a11_balanced_pixels",
    """WITH cy AS (SELECT year(o_orderdate) AS yr FROM orders GROUP BY 1 HAVING count(DISTINCT month(o_orderdate)) = 12),
    v AS (SELECT o_custkey, year(o_orderdate) AS yr, count(DISTINCT month(o_orderdate)) AS months FROM orders WHERE year(o_orderdate) IN (SELECT yr FROM cy) GROUP BY 1, 2)
    SELECT o_custkey FROM v WHERE months >= 1 GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM cy)""",
)
def a11(s, d):
    whole = years(s, d, complete=True)
    v = (
        table(s, d, "orders").where(F.year("o_orderdate").isin(whole))
        .select("o_custkey", F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo")).distinct().withColumn("valid", F.lit(True))
    )
    return R.balanced_pixels(v, ["o_custkey"], "yr", months_needed=1, years=len(whole))


@query(
    "a12_grid_coarsening",
    f"""WITH {OBS}, {MEANS} SELECT x // 3 AS cx, y // 3 AS cy, round(avg(CASE WHEN v > 48 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) + 0.0 AS share_valid, count(*) AS n_fine,
      avg(CASE WHEN v > 48 THEN 1.0 ELSE 0.0 END) >= 0.5 AS kept FROM img GROUP BY 1, 2""",
)
def a12(s, d):
    return R.coarsen(image(s, d), 3, F.col("v") > 48, 0.5).withColumn("share_valid", rnd("share_valid"))


@query(
    "a13_connected_regions",
    f"""WITH RECURSIVE {OBS}, {MEANS}, m AS (SELECT x, y, y * 1000000 + x AS id FROM img WHERE v > 50),
    e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
    r(id, root) AS (SELECT id, id FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id AND e.b > r.root),
    l AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
    SELECT root % 1000000 AS region_x, root // 1000000 AS region_y, count(*) AS n_cells, count(*) * 0.09::DOUBLE AS area FROM l GROUP BY 1, 2 HAVING count(*) * 0.09::DOUBLE >= 0.18""",
)
def a13(s, d):
    cells = image(s, d).where("v > 50").select("x", "y")
    return R.region_table(cells, 0.09, 0.18, tile=32)


@query(
    "a14_dissolve",
    f"""WITH {OBS}, c AS (SELECT DISTINCT event_type, x, y FROM obs WHERE value > 100) SELECT event_type, count(*) AS n_cells, count(*) * 0.01::DOUBLE AS area FROM c GROUP BY 1""",
)
def a14(s, d):
    return R.dissolve(obs(s, d).where("value > 100"), ["event_type"], ["x", "y"], 0.01)


@query(
    "a36_multi_sensor_union_composite",
    f"""WITH {OBS}, u AS (SELECT user_id, p, 0.9723 * value + 0.0235 AS v, 'A' AS sensor FROM obs WHERE event_type IN ('click', 'error')
      UNION ALL SELECT user_id, p, value, 'B' FROM obs WHERE event_type = 'view')
    SELECT user_id, p, round(median(v) + 1e-9, 7) + 0.0 AS v_median, count(*) AS n, count(CASE WHEN sensor = 'A' THEN 1 END) AS n_a FROM u GROUP BY 1, 2""",
)
def a36(s, d):
    o = obs(s, d)
    a = o.where(F.col("event_type").isin("click", "error")).select("user_id", "p", S.harmonised("event_type", "value", HARM).alias("v"), F.lit("A").alias("sensor"))
    b = o.where("event_type = 'view'").select("user_id", "p", F.col("value").alias("v"), F.lit("B").alias("sensor"))
    u = a.unionByName(b)
    z = grouped_stats(u, ["user_id", "p"], "v", {"v_median": 0.5}, F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("sensor") == "A", 1)).alias("n_a"))
    return z.withColumn("v_median", rnd("v_median", 7))
