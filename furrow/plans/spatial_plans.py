"""Queries over tracks, points and cell sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import panel as P
from furrow.operators import sampling as M
from furrow.operators import spatial as G
from furrow.operators import tracks as K
from furrow.plans.base import OBS, obs, rnd, table
from furrow.plans.registry import query

FIX = f"""{OBS}, fix AS (SELECT user_id AS sid, event_id, ts, 80 + (epoch_us(ts) - 1704067200000000) / 1000000.0 / 86400 * 0.3 + value / 500 AS lon, 18 + k / 100.0 + (user_id % 7) * 0.3 AS lat,
   CASE WHEN event_type IN ('view', 'error') THEN value END AS wmo, CASE WHEN event_type IN ('click', 'view') THEN value * 1.1 END AS usa FROM obs)"""


def fixes(s, d):
    """Every pixel's record read as the fixes of one moving system."""
    o = obs(s, d)
    days = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1000000.0 / 86400
    return o.select(
        F.col("user_id").alias("sid"), "event_id", "ts",
        (F.lit(80) + days * 0.3 + F.col("value") / 500).alias("lon"),
        (F.lit(18) + F.col("k") / 100.0 + (F.col("user_id") % 7) * 0.3).alias("lat"),
        F.when(F.col("event_type").isin("view", "error"), F.col("value")).alias("wmo"),
        F.when(F.col("event_type").isin("click", "view"), F.col("value") * 1.1).alias("usa"),
    )


PTS = "pts AS (SELECT vec_id, label, 84.5 + embedding[1]::DOUBLE * 10 AS lon, 19.5 + embedding[2]::DOUBLE * 10 AS lat FROM embeddings)"


def points(s, d):
    e = table(s, d, "embeddings")
    return e.select(
        "vec_id", "label", (F.lit(84.5) + F.col("embedding")[0].cast("double") * 10).alias("lon"),
        (F.lit(19.5) + F.col("embedding")[1].cast("double") * 10).alias("lat"),
    )


HAV = "2 * {r} * asin(sqrt(pow(sin(radians({b2} - {b1}) / 2), 2) + cos(radians({b1})) * cos(radians({b2})) * pow(sin(radians({a2} - {a1}) / 2), 2)))"


def hav(a1, b1, a2, b2, r="6371.0"):
    return HAV.format(r=r, a1=a1, b1=b1, a2=a2, b2=b2)


@query(
    "j05_points_near_track",
    f"""WITH {FIX}, {PTS}, sg AS (SELECT sid, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM fix WINDOW w AS (PARTITION BY sid ORDER BY ts, event_id)),
    q AS (SELECT vec_id, (lon1 - lon) * cos(radians(lat)) * 111.32 AS ax, (lat1 - lat) * 111.32 AS ay, (lon2 - lon) * cos(radians(lat)) * 111.32 AS bx, (lat2 - lat) * 111.32 AS by_ FROM pts, sg WHERE lon2 IS NOT NULL),
    t AS (SELECT *, coalesce(greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0))), 0.0) AS t FROM q)
    SELECT vec_id, label FROM pts WHERE vec_id IN (SELECT vec_id FROM t WHERE sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) <= 4)""",
)
def j05(s, d):
    seg = K.segments(fixes(s, d), "sid", "ts", "event_id")
    return G.near_segments(points(s, d), seg, 4.0, cell=0.25).select("vec_id", "label")


@query(
    "j06_tracks_within_radius",
    f"WITH {FIX} SELECT sid, round(min({hav('lon', 'lat', '86.0', '18.6')}) + 1e-9, 6) AS min_dist_km FROM fix GROUP BY 1 HAVING min({hav('lon', 'lat', '86.0', '18.6')}) <= 40",
)
def j06(s, d):
    return G.groups_within(fixes(s, d), ["sid"], 86.0, 18.6, 40.0).withColumn("min_dist_km", rnd("min_dist_km"))


@query(
    "j07_as_of_landfall",
    f"""WITH {FIX}, a AS (SELECT sid, arg_min(ts, (pow(lon - 85, 2) + pow(lat - 19, 2), event_id)) AS t0 FROM fix GROUP BY 1)
    SELECT sid, count(*) AS n, max(ts) AS last_ts, round(max(lon) + 1e-9, 6) AS lon_max FROM fix JOIN a USING (sid) WHERE ts <= t0 + INTERVAL 12 HOUR GROUP BY 1""",
)
def j07(s, d):
    f = fixes(s, d)
    d2 = F.pow(F.col("lon") - 85, F.lit(2)) + F.pow(F.col("lat") - 19, F.lit(2))
    kept = K.until_landfall(f, "sid", "ts", K.nearest_fix(f, "sid", [d2, F.col("event_id")], ["ts"]), 12)
    return kept.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), rnd(F.max("lon")).alias("lon_max"))


@query(
    "j08_block_folds",
    f"""WITH {PTS}, b AS (SELECT DISTINCT CAST(floor(lon / 0.5) AS BIGINT) AS bx, CAST(floor(lat / 0.5) AS BIGINT) AS by_ FROM pts WHERE label < 5),
    f AS (SELECT *, least(floor(CAST('0x' || substr(md5(concat_ws('|', bx, by_, '42')), 1, 13) AS BIGINT) / pow(16, 13) * 5), 4) AS fold FROM b)
    SELECT vec_id, CAST(coalesce(fold, 0) AS INTEGER) AS fold FROM pts p LEFT JOIN f ON floor(lon / 0.5) = bx AND floor(lat / 0.5) = by_""",
)
def j08(s, d):
    p = points(s, d)
    blocks = G.block_folds(p.where("label < 5"), 0.5, 5)
    return G.with_fold(p, blocks, 0.5).select("vec_id", "fold")


@query(
    "j09_footprint_overlay",
    f"""WITH {OBS}, z AS (SELECT DISTINCT x, y, x // 5 AS zone FROM obs), fp AS (SELECT DISTINCT event_type, x, y FROM obs WHERE value > 120),
    za AS (SELECT zone, count(*) * 0.01::DOUBLE AS zone_area FROM z GROUP BY 1)
    SELECT event_type, zone, round(count(*) * 0.01::DOUBLE + 1e-9, 6) AS covered_area, round(count(*) * 0.01::DOUBLE / any_value(zone_area) + 1e-9, 6) AS share FROM fp JOIN z USING (x, y) JOIN za USING (zone) GROUP BY 1, 2""",
)
def j09(s, d):
    o = obs(s, d)
    zones = o.select("x", "y").distinct().withColumn("zone", F.floor(F.col("x") / 5).cast("long"))
    r = G.overlay_share(o.where("value > 120"), zones, ["event_type"], ["zone"], ["x", "y"], 0.01)
    return r.select("event_type", "zone", rnd("covered_area").alias("covered_area"), rnd("share").alias("share"))


@query(
    "j10_near_duplicate_points",
    f"""WITH {PTS} SELECT a.vec_id, a.label FROM pts a WHERE EXISTS (SELECT 1 FROM pts b WHERE a.label = b.label AND a.vec_id <> b.vec_id AND {hav('a.lon', 'a.lat', 'b.lon', 'b.lat', '6371000.0')} < 12000)""",
)
def j10(s, d):
    return G.near_duplicates(points(s, d), ["label"], "vec_id", 12000.0).select("vec_id", "label")


@query(
    "w09_nearest_fix_per_track",
    f"""WITH {FIX}, c AS (SELECT *, abs(lon - 85) * 100 AS d2l FROM fix WHERE dayofyear(ts) BETWEEN 5 AND 25 AND lon BETWEEN 81 AND 89 AND lat BETWEEN 17.5 AND 23),
    r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d2l, ts, event_id) AS rn FROM c)
    SELECT sid, event_id, CAST(dayofyear(ts) AS INTEGER) AS doy, round(d2l + 1e-9, 6) + 0.0 AS d2l, coalesce(wmo, usa) AS wind FROM r WHERE rn = 1""",
)
def w09(s, d):
    f = fixes(s, d).withColumn("d2l", F.abs(F.col("lon") - 85) * 100)
    f = f.where(F.dayofyear("ts").between(5, 25) & G.in_box("lon", "lat", (81, 17.5, 89, 23)))
    n = K.nearest_fix(f, "sid", [F.col("d2l"), F.col("ts"), F.col("event_id")], ["event_id", "ts", "d2l", "wmo", "usa"])
    return n.select("sid", "event_id", F.dayofyear("ts").alias("doy"), rnd("d2l").alias("d2l"), F.coalesce("wmo", "usa").alias("wind"))


@query(
    "w09_first_landfall_fix",
    f"""WITH {FIX}, r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) AS rn FROM fix WHERE lon >= 84) SELECT sid, event_id, ts, round(lon + 1e-9, 6) AS lon FROM r WHERE rn = 1""",
)
def w09_first(s, d):
    n = K.nearest_fix(fixes(s, d).where("lon >= 84"), "sid", [F.col("ts"), F.col("event_id")], ["event_id", "ts", "lon"])
    return n.withColumn("lon", rnd("lon"))


#: Published points of each metric as (metric, percentile, value); the inverted scale is negated.
BREAKS = [("wind", 10, 35.0), ("wind", 50, 90.0), ("wind", 90, 180.0), ("wind", 100, 300.0), ("low", 0, -20.0), ("low", 50, -5.0), ("low", 100, -0.05), ("day", 0, 1.0), ("day", 25, 8.0), ("day", 75, 22.0), ("day", 100, 31.0)]


@query(
    "w12_breakpoint_percentile",
    f"""WITH {FIX}, m AS (SELECT sid, 'wind' AS metric, max(wmo) AS v FROM fix GROUP BY 1 UNION ALL SELECT sid, 'low', -min(wmo) FROM fix GROUP BY 1 UNION ALL SELECT sid, 'day', CAST(day(max(ts)) AS DOUBLE) FROM fix GROUP BY 1),
    b AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {p}::DOUBLE, {v}::DOUBLE)" for m, p, v in BREAKS)}) t(metric, p, brk)),
    lo AS (SELECT sid, metric, v, max(brk) AS a0, arg_max(p, brk) AS p0 FROM m JOIN b USING (metric) WHERE brk <= v GROUP BY 1, 2, 3), hi AS (SELECT sid, metric, min(brk) AS a1, arg_min(p, brk) AS p1 FROM m JOIN b USING (metric) WHERE brk > v GROUP BY 1, 2)
    SELECT m.sid, m.metric, round(CASE WHEN m.v IS NULL THEN NULL WHEN a0 IS NULL THEN p1 WHEN a1 IS NULL THEN p0 ELSE p0 + (m.v - a0) / (a1 - a0) * (p1 - p0) END + 1e-9, 6) + 0.0 AS pct FROM m LEFT JOIN lo ON lo.sid = m.sid AND lo.metric = m.metric LEFT JOIN hi ON hi.sid = m.sid AND hi.metric = m.metric""",
)
def w12(s, d):
    """Three metrics of every system ranked by one join with their table of points."""
    f = fixes(s, d).groupBy("sid").agg(F.max("wmo").alias("wind"), (-F.min("wmo")).alias("low"), F.dayofmonth(F.max("ts")).cast("double").alias("day"))
    m = f.unpivot(["sid"], ["wind", "low", "day"], "metric", "v")
    breaks = P.literal_table(f, "metric string, p double, at double", [(a, float(b), c) for a, b, c in BREAKS])
    return K.breakpoint_ranks(m, "metric", "v", breaks, "p", "at").select("sid", "metric", rnd("pct").alias("pct"))


@query(
    "w13_track_assembly",
    f"""WITH {FIX} SELECT sid, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_fixes, max(greatest(wmo, usa)) AS max_wind FROM fix GROUP BY 1 HAVING count(*) >= 2""",
)
def w13(s, d):
    return K.track_summary(fixes(s, d), "sid", "ts", ["wmo", "usa"])


@query(
    "w13_track_line_parts",
    f"""WITH {FIX}, n AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) AS seq FROM fix)
    SELECT sid, CAST((seq - 1) // 20 AS INTEGER) AS part, count(*) AS n, round(arg_min(lon, seq) + 1e-9, 6) AS lon_first, round(arg_max(lon, seq) + 1e-9, 6) AS lon_last FROM n GROUP BY 1, 2""",
)
def w13_parts(s, d):
    p = K.track_parts(fixes(s, d), "sid", "ts", "event_id", size=20)
    return p.select("sid", "part", F.size("line").cast("long").alias("n"), rnd(F.col("line")[0]["lon"]).alias("lon_first"), rnd(F.element_at("line", -1)["lon"]).alias("lon_last"))


@query(
    "p22_multipoint_explode",
    f"""WITH {FIX}, n AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) AS seq FROM fix)
    SELECT sid, CAST((seq - 1) // 20 AS INTEGER) AS part, CAST((seq - 1) % 20 AS INTEGER) AS pos, round(lon + 1e-9, 6) AS lon, round(lat + 1e-9, 6) AS lat FROM n""",
)
def p22(s, d):
    p = K.track_parts(fixes(s, d), "sid", "ts", "event_id", size=20)
    return p.select("sid", "part", F.posexplode("line").alias("pos", "pt")).select("sid", "part", "pos", rnd("pt.lon").alias("lon"), rnd("pt.lat").alias("lat"))


@query(
    "a25_lifetime_max_wind",
    f"""WITH {FIX} SELECT sid, max(greatest(coalesce(wmo, usa), coalesce(usa, wmo))) AS vmax, coalesce(arg_min(coalesce(wmo, usa, -1), event_id), -1) AS first_wind, count(coalesce(wmo, usa)) AS n FROM fix GROUP BY 1""",
)
def a25(s, d):
    f = fixes(s, d)
    return f.groupBy("sid").agg(
        F.max(F.greatest("wmo", "usa")).alias("vmax"), F.min_by(F.coalesce("wmo", "usa", F.lit(-1.0)), "event_id").alias("first_wind"), F.count(F.coalesce("wmo", "usa")).alias("n")
    )


# --- sampling ----------------------------------------------------------------------------

@query(
    "a15_stratified_sample",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', event_id, '42')), event_id) AS rn FROM events) SELECT event_type, event_id, value FROM r WHERE rn <= 50""",
)
def a15(s, d):
    return M.stratified_sample(table(s, d, "events"), ["event_type"], ["event_id"], 50).select("event_type", "event_id", "value")


@query(
    "w10_sequential_ids",
    """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM events)
    SELECT event_type, event_id, idx, event_type || '_' || CASE WHEN length(idx::VARCHAR) >= 4 THEN idx::VARCHAR ELSE lpad(idx::VARCHAR, 4, '0') END AS cell_id FROM r""",
)
def w10(s, d):
    e = table(s, d, "events").select("event_type", "event_id")
    out = M.sequential_ids(e, ["event_type"], ["event_id"], F.floor(F.col("event_id") / 2**20))
    return out.withColumn("cell_id", M.padded_id(F.col("event_type"), F.col("idx")))


@query(
    "m09_label_panel_assembly",
    f"""WITH {OBS}, fp AS (SELECT DISTINCT event_type AS cyclone, x, y FROM obs WHERE value > 120),
    fs AS (SELECT cyclone, x, y FROM (SELECT *, row_number() OVER (PARTITION BY cyclone ORDER BY md5(concat_ws('|', x, y, '7')), x, y) AS rn FROM fp) WHERE rn <= 20),
    ca AS (SELECT 'none' AS cyclone, x, y FROM (SELECT DISTINCT x, y FROM obs) WHERE (x, y) NOT IN (SELECT (x, y) FROM fp)),
    u AS (SELECT 'flood' AS class_name, 2 AS class_id, cyclone, x, y FROM fs UNION ALL SELECT 'dry', 1, cyclone, x, y FROM ca)
    SELECT class_name, class_id, cyclone, x, y, row_number() OVER (ORDER BY class_name, cyclone, y, x) - 1 AS label_id FROM u""",
)
def m09(s, d):
    o = obs(s, d)
    fp = o.where("value > 120").select(F.col("event_type").alias("cyclone"), "x", "y").distinct()
    flood = M.stratified_sample(fp, ["cyclone"], ["x", "y"], 20, seed=7).select(F.lit("flood").alias("class_name"), F.lit(2).alias("class_id"), "cyclone", "x", "y")
    dry = o.select("x", "y").distinct().join(fp, ["x", "y"], "left_anti").select(F.lit("dry").alias("class_name"), F.lit(1).alias("class_id"), F.lit("none").alias("cyclone"), "x", "y")
    u = flood.unionByName(dry)
    # one global numbering: rows are ordered inside (class, event, grid row) bins only
    names = F.concat_ws("|", "class_name", "cyclone", F.lpad(F.col("y").cast("string"), 12, "0"))
    return M.sequential_ids(u, [], ["class_name", "cyclone", "y", "x"], names, "label_id")
