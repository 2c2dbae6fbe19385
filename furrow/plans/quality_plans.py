"""Queries over rules, verdicts, text references, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions.ranking import column_medians
from furrow.operators import panel as P
from furrow.operators import quality as Q
from furrow.operators import spatial as G
from furrow.operators import text_refs as X
from furrow.operators import tracks as K
from furrow.plans.base import LONG_PANEL, NATION_PANEL, OBS, long_panel, nation_panel, obs, orders_located, periods, rnd, table
from furrow.plans.panel_plans import FEAT, features
from furrow.plans.registry import query
from furrow.plans.spatial_plans import FIX, PTS, fixes, hav, points
from furrow.session import cut_lineage, scratch_path
from furrow.sources import readers as R
from furrow.sources import sinks as W

PIXELS = """pix AS (SELECT n_nationkey AS unit, year, month(o_orderdate) AS mo, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rmsr FROM loc GROUP BY 1, 2, 3),
    cells AS (SELECT unit, year, avg(CASE WHEN rmsr > 0.5 THEN 1.0 ELSE 0.0 END) AS poor, count(CASE WHEN NOT rmsr > 0.5 THEN 1 END) AS n_ok FROM pix GROUP BY 1, 2)"""

# --- rule suites ---------------------------------------------------------------------------


@query(
    "a27_three_gate_check",
    f"""WITH {LONG_PANEL}, pn AS (SELECT unit, year, metric, round(y / 1000) AS v FROM long WHERE product = 'corrected'),
    c AS (SELECT metric, v, count(*) AS cnt FROM pn GROUP BY 1, 2), mm AS (SELECT metric, sum(cnt)::BIGINT AS n, count(*) AS nu, max(cnt) / sum(cnt) AS ms FROM c GROUP BY 1),
    w AS (SELECT * FROM (VALUES ('p25', 100, 160), ('p50', 220, 260), ('p75', 300, 340)) t(metric, lo, hi)), md AS (SELECT metric, median(v) AS med FROM pn GROUP BY 1),
    {PIXELS}, px AS (SELECT max(poor) AS worst, min(n_ok) AS least FROM cells), need AS (SELECT * FROM (VALUES ('p25', 20), ('p50', 20), ('p75', 25)) t(metric, k)),
    r AS (SELECT metric, 'A_rows' AS "check", n::DOUBLE AS observed, n >= 48 AS ok FROM mm UNION ALL SELECT metric, 'A_unique', nu::DOUBLE, nu >= k FROM mm JOIN need USING (metric) UNION ALL SELECT metric, 'A_mode_share', ms, ms <= 0.2 FROM mm
      UNION ALL SELECT metric, 'B_window', med, med BETWEEN lo AND hi FROM md JOIN w USING (metric) UNION ALL SELECT metric, 'C_fit', worst, worst <= 0.5 FROM mm, px UNION ALL SELECT metric, 'A_n_ok', least::DOUBLE, least >= 5 FROM mm, px)
    SELECT metric, "check", round(observed + 1e-9, 6) + 0.0 AS observed, ok FROM r""",
)
def a27(s, d):
    verdict, _ = gates(s, d)
    return verdict.withColumn("observed", rnd("observed"))


def pixels(s, d):
    """A pixel is a month of a nation's year; its residual is the share of finished orders."""
    keys = [F.col("n_nationkey").alias("unit"), "year", F.month("o_orderdate").alias("month")]
    return orders_located(s, d).groupBy(*keys).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rmsr"))


GATE = dict(windows={"p25": (100.0, 160.0), "p50": (220.0, 260.0), "p75": (300.0, 340.0)}, min_rows=48, min_unique={"p25": 20, "p50": 20, "p75": 25}, max_mode=0.2, max_rmsr=0.5, max_poor=0.5, min_ok=5)


def gates(s, d):
    lp = cut_lineage(long_panel(s, d))
    pn = lp.where("product = 'corrected'").select("unit", "year", "metric", F.round(F.col("y") / 1000).alias("v"))
    return Q.three_gates(pn, pixels(s, d), "metric", "v", unit=["unit", "year"], **GATE)


@query(
    "a27_passing_panel",
    f"""WITH {LONG_PANEL}, pn AS (SELECT unit, year, metric, round(y / 1000) AS v FROM long WHERE product = 'corrected'),
    c AS (SELECT metric, v, count(*) AS cnt FROM pn GROUP BY 1, 2), mm AS (SELECT metric FROM c GROUP BY 1 HAVING sum(cnt) >= 48 AND count(*) >= CASE metric WHEN 'p75' THEN 25 ELSE 20 END AND max(cnt) / sum(cnt) <= 0.2),
    w AS (SELECT * FROM (VALUES ('p25', 100, 160), ('p50', 220, 260), ('p75', 300, 340)) t(metric, lo, hi)),
    {PIXELS}
    SELECT unit, year, metric, v FROM pn JOIN mm USING (metric) JOIN w USING (metric) JOIN cells USING (unit, year) WHERE v BETWEEN lo AND hi AND poor <= 0.5 AND n_ok >= 5""",
)
def a27_panel(s, d):
    return gates(s, d)[1]


LABEL_SQL = f"{PTS}, lab AS (SELECT *, CASE WHEN label < 5 THEN 'flood' ELSE 'dry' END AS class_name, CASE WHEN label IN (0, 1, 2, 3, 4, 9) THEN 2 ELSE 1 END AS class_id, CASE WHEN label % 3 = 0 THEN 'A' WHEN label % 3 = 1 THEN 'B' ELSE 'C' END AS cyclone, 2019 + label % 4 AS year FROM pts)"


def label_panel(s, d):
    p = points(s, d)
    third = F.col("label") % 3
    return p.withColumns({
        "class_name": F.when(F.col("label") < 5, "flood").otherwise("dry"),
        "class_id": F.when(F.col("label").isin(0, 1, 2, 3, 4, 9), 2).otherwise(1),
        "cyclone": F.when(third == 0, "A").when(third == 1, "B").otherwise("C"),
        "year": F.col("label") % 4 + 2019,
    })


@query(
    "a29_label_quality_suite",
    f"""WITH {LABEL_SQL}, c AS (SELECT cy.c AS cyclone, cl.c AS class_name, count(lab.vec_id) AS n FROM (VALUES ('A'), ('B'), ('C')) cy(c) CROSS JOIN (VALUES ('flood'), ('dry')) cl(c) LEFT JOIN lab ON lab.cyclone = cy.c AND lab.class_name = cl.c GROUP BY 1, 2),
    sp AS (SELECT class_name, stddev_samp(lon) AS sx, stddev_samp(lat) AS sy FROM lab GROUP BY 1),
    r AS (SELECT '01_schema' AS rule, 0::BIGINT AS n_bad UNION ALL SELECT '02_row_count', CASE WHEN count(*) BETWEEN 400 AND 600 THEN 0 ELSE 1 END FROM lab
      UNION ALL SELECT '03_balance', CASE WHEN abs(count(CASE WHEN class_name = 'flood' THEN 1 END) - count(CASE WHEN class_name = 'dry' THEN 1 END)) <= 0.1 * count(*) THEN 0 ELSE 1 END FROM lab
      UNION ALL SELECT '04_purity', count(CASE WHEN class_name NOT IN ('flood', 'dry') THEN 1 END) FROM lab UNION ALL SELECT '05_id_name', count(CASE WHEN (class_id = 2) <> (class_name = 'flood') THEN 1 END) FROM lab
      UNION ALL SELECT '06_coverage', count(*) FROM c WHERE n < 70 UNION ALL SELECT '07_key_year', count(CASE WHEN CASE cyclone WHEN 'A' THEN 2019 WHEN 'B' THEN 2020 ELSE 2021 END <> year THEN 1 END) FROM lab
      UNION ALL SELECT '08_bounds', count(CASE WHEN NOT (lon BETWEEN 82.5 AND 86.5 AND lat BETWEEN 17.5 AND 21.5) THEN 1 END) FROM lab UNION ALL SELECT '09_spread', count(*) FROM sp WHERE sx < 0.1 OR sy < 0.1
      UNION ALL SELECT '10_near_duplicates', count(*) FROM lab a WHERE EXISTS (SELECT 1 FROM lab b WHERE a.class_name = b.class_name AND a.vec_id <> b.vec_id AND {hav('a.lon', 'a.lat', 'b.lon', 'b.lat', '6371000.0')} < 5000))
    SELECT rule, n_bad = 0 AS ok, n_bad FROM r""",
)
def a29(s, d):
    lab = label_panel(s, d)
    flood = F.count(F.when(F.col("class_name") == "flood", 1))
    dry = F.count(F.when(F.col("class_name") == "dry", 1))
    want = F.when(F.col("cyclone") == "A", 2019).when(F.col("cyclone") == "B", 2020).otherwise(2021)
    one_pass = Q.run_rules(lab, {
        "02_row_count": F.when(F.count("*").between(400, 600), 0).otherwise(1),
        "03_balance": F.when(F.abs(flood - dry) <= 0.1 * F.count("*"), 0).otherwise(1),
        "04_purity": Q.bad_rows(F.col("class_name").isin("flood", "dry")),
        "05_id_name": Q.bad_rows((F.col("class_id") == 2) == (F.col("class_name") == "flood")),
        "07_key_year": Q.bad_rows(want == F.col("year")),
        "08_bounds": Q.bad_rows(G.in_box("lon", "lat", (82.5, 17.5, 86.5, 21.5))),
    })
    required = ["vec_id", "lon", "lat", "class_name", "class_id", "cyclone", "year"]
    schema = Q.schema_rule(lab, required).withColumn("rule", F.lit("01_schema"))
    axis = P.literal_table(lab, "cyclone string", [("A",), ("B",), ("C",)])
    low = Q.coverage(lab, P.design_grid(axis, {"class_name": ["flood", "dry"]}), ["cyclone", "class_name"], 70).where("not ok")
    spread = lab.groupBy("class_name").agg(F.stddev_samp("lon").alias("sx"), F.stddev_samp("lat").alias("sy")).where("sx < 0.1 or sy < 0.1")
    dup = G.near_duplicates(lab, ["class_name"], "vec_id", 5000.0)
    return Q.union_rules(schema, one_pass, Q.count_rule("06_coverage", low), Q.count_rule("09_spread", spread), Q.count_rule("10_near_duplicates", dup))


@query("a29_clean_sorted_panel", f"WITH {LABEL_SQL} SELECT vec_id, class_name, cyclone, round(lat + 1e-9, 6) AS lat, round(lon + 1e-9, 6) AS lon FROM lab ORDER BY cyclone, class_name, lat, lon")
def a29_clean(s, d):
    return label_panel(s, d).orderBy("cyclone", "class_name", "lat", "lon").select("vec_id", "class_name", "cyclone", rnd("lat").alias("lat"), rnd("lon").alias("lon"))


@query(
    "a30_panel_quality_suite",
    f"""WITH {NATION_PANEL}, r AS (SELECT '01_columns' AS rule, 0::BIGINT AS n_bad UNION ALL SELECT '02_rows', abs(count(*) - (SELECT count(*) FROM nation) * count(DISTINCT year)) FROM panel UNION ALL SELECT '03_units', (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT unit FROM panel))
      UNION ALL SELECT '04_years', count(CASE WHEN year NOT BETWEEN 1995 AND 2001 THEN 1 END) FROM panel UNION ALL SELECT '05_treatment', count(CASE WHEN (treat = 1) <> (region <= 1) THEN 1 END) FROM panel
      UNION ALL SELECT '06_event', count(CASE WHEN coalesce(CASE WHEN treat = 1 AND post = 1 THEN 'wave' ELSE 'none' END, '') NOT IN ('wave', 'none') OR (treat = 1 AND post = 1) <> (region <= 1 AND year IN (1997, 1998, 1999)) THEN 1 END) FROM panel
      UNION ALL SELECT '07_qa', count(CASE WHEN n < 95 THEN 1 END) FROM panel
      UNION ALL SELECT '08_range', count(CASE WHEN NOT (y BETWEEN 1 AND 255000) THEN 1 END) FROM panel UNION ALL SELECT '09_support', count(CASE WHEN n < 60 THEN 1 END) FROM panel)
    SELECT rule, n_bad = 0 AS ok, n_bad FROM r""",
)
def a30(s, d):
    p = nation_panel(s, d).withColumns({
        "event": F.when((F.col("treat") == 1) & (F.col("post") == 1), "wave").otherwise("none"),
        "qa": F.when(F.col("n") < 70, "excluded").when(F.col("n") < 95, "gap-filled").otherwise("OK"),
    })
    wave = (F.col("region") <= 1) & F.col("year").isin(1997, 1998, 1999)
    rules = Q.run_rules(p, {
        "02_rows": F.abs(F.count("*") - table(s, d, "nation").count() * F.count_distinct("year")),
        "04_years": Q.bad_rows(F.col("year").between(1995, 2001)),
        "05_treatment": Q.bad_rows((F.col("treat") == 1) == (F.col("region") <= 1)),
        "06_event": Q.bad_rows(F.col("event").isin("wave", "none") & ((F.col("event") == "wave") == wave)),
        "07_qa": Q.bad_rows(F.col("qa") == "OK"),
        "08_range": Q.bad_rows(F.col("y").isNull() | F.col("y").between(1, 255000)),
        "09_support": Q.bad_rows(F.col("n") >= 60),
    })
    cols = Q.schema_rule(p, ["unit", "region", "year", "y", "n", "treat", "post"]).withColumn("rule", F.lit("01_columns"))
    absent = table(s, d, "nation").join(p.select(F.col("unit").alias("n_nationkey")).distinct(), "n_nationkey", "left_anti")
    return Q.union_rules(cols, rules, Q.count_rule("03_units", absent))


PRED = """pr AS (SELECT d.doc_id, l.quality AS label, CASE WHEN n_chars BETWEEN 350 AND 4000 AND lang <> 'de' THEN 1 ELSE 0 END AS pred FROM documents d JOIN labels l USING (doc_id))"""


@query(
    "a31_confusion_and_accuracy",
    f"""WITH {PRED}, t AS (SELECT count(*) AS n, count(CASE WHEN label = pred THEN 1 END) AS hit FROM pr), c AS (SELECT x.c AS cls, count(CASE WHEN label = x.c THEN 1 END) AS n_ref, count(CASE WHEN pred = x.c THEN 1 END) AS n_pred, count(CASE WHEN label = x.c AND pred = x.c THEN 1 END) AS tp FROM pr, (VALUES (0), (1)) x(c) GROUP BY 1),
    a AS (SELECT *, coalesce(tp / nullif(n_ref, 0), 0) AS pa, coalesce(tp / nullif(n_pred, 0), 0) AS ua FROM c), f AS (SELECT *, coalesce(2 * pa * ua / nullif(pa + ua, 0), 0) AS f1 FROM a),
    w AS (SELECT sum(n_ref * n_pred / (t.n * t.n)) AS pe, any_value(t.hit / t.n) AS oa, avg(f1) AS fm, sum(f1 * n_ref) / sum(n_ref) AS fw FROM f, t)
    SELECT cls, n_ref, n_pred, tp, round(pa + 1e-9, 6) + 0.0 AS producer_acc, round(ua + 1e-9, 6) + 0.0 AS user_acc, round(f1 + 1e-9, 6) + 0.0 AS f1, round(oa + 1e-9, 6) + 0.0 AS oa, round((oa - pe) / (1 - pe) + 1e-9, 6) + 0.0 AS kappa, round(fm + 1e-9, 6) + 0.0 AS f1_macro, round(fw + 1e-9, 6) + 0.0 AS f1_weighted FROM f, w""",
)
def a31(s, d):
    pr = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(
        F.col("quality").alias("label"), F.when(F.col("n_chars").between(350, 4000) & (F.col("lang") != "de"), 1).otherwise(0).alias("pred")
    )
    acc = Q.accuracy(pr.groupBy("label", "pred").agg(F.count("*").alias("n")))
    return acc.withColumns({c: rnd(c) for c in ("producer_acc", "user_acc", "f1", "oa", "kappa", "f1_macro", "f1_weighted")})


@query(
    "a31_confusion_rows",
    f"""WITH {PRED}, c AS (SELECT label, pred, count(*) AS n FROM pr GROUP BY 1, 2), k AS (SELECT label AS k FROM pr UNION SELECT pred FROM pr), g AS (SELECT a.k AS label, b.k AS pred FROM k a, k b)
    SELECT g.label, g.pred, coalesce(n, 0) AS n, round(coalesce(n, 0) / nullif(sum(n) OVER (PARTITION BY g.label), 0) + 1e-9, 6) + 0.0 AS share_of_label FROM g LEFT JOIN c ON c.label = g.label AND c.pred = g.pred""",
)
def a31_rows(s, d):
    pr = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(
        F.col("quality").alias("label"), F.when(F.col("n_chars").between(350, 4000) & (F.col("lang") != "de"), 1).otherwise(0).alias("pred")
    )
    r = Q.confusion_rows(pr, "label", "pred")
    return r.withColumn("share_of_label", rnd("share_of_label"))


@query(
    "a32_class_separation_checks",
    f"""WITH {FEAT}, m AS (SELECT median(CASE WHEN quality = 1 THEN f1 END) - median(CASE WHEN quality = 0 THEN f1 END) AS g1, median(CASE WHEN quality = 1 THEN f2 END) - median(CASE WHEN quality = 0 THEN f2 END) AS g2 FROM f)
    SELECT 'f1_gap' AS "check", round(g1 + 1e-9, 6) + 0.0 AS observed, CASE WHEN g1 >= 100 THEN 'PASS' ELSE 'FAIL' END AS status FROM m UNION ALL SELECT 'f2_gap', round(g2 + 1e-9, 6) + 0.0, CASE WHEN g2 >= 20 THEN 'PASS' ELSE 'FAIL' END FROM m
    UNION ALL SELECT 'opposite_sign', round(g1 * g2 + 1e-9, 6) + 0.0, CASE WHEN g1 * g2 < 0 THEN 'PASS' ELSE 'FAIL' END FROM m""",
)
def a32(s, d):
    m = column_medians(features(s, d), ["quality"], {"f1": "m1", "f2": "m2"})
    pick = lambda c, q: F.max(F.when(F.col("quality") == q, F.col(c)))
    g = m.agg((pick("m1", 1) - pick("m1", 0)).alias("g1"), (pick("m2", 1) - pick("m2", 0)).alias("g2"))
    g1, g2 = F.col("g1"), F.col("g2")
    checks = F.array(*[
        F.struct(F.lit(n).alias("check"), rnd(v).alias("observed"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))
        for n, v, ok in (("f1_gap", g1, g1 >= 100), ("f2_gap", g2, g2 >= 20), ("opposite_sign", g1 * g2, g1 * g2 < 0))
    ])
    return g.select(F.explode(checks).alias("c")).select("c.*")


@query(
    "a35_claim_reconciliation",
    f"""WITH {NATION_PANEL}, act AS (SELECT region, year, avg(y) AS value FROM panel GROUP BY 1, 2 HAVING NOT (region = 4 AND year = 1999)), ex AS (SELECT n_regionkey AS region, year, round(avg(o_totalprice), -2) AS value FROM loc GROUP BY 1, 2)
    SELECT ex.region, ex.year, CASE WHEN act.value IS NULL THEN 'missing' WHEN abs(ex.value - act.value) > 150 THEN 'mismatch' ELSE 'ok' END AS status FROM ex LEFT JOIN act USING (region, year)""",
)
def a35(s, d):
    from furrow.plans.base import orders_located

    act = nation_panel(s, d).groupBy("region", "year").agg(F.avg("y").alias("value")).where("not (region = 4 and year = 1999)")
    ex = orders_located(s, d).groupBy(F.col("n_regionkey").alias("region"), "year").agg(F.round(F.avg("o_totalprice"), -2).alias("value"))
    return Q.reconcile(ex, act, ["region", "year"], 150).select("region", "year", "status")


@query(
    "u04_domain_difference",
    """WITH h AS (SELECT DISTINCT o_orderpriority AS value FROM orders), w AS (SELECT * FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('6-NONE')) t(value))
    SELECT value, 'unexpected' AS finding FROM h WHERE value NOT IN (SELECT value FROM w) UNION ALL SELECT value, 'missing' FROM w WHERE value NOT IN (SELECT value FROM h)""",
)
def u04(s, d):
    return Q.domain_difference(table(s, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "6-NONE"])


# --- text references -----------------------------------------------------------------------------

WORD = "[a-z]{9,}"
CITES = f"""ci AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS target FROM documents), cat AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS target FROM benchmark)"""


def catalogue(s, d):
    return X.citations(table(s, d, "benchmark"), "item_id", "text", WORD).select("target").distinct()


@query("j17_reference_counts", f"WITH {CITES} SELECT cat.target, count(ci.doc_id) AS n_mentions, min(ci.doc_id) AS first_doc FROM cat LEFT JOIN ci USING (target) GROUP BY 1")
def j17(s, d):
    return X.forward_counts(X.citations(table(s, d, "documents"), "doc_id", "text", WORD), catalogue(s, d), "doc_id")


@query("j17_unresolved_references", f"WITH {CITES} SELECT target, count(*) AS n_mentions FROM ci WHERE target NOT IN (SELECT target FROM cat) GROUP BY 1")
def j17_rev(s, d):
    return X.unresolved(X.citations(table(s, d, "documents"), "doc_id", "text", WORD), catalogue(s, d))


@query(
    "u03_run_difference",
    f"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS t FROM conversations), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS t FROM benchmark)
    SELECT '{{"check":"ref","match":"' || coalesce(a.t, b.t) || '"}}' AS key, CASE WHEN a.t IS NULL THEN 'new' WHEN b.t IS NULL THEN 'fixed' ELSE 'carried' END AS state FROM a FULL JOIN b ON a.t = b.t""",
)
def u03(s, d):
    one = lambda df, k: X.citations(df, k, "text", WORD).select(F.lit("ref").alias("check"), F.col("target").alias("match"))
    return X.run_difference(one(table(s, d, "conversations"), "conv_id"), one(table(s, d, "benchmark"), "item_id"), ["match", "check"])


# --- sources and sinks ------------------------------------------------------------------------------


@query("s01_panel_csv_scan", f"WITH {NATION_PANEL} SELECT year, count(*) AS n, round(sum(y) + 1e-9, 2) + 0.0 AS y, sum(n)::BIGINT AS support FROM panel GROUP BY 1")
def s01(s, d):
    path = scratch_path(s, "panel")
    cols = ["unit", "region", "year", "y", "n", "treat"]
    W.write_csv(nation_panel(s, d), path, cols)
    back = R.read_panel(s, path, "unit int, region int, year int, y double, n long, treat int", cols)
    return back.groupBy("year").agg(F.count("*").alias("n"), rnd(F.sum("y"), 2).alias("y"), F.sum(back["n"]).alias("support"))


@query("s02_track_csv_scan", f"WITH {FIX} SELECT sid, count(*) AS n, round(max(wmo) + 1e-9, 6) + 0.0 AS wmo, count(usa) AS n_usa FROM fix WHERE dayofyear(ts) <= 31 GROUP BY 1")
def s02(s, d):
    path = scratch_path(s, "tracks")
    f = fixes(s, d).select(
        F.col("sid").cast("string").alias("SID"), F.lit("2024").alias("SEASON"), F.col("ts").cast("string").alias("ISO_TIME"), F.col("lat").cast("string").alias("LAT"),
        F.coalesce(F.col("wmo").cast("string"), F.lit(" ")).alias("WMO_WIND"), F.coalesce(F.col("usa").cast("string"), F.lit(" ")).alias("USA_WIND"),
    )
    units = P.literal_table(f, "SID string, SEASON string, ISO_TIME string, LAT string, WMO_WIND string, USA_WIND string", [(" ", "Year", " ", "degrees", "kts", "kts")])
    units.unionByName(f).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    t = R.read_tracks(s, path, ["LAT", "WMO_WIND", "USA_WIND"], ["SID", "SEASON", "ISO_TIME", "LAT", "WMO_WIND", "USA_WIND"])
    return t.groupBy(F.col("SID").cast("long").alias("sid")).agg(F.count("*").alias("n"), rnd(F.max("WMO_WIND")).alias("wmo"), F.count("USA_WIND").alias("n_usa"))


@query("s03_multi_file_provenance", "SELECT n_regionkey AS region, count(*) AS n, 1::BIGINT AS n_files FROM nation GROUP BY 1")
def s03(s, d):
    path = scratch_path(s, "files")
    n = table(s, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("region"))
    n.repartition(5, "region").write.option("header", True).partitionBy("region").csv(path)
    back = R.read_with_provenance(s, [path], "n_nationkey int, n_name string")
    region = F.regexp_extract("src_file", "region=([0-9]+)", 1).cast("int")
    return back.groupBy(region.alias("region")).agg(F.count("*").alias("n"), F.count_distinct("src_file").alias("n_files"))


@query("s04_feature_scan", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS zone, 'Point' AS geom_type FROM nation WHERE n_regionkey IN (1, 2)")
def s04(s, d):
    path = scratch_path(s, "features")
    n = table(s, d, "nation")
    feat = F.struct(
        F.lit("Feature").alias("type"), F.create_map(F.lit("NAME"), F.col("n_name"), F.lit("ZONE"), F.col("n_regionkey").cast("string")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col("n_nationkey").cast("double"), F.lit(20.0)).alias("coordinates")).alias("geometry"),
    )
    # one collection per zone: a feature file holds a zone's features and no more
    n.groupBy("n_regionkey").agg(F.lit("FeatureCollection").alias("type"), F.collect_list(feat).alias("features")).write.partitionBy("n_regionkey").json(path)
    f = R.read_features(s, path, ["NAME", "ZONE"]).where(F.col("ZONE").isin("1", "2"))
    return f.select(F.col("NAME").alias("name"), F.col("ZONE").alias("zone"), "geom_type")


@query("s08_csv_sink", f"WITH {NATION_PANEL} SELECT unit, year, n FROM panel")
def s08(s, d):
    path = scratch_path(s, "csv")
    W.write_csv(nation_panel(s, d), path, ["unit", "year", "n"])
    return s.read.schema("unit int, year int, n long").option("header", True).csv(path)


@query(
    "s09_managed_table_sink",
    "SELECT n_regionkey AS region, count(DISTINCT c_custkey) AS n, count(o_orderkey) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def s09(s, d):
    """Two tables by name, bucketed alike: the join and the count per customer move no rows."""
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"))
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    names = []
    for df, kind in ((c, "customers"), (o, "orders")):
        path = scratch_path(s, kind)
        names.append("furrow_" + path.rsplit("-", 1)[-1])
        W.save_bucketed(df, names[-1], "c_custkey", 16, path)
    per = s.table(names[0]).join(s.table(names[1]), "c_custkey", "left").groupBy("c_custkey").agg(F.max("region").alias("region"), F.count("o_orderkey").alias("n_orders"))
    return per.groupBy("region").agg(F.count("*").alias("n"), F.sum("n_orders").alias("n_orders"))


@query("s10_stamped_partition_sink", f"WITH {OBS} SELECT event_type, x, y, round(avg(value) + 1e-9, 6) + 0.0 AS v, 42 AS seed, 'grid' AS method FROM obs GROUP BY 1, 2, 3")
def s10(s, d):
    path = scratch_path(s, "raster")
    img = obs(s, d).groupBy("event_type", "x", "y").agg(F.avg("value").alias("v"))
    W.write_stamped(img, path, ["event_type"], {"seed": 42, "method": "grid"})
    return s.read.parquet(path).select("event_type", "x", "y", rnd("v").alias("v"), "seed", "method")


@query("s11_unit_outputs_with_rejects", f"WITH {NATION_PANEL} SELECT 'ok' AS kind, count(*) AS n FROM panel WHERE share >= 0.3 UNION ALL SELECT 'reject', count(*) FROM panel WHERE share < 0.3")
def s11(s, d):
    good, bad = W.write_units(nation_panel(s, d), scratch_path(s, "units"), "unit", F.col("share") >= 0.3)
    n = F.count("*").alias("n")
    return s.read.parquet(good).agg(n).select(F.lit("ok").alias("kind"), "n").unionByName(s.read.parquet(bad).agg(n).select(F.lit("reject").alias("kind"), "n"))


@query("s12_track_line_sink", f"WITH {FIX} SELECT sid, count(*) AS n_points, round(sum(lon) + 1e-9, 4) + 0.0 AS lon_sum FROM fix GROUP BY 1")
def s12(s, d):
    path = scratch_path(s, "lines")
    W.write_track_lines(K.track_parts(fixes(s, d), "sid", "ts", "event_id", 100), path, ["sid", "part"])
    back = W.read_track_lines(s, path, "sid:long,part:int")
    pts = back.select(F.col("properties.sid").alias("sid"), F.explode("geometry.coordinates").alias("c"))
    return pts.groupBy("sid").agg(F.count("*").alias("n_points"), rnd(F.sum(F.col("c")[0]), 4).alias("lon_sum"))


@query("s13_nested_json_round_trip", f"WITH {NATION_PANEL}, g AS (SELECT region, count(*)::DOUBLE AS n, avg(y) AS y FROM panel GROUP BY 1) SELECT region, 'n' AS metric, round(n + 1e-9, 4) + 0.0 AS value FROM g UNION ALL SELECT region, 'y', round(y + 1e-9, 4) + 0.0 FROM g")
def s13(s, d):
    path = scratch_path(s, "card")
    g = nation_panel(s, d).groupBy("region").agg(F.create_map(F.lit("n"), F.count("*").cast("double"), F.lit("y"), F.avg("y")).alias("metrics"))
    W.write_nested(g, path)
    return W.flatten_metrics(s.read.schema("region int, metrics map<string,double>").json(path), ["region"], "metrics").withColumn("value", rnd("value", 4))


@query("s14_resume_pending_units", f"WITH {NATION_PANEL} SELECT unit, year, n FROM panel")
def s14(s, d):
    """Three runs into one table: the early years, what is pending of all, and nothing more."""
    p = nation_panel(s, d).select("unit", "year", "n")
    path = scratch_path(s, "resumed")
    rows = lambda units: p.join(units, ["unit", "year"], "left_semi")
    for todo in (p.where("year < 1998 and n > 80"), p, p):
        W.append_pending(todo, rows, path, ["unit", "year"])
    return W.finished_rows(s, path)


@query(
    "s15_partition_refresh",
    f"WITH {NATION_PANEL} SELECT unit, year, round(CASE WHEN year IN (1998, 1999) THEN share * 2 ELSE share END + 1e-9, 6) + 0.0 AS share, CASE WHEN year IN (1998, 1999) THEN 'refresh' ELSE 'base' END AS source FROM panel",
)
def s15(s, d):
    """A table written by year, two of whose years are replaced twice, read back."""
    p = nation_panel(s, d).select("unit", "year", "share", F.lit("base").alias("source"))
    path = scratch_path(s, "refreshed")
    W.write_partitioned(p, path, ["year"])
    new = p.withColumn("share", F.col("share") * 2).withColumn("source", F.lit("refresh"))
    for _ in range(2):
        W.refresh_partitions(new, path, ["year"], F.col("year").isin(1998, 1999))
    return s.read.schema(p.schema).parquet(path).select("unit", "year", rnd("share").alias("share"), "source")


@query("s16_missing_partitions", f"WITH {OBS}, e AS (SELECT u.user_id, p.p FROM (SELECT DISTINCT user_id FROM obs) u, gr p), h AS (SELECT DISTINCT user_id, p FROM obs WHERE event_type = 'signup') SELECT user_id, CAST(p AS INTEGER) AS p FROM e WHERE (user_id, p) NOT IN (SELECT (user_id, p) FROM h)")
def s16(s, d):
    o = obs(s, d)
    expected = P.design_grid(o.select("user_id").distinct(), {"p": periods(s, d)})
    return W.missing_partitions(expected, o.where("event_type = 'signup'"), ["user_id", "p"])
