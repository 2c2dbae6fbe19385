"""Queries over unit x period panels: projections, joins, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import scalar as S
from furrow.functions.ranking import column_medians, join_on
from furrow.operators import panel as P
from furrow.operators.raster import latest_per
from furrow.plans.base import (
    DELTA,
    LOCATED,
    LONG_PANEL,
    NATION_PANEL,
    OBS,
    POST,
    YEARS,
    long_panel,
    nation_panel,
    obs,
    orders_located,
    rnd,
    table,
    years,
)
from furrow.plans.registry import query
from furrow.session import cut_lineage


# --- filters and projections -----------------------------------------------------------


@query(
    "p01_filters",
    """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice) + 1e-9, 2) + 0.0 AS total FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 100000 AND 300000 AND list_contains([1996, 1998, 2000], year(o_orderdate)) GROUP BY 1""",
)
def p01(s, d):
    def in_year(y):  # a range, so that the scan can prune by it
        return (F.col("o_orderdate") >= F.lit(f"{y}-01-01").cast("date")) & (F.col("o_orderdate") < F.lit(f"{y + 1}-01-01").cast("date"))

    o = table(s, d, "orders").where(
        (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_totalprice").between(100000, 300000)
        & (in_year(1996) | in_year(1998) | in_year(2000))
    )
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "p02_membership_tag",
    """SELECT CASE WHEN n_nationkey IN (0, 5, 10) THEN 'coastal' WHEN n_nationkey IN (1, 6, 11) THEN 'inland' ELSE 'other' END AS zone, count(*) AS n, count(CASE WHEN n_regionkey <= 1 THEN 1 END) AS n_treated
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def p02(s, d):
    j = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    zone = P.tag("n_nationkey", {"coastal": [0, 5, 10], "inland": [1, 6, 11]}, "other")
    return j.groupBy(zone.alias("zone")).agg(F.count("*").alias("n"), F.count(F.when(F.col("n_regionkey") <= 1, 1)).alias("n_treated"))


@query(
    "p03_dictionary_lookup",
    """SELECT coalesce(CASE CAST(year(o_orderdate) AS INTEGER) WHEN 1997 THEN 'Alpha' WHEN 1998 THEN 'Beta' WHEN 1999 THEN 'Gamma' END, 'none') AS event, count(*) AS n FROM orders GROUP BY 1""",
)
def p03(s, d):
    names = P.literal_map({1997: "Alpha", 1998: "Beta", 1999: "Gamma"})
    ev = F.coalesce(F.try_element_at(names, F.year("o_orderdate")), F.lit("none"))
    return table(s, d, "orders").groupBy(ev.alias("event")).agg(F.count("*").alias("n"))


@query(
    "p04_name_normalisation",
    """WITH r AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '   ' ELSE '  ' || lower(s_name) || ' ' END AS raw FROM supplier), t AS (SELECT s_suppkey, trim(raw) AS nm FROM r)
    SELECT s_suppkey, CASE WHEN nm = '' THEN 'Unnamed_' || s_suppkey ELSE upper(left(nm, 1)) || lower(substr(nm, 2)) END AS name FROM t""",
)
def p04(s, d):
    raw = F.when(F.col("s_acctbal") < 0, "   ").otherwise(F.concat(F.lit("  "), F.lower("s_name"), F.lit(" ")))
    fallback = F.concat(F.lit("Unnamed_"), F.col("s_suppkey").cast("string"))
    return table(s, d, "supplier").select("s_suppkey", S.clean_name(raw, fallback=fallback).alias("name"))


@query(
    "p04_candidate_spellings",
    """WITH r AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '  ' || upper(s_name) || ' ' WHEN 2 THEN 'supp. ' || right(s_name, 9) WHEN 3 THEN 'Supplier-' || s_suppkey ELSE 'unlisted ' || s_suppkey END AS raw FROM supplier),
    v AS (SELECT s_name AS c, s_name AS sp, 0 AS p FROM supplier UNION ALL SELECT s_name, 'Supp ' || right(s_name, 9), 1 FROM supplier UNION ALL SELECT s_name, 'Supplier ' || s_suppkey, 2 FROM supplier UNION ALL SELECT s_name, 'Supplier ' || s_suppkey + 1, 3 FROM supplier),
    k AS (SELECT regexp_replace(lower(sp), '[^\\p{L}\\p{N}]+', '', 'g') AS k, arg_min(c, (p, c)) AS c, min(p) AS p FROM v GROUP BY 1)
    SELECT s_suppkey, coalesce(c, 'Unnamed_' || s_suppkey) AS resolved, CAST(p AS INTEGER) AS match_priority FROM r LEFT JOIN k ON k.k = nullif(regexp_replace(lower(raw), '[^\\p{L}\\p{N}]+', '', 'g'), '')""",
)
def p04_spellings(s, d):
    """Suppliers under five spellings; each name's variants, one of them shared by two names."""
    t = table(s, d, "supplier")
    key, tail = F.col("s_suppkey").cast("string"), F.substring("s_name", -9, 9)
    form = F.col("s_suppkey") % 5
    raw = F.when(form == 0, " ").when(form == 1, F.concat(F.lit("  "), F.upper("s_name"), F.lit(" "))).when(form == 2, F.concat(F.lit("supp. "), tail)).when(form == 3, F.concat(F.lit("Supplier-"), key)).otherwise(F.concat(F.lit("unlisted "), key))
    spell = lambda text, p: F.struct(text.alias("spelling"), F.lit(p).alias("priority"))
    after = (F.col("s_suppkey") + 1).cast("string")
    forms = F.array(spell(F.col("s_name"), 0), spell(F.concat(F.lit("Supp "), tail), 1), spell(F.concat(F.lit("Supplier "), key), 2), spell(F.concat(F.lit("Supplier "), after), 3))
    variants = t.select("s_name", F.explode(forms).alias("f")).select("s_name", "f.spelling", "f.priority")
    r = P.resolve_names(t.select("s_suppkey", raw.alias("raw")), "raw", variants, "s_name", "spelling", "priority", F.concat(F.lit("Unnamed_"), key))
    return r.select("s_suppkey", "resolved", "match_priority")


@query(
    "p14_support_bucketing",
    f"""WITH {NATION_PANEL} SELECT unit, year, CASE WHEN n < 70 THEN 'excluded' WHEN n < 95 THEN 'gap-filled' ELSE 'OK' END AS qa_flag, CASE WHEN share < 0.3 THEN 'poor' WHEN share < 0.36 THEN 'fair' ELSE 'good' END AS fit_quality FROM panel""",
)
def p14(s, d):
    return nation_panel(s, d).select(
        "unit", "year", P.bucket("n", [70, 95], ["excluded", "gap-filled", "OK"]).alias("qa_flag"), P.bucket("share", [0.3, 0.36], ["poor", "fair", "good"]).alias("fit_quality")
    )


@query(
    "p15_wide_to_long",
    f"WITH {LONG_PANEL} SELECT unit, year, metric, product, n, round(y + 1e-9, 4) + 0.0 AS y FROM long",
)
def p15(s, d):
    return long_panel(s, d).select("unit", "year", "metric", "product", "n", rnd("y", 4).alias("y"))


@query(
    "p16_design_indicators",
    f"""WITH {NATION_PANEL} SELECT unit, year, treat, post, treat * post AS did, CASE WHEN treat = 1 THEN year - 1997 END AS event_k, year - (SELECT min(year) FROM panel) AS year_c FROM panel""",
)
def p16(s, d):
    p = P.design_indicators(nation_panel(s, d), F.col("region") <= 1, F.col("year").isin(POST), first_event=1997)
    return P.centre_year(p).select("unit", "year", "treat", "post", "did", "event_k", "year_c")


@query(
    "p17_usable_rows",
    f"""WITH {OBS}, u AS (SELECT user_id, p, avg(CASE WHEN event_type = 'signup' THEN value END) AS y, count(CASE WHEN k < 50 THEN 1 END) AS n FROM obs GROUP BY 1, 2)
    SELECT user_id, p, round(y + 1e-9, 6) + 0.0 AS y, n FROM u WHERE y IS NOT NULL AND n > 0""",
)
def p17(s, d):
    u = obs(s, d).groupBy("user_id", "p").agg(
        F.avg(F.when(F.col("event_type") == "signup", F.col("value"))).alias("y"), F.count(F.when(F.col("k") < 50, 1)).alias("n")
    )
    return P.usable(u, "y", "n").select("user_id", "p", rnd("y").alias("y"), "n")


SHIFT = """, base AS (SELECT unit, region, year, n, share, metric, y FROM long WHERE product = 'raw'),
    sh AS (SELECT DISTINCT unit, year, share AS f, 'status' AS source FROM base WHERE region <= 2)"""


def shifted(s, d):
    base = long_panel(s, d).where("product = 'raw'").drop("product", "treat", "post")
    shares = base.where("region <= 2").select("unit", "year", "share").distinct().withColumn("source", F.lit("status"))
    return P.bounded_shift(base.drop("share"), shares, ["unit", "year"], "y", "metric", DELTA, (F.col("region") <= 1) & F.col("year").isin(POST))


@query(
    "p18_bounded_shift_correction",
    f"""WITH {LONG_PANEL} {SHIFT}, j AS (SELECT b.*, coalesce(f, 0.0) AS f, coalesce(source, 'none') AS source, CASE metric WHEN 'p25' THEN 1400.0 WHEN 'p50' THEN 700.0 ELSE 2100.0 END AS dl FROM base b LEFT JOIN sh USING (unit, year)),
    k AS (SELECT *, region <= 1 AND year IN (1997, 1998, 1999) AND f >= 0.001 AS hit FROM j)
    SELECT unit, year, metric, round(CASE WHEN hit THEN round(y - f * dl, 2) ELSE y END + 1e-9, 6) + 0.0 AS corrected, CASE WHEN hit THEN round(f, 6) ELSE 0.0 END AS shift_f, CASE WHEN hit THEN dl ELSE 0.0 END::DOUBLE AS shift_delta,
      round(CASE WHEN hit THEN -f * dl ELSE 0.0 END + 1e-9, 2) + 0.0 AS shift_days, source AS share_source FROM k""",
)
def p18(s, d):
    return shifted(s, d).select(
        "unit", "year", "metric", rnd("corrected").alias("corrected"), "shift_f", "shift_delta", rnd("shift_days", 2).alias("shift_days"), "share_source"
    )


@query(
    "p19_uncertainty_envelope",
    f"""WITH {NATION_PANEL}, sd AS (SELECT region, year, coalesce(nullif(stddev_samp(y), 0), 7.0) AS sd FROM panel GROUP BY 1, 2)
    SELECT unit, year, round(y - 0.6745 * sd + 1e-9, 4) + 0.0 AS p25, round(y + 0.6745 * sd + 1e-9, 4) + 0.0 AS p75, round(y - 1.96 * sd / greatest(1.0, sqrt(least(n, 100000) / 1000.0)) + 1e-9, 4) + 0.0 AS lo95,
      round(y + 1.96 * sd / greatest(1.0, sqrt(least(n, 100000) / 1000.0)) + 1e-9, 4) + 0.0 AS hi95 FROM panel JOIN sd USING (region, year)""",
)
def p19(s, d):
    p = nation_panel(s, d)
    j = join_on(p, P.spread_or(p, ["region", "year"], "y", 7.0), ["region", "year"])
    return j.select("unit", "year", *[rnd(c, 4).alias(n) for n, c in P.envelope(F.col("y"), F.col("sd"), F.col("n")).items()])


@query(
    "p20_exclusion_flag",
    f"""WITH {NATION_PANEL} SELECT unit, year, unit IN (3, 7) AS exclude_flag, CASE unit WHEN 3 THEN 'forest' WHEN 7 THEN 'coverage' ELSE '' END AS exclude_reason, round(y + 1e-9, 4) + 0.0 AS y FROM panel""",
)
def p20(s, d):
    reasons = P.literal_table(table(s, d, "nation"), "unit int, reason string", [(3, "forest"), (7, "coverage")])
    j = nation_panel(s, d).join(F.broadcast(reasons), "unit", "left")
    return j.select("unit", "year", F.col("reason").isNotNull().alias("exclude_flag"), F.coalesce("reason", F.lit("")).alias("exclude_reason"), rnd("y", 4).alias("y"))


@query(
    "p21_provenance_stamp",
    f"""WITH {OBS} SELECT event_type, count(*) AS n, 'auto' AS operator, '2024-01-01/2024-01-31' AS time_window, 'events' AS source, 'mean of ' || event_type AS method FROM obs GROUP BY 1""",
)
def p21(s, d):
    from furrow.operators.provenance import stamp

    g = obs(s, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return stamp(g, operator="auto", time_window="2024-01-01/2024-01-31", source="events").withColumn("method", F.concat(F.lit("mean of "), "event_type"))


@query(
    "p23_calendar_predicates",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(CASE WHEN month(o_orderdate) BETWEEN 6 AND 11 THEN 1 END) AS n_season, count(CASE WHEN month(o_orderdate) IN (7, 8) THEN 1 END) AS n_months,
      count(CASE WHEN dayofyear(o_orderdate) BETWEEN 105 AND 166 THEN 1 END) AS n_doy FROM orders GROUP BY 1""",
)
def p23(s, d):
    t = F.col("o_orderdate")
    return table(s, d, "orders").groupBy(F.year(t).alias("year")).agg(
        F.count(F.when(F.month(t).between(6, 11), 1)).alias("n_season"), F.count(F.when(F.month(t).isin(7, 8), 1)).alias("n_months"),
        F.count(F.when(F.dayofyear(t).between(105, 166), 1)).alias("n_doy"),
    )


# --- joins --------------------------------------------------------------------------------


@query(
    "j02_left_join_with_default",
    f"""WITH {NATION_PANEL}, sh AS (SELECT unit, year, share AS f, 'F' AS source FROM panel WHERE share > 0.34) SELECT p.unit, p.year, round(coalesce(f, 0.0) + 1e-9, 6) + 0.0 AS f, coalesce(source, 'none') AS source FROM panel p LEFT JOIN sh USING (unit, year)""",
)
def j02(s, d):
    p = nation_panel(s, d)
    sh = p.where("share > 0.34").select("unit", "year", F.col("share").alias("f"), F.lit("F").alias("source"))
    return p.select("unit", "year").join(sh, ["unit", "year"], "left").select("unit", "year", rnd(F.coalesce("f", F.lit(0.0))).alias("f"), F.coalesce("source", F.lit("none")).alias("source"))


@query(
    "j11_key_aligned_pair",
    f"""WITH {LONG_PANEL} SELECT unit, year, metric, round(max(CASE WHEN product = 'raw' THEN y END) + 1e-9, 4) + 0.0 AS raw, round(max(CASE WHEN product = 'corrected' THEN y END) + 1e-9, 4) + 0.0 AS corrected,
      round(max(CASE WHEN product = 'raw' THEN y END) - max(CASE WHEN product = 'corrected' THEN y END) + 1e-9, 4) + 0.0 AS delta FROM long GROUP BY 1, 2, 3""",
)
def j11(s, d):
    w = aligned(s, d)
    return w.select("unit", "year", "metric", rnd("raw", 4).alias("raw"), rnd("corrected", 4).alias("corrected"), rnd(F.col("raw") - F.col("corrected"), 4).alias("delta"))


def aligned(s, d):
    """Raw and corrected side by side: one aggregation instead of a self join."""
    pick = lambda k: F.max(F.when(F.col("product") == k, F.col("y"))).alias(k)
    return long_panel(s, d).groupBy("unit", "region", "year", "metric").agg(pick("raw"), pick("corrected"))


@query(
    "j12_pivot_then_join",
    f"""WITH {NATION_PANEL}, o AS (SELECT * FROM (VALUES (2, 0), (0, 1), (4, 2), (1, 3), (3, 4)) t(region, ord))
    SELECT region, CAST(ord AS INTEGER) AS ord, {', '.join(f"round(avg(CASE WHEN year = {y} THEN share END) + 1e-9, 6) + 0.0 AS share_{y}, round(avg(CASE WHEN year = {y} THEN y END) + 1e-9, 4) + 0.0 AS y_{y}" for y in POST)}
    FROM panel JOIN o USING (region) GROUP BY 1, 2""",
)
def j12(s, d):
    w = nation_panel(s, d).groupBy("region").pivot("year", POST).agg(F.avg("share").alias("share"), F.avg("y").alias("y"))
    order = P.literal_table(w, "region int, ord int", [(2, 0), (0, 1), (4, 2), (1, 3), (3, 4)])
    cols = [c for y in POST for c in (rnd(f"{y}_share").alias(f"share_{y}"), rnd(f"{y}_y", 4).alias(f"y_{y}"))]
    return w.join(F.broadcast(order), "region").orderBy("ord").select("region", "ord", *cols)


@query(
    "j13_design_grid",
    f"""WITH {LOCATED}, u AS (SELECT n_nationkey AS unit FROM nation), g AS (SELECT unit, CAST(y.y AS INTEGER) AS year, m.metric FROM u CROSS JOIN (SELECT DISTINCT year FROM loc) y(y) CROSS JOIN (VALUES ('SOS'), ('POS'), ('EOS')) m(metric)),
    f AS (SELECT n_nationkey AS unit, year, count(*) AS n FROM loc WHERE o_totalprice > 450000 GROUP BY 1, 2) SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN f USING (unit, year)""",
)
def j13(s, d):
    units = table(s, d, "nation").select(F.col("n_nationkey").alias("unit"))
    g = P.design_grid(units, {"year": years(s, d), "metric": ["SOS", "POS", "EOS"]})
    f = orders_located(s, d).where("o_totalprice > 450000").groupBy(F.col("n_nationkey").alias("unit"), "year").agg(F.count("*").alias("n"))
    return g.join(f, ["unit", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "j14_semi_anti",
    """SELECT c_mktsegment, count(CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) THEN 1 END) AS n_with, count(CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 1 END) AS n_without FROM customer GROUP BY 1""",
)
def j14(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    big = c.join(o.where("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_mktsegment", F.lit(1).alias("w"), F.lit(0).alias("z"))
    none = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_mktsegment", F.lit(0).alias("w"), F.lit(1).alias("z"))
    seg = c.select("c_mktsegment", F.lit(0).alias("w"), F.lit(0).alias("z"))
    return big.unionByName(none).unionByName(seg).groupBy("c_mktsegment").agg(F.sum("w").cast("long").alias("n_with"), F.sum("z").cast("long").alias("n_without"))


DECIDE = "CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'error' THEN 'reject' ELSE 'skip' END"


@query(
    "j15_decision_merge",
    f"""WITH {OBS}, dec AS (SELECT user_id, {DECIDE} AS decision, ts, event_id FROM obs WHERE event_type IN ('purchase', 'error', 'signup') AND k < 3),
    l AS (SELECT user_id, arg_max(decision, (ts, event_id)) AS decision FROM dec GROUP BY 1), u AS (SELECT DISTINCT user_id FROM obs)
    SELECT coalesce(decision, 'pending') AS decision, count(*) AS n FROM u LEFT JOIN l USING (user_id) GROUP BY 1""",
)
def j15(s, d):
    o = obs(s, d)
    dec = o.where(F.col("event_type").isin("purchase", "error", "signup") & (F.col("k") < 3)).withColumn("decision", F.expr(DECIDE))
    last = latest_per(dec, ["user_id"], [F.col("ts"), F.col("event_id")], ["decision"])
    j = o.select("user_id").distinct().join(last, "user_id", "left")
    return j.groupBy(F.coalesce("decision", F.lit("pending")).alias("decision")).agg(F.count("*").alias("n"))


@query(
    "j16_rule_join",
    f"""WITH {LONG_PANEL}, r AS (SELECT * FROM (VALUES ('p25', 100000.0, 160000.0), ('p50', 220000.0, 260000.0), ('p75', 340000.0, 400000.0)) t(metric, lo, hi))
    SELECT unit, year, product, metric, y BETWEEN lo AND hi AS in_window FROM long JOIN r USING (metric)""",
)
def j16(s, d):
    lp = long_panel(s, d)
    rules = P.literal_table(lp, "metric string, lo double, hi double", [("p25", 1e5, 1.6e5), ("p50", 2.2e5, 2.6e5), ("p75", 3.4e5, 4e5)])
    j = lp.join(F.broadcast(rules), "metric")
    return j.select("unit", "year", "product", "metric", F.col("y").between(F.col("lo"), F.col("hi")).alias("in_window"))


# --- aggregates ----------------------------------------------------------------------------


@query(
    "a16_counts_and_distinct",
    "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_cust, round(count(*) * 1.0 / (SELECT count(*) FROM orders) + 1e-9, 6) + 0.0 AS frac FROM orders GROUP BY 1",
)
def a16(s, d):
    o = table(s, d, "orders")
    g = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_cust"))
    return P.attach_scalar(g, o.agg(F.count("*").alias("t"))).select("o_orderstatus", "n", "n_cust", rnd(F.col("n") / F.col("t")).alias("frac"))


FEAT = """f AS (SELECT d.doc_id, l.quality, CASE WHEN d.n_chars % 7 = 0 THEN NULL ELSE d.n_chars::DOUBLE END AS f1, CASE WHEN l.toxic = 1 THEN NULL ELSE length(d.text) - length(replace(d.text, ' ', '')) + 1.0::DOUBLE END AS f2 FROM documents d JOIN labels l USING (doc_id))"""


def features(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1.0
    return j.select(
        "doc_id", "quality", F.when(F.col("n_chars") % 7 != 0, F.col("n_chars").cast("double")).alias("f1"), F.when(F.col("toxic") != 1, words).alias("f2")
    )


@query(
    "a17_class_median_imputation",
    f"""WITH {FEAT}, c AS (SELECT quality, median(f1) AS m1, median(f2) AS m2 FROM f GROUP BY 1), g AS (SELECT median(f1) AS g1, median(f2) AS g2 FROM f)
    SELECT doc_id, quality, round(coalesce(f1, m1, g1) + 1e-9, 6) + 0.0 AS f1, round(coalesce(f2, m2, g2) + 1e-9, 6) + 0.0 AS f2 FROM f JOIN c USING (quality), g""",
)
def a17(s, d):
    return P.impute_by_class(features(s, d), "quality", ["f1", "f2"]).withColumns({"f1": rnd("f1"), "f2": rnd("f2")})


@query(
    "a18_group_spread",
    f"""WITH {OBS} SELECT user_id, p, round(coalesce(nullif(stddev_samp(value), 0), 7.0) + 1e-9, 5) + 0.0 AS sd FROM obs WHERE event_type = 'view' GROUP BY 1, 2""",
)
def a18(s, d):
    o = obs(s, d).where("event_type = 'view'")
    return P.spread_or(o, ["user_id", "p"], "value", 7.0).withColumn("sd", rnd("sd", 5))


@query(
    "a19_coverage_minimum",
    """WITH g AS (SELECT l.label, q.q AS sgn FROM (SELECT DISTINCT label FROM embeddings) l CROSS JOIN (VALUES ('neg'), ('pos')) q(q)), c AS (SELECT label, CASE WHEN embedding[1] < 0 THEN 'neg' ELSE 'pos' END AS sgn, count(*) AS n FROM embeddings GROUP BY 1, 2)
    SELECT label, sgn, coalesce(n, 0) AS n, coalesce(n, 0) >= 24 AS ok FROM g LEFT JOIN c USING (label, sgn)""",
)
def a19(s, d):
    from furrow.operators.quality import coverage

    e = table(s, d, "embeddings").select("label", F.when(F.col("embedding")[0] < 0, "neg").otherwise("pos").alias("sgn"))
    grid = P.design_grid(e.select("label").distinct(), {"sgn": ["neg", "pos"]})
    return coverage(e, grid, ["label", "sgn"], 24)


PHASES = [("baseline", 1, 5), ("early", 6, 15), ("peak", 14, 24), ("event", 25, 29), ("after", 40, 60)]
PHASE_SQL = f"""ph AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}, {b})" for n, a, b in PHASES)}) t(phase, lo, hi)), z AS (SELECT DISTINCT x FROM obs),
    ps AS (SELECT z.x, ph.phase, count(o.event_id) AS n, avg(value) AS v, avg(k) AS k FROM z CROSS JOIN ph LEFT JOIN obs o ON o.x = z.x AND dayofyear(o.ts) BETWEEN lo AND hi GROUP BY 1, 2)"""


def phases(s, d):
    return P.phase_means(obs(s, d).withColumn("doy", F.dayofyear("ts")).withColumnRenamed("value", "v"), ["x"], "doy", PHASES, ["v", "k"])


@query("a20_phase_means", f"WITH {OBS}, {PHASE_SQL} SELECT x, phase, n, round(v + 1e-9, 6) + 0.0 AS v, round(k + 1e-9, 6) + 0.0 AS k FROM ps")
def a20(s, d):
    return phases(s, d).withColumns({"v": rnd("v"), "k": rnd("k")})


@query(
    "a21_phase_deltas",
    f"WITH {OBS}, {PHASE_SQL} SELECT a.x, a.phase, round(a.v - b.v + 1e-9, 6) + 0.0 AS delta_v, round(a.k - b.k + 1e-9, 6) + 0.0 AS delta_k FROM ps a JOIN ps b ON a.x = b.x AND b.phase = 'baseline' WHERE a.phase <> 'baseline'",
)
def a21(s, d):
    return P.phase_deltas(phases(s, d), ["x"], "baseline", ["v", "k"]).withColumns({"delta_v": rnd("delta_v"), "delta_k": rnd("delta_k")})


@query(
    "a22_wide_pivot",
    f"WITH {NATION_PANEL} SELECT unit, {', '.join(f'round(avg(CASE WHEN year = {y} THEN y END) + 1e-9, 4) + 0.0 AS y_{y}' for y in YEARS)} FROM panel GROUP BY 1",
)
def a22(s, d):
    w = nation_panel(s, d).groupBy("unit").pivot("year", YEARS).agg(F.avg("y"))
    return w.select("unit", *[rnd(str(y), 4).alias(f"y_{y}") for y in YEARS])


BENCH = """pr AS (SELECT unit, region, year, metric, max(CASE WHEN product = 'raw' THEN y END) AS raw, max(CASE WHEN product = 'corrected' THEN y END) AS cor FROM long GROUP BY 1, 2, 3, 4),
  det AS (SELECT metric, unit, count(*) AS n, median(raw) AS raw_med, median(cor) AS cor_med, avg(abs(raw - cor)) AS mad, max(abs(raw - cor)) AS xad FROM pr GROUP BY 1, 2)"""


def benchmark(s, d):
    w = aligned(s, d).withColumn("ad", F.abs(F.col("raw") - F.col("corrected")))
    keys = ["metric", "unit"]
    g = w.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ad").alias("mad"), F.max("ad").alias("xad"))
    return join_on(g, column_medians(w, keys, {"raw": "raw_med", "corrected": "cor_med"}), keys, "left")


@query(
    "a23_detail_and_pooled",
    f"""WITH {LONG_PANEL}, {BENCH}, u AS (SELECT metric, unit::VARCHAR AS unit, n, raw_med, cor_med, mad, xad FROM det UNION ALL
      SELECT metric, 'ALL', sum(n)::BIGINT, median(raw_med), median(cor_med), avg(mad), max(xad) FROM det GROUP BY 1)
    SELECT metric, unit, n, round(raw_med + 1e-9, 6) + 0.0 AS raw_med, round(cor_med + 1e-9, 6) + 0.0 AS cor_med, round(mad + 1e-9, 4) + 0.0 AS mad, round(xad + 1e-9, 4) + 0.0 AS xad FROM u""",
)
def a23(s, d):
    det = cut_lineage(benchmark(s, d))
    pooled = det.groupBy("metric").agg(F.sum("n").alias("n"), F.avg("mad").alias("mad"), F.max("xad").alias("xad"))
    pooled = join_on(pooled, column_medians(det, ["metric"], {"raw_med": "raw_med", "cor_med": "cor_med"}), ["metric"], "left")
    u = det.withColumn("unit", F.col("unit").cast("string")).unionByName(pooled.withColumn("unit", F.lit("ALL")))
    return u.withColumns({"raw_med": rnd("raw_med"), "cor_med": rnd("cor_med"), "mad": rnd("mad", 4), "xad": rnd("xad", 4)})


@query(
    "e23_correction_benchmark",
    f"""WITH {LONG_PANEL}, {BENCH} SELECT metric, unit, n, round(mad + 1e-9, 4) + 0.0 AS mean_abs, round(xad + 1e-9, 4) + 0.0 AS max_abs, round(xad / 500 + 1e-9, 6) + 0.0 AS ratio, xad < 250 AS below_half, xad < 600 AS within_sd FROM det""",
)
def e23(s, d):
    return benchmark(s, d).select(
        "metric", "unit", "n", rnd("mad", 4).alias("mean_abs"), rnd("xad", 4).alias("max_abs"), rnd(F.col("xad") / 500).alias("ratio"), (F.col("xad") < 250).alias("below_half"), (F.col("xad") < 600).alias("within_sd")
    )


@query("a24_group_trajectory", f"WITH {NATION_PANEL} SELECT treat, year, round(avg(y) + 1e-9, 4) + 0.0 AS y, count(*) AS n_units FROM panel GROUP BY 1, 2")
def a24(s, d):
    return nation_panel(s, d).groupBy("treat", "year").agg(rnd(F.avg("y"), 4).alias("y"), F.count("*").alias("n_units"))


@query(
    "a26_mode_share",
    """WITH c AS (SELECT l_returnflag, round(l_quantity) AS val, count(*) AS cnt FROM lineitem GROUP BY 1, 2), m AS (SELECT l_returnflag, max(cnt) AS mc FROM c GROUP BY 1)
    SELECT c.l_returnflag, min(CASE WHEN cnt = mc THEN val END) AS mode_value, round(max(cnt) / sum(cnt) + 1e-9, 6) + 0.0 AS mode_share, count(*) AS n_unique, sum(cnt)::BIGINT AS n FROM c JOIN m USING (l_returnflag) GROUP BY 1""",
)
def a26(s, d):
    return P.mode_stats(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity").withColumn("mode_share", rnd("mode_share"))


@query(
    "a28_correlation",
    f"""WITH {LONG_PANEL}, dv AS (SELECT product, metric, unit, year, treat * post AS ev, share, y - avg(y) OVER (PARTITION BY product, metric, unit) AS a FROM long),
    r AS (SELECT *, rank() OVER (PARTITION BY product, metric ORDER BY a) + (count(*) OVER (PARTITION BY product, metric, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY product, metric ORDER BY share) + (count(*) OVER (PARTITION BY product, metric, share) - 1) / 2.0 AS rb FROM dv)
    SELECT product, metric, count(*) AS n, round(corr(a, share) + 1e-9, 6) + 0.0 AS pearson, round(corr(ra, rb) + 1e-9, 6) + 0.0 AS spearman FROM r GROUP BY 1, 2""",
)
def a28(s, d):
    dv = cut_lineage(P.deviation(long_panel(s, d), ["product", "metric", "unit"], ["y"]))
    return P.correlations(dv, ["product", "metric"], "y_dev", "share").withColumns({"pearson": rnd("pearson"), "spearman": rnd("spearman")})


@query(
    "a33_mcnemar",
    f"""WITH {LONG_PANEL}, {BENCH}, g AS (SELECT metric, median(v) AS med FROM (SELECT metric, raw AS v FROM pr UNION ALL SELECT metric, cor FROM pr) GROUP BY 1),
    t AS (SELECT metric, count(*) AS n_pairs, count(CASE WHEN raw >= med AND cor < med THEN 1 END) AS b, count(CASE WHEN raw < med AND cor >= med THEN 1 END) AS c FROM pr JOIN g USING (metric) GROUP BY 1)
    SELECT metric, n_pairs, b, c, round(pow(abs(b - c) - 1, 2) / nullif(b + c, 0) + 1e-9, 6) + 0.0 AS chi2 FROM t""",
)
def a33(s, d):
    return P.mcnemar(aligned(s, d), ["metric"], "raw", "corrected").withColumn("chi2", rnd("chi2"))


@query(
    "a34_cohens_d",
    f"""WITH {LONG_PANEL}, g AS (SELECT product, metric, avg(CASE WHEN post = 1 THEN y END) AS m1, avg(CASE WHEN post = 0 THEN y END) AS m0, var_samp(CASE WHEN post = 1 THEN y END) AS v1, var_samp(CASE WHEN post = 0 THEN y END) AS v0,
      count(CASE WHEN post = 1 THEN y END) AS n1, count(CASE WHEN post = 0 THEN y END) AS n0 FROM long WHERE treat = 1 GROUP BY 1, 2)
    SELECT product, metric, n1, n0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) + 1e-9, 6) + 0.0 AS cohens_d FROM g""",
)
def a34(s, d):
    g = P.cohens_d(long_panel(s, d).where("treat = 1"), ["product", "metric"], F.col("post") == 1, "y")
    return g.select("product", "metric", "n1", "n0", rnd("cohens_d").alias("cohens_d"))


# --- windows --------------------------------------------------------------------------------


@query(
    "w01_deviation_from_mean",
    f"""WITH {NATION_PANEL}, a AS (SELECT *, y - avg(y) OVER (PARTITION BY unit) AS d1 FROM panel) SELECT unit, year, round(d1 + 1e-9, 4) + 0.0 AS unit_dev, round(d1 - avg(d1) OVER (PARTITION BY year) + 1e-9, 4) + 0.0 AS two_way FROM a""",
)
def w01(s, d):
    p = P.two_way_deviation(P.deviation(nation_panel(s, d), ["unit"], ["y"]), ["unit"], ["year"], "y")
    return p.select("unit", "year", rnd("y_dev", 4).alias("unit_dev"), rnd("dev2", 4).alias("two_way"))


@query(
    "w08_baseline_delta",
    f"""WITH {NATION_PANEL} SELECT unit, round(avg(CASE WHEN year IN (1995, 1996) THEN y END) + 1e-9, 4) + 0.0 AS baseline, round(max(CASE WHEN year = 1998 THEN y END) + 1e-9, 4) + 0.0 AS post,
      round(max(CASE WHEN year = 1998 THEN y END) - avg(CASE WHEN year IN (1995, 1996) THEN y END) + 1e-9, 4) + 0.0 AS delta FROM panel GROUP BY 1""",
)
def w08(s, d):
    from furrow.operators.season import baseline_delta

    b = baseline_delta(nation_panel(s, d), ["unit"], "year", "y", [1995, 1996], 1998)
    return b.withColumns({c: rnd(c, 4) for c in ("baseline", "post", "delta")})


@query(
    "w11_rank_by_score",
    f"""WITH {NATION_PANEL}, g AS (SELECT unit, avg(y) AS score FROM panel GROUP BY 1) SELECT unit, round(score + 1e-9, 4) + 0.0 AS score, row_number() OVER (ORDER BY score DESC, unit) AS rank FROM g""",
)
def w11(s, d):
    from furrow.functions.ranking import exact_row_number, value_bin

    g = nation_panel(s, d).groupBy("unit").agg(F.avg("y").alias("score"))
    return exact_row_number(g, [], [F.col("score").desc(), "unit"], -value_bin("score"), "rank", nulls_first=False).select("unit", rnd("score", 4).alias("score"), "rank")


@query(
    "w14_variance_components",
    f"""WITH {LONG_PANEL}, u AS (SELECT product, metric, unit, avg(y) AS um, count(*) AS n FROM long GROUP BY 1, 2, 3), k AS (SELECT l.*, um FROM long l JOIN u USING (product, metric, unit) WHERE u.n = (SELECT count(DISTINCT year) FROM long)),
    p AS (SELECT product, metric, year, avg(y) AS pm FROM k GROUP BY 1, 2, 3), g AS (SELECT product, metric, avg(y) AS mu, count(*) AS n FROM k GROUP BY 1, 2)
    SELECT product, metric, round(any_value(mu) + 1e-9, 4) + 0.0 AS mu, any_value(g.n) AS n_cells, (SELECT round(stddev_samp(um), 4) FROM u z WHERE z.product = k.product AND z.metric = k.metric) + 0.0 AS sigma_u,
      (SELECT round(stddev_samp(pm), 4) FROM p z WHERE z.product = k.product AND z.metric = k.metric) + 0.0 AS sigma_t, round(stddev_samp(y - um - pm + mu) + 1e-9, 4) + 0.0 AS sigma_e
    FROM k JOIN p USING (product, metric, year) JOIN g USING (product, metric) GROUP BY 1, 2""",
)
def w14(s, d):
    v = P.variance_components(cut_lineage(long_panel(s, d)), ["product", "metric"], "unit", "year", "y")
    return v.select("product", "metric", rnd("mu", 4).alias("mu"), "n_cells", *[rnd(c, 4).alias(c) for c in ("sigma_u", "sigma_t", "sigma_e")])


# --- ordering and sets -------------------------------------------------------------------------


@query("t01_multi_key_sort", f"WITH {NATION_PANEL} SELECT region, unit, year, n FROM panel ORDER BY 1, 2, 3")
def t01(s, d):
    return nation_panel(s, d).select("region", "unit", "year", "n").orderBy("region", "unit", "year")


@query(
    "t02_top_by_magnitude",
    f"WITH {LONG_PANEL}, {BENCH} SELECT unit, year, metric, round(raw - cor + 1e-9, 4) + 0.0 AS delta FROM pr WHERE abs(raw - cor) > 1 ORDER BY round(abs(raw - cor), 6) DESC, unit, year, metric LIMIT 15",
)
def t02(s, d):
    w = aligned(s, d).withColumn("dl", F.col("raw") - F.col("corrected")).where("abs(dl) > 1")
    return w.orderBy(F.round(F.abs("dl"), 6).desc(), "unit", "year", "metric").limit(15).select("unit", "year", "metric", rnd("dl", 4).alias("delta"))


@query("t03_ordered_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t03(s, d):
    return table(s, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query(
    "t04_custom_category_order",
    "SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END AS ord FROM orders GROUP BY 1 ORDER BY 3",
)
def t04(s, d):
    from furrow.operators.provenance import category_rank

    order = ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH"]
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("ord", category_rank("o_orderpriority", order)).orderBy("ord")


@query(
    "u01_union_of_tables",
    "SELECT kind, count(*) AS n, round(sum(bal) + 1e-9, 2) + 0.0 AS bal FROM (SELECT 'c' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier) GROUP BY 1",
)
def u01(s, d):
    c = table(s, d, "customer").select(F.lit("c").alias("kind"), F.col("c_acctbal").alias("bal"))
    p = table(s, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(p).groupBy("kind").agg(F.count("*").alias("n"), rnd(F.sum("bal"), 2).alias("bal"))


@query(
    "u02_union_with_priority_dedup",
    f"""WITH {NATION_PANEL}, a AS (SELECT unit, year, y, NULL::BIGINT AS n, 'A' AS sensor, 1 AS pr FROM panel WHERE year <= 1997), b AS (SELECT unit, year, y, n, 'B', 0 FROM panel WHERE year >= 1996), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY unit, year ORDER BY pr) AS rn FROM u) SELECT unit, year, round(y + 1e-9, 4) + 0.0 AS y, n, sensor FROM r WHERE rn = 1""",
)
def u02(s, d):
    from furrow.operators.provenance import union_by_priority

    p = nation_panel(s, d)
    a = p.where("year <= 1997").select("unit", "year", "y")
    b = p.where("year >= 1996").select("unit", "year", "y", "n")
    return union_by_priority({"B": b, "A": a}, ["unit", "year"], "sensor").select("unit", "year", rnd("y", 4).alias("y"), "n", "sensor")
