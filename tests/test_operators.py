"""Operators against brute force on small fixtures, with NULL, tie and skew cases."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import distributions as dist
from furrow.functions import ranking as rk
from furrow.functions import scalar as S
from furrow.operators import did as D
from furrow.operators import panel as P
from furrow.operators import raster as R
from furrow.operators import resampling as B
from furrow.operators import season as N
from furrow.operators import spatial as G
from furrow.operators import tracks as K


def test_exact_quantiles_match_percentile_with_skew(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.choice([1.0, 2.5, -3.0, rnd.gauss(0, 50)])) for _ in range(3000)]
    rows += [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None), ("neg", -1e-9), ("neg", 1e12), ("neg", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.0, "b": 0.02, "c": 0.25, "d": 0.5, "e": 0.97, "f": 1.0}
    got = {r.k: r for r in rk.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert "none" not in got
    for k in ("hot", "one", "two", "neg"):
        vals = np.array([v for kk, v in rows if kk == k])
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(vals, p), rel=1e-12, abs=1e-12)


def test_exact_row_number_any_partitioning(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), ((F.col("id") * 7919) % 5003).alias("v"))
    one = rk.exact_row_number(df.repartition(1), ["k"], ["v"], F.floor(F.col("v") / 64)).orderBy("k", "v").collect()
    many = rk.exact_row_number(df.repartition(64), ["k"], ["v"], F.floor(F.col("v") / 64)).orderBy("k", "v").collect()
    assert one == many
    seen = {}
    for r in one:
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.rn == seen[r.k]


def test_average_ranks_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (5.0, 1.0, 1.0, 3.0, 5.0, 5.0)], "k string, v double")
    got = {r.v: r.r for r in rk.average_ranks(df, ["k"], "v", "r").collect()}
    assert got == {1.0: 1.5, 3.0: 3.0, 5.0: 5.0}


def test_distributions():
    assert dist.t_ppf(0.975, 7) == pytest.approx(2.364624, abs=1e-6)
    assert dist.t_ppf(0.80, 7) == pytest.approx(0.896030, abs=1e-6)
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(30.0, 4) == pytest.approx(4.8944e-06, rel=1e-3)
    assert dist.t_sf2(2.0, 1e6) == pytest.approx(math.erfc(2 / math.sqrt(2)), abs=1e-5)


def test_normalised_difference_zero_denominator(spark):
    r = spark.createDataFrame([(0.0, 0.0), (3.0, 1.0), (None, 1.0)], "a double, b double").select(S.normalised_difference("a", "b").alias("v")).collect()
    assert [x.v for x in r] == [None, 0.5, None]


def test_extended_season_overlap(spark):
    r = spark.sql("select date'2020-01-15' d union all select date'2020-02-15'").select(S.season_year("d", 30).alias("y"), S.season_doy("d", 30).alias("n")).collect()
    assert [(x.y, x.n) for x in r] == [(2019, 380), (2020, 46)]


def test_period_dates_null_rules(spark):
    rows = [("a", 0, 0.0), ("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9), ("a", 4, 0.2), ("b", 0, None), ("b", 1, None), ("c", 0, 0.6), ("c", 1, None), ("c", 2, 0.7)]
    df = spark.createDataFrame(rows, "u string, p int, v double")
    got = {r.u: (r.sos, r.pos, r.eos) for r in N.period_dates(df, ["u"], "p", "v", 0.4).collect()}
    assert got == {"a": (1, 2, 4), "b": (None, None, None), "c": (0, 2, None)}


def _crossing(doy, y, frac=0.3, lo=90, hi=250):
    pts = [(d, v) for d, v in zip(doy, y) if v is not None]
    if len(pts) < 4:
        return None
    vs = [v for _, v in pts]
    if max(vs) - min(vs) < 0.05:
        return None
    thr, pk = min(vs) + frac * (max(vs) - min(vs)), vs.index(max(vs))
    if pk == 0:
        return None
    for i in range(pk - 1, -1, -1):
        (d0, a), (d1, b) = pts[i], pts[i + 1]
        if a <= thr <= b:
            x = d0 if a == b else d0 + (thr - a) * (d1 - d0) / (b - a)
            if lo <= x <= hi:
                return float(x)
    return float(next(d for d, v in pts if v >= thr))


def test_crossing_date_brute_force(spark):
    rnd = random.Random(7)
    doys = [105, 135, 166, 196, 227, 258, 288, 319, 349]
    series = {f"u{i}": [None if rnd.random() < 0.25 else round(rnd.random() * rnd.choice([0.03, 1.0]), 3) for _ in doys] for i in range(120)}
    df = spark.createDataFrame([(u, d, v) for u, ys in series.items() for d, v in zip(doys, ys)], "u string, doy int, v double")
    got = {r.u: r.sos for r in N.crossing_date(df, ["u"], "doy", "v", 0.3, 90, 250).collect()}
    for u, ys in series.items():
        want = _crossing(doys, ys)
        have = got.get(u)
        assert (have is None) == (want is None), (u, ys)
        if want is not None:
            assert have == pytest.approx(want, abs=1e-9)


def test_grid_fit_recovers_its_own_curve(spark):
    days = list(range(150, 340, 15))
    params, basis = N.curve_basis(days)
    assert len(params) == 576
    want = {i: int(p) for i, p in enumerate((0, 77, 300, 575))}
    rows = [(i, [float(0.2 + 0.6 * (b - basis[p].min()) / (basis[p].max() - basis[p].min())) for b in basis[p]]) for i, p in want.items()]
    rows.append((9, [None] * (len(days) - 3) + [0.1, 0.2, 0.3]))
    df = spark.createDataFrame(rows, "i int, ys array<double>")
    fit = N.grid_fit(days)
    got = {r.i: r.f for r in df.withColumn("f", fit("ys")).collect()}
    assert got[9].p is None
    for i, p in want.items():
        assert got[i].ssr <= 0.05 and got[i].n == len(days)
    dates = df.where("i = 1").withColumn("f", fit("ys")).select(*[c.alias(n) for n, c in N.fitted_dates(F.col("f")).items()]).first()
    f = got[1]
    assert dates.pos == pytest.approx((f.d_rise + f.d_fall) / 2)
    assert dates.sos == pytest.approx(f.d_rise - math.log(1 / 0.7 - 1) / f.m_rise)


def test_replicate_intervals_against_single_fits(spark):
    """Every replicate fitted on its own gives the same quantiles; one shared draw leaves the dates as they are."""
    days, key, ssr, n_rep = [150 + 20 * k for k in range(10)], 7, 0.4, 60
    params, basis = N.curve_basis(days)
    y = [float(v) if i != 4 else None for i, v in enumerate(basis[100])]
    df = spark.createDataFrame([(key, y, ssr), (8, [None] * 10, ssr), (9, y, None)], "u int, ys array<double>, ssr double")
    got = {r.u: r.r for r in df.select("u", N.replicate_intervals(days, n_rep)("u", "ys", "ssr").alias("r")).collect()}
    sos = []
    for rep in range(n_rep):
        z = [None if v is None else v + (int(hashlib.md5(f"{key}|{rep}|{j}|42".encode()).hexdigest()[:13], 16) / 16**13 - 0.5) * 2 * math.sqrt(ssr / 10) for j, v in enumerate(y)]
        ok = [j for j in range(10) if z[j] is not None]
        lo, hi = min(z[j] for j in ok), max(z[j] for j in ok)
        errors = [round(sum((z[j] - (lo + (hi - lo) * b[j])) ** 2 for j in ok), 9) for b in basis]
        m, s, *_ = params[errors.index(min(errors))]
        sos.append(s - math.log(1 / 0.7 - 1) / m)
    assert (got[key].sos_lo, got[key].sos_hi) == pytest.approx(tuple(np.quantile(sos, [0.025, 0.975])))
    assert got[key].n_rep == n_rep and got[key].sos_lo < got[key].sos_hi
    assert got[8].sos_lo is None and got[9].eos_hi is None and got[8].n_rep == 0
    one = df.where(f"u = {key}").select(N.replicate_intervals(days, n_rep, shared=True)("u", "ys", "ssr").alias("r")).first().r
    assert one.sos_lo == one.sos_hi and one.eos_lo == one.eos_hi


def test_copies_of_one_series_are_fitted_as_rows_of_their_own():
    r = np.random.default_rng(4)
    params, basis = N.curve_basis([150 + 20 * k for k in range(10)])
    y = basis[r.integers(0, len(basis), 700)] + r.normal(0, 0.2, (700, 10))
    y[:3], y[3:6] = 0.5, basis[7]
    for gaps in ([], [0, 4], [9]):
        z = y.copy()
        z[:, gaps] = np.nan
        assert N.least_of_copies(z, np.isfinite(z[0]), basis, 9).tolist() == N.least_curves(z, basis, 9)[0].tolist()


def test_penalised_smoother_brute_force(spark):
    n = 10
    rnd = np.random.default_rng(3)
    full = [float(v) for v in rnd.random(n)]
    gaps = [None if i in (2, 7, 8) else v for i, v in enumerate(full)]
    four = [None] * 6 + full[:4]
    df = spark.createDataFrame([(0, full), (1, gaps), (2, four)], "i int, ys array<double>")
    smooth = N.penalised_smooth(n)
    got = {r.i: r.r for r in df.withColumn("r", smooth("ys")).collect()}
    assert got[2].z is None and got[1].lam == 100.0
    d = np.diff(np.eye(n), n=2, axis=0)
    best = None
    for lam in N.LAMBDAS:
        h = np.linalg.inv(np.eye(n) + lam * d.T @ d)
        z = h @ full
        g = n * ((np.array(full) - z) ** 2).sum() / (n - np.trace(h)) ** 2
        if best is None or g < best[0]:
            best = (g, lam, z)
    assert got[0].lam == best[1] and np.allclose(got[0].z, best[2])


def test_connected_regions_snake_across_tiles(spark):
    cells = [(x, 0) for x in range(40)] + [(39, y) for y in range(1, 30)] + [(x, 30) for x in range(5, 39)] + [(0, 10), (1, 11), (100, 100)]
    got = R.connected_regions(spark.createDataFrame(cells, "x long, y long"), tile=4).groupBy("region_x", "region_y").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2, 40 + 29 + 34]


def test_interval_join_end_exclusive(spark):
    o = spark.sql("select 1 k, timestamp'2024-01-01 00:00:00' ts union all select 1, timestamp'2024-01-03 00:00:00' union all select 2, timestamp'2024-01-02 12:00:00'")
    w = spark.sql("select 1 k, timestamp'2024-01-01 00:00:00' s, timestamp'2024-01-03 00:00:00' e")
    assert [str(r.ts) for r in R.interval_join(o, w, ["k"], "ts", "s", "e").collect()] == ["2024-01-01 00:00:00"]


def test_near_duplicates_brute_force_with_hot_spot(spark):
    rnd = random.Random(5)
    pts = [(i, "a" if i % 2 else "b", 86 + rnd.random() * 0.004, 20 + rnd.random() * 0.004) for i in range(300)]
    pts += [(1000 + i, "a", 86.5, 20.5) for i in range(150)] + [(2000, "a", 86.5 + 2e-4, 20.5), (2001, "a", 86.6, 20.6), (2002, "b", 86.5, 20.5)]
    df = spark.createDataFrame(pts, "id long, k string, lon double, lat double")
    got = {r.id for r in G.near_duplicates(df, ["k"], "id", 30.0).collect()}

    def m(a, b):
        p1, p2 = math.radians(a[3]), math.radians(b[3])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    want = {a[0] for a in pts if any(b[0] != a[0] and b[1] == a[1] and m(a, b) < 30 for b in pts)}
    assert got == want and 2000 in got and 2001 not in got and 2002 not in got


def test_track_parts_join_end_to_end(spark):
    df = spark.range(1203).select(F.lit(1).alias("sid"), F.col("id").alias("eid"), (F.timestamp_seconds(F.col("id") * 600)).alias("ts"), F.col("id").cast("double").alias("lon"), F.lit(1.0).alias("lat"))
    parts = K.track_parts(df.repartition(7), "sid", "ts", "eid", size=500).orderBy("part").collect()
    assert [len(p.line) for p in parts] == [500, 500, 203]
    assert [q.lon for p in parts for q in p.line] == [float(i) for i in range(1203)]
    assert K.segments(df, "sid", "ts", "eid").count() == 1202


def test_breakpoint_ranks_join_a_table_of_points(spark):
    points = spark.createDataFrame([("a", 10.0, 35.0), ("a", 50.0, 65.0), ("a", 100.0, 140.0), ("one", 40.0, 7.0), ("step", 0.0, 1.0), ("step", 20.0, 2.0), ("step", 60.0, 2.0), ("step", 100.0, 3.0)], "m string, p double, at double")
    asked = {("a", 20.0): 10.0, ("a", 35.0): 10.0, ("a", 50.0): 30.0, ("a", 65.0): 50.0, ("a", 140.0): 100.0, ("a", 500.0): 100.0, ("a", None): None, ("a", float("nan")): None,
             ("one", 1.0): 40.0, ("one", 9.0): 40.0, ("none", 5.0): None, ("step", 1.5): 10.0, ("step", 2.0): 60.0, ("step", 2.5): 80.0}
    v = spark.createDataFrame([(m, x, i) for i, (m, x) in enumerate(asked)], "m string, x double, lo int")
    got = {r.lo: r.pct for r in K.breakpoint_ranks(v, "m", "x", points, "p", "at").collect()}
    assert [got[i] for i in range(len(asked))] == [None if w is None else pytest.approx(w) for w in asked.values()]


def test_points_near_segments_when_most_lie_in_one_cell(spark):
    """Nine in ten points in one cell, many on one spot, and a long slanting segment: as by brute force."""
    r = np.random.default_rng(11)
    lon = np.concatenate([80.1 + 0.3 * r.random(3_000), np.full(1_500, 80.2), 70 + 20 * r.random(500)])
    lat = np.concatenate([20.1 + 0.3 * r.random(3_000), np.full(1_500, 20.2), 10 + 20 * r.random(500)])
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat))] + [(-1, None, 20.0)]
    seg = [(70.0, 10.0, 90.0, 30.0), (80.2, 20.2, 80.2, 20.2), (80.12, 20.4, 80.13, 20.41), (80.12, 20.4, 80.13, 20.41), (80.0, None, 80.0, 20.0)]
    p, s = spark.createDataFrame(pts, "id long, lon double, lat double"), spark.createDataFrame(seg, "lon1 double, lat1 double, lon2 double, lat2 double")
    want = set()
    for x1, y1, x2, y2 in (q for q in seg if None not in q):
        kx = np.cos(np.radians(lat)) * 111.32
        ax, ay, bx, by = (x1 - lon) * kx, (y1 - lat) * 111.32, (x2 - lon) * kx, (y2 - lat) * 111.32
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = np.clip(np.where(n > 0, -(ax * dx + ay * dy) / np.where(n > 0, n, 1), 0), 0, 1)
        want |= set(np.flatnonzero(np.hypot(ax + t * dx, ay + t * dy) <= 3.0).tolist())
    got = [x.id for x in G.near_segments(p, s, 3.0, crowd=100).collect()]
    assert sorted(got) == sorted(want) and 1_500 < len(want) < 4_900
    cells = G.crowd_cells(p.where("lon is not null"), 0.5, crowd=100).collect()
    assert max(c.level for c in cells) == G.LEVELS and max(c.lots for c in cells) >= 15 and any(c.level == 0 for c in cells)


def test_points_near_many_segments_of_one_cell_are_dealt_into_shares(spark):
    """A pile of segments in one cell, points within, on the fringe, far off, near a pole, repeated or without a number: as by brute force."""
    r = np.random.default_rng(12)
    x1, y1 = 80.05 + 0.1 * r.random(400), 20.05 + 0.1 * r.random(400)
    seg = [*zip(x1, y1, x1 + 0.05 * r.standard_normal(400), y1 + 0.02 * r.standard_normal(400)), (10.0, 88.4, 10.6, 88.6), (-70.3, -0.2, -69.9, 0.3), (float("nan"), 20.0, 80.0, 20.0)]
    seg = [tuple(map(float, q)) for q in seg]
    lon = np.concatenate([80 + 0.5 * r.random(1_500), np.full(300, 80.28), 9 + 3 * r.random(300), -70.5 + 0.8 * r.random(300), [float("nan"), 80.1, 80.1, 0.0]])
    lat = np.concatenate([20 + 0.5 * r.random(1_500), np.full(300, 20.1), 88.2 + 0.6 * r.random(300), -0.5 + r.random(300), [20.1, 20.1, float("nan"), 0.0]])
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat))]
    p = spark.createDataFrame([*pts, pts[5], (-1, None, 20.0)], "id long, lon double, lat double")
    want = set()
    for a1, b1, a2, b2 in seg:
        kx = np.cos(np.radians(lat)) * 111.32
        ax, ay, bx, by = (a1 - lon) * kx, (b1 - lat) * 111.32, (a2 - lon) * kx, (b2 - lat) * 111.32
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = np.clip(np.where(n > 0, -(ax * dx + ay * dy) / np.where(n > 0, n, 1), 0), 0, 1)
        want |= set(np.flatnonzero(np.hypot(ax + t * dx, ay + t * dy) <= 4.0).tolist())
    got = [x.id for x in G.near_segments(p, spark.createDataFrame(seg, "lon1 double, lat1 double, lon2 double, lat2 double"), 4.0, cell=0.25, crowd=100, share=40).collect()]
    assert sorted(got) == sorted([*want, *({5} & want)]) and 700 < len(want) < 2_000


def test_names_resolve_to_the_best_spelling(spark):
    v = spark.createDataFrame([("Anugul", "Angul", 0), ("Anugul", "ANUGUL", 1), ("Other", "an-gul", 2), ("Puri", "Puri (Sadar)", 1), ("B", "same", 1), ("A", "Same", 1), ("X", " . ", 0)], "c string, s string, p int")
    d = spark.createDataFrame([(1, " angul "), (2, "AN GUL"), (3, "anugul"), (4, "puri sadar"), (5, "SAME"), (6, None), (7, "  "), (8, "nowhere")], "id int, raw string")
    got = {r.id: (r.resolved, r.match_priority) for r in P.resolve_names(d, "raw", v, "c", "s", "p", F.lit("unnamed")).collect()}
    assert got == {1: ("Anugul", 0), 2: ("Anugul", 0), 3: ("Anugul", 1), 4: ("Puri", 1), 5: ("A", 1), 6: ("unnamed", None), 7: ("unnamed", None), 8: ("unnamed", None)}


# --- estimators ------------------------------------------------------------------------


def dummy_ols(rows, reg):
    """Full dummy regression with CR1 errors: rows of (unit, cluster, period, y, x...)."""
    us, ts, cs = (sorted({r[i] for r in rows}) for i in (0, 2, 1))
    y = np.array([r[3] for r in rows])
    x = np.column_stack([[r[4] for r in rows]] + [[float(r[0] == u) for r in rows] for u in us] + [[float(r[2] == t) for r in rows] for t in ts[1:]])
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    meat = np.zeros((x.shape[1],) * 2)
    for c in cs:
        m = np.array([r[1] == c for r in rows])
        s = x[m].T @ e[m]
        meat += np.outer(s, s)
    n, k, g = len(y), np.linalg.matrix_rank(x), len(cs)
    v = inv @ meat @ inv * g / (g - 1) * (n - 1) / (n - k)
    return b[0], math.sqrt(v[0, 0]), x, y, cs


def unbalanced(seed=11, units=14, clusters=7):
    rnd = random.Random(seed)
    rows = []
    for u in range(units):
        for t in range(6):
            if rnd.random() < 0.25 and t != u % 6:
                continue
            d = float(u % clusters < 3 and t in (2, 3, 4))
            for _ in range(1 + (rnd.random() < 0.2)):
                rows.append((u, u % clusters, t, 3.0 * d + u + 2 * t + rnd.gauss(0, 1), d))
    return rows


def test_panel_ols_matches_dummy_regression(spark):
    rows = unbalanced()
    df = spark.createDataFrame(rows, "u int, c int, t int, y double, d double").withColumn("cell", F.lit("x"))
    r = D.panel_ols(D.panel_blocks(df.repartition(9), ["cell"], "u", "c", "t", range(6), "y", {"d": F.col("d")})).first()
    b, se, *_ = dummy_ols(rows, None)
    assert r.est == pytest.approx(b, abs=1e-9) and r.se == pytest.approx(se, abs=1e-9)


def test_wild_bootstrap_matches_refits_on_unbalanced_panel(spark):
    rows = unbalanced(seed=4, units=12, clusters=6)
    df = spark.createDataFrame(rows, "u int, c int, t int, y double, d double").withColumn("cell", F.lit("x"))
    got = B.wild_bootstrap_p(D.panel_blocks(df, ["cell"], "u", "c", "t", range(6), "y", {"d": F.col("d")}), draws=64).first()
    b, se, x, y, cs = dummy_ols(rows, None)
    rest = x[:, 1:]
    fit = rest @ np.linalg.pinv(rest) @ y
    res = y - fit
    cl = np.array([cs.index(r[1]) for r in rows])
    hits = 0
    for mask in range(64):
        w = np.array([1.0 if mask >> i & 1 else -1.0 for i in range(6)])
        ystar = fit + w[cl] * res
        bb, ss, *_ = dummy_ols([(*r[:3], ys, r[4]) for r, ys in zip(rows, ystar)], None)
        hits += abs(bb / ss) >= abs(b / se) - 1e-9
    assert got.n_draws == 64 and got.n_extreme == hits


def test_hashed_bootstrap_matches_refits(spark):
    """Draw by draw on an unbalanced panel, over several ranges of draws, with the signs that SQL can repeat."""
    rows = unbalanced(seed=4, units=12, clusters=6)
    df = spark.createDataFrame(rows, "u int, c int, t int, y double, d double").withColumn("cell", F.lit("x"))
    blocks = D.panel_blocks(df, ["cell"], "u", "c", "t", range(6), "y", {"d": F.col("d")})
    got = B.wild_bootstrap_p(blocks, draws=600, signs="hashed").first()
    b, se, x, y, cs = dummy_ols(rows, None)
    rest = x[:, 1:]
    fit = rest @ np.linalg.pinv(rest) @ y
    res, cl, hits = y - fit, np.array([cs.index(r[1]) for r in rows]), 0
    for draw in range(600):
        w = np.array([1.0 if hashlib.md5(f"{c}|{draw}|42".encode()).hexdigest()[0] >= "8" else -1.0 for c in cs])
        bb, ss, *_ = dummy_ols([(*r[:3], ys, r[4]) for r, ys in zip(rows, fit + w[cl] * res)], None)
        hits += abs(bb / ss) >= abs(b / se) - 1e-9
    assert (got.n_draws, got.n_extreme) == (600, hits) and got.p_wcb == (hits + 1) / 601


def test_leave_one_cluster_out_matches_refits(spark):
    rows = unbalanced(seed=8, units=14, clusters=7)
    df = spark.createDataFrame(rows, "u int, c int, t int, y double, d double").withColumn("cell", F.lit("x"))
    got = {r.dropped: r for r in B.leave_cluster_out(D.panel_blocks(df, ["cell"], "u", "c", "t", range(6), "y", {"d": F.col("d")})).collect()}
    assert sorted(got) == sorted({r[1] for r in rows})
    for c, r in got.items():
        b, se, *_ = dummy_ols([x for x in rows if x[1] != c], None)
        if r.status == "ok":
            assert r.est == pytest.approx(b, abs=1e-9) and r.se == pytest.approx(se, abs=1e-9)
        assert r.n_obs == sum(x[1] != c for x in rows) and r.n_clusters == 6
    assert sum(r.status == "ok" for r in got.values()) >= 5


def test_power_by_refits(spark):
    """Each replicate as a panel of its own, with the effect added to its rows."""
    base = np.random.default_rng(3).normal(0, 5, (5, 4))
    rows = [(u, t, float(base[u, t]), int(t >= 2)) for u in range(5) for t in range(4)]
    df = spark.createDataFrame(rows, "u int, t int, y double, post int").withColumn("cell", F.lit("x"))
    sizes, taus, reps, crit = [4, 5], [0.0, 6.0, 15.0], 40, {4: 3.182, 5: 2.776}
    got = {(r.G, r.tau_true): r for r in B.power_curve(df, ["cell"], "u", "t", "y", "post", taus, sizes, reps, crit).collect()}
    for g in sizes:
        for tau in taus:
            hits = 0
            for rep in range(reps):
                pick = [int(int(hashlib.md5(f"{g}|{rep}|{k}|42".encode()).hexdigest()[:13], 16) / 16**13 * 5) for k in range(g)]
                s = np.array([k < g // 2 for k in range(g)], float)
                y = base[pick] + tau * s[:, None] * np.array([0, 0, 1, 1])
                x = (s - s.mean())[:, None] * (np.array([0, 0, 1, 1]) - 0.5)
                yd = y - y.mean(axis=1, keepdims=True) - y.mean(axis=0) + y.mean()
                b = (x * yd).sum() / (x * x).sum()
                se = math.sqrt((((yd - b * x) * x).sum(axis=1) ** 2).sum() * g / (g - 1)) / (x * x).sum()
                hits += se > 1e-9 and abs(b) > crit[g] * se
            assert got[g, tau].n_reps == reps and got[g, tau].power == pytest.approx(hits / reps)


def test_degenerate_cells_are_reported(spark):
    rows = [("always", u, t, float(u + t * t), int(u < 2), 1) for u in range(4) for t in range(4)]
    rows += [("fine", u, t, float(u * t + (u == 1) * t), int(u < 2), int(t >= 2)) for u in range(4) for t in range(4)]
    df = spark.createDataFrame(rows, "cell string, u int, t int, y double, treat int, post int")
    got = {r.cell: r for r in D.static_did(df, ["cell"], "u", "t", range(4), "y", "treat", "post").collect()}
    assert got["always"].status == "not_estimable" and got["always"].tau is None
    assert got["fine"].status == "ok"
    bal = {r.cell: r for r in D.balanced_did(df, ["cell"], "u", "t", "y", "treat", "post").collect()}
    assert bal["always"].status == "not_estimable"
    assert bal["fine"].tau == pytest.approx(got["fine"].tau) and bal["fine"].se == pytest.approx(got["fine"].se)


def test_known_effect_recovered_at_cell_scale(spark):
    n = 20000
    noise = (S.hash_uniform("u", "t", seed=9) - 0.5) * 10
    df = spark.range(n * 6).select((F.col("id") % n).alias("u"), F.floor(F.col("id") / n).cast("int").alias("t"))
    df = df.where(S.hash_uniform("u", "t", seed=1) > 0.1).withColumn("c", F.col("u") % 40)
    df = df.withColumn("treat", (F.col("c") < 20).cast("int")).withColumn("post", (F.col("t") >= 3).cast("int"))
    df = df.withColumn("y", F.col("u") % 17 + F.col("t") * 2 + 1.5 * F.col("treat") * F.col("post") + noise)
    r = D.static_did(df, [], "u", "t", range(6), "y", "treat", "post", cluster="c").first()
    assert abs(r.tau - 1.5) < 5 * r.se and r.se < 0.1 and r.n_clusters == 40


def test_placebo_guard_on_too_many_units(spark):
    rows = [("c", u, t, float(u), int(u == 0), int(t > 0)) for u in range(25) for t in range(2)]
    df = spark.createDataFrame(rows, "cell string, u int, t int, y double, treat int, post int")
    with pytest.raises(Exception, match="too many units"):
        B.in_space_placebo(df, ["cell"], "u", "t", "y", "treat", "post").collect()


def test_hashed_placebo_beyond_enumeration(spark):
    rows = [("c", u, t, float((u * 7) % 11 + t * (u % 3) + 4 * (u < 4) * t), int(u < 4), int(t > 0)) for u in range(25) for t in range(2)]
    df = spark.createDataFrame(rows, "cell string, u int, t int, y double, treat int, post int")
    p = B.in_space_placebo(df, ["cell"], "u", "t", "y", "treat", "post", assignments="hashed", draws=60)
    got = {r["mask"]: r for r in p.collect()}
    assert sorted(got) == list(range(61)) and [m for m, r in got.items() if r.is_real] == [0]
    change = {u: next(r[3] for r in rows if r[1:3] == (u, 1)) - next(r[3] for r in rows if r[1:3] == (u, 0)) for u in range(25)}
    for r in got.values():
        on = {int(u) for u in r.treated.split("|")}
        assert len(on) == 4
        assert r.tau == pytest.approx(np.mean([change[u] for u in on]) - np.mean([change[u] for u in range(25) if u not in on]))
    assert {int(u) for u in got[0].treated.split("|")} == {0, 1, 2, 3} and len({r.treated for r in got.values()}) > 30
    assert B.summarise_placebo(p, ["cell"]).first().n_perm == 61


def test_sign_choice_does_not_follow_the_number_of_clusters(spark):
    df = spark.createDataFrame(unbalanced(seed=4, units=12, clusters=6), "u int, c int, t int, y double, d double").withColumn("cell", F.lit("x"))
    blocks = D.panel_blocks(df, ["cell"], "u", "c", "t", range(6), "y", {"d": F.col("d")})
    few = B.wild_bootstrap_p(blocks, draws=10).first()
    assert few.exact and few.n_draws == 64 and few.p_wcb == few.n_extreme / 64
    many = B.wild_bootstrap_p(blocks, draws=99, signs="hashed").first()
    assert not many.exact and many.n_draws == 99 and many.p_wcb == (many.n_extreme + 1) / 100


def test_joint_test_matches_dense_algebra(spark):
    rows = [r[:4] for r in unbalanced(seed=21, units=16, clusters=8)]
    df = spark.createDataFrame(rows, "u int, c int, t int, y double").withColumn("cell", F.lit("x")).withColumn("treat", (F.col("c") < 4).cast("int"))
    got = D.wald_joint(D.event_blocks(df, ["cell"], "u", "t", range(6), "y", "treat", 2, cluster="c"), ["0", "1"]).first()
    us, cs = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    y = np.array([r[3] for r in rows])
    ks = [t for t in range(6) if t != 2]
    x = np.column_stack([[float(r[2] == k and r[1] < 4) for r in rows] for k in ks] + [[float(r[0] == u) for r in rows] for u in us] + [[float(r[2] == t) for r in rows] for t in range(1, 6)])
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    meat = sum(np.outer(s, s) for s in (x[m].T @ e[m] for m in (np.array([r[1] == c for r in rows]) for c in cs)))
    n, k, g = len(y), np.linalg.matrix_rank(x), len(cs)
    v = (inv @ meat @ inv * g / (g - 1) * (n - 1) / (n - k))[:2, :2]
    assert got.dof == 2 and got.chi2 == pytest.approx(b[:2] @ np.linalg.solve(v, b[:2]), rel=1e-6)


def test_one_pass_equals_exact_only_when_balanced(spark):
    rows = [(u, u % 4, t, float((u * 7 + t * 3) % 11) + (u < 4 and t > 1), float(u < 4 and t > 1)) for u in range(8) for t in range(4)]
    df = spark.createDataFrame(rows, "u int, c int, t int, y double, d double").withColumn("cell", F.lit("x"))

    def both(x):
        exact = D.panel_ols(D.panel_blocks(x, ["cell"], "u", "u", "t", range(4), "y", {"d": F.col("d")})).first().est
        return exact, D.one_pass_did(x, ["cell"], "u", "t", "y", "d", "u").first().tau

    a, b = both(df)
    assert a == pytest.approx(b)
    a, b = both(df.where("not (u = 1 and t = 2) and not (u = 6 and t = 0)"))
    assert a != pytest.approx(b, abs=1e-6)


def test_trimmed_bounds_order(spark):
    rows = [("c", u, t, float((u * 13 + t * 5) % 17), int(u < 10), int(t >= 2)) for u in range(20) for t in range(4)]
    df = spark.createDataFrame(rows, "cell string, u int, t int, y double, treat int, post int")
    hit = (F.col("treat") == 1) & (F.col("post") == 1)
    taus = [D.static_did(B.trimmed(df, ["cell"], "y", hit, 0.2, side), ["cell"], "u", "t", range(4), "y", "treat", "post").first().tau for side in ("lower", "upper")]
    full = D.static_did(df, ["cell"], "u", "t", range(4), "y", "treat", "post").first().tau
    assert taus[0] < full < taus[1]


def test_rows_outside_the_period_roster_are_an_error(spark):
    df = spark.createDataFrame([(u, p, float(u * p), float(u % 2 * (p > 1))) for u in range(6) for p in range(4)], "u int, p int, y double, x double")
    args = ("u", "u", "p")
    assert D.panel_ols(D.panel_blocks(df, [], *args, [0, 1, 2, 3], "y", {"x": F.col("x")})).first()["n_obs"] == 24
    with pytest.raises(Exception, match="period outside the roster: 3"):
        D.panel_ols(D.panel_blocks(df, [], *args, [0, 1, 2], "y", {"x": F.col("x")})).collect()


def test_component_contrast_registers_the_published_draws():
    from furrow.plans import did_plans, season_plans

    assert did_plans.HASHED_DRAWS == 9999 and season_plans.REPLICATES == 1000
    assert did_plans.REPS == 999 and len(did_plans.EFFECTS) == 10 and did_plans.SIZES == [4, 6, 8, 12]


def test_gates_work_by_cell(spark):
    from furrow.operators import quality as Q

    panel = spark.createDataFrame([(u, y, "m", float(10 + 3 * u + y)) for u in (1, 2, 3) for y in (1, 2)], "unit int, year int, metric string, v double")
    # (1, 1) has one bad pixel of four, (2, 1) three bad ones, one of them without a residual, (1, 2) two good pixels only, (3, 2) none
    rmsr = {(1, 1): [0.1, 0.1, 0.1, 0.9], (1, 2): [0.1, 0.1], (2, 1): [0.9, 0.9, None, 0.1, 0.1, 0.1], (2, 2): [0.1] * 3, (3, 1): [0.2] * 5}
    pixels = spark.createDataFrame([(u, y, r) for (u, y), rs in rmsr.items() for r in rs], "unit int, year int, rmsr double")
    args = dict(windows={"m": (0.0, 100.0)}, unit=["unit", "year"], min_rows=6, max_mode=0.5, max_rmsr=0.5, max_poor=0.3, min_ok=3)
    verdict, passed = Q.three_gates(panel, pixels, "metric", "v", min_unique={"m": 5}, **args)
    got = {r.check: (r.observed, r.ok) for r in verdict.collect()}
    assert got["A_n_ok"] == (2.0, False) and got["C_fit"] == (0.5, False) and got["A_unique"] == (6.0, True)
    assert sorted((r.unit, r.year) for r in passed.collect()) == [(1, 1), (2, 2), (3, 1)]
    assert Q.three_gates(panel, pixels, "metric", "v", min_unique={"m": 7}, **args)[1].count() == 0
    assert Q.three_gates(panel, pixels, "metric", "v", min_unique={"other": 1}, **args)[1].count() == 0
    assert Q.three_gates(panel.limit(0), pixels.limit(0), "metric", "v", min_unique={"m": 5}, **args)[1].count() == 0
