from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<double>, label int, n int, key string, comp int"


def brute(rows):
    """(vec_id, embedding, label) -> sorted (vec_id, n_links, component_id, kept)"""
    ok = [v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, float) / max(map(abs, v)) if o else None for (_, v, _), o in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if o else None for u, o in zip(unit, ok)]
    links = [[b for b in range(len(rows)) if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            more = [b for b in links[todo.pop()] if b not in seen]
            seen.update(more)
            todo += more
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        comp = min(ids) if ids else None
        out.append((rows[a][0], len(links[a]), comp, rows[a][0] == comp))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    got = sorted(map(tuple, E.near_vectors(df).collect()), key=repr)
    assert got == brute(rows)
    return got


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 1.0, 1.0], 1), (9, [inf, 1.0, 1.0], 1),
        (10, [1.0, None, 2.0], 1), (11, [], 1), (12, [1.0, 2.0], 1), (13, [1e300, 2e300, 3e300], 1), (14, [1e-300, 2e-300, 3e-300], 1), (None, v, 1), (None, [-1.0, 0.0, 0.5], 3),
        (15, [-1.0, -2.0, -3.0], 1), (16, [1.0, 2.0, 3.001], 1), (2, [9.0, 0.0, 0.0], 1), (17, [5.0], 4), (18, [7.0], 4), (19, [-7.0], 4),
    ]
    check(spark, rows)
    assert E.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert check(spark, [(5, v, None), (6, None, 1)])


def test_hot_groups_chains_and_copies(spark, monkeypatch):
    """Groups of near copies and of exact ones, over several blocks of a cell, and pairs about the threshold."""
    monkeypatch.setattr(E, "BLOCK", 40)
    r = np.random.default_rng(5)
    base = r.standard_normal((4, 24))
    rows = []
    for g in range(150):  # one group with many near copies
        rows.append((len(rows), (base[0] + 0.05 * r.standard_normal(24)).tolist(), 1))
    for g in range(120):  # copies of one vector
        rows.append((len(rows), base[1].tolist(), 1))
    for g in range(60):  # pairs on either side of the threshold
        u = base[2] / np.linalg.norm(base[2])
        w = r.standard_normal(24)
        w -= (w @ u) * u
        a = math.acos(0.98) * (0.8 + 0.4 * g / 60)
        rows.append((len(rows), (math.cos(a) * u + math.sin(a) * w / np.linalg.norm(w)).tolist(), 2))
    rows.append((len(rows), base[2].tolist(), 2))
    for g in range(200):
        rows.append((len(rows), r.standard_normal(24).tolist(), 1 + g % 2))
    got = check(spark, rows)
    assert sum(x[1] for x in got) > 150 * 100


def test_count_is_calibrated():
    for most in (1, 100, 10_000, 10**6, 10**9):
        plan = E.calibrated(most)
        assert plan.count >= 2
        p = E._shared(E.CELL) ** plan.depth * math.erf(E.WINDOW / math.sqrt(2))
        short = sum(math.comb(plan.tables, k) * p**k * (1 - p) ** (plan.tables - k) for k in range(plan.count))
        assert short <= E.MISS
        assert most * E._shared(plan.cell / math.sqrt(2)) ** plan.depth <= E.STRANGERS + 1e-9


@pytest.mark.parametrize("tables", ["sf0.1", "check_h"])
def test_recall_on_the_tables(spark, tables):
    df = spark.read.parquet(f"/root/testdata/{tables}/embeddings.parquet")
    pd = df.toPandas()
    got = E.near_vectors(df).toPandas().set_index("vec_id").n_links.reindex(pd.vec_id).to_numpy()
    want = np.zeros(len(pd), int)
    m = np.stack(pd.embedding).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for lab in pd.label.unique():
        at = np.flatnonzero(pd.label == lab)
        want[at] = (m[at] @ m[at].T >= 0.98).sum(axis=1) - 1
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum()
    assert df.where(F.col("label").isNull()).count() == 0


def test_a_cosine_at_the_threshold_is_not_rounded():
    u = np.array([1.0, 0.0])
    for w, cosine, linked in (([3.0, 4.0], 0.6, True), ([3.0, np.nextafter(4.0, 5)], 0.6, False), ([-3.0, 4.0], -0.5, False), ([-3.0, 4.0], -0.75, True), ([2.0, 0.0], 1.0, True)):
        assert E.reaches(u, np.array(w), cosine) == linked
