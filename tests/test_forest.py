"""Forests: splits against enumeration, the same trees whatever the partitions, several blocks, missing labels and values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import forest as M

SMALL = dict(trees=30, depth=5, min_leaf=2, subset="2")


def brute_split(c, weight, min_leaf):
    """Slot, bin and weighted gain of the best split of one node, each tried on its own."""
    gini = lambda x: 1 - sum((v / x.sum()) ** 2 for v in x)
    best = (0.0, -1, -1)
    for s, of in enumerate(c):
        for b in range(len(of)):
            left, right = of[: b + 1].sum(axis=0), of[b + 1 :].sum(axis=0)
            if min(left.sum(), right.sum()) < min_leaf:
                continue
            wl, wr = left * weight, right * weight
            n = (wl + wr).sum()
            gain = n * gini(wl + wr) - wl.sum() * gini(wl) - wr.sum() * gini(wr)
            if gain > best[0] + 1e-9:
                best = (gain, s, b)
    return best


def test_splits_against_enumeration():
    rng = np.random.default_rng(5)
    weight = np.array([0.6, 2.5, 1.1])
    row = rng.integers(0, 6, (60, 4, 7, 3)) * (rng.random((60, 4, 7, 3)) < 0.4)
    whole = row[:, :1].sum(axis=2)  # every slot of a node counts the same rows
    row[:, 1:, -1] += whole - np.minimum(whole, row[:, 1:].sum(axis=2))
    row = np.concatenate([row[:, :1], np.repeat(row[:, :1], 3, axis=1)[:, :, rng.permutation(7)]], axis=1)
    slot, cut, gain, left, all_ = M.best_splits(row, weight, 3)
    for i, c in enumerate(row):
        g, s, b = brute_split(c, weight, 3)
        assert (slot[i] >= 0) == (s >= 0) and gain[i] == pytest.approx(g, abs=1e-9)
        if s >= 0:
            assert left[i].tolist() == c[slot[i], : cut[i] + 1].sum(axis=0).tolist() and all_[i].tolist() == c[0].sum(axis=0).tolist()


@pytest.fixture(scope="module")
def table(spark):
    """Class 1 where a + b > 1, repeated rows, a feature of few values and one of noise."""
    rng = np.random.default_rng(7)
    x = rng.random((900, 3))
    rows = [(i, float(a), float(b), float(i % 3), float(c), int(a + b > 1)) for i, (a, b, c) in enumerate(x)]
    rows += [(900 + i, *rows[7][1:]) for i in range(300)]
    return spark.createDataFrame(rows, "id long, a double, b double, few double, noise double, y int")


FEATURES = ["a", "b", "few", "noise"]


def test_trees_do_not_depend_on_partitions(table):
    one, many = (M.train_forest(table.repartition(n), FEATURES, "y", balanced=True, **SMALL) for n in (1, 7))
    for x, y in ((one.feature, many.feature), (one.cut, many.cut), (one.p, many.p), (one.gain, many.gain)):
        assert np.array_equal(x, y)
    assert [len(t) for t in one.cuts][2] == 2 and one.cuts[2].tolist() == [0.5, 1.5]
    gini = one.importances()
    assert gini.sum() == pytest.approx(1) and min(gini[:2]) > max(gini[2:])


def test_several_blocks_add_up(spark, table, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 100)
    model = M.train_forest(table, FEATURES, "y", **SMALL)
    share = table.agg(F.avg("y")).first()[0]
    assert model.p[:, 0, 1].mean() == pytest.approx(share, abs=0.02)
    got = M.predict(model, table, FEATURES, ["id", "y"])
    assert got.count() == 1200 and got.where("pred = y").count() > 1100
    p = M.class_probability(model, table, FEATURES, ["id"], 1, "p").agg(F.min("p"), F.max("p")).first()
    assert 0 <= p[0] < 0.1 and 0.9 < p[1] <= 1


def test_leaves_and_pruning(table):
    model = M.train_forest(table, FEATURES, "y", **{**SMALL, "min_leaf": 40})
    last = model.feature.shape[1]
    for f, p in zip(model.feature, model.p):
        for i in np.flatnonzero(f >= 0):
            kids = (2 * i + 1, 2 * i + 2)
            assert all(p[k].sum() == pytest.approx(1) for k in kids)
            if all(k >= last or f[k] < 0 for k in kids):
                assert len({int(p[k].argmax()) for k in kids}) == 2


def test_every_row_is_predicted_out_of_fold(spark, table):
    df = table.withColumn("fold", (F.col("id") % 3).cast("int"))
    got = M.cross_validate(df, FEATURES, "y", "fold", 3, ["id"], **SMALL)
    assert sorted(r.id for r in got.select("id").collect()) == list(range(1200))
    with pytest.raises(ValueError):
        M.train_forest(df.limit(0), FEATURES, "y", **SMALL)


def test_missing_labels_and_values(table):
    holes = table.withColumn("y", F.when(F.col("id") % 9 > 0, F.col("y")))
    known = M.train_forest(holes.where("y IS NOT NULL"), FEATURES, "y", balanced=True, **SMALL)
    assert np.array_equal(M.train_forest(holes, FEATURES, "y", balanced=True, **SMALL).p, known.p)
    with pytest.raises(ValueError):
        M.train_forest(holes, FEATURES, "y", **SMALL)
    with pytest.raises(Exception, match="finite"):
        M.train_forest(table.withColumn("b", F.when(F.col("id") != 3, F.col("b"))), FEATURES, "y", **SMALL)
