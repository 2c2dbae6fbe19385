from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import ranking
from furrow.functions.ranking import average_ranks, exact_quantiles, exact_row_number, grouped_stats, value_bin


def test_null_order_values_keep_their_rows(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "k string, v double")
    up = exact_row_number(d, ["k"], ["v"], value_bin("v")).collect()
    assert sorted((r.k, r.rn, r.v or 0) for r in up) == [("a", 1, 0), ("a", 2, 1.0), ("a", 3, 3.0), ("b", 1, 0)]
    down = exact_row_number(d, ["k"], [F.col("v").desc()], -value_bin("v"), nulls_first=False).collect()
    assert sorted((r.k, r.rn, r.v or 0) for r in down) == [("a", 1, 3.0), ("a", 2, 1.0), ("a", 3, 0), ("b", 1, 0)]


def test_null_keys_are_a_group(spark):
    d = spark.createDataFrame([(None, 1, 1.0), (None, 1, 2.0), ("a", None, 3.0), ("a", 2, 5.0), ("a", 2, None)], "k string, j int, v double")
    rn = exact_row_number(d, ["k", "j"], ["v"], value_bin("v")).collect()
    assert len(rn) == 5 and sorted(r.rn for r in rn if r.k is None) == [1, 2]
    got = {(r.k, r.j): (r.n, r.m) for r in grouped_stats(d, ["k", "j"], "v", {"m": 0.5}, F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(None, 1): (2, 1.5), ("a", None): (1, 3.0), ("a", 2): (2, 5.0)}
    ranks = {(r.k, r.j, r.v): r.r for r in average_ranks(d, ["k", "j"], "v", "r").collect()}
    assert ranks == {(None, 1, 1.0): 1.0, (None, 1, 2.0): 2.0, ("a", None, 3.0): 1.0, ("a", 2, 5.0): 1.0}
    assert exact_quantiles(d, [], "v", {"m": 0.5}).first().m == 2.5


@pytest.fixture(scope="module")
def crowded(spark):
    """A million values between 290 and 300 in one group, next to a small one with repeats."""
    many = spark.range(1_000_000).select(F.lit("hot").alias("k"), (290 + F.col("id") * 7919 % 1_000_000 / 100_000.0).alias("v"))
    few = spark.range(30).select(F.lit("few").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    return many.unionByName(few)


def test_crowded_bins_are_split(spark, crowded):
    d = ranking._valued(crowded, ["k"], "v")
    h = ranking._histogram(d, F.count(F.lit(1)))
    assert h.where("__bc > 100000").count() >= 2  # the first cut alone leaves bins with a large share of the group
    parts = d.join(h, ["__key", "__bin"]).groupBy("__key", "__bin", ranking._part()).count().agg(F.max("count")).first()[0]
    assert parts <= 3 * ranking.PART_ROWS
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.975, "e": 1.0}
    got = {r.k: [r[n] for n in probs] for r in exact_quantiles(crowded, ["k"], "v", probs).collect()}
    hot = np.sort(290 + np.arange(1_000_000) / 100_000.0)
    assert got["hot"] == pytest.approx(np.quantile(hot, list(probs.values())).tolist(), abs=1e-9)
    assert got["few"] == pytest.approx(np.quantile([i % 7 for i in range(30)], list(probs.values())).tolist())


def test_average_ranks_over_split_bins(spark, crowded):
    r = average_ranks(crowded, ["k"], "v", "r")
    few = {x.v: x.r for x in r.where("k = 'few'").collect()}
    assert few == {float(v): sum(sum(1 for i in range(30) if i % 7 == w) for w in range(v)) + (sum(1 for i in range(30) if i % 7 == v) + 1) / 2 for v in range(7)}
    hot = r.where("k = 'hot'").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.sum(F.abs(F.col("r") - 1 - F.round((F.col("v") - 290) * 100_000))).alias("off")).first()
    assert (hot.n, hot.lo, hot.hi, hot.off) == (1_000_000, 1.0, 1_000_000.0, 0.0)
