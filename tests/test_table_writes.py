"""Tables that are written, refreshed and taken up again, read back from their files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from furrow.plans import QUERIES
from furrow.sources import sinks as W

SF = "/root/testdata/sf0.001"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_refresh_replaces_named_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(i, f"v{i}", k) for i in range(40) for k in ("a", "b/c", None, "gone")][:150], "i int, v string, k string")
    W.write_partitioned(base, path, ["k"])
    before = files(path)
    # worked out from the table itself; rows of other partitions are offered too, and left out
    new = spark.read.parquet(path).where("k <> 'gone' OR k IS NULL").withColumn("v", F.concat("v", F.lit("!")))
    hit = F.col("k").isin("b/c", "gone") | F.col("k").isNull()
    W.refresh_partitions(new, path, ["k"], hit)
    want = sorted(((i, v if k == "a" else v + "!", k) for i, v, k in rows(base) if k != "gone"), key=repr)
    back = lambda: rows(spark.read.schema("i int, v string, k string").parquet(path))
    assert back() == want
    after = files(path)
    kept = {f for f in before if "k=a" in f}
    assert kept and {f: before[f] for f in kept} == {f: after[f] for f in after if "k=a" in f}
    assert not any("gone" in f for f in after)
    once = spark.createDataFrame(want, "i int, v string, k string")
    for _ in range(2):
        W.refresh_partitions(once, path, ["k"], hit)
    assert back() == want
    W.refresh_partitions(once.limit(0), path, ["k"], F.col("k") == "none of them")
    assert back() == want


def test_broken_refresh_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(20).select("id", (F.col("id") % 2).alias("k"))
    W.write_partitioned(base, path, ["k"])
    before = files(path)
    with pytest.raises(Exception, match="boom"):
        W.refresh_partitions(base.withColumn("id", F.when(F.col("id") == 11, F.raise_error(F.lit("boom"))).otherwise(F.col("id"))), path, ["k"], F.col("k") == 1)
    assert files(path) == before


def test_pending_units_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "t")
    todo = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 3), ("a", 1)], "u string, y int")
    asked = []

    def compute(units):
        asked.append(rows(units))
        return units.where("y < 3").withColumn("v", F.col("y") * 10)  # the unit of y = 3 has no rows

    first = W.append_pending(todo.where("u = 'a'"), compute, path, ["u", "y"])
    assert first and asked == [[("a", 1), ("a", 2)]]

    def broken(units):
        compute(units).write.parquet(f"{path}/rows/run=broken")  # rows without a place on the list
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        W.append_pending(todo, broken, path, ["u", "y"])
    assert rows(W.finished_rows(spark, path)) == [("a", 1, 10), ("a", 2, 20)]
    before = files(path)
    assert W.append_pending(todo, compute, path, ["u", "y"])
    assert asked[-1] == [("b", 1), (None, 3)]
    assert set(before) <= set(files(path))
    assert rows(W.finished_rows(spark, path)) == [("a", 1, 10), ("a", 2, 20), ("b", 1, 10)]
    n = len(asked)
    after = files(path)
    assert W.append_pending(todo, compute, path, ["u", "y"]) is None
    assert len(asked) == n and files(path) == after


def test_bucketed_tables_join_without_an_exchange(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = QUERIES["s09_managed_table_sink"](spark, SF)
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "hashpartitioning(c_custkey" not in plan
        assert q.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
