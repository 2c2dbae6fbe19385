"""Rules over a table, answered as rows: (rule, ok, n_bad)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.ranking import exact_quantiles, join_on
from furrow.operators.panel import attach_scalar, mode_stats


def bad_rows(cond: Column) -> Column:
    """Aggregate: rows where the condition is not true (NULL counts as bad)."""
    return F.count(F.when(~F.coalesce(cond, F.lit(False)), 1))


def run_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """All rules in one pass: each is an aggregate that yields its number of bad rows."""
    names = list(rules)
    one = df.agg(*[F.coalesce(rules[n].cast("long"), F.lit(0)).alias(f"r{i}") for i, n in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n_bad")) for i, n in enumerate(names)]))
    return one.select(rows.alias("r")).select("r.rule", (F.col("r.n_bad") == 0).alias("ok"), "r.n_bad")


def schema_rule(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame([("schema", not missing, len(missing))], "rule string, ok boolean, n_bad long")


def count_rule(name: str, df: DataFrame) -> DataFrame:
    """A rule whose offending rows are given as a table."""
    n = df.agg(F.count(F.lit(1)).alias("n_bad"))
    return n.select(F.lit(name).alias("rule"), (F.col("n_bad") == 0).alias("ok"), "n_bad")


def union_rules(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def domain_difference(df: DataFrame, col: str, expected: Sequence) -> DataFrame:
    """Values present but not expected, and expected but not present."""
    kind = df.schema[col].dataType.simpleString()
    want = df.sparkSession.createDataFrame([(v,) for v in expected], f"value {kind}")
    have = df.select(F.col(col).alias("value")).distinct()
    extra = have.subtract(want).withColumn("finding", F.lit("unexpected"))
    return extra.unionByName(want.subtract(have).withColumn("finding", F.lit("missing")))


def coverage(df: DataFrame, grid: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    """Rows per expected cell, zero where absent, with the minimum check."""
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    j = join_on(grid, c, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.withColumn("ok", F.col("n") >= minimum)


def three_gates(panel: DataFrame, pixels: DataFrame, metric: str, v: str, windows: Mapping[str, tuple[float, float]], unit: Sequence[str],
                min_rows: int, min_unique: Mapping[str, int], max_mode: float, max_rmsr: float, max_poor: float, min_ok: int) -> tuple[DataFrame, DataFrame]:
    """Gate A: mode share, counts and the metric's own least number of different values, and the
    least number of well fitted pixels of a cell (``unit``, such as unit and year); B: dates inside
    the metric's window; C: share of badly fitted pixels per cell, a NULL residual being bad.
    Returns (verdict rows, passing panel): the panel loses failing metrics, dates outside the window
    and cells with too few good or too many bad pixels, cells without pixels among them."""
    unit = list(unit)
    modes = mode_stats(panel, [metric], v)
    needed = reduce(lambda o, m: F.when(F.col(metric) == m, min_unique[m]).otherwise(o), min_unique, F.lit(None).cast("int"))
    checks = F.explode(F.array(
        F.struct(F.lit("A_rows").alias("check"), F.col("n").cast("double").alias("observed"), (F.col("n") >= min_rows).alias("ok")),
        F.struct(F.lit("A_unique").alias("check"), F.col("n_unique").cast("double").alias("observed"), F.coalesce(F.col("n_unique") >= needed, F.lit(False)).alias("ok")),
        F.struct(F.lit("A_mode_share").alias("check"), F.col("mode_share").alias("observed"), (F.col("mode_share") <= max_mode).alias("ok")),
    ))
    a = modes.select(metric, checks.alias("c")).select(metric, "c.*")
    lo = reduce(lambda o, m: F.when(F.col(metric) == m, windows[m][0]).otherwise(o), windows, F.lit(None).cast("double"))
    hi = reduce(lambda o, m: F.when(F.col(metric) == m, windows[m][1]).otherwise(o), windows, F.lit(None).cast("double"))
    in_window = F.coalesce(F.col(v).between(lo, hi), F.lit(False))
    med = exact_quantiles(panel, [metric], v, {"observed": 0.5})
    b = med.select(metric, F.lit("B_window").alias("check"), "observed", F.coalesce(F.col("observed").between(lo, hi), F.lit(False)).alias("ok"))
    bad = F.coalesce(F.col("rmsr") > max_rmsr, F.lit(True)).cast("int")
    cells = pixels.groupBy(*unit).agg(F.avg(bad.cast("double")).alias("poor"), F.sum(1 - bad).alias("n_ok"))
    worst = attach_scalar(panel.select(metric).distinct(), cells.agg(F.max("poor").alias("poor"), F.min("n_ok").cast("double").alias("n_ok")))
    both = F.explode(F.array(
        F.struct(F.lit("A_n_ok").alias("check"), F.col("n_ok").alias("observed"), (F.col("n_ok") >= min_ok).alias("ok")),
        F.struct(F.lit("C_fit").alias("check"), F.col("poor").alias("observed"), (F.col("poor") <= max_poor).alias("ok")),
    ))
    c = worst.select(metric, both.alias("c")).select(metric, "c.*")
    verdict = a.unionByName(b).unionByName(c)
    good_metric = a.groupBy(metric).agg(F.min("ok").alias("__a"))
    good_cell = cells.select(*unit, ((F.col("poor") <= max_poor) & (F.col("n_ok") >= min_ok)).alias("__c"))
    passed = join_on(join_on(panel, good_metric, [metric]), good_cell, unit, "left")
    passed = passed.where(F.col("__a") & in_window & F.coalesce("__c", F.lit(False))).select(*panel.columns)
    return verdict, passed


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """Findings where a claimed value is missing or further off than ``tol``."""
    a = actual.select(*keys, F.col("value").alias("__got"), F.lit(True).alias("__has"))
    j = join_on(expected, a, list(keys), "left")
    status = F.when(F.col("__has").isNull(), "missing").when(F.abs(F.col("value") - F.col("__got")) > tol, "mismatch").otherwise("ok")
    return j.select(*keys, status.alias("status"), F.col("value").alias("expected"), F.col("__got").alias("got"))


def accuracy(counts: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Overall, kappa, and per-class accuracies from (label, pred, n) counts.

    The confusion table is at most classes x classes rows.
    """
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).alias("hit"))
    rows = counts.groupBy(F.col(label).alias("cls")).agg(
        F.sum("n").alias("n_ref"), F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).alias("tp")
    )
    cols = counts.groupBy(F.col(pred).alias("cls")).agg(F.sum("n").alias("n_pred"))
    pc = rows.join(cols, "cls", "full").na.fill(0, ["n_ref", "tp", "n_pred"])
    pc = pc.withColumn("producer_acc", F.coalesce(F.try_divide(F.col("tp"), F.col("n_ref")), F.lit(0.0)))
    pc = pc.withColumn("user_acc", F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(2 * F.col("producer_acc") * F.col("user_acc"), F.col("producer_acc") + F.col("user_acc")), F.lit(0.0))
    pc = attach_scalar(pc.withColumn("f1", f1), total)
    whole = pc.agg(
        F.sum(F.col("n_ref") * F.col("n_pred") / (F.col("total") * F.col("total"))).alias("pe"),
        (F.max("hit") / F.max("total")).alias("oa"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("n_ref")) / F.sum("n_ref")).alias("f1_weighted"),
    ).withColumn("kappa", F.try_divide(F.col("oa") - F.col("pe"), 1 - F.col("pe")))
    return attach_scalar(pc, whole).select("cls", "n_ref", "n_pred", "tp", "producer_acc", "user_acc", "f1", "oa", "kappa", "f1_macro", "f1_weighted")


def confusion_rows(df: DataFrame, label: str, pred: str) -> DataFrame:
    """The confusion table as rows, every pair of classes with its count, 0 included, and its share of the label's rows.

    The classes, those that occur as label or prediction, are gathered as one small set.
    """
    c = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    every = c.agg(F.array_sort(F.array_union(F.collect_set(label), F.collect_set(pred))).alias("k"))
    grid = every.select(F.explode("k").alias(label), "k").select(label, F.explode("k").alias(pred))
    rows = grid.join(c, [label, pred], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("share_of_label", F.try_divide("n", F.sum("n").over(Window.partitionBy(label))))
