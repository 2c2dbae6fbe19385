"""Exact ranks and quantiles that never gather a whole group in one task.

A group may hold a third of all rows, so ordering it inside one window
partition, or merging one value map per group, does not scale.  The operators
here cut each group into value bins by a fixed monotone function, count the
bins, and split a bin that is crowded by a second cut, drawn from what the
first pass saw of it: its least and greatest value and its count.  Rows are
ordered only inside a part; prefix sums over the small counts give the offsets.

Keys are carried as one struct: structs with equal fields are equal, NULL
fields too, so a NULL key is a group like any other, and a join on the struct
keeps the partitioning of the grouping before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.scalar import C

BINS_PER_E = 64
BIN_ORIGIN = 1000.0
PART_ROWS = 1_000


def value_bin(v) -> Column:
    """Monotone integer bin of a number; about 1.6 % relative width.

    Needs no pass over the data, so a re-run task always bins alike.
    """
    v = C(v).cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * BIN_ORIGIN) * BINS_PER_E).cast("long")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on same-named keys, keeping one copy of them.

    For keys that are identifiers and never NULL.  Plain equality lets a side
    that was just grouped by the same keys keep its partitioning, so the join
    adds no shuffle for it; a null-safe comparison would hash other expressions.
    """
    return left.join(right, list(keys), how)


def _packed(keys: Sequence[str]) -> Column:
    return (F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))).alias("__key")


def _unpacked(keys: Sequence[str]) -> list[Column]:
    return [F.col("__key")[k].alias(k) for k in keys]


def exact_row_number(df: DataFrame, keys: Sequence[str], order: Sequence, bin_col, name: str = "rn", nulls_first: bool = True) -> DataFrame:
    """``row_number`` over (keys, order), sorted only within bins.

    ``bin_col`` must be monotone in the leading order column, and the order must
    be total for a reproducible result.  Rows whose bin is NULL are a bin of their
    own, before the others or after them as the leading order column has it.
    """
    b = df.withColumn("__key", F.struct(_packed(keys), C(bin_col).alias("bin")))
    counts = b.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    group = F.col("__key")["__key"]
    at = F.col("__key")["bin"].asc_nulls_first() if nulls_first else F.col("__key")["bin"].asc_nulls_last()
    w = Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    win = Window.partitionBy("__key").orderBy(*order)
    j = b.join(offsets, "__key")
    return j.withColumn(name, (F.row_number().over(win) + F.col("__before")).cast("long")).select(*df.columns, name)


def _valued(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    d = df.select(_packed(keys), F.col(value).cast("double").alias("__v"))
    return d.where(F.col("__v").isNotNull() & ~F.isnan("__v")).withColumn("__bin", value_bin("__v"))


def _histogram(d: DataFrame, count: Column) -> DataFrame:
    """Per bin: its count, what lies before it in the group, the group's count, and the cut of its parts."""
    h = d.groupBy("__key", "__bin").agg(count.alias("__bc"), F.min("__v").alias("__mn"), F.max("__v").alias("__mx"))
    w = Window.partitionBy("__key")
    before = F.sum("__bc").over(w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__bc")
    return h.select("__key", "__bin", "__bc", "__mn", "__mx", before.alias("__lo"), F.sum("__bc").over(w).alias("__n"))


def _part() -> Column:
    """Equal widths between the bin's least and greatest value, as many as its count asks for."""
    parts = F.ceil(F.col("__bc") / PART_ROWS)
    at = F.floor((F.col("__v") - F.col("__mn")) / (F.col("__mx") - F.col("__mn")) * parts)
    return F.when(F.col("__mx") > F.col("__mn"), F.least(at, parts - 1)).otherwise(F.lit(0)).cast("long")


def _placed(values: DataFrame, bins: DataFrame) -> DataFrame:
    """Per part: its count and what lies before it in the group. ``values`` are (key, bin, part, v, c)."""
    p = values.groupBy("__key", "__bin", "__part").agg(F.sum("__c").alias("__pc")).join(bins.select("__key", "__bin", "__lo", "__n"), ["__key", "__bin"])
    w = Window.partitionBy("__key", "__bin").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("__lo", F.col("__lo") + F.sum("__pc").over(w) - F.col("__pc"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group: one row per key, one column per name.

    Equal to ``percentile(value, p)``.  The first pass only counts bins; the second reads the rows of
    the bins that hold a wanted rank, repeated values as counts, and orders the parts that hold one.
    """
    keys, names = list(keys), list(probs)
    d = _valued(df, keys, value)
    ranks = {}
    for nm in names:
        pos = F.lit(float(probs[nm])) * (F.col("__n") - 1)
        ranks[nm] = (F.floor(pos), F.ceil(pos), pos - F.floor(pos))

    def wanted(size: str) -> Column:
        inside = [(r >= F.col("__lo")) & (r < F.col("__lo") + F.col(size)) for lo, hi, _ in ranks.values() for r in (lo, hi)]
        return reduce(lambda a, b: a | b, inside)

    bins = _histogram(d, F.count(F.lit(1))).where(wanted("__bc"))
    values = d.join(bins, ["__key", "__bin"]).groupBy("__key", "__bin", _part().alias("__part"), "__v").agg(F.count(F.lit(1)).alias("__c"))
    cand = values.join(_placed(values, bins).where(wanted("__pc")).drop("__pc"), ["__key", "__bin", "__part"])
    wb = Window.partitionBy("__key", "__bin", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("__hi", F.col("__lo") + F.sum("__c").over(wb))
    cand = cand.withColumn("__start", F.col("__hi") - F.col("__c"))
    aggs = []
    for nm in names:
        lo, hi, frac = ranks[nm]
        for tag, r in (("lo", lo), ("hi", hi)):
            inside = (r >= F.col("__start")) & (r < F.col("__hi"))
            aggs.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{nm}_{tag}"))
        aggs.append(F.max(frac).alias(f"__{nm}_f"))
    picked = cand.groupBy("__key").agg(*aggs)
    return picked.select(
        *_unpacked(keys),
        *[
            (F.col(f"__{nm}_lo") + (F.col(f"__{nm}_hi") - F.col(f"__{nm}_lo")) * F.col(f"__{nm}_f")).alias(nm)
            for nm in names
        ],
    )


def grouped_stats(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *aggs: Column) -> DataFrame:
    """Plain aggregates plus exact quantiles of ``value`` in one row per group; NULL keys are a group."""
    keys = list(keys)
    plain = df.withColumn("__key", _packed(keys)).groupBy("__key").agg(*aggs)
    q = exact_quantiles(df, keys, value, probs)
    q = q.select(_packed(keys), *probs)
    out = plain.join(q, "__key", "left")
    return out.select(*_unpacked(keys), *[c for c in out.columns if c != "__key"])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank with ties averaged, as rows of (keys, value, rank)."""
    keys = list(keys)
    base = _valued(df, keys, value).groupBy("__key", "__bin", "__v").agg(F.count(F.lit(1)).alias("__c"))
    bins = _histogram(base, F.sum("__c"))
    values = base.join(bins, ["__key", "__bin"]).select("__key", "__bin", _part().alias("__part"), "__v", "__c")
    j = values.join(_placed(values, bins).drop("__pc", "__n"), ["__key", "__bin", "__part"])
    wb = Window.partitionBy("__key", "__bin", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.col("__lo") + F.sum("__c").over(wb)
    return j.select(*_unpacked(keys), F.col("__v").alias(value), (cum - F.col("__c") + (F.col("__c") + 1) / 2.0).alias(name))


def attach_scalar(df: DataFrame, one: DataFrame) -> DataFrame:
    """Put the columns of a one-row table (a global aggregate) on every row, as a scalar subquery."""
    row = one.select(F.struct(*one.columns).alias("__s")).scalar()
    return df.withColumn("__s", row).select(*df.columns, *[F.col("__s")[c].alias(c) for c in one.columns])


def column_medians(df: DataFrame, keys: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """Exact medians of several columns in one plan: {column: output name}."""
    keys = list(keys)
    items = F.explode(F.array(*[F.struct(F.lit(n).alias("s"), F.col(c).cast("double").alias("v")) for c, n in cols.items()]))
    long = df.select(*keys, items.alias("__i")).select(*keys, F.col("__i.s").alias("__s"), F.col("__i.v").alias("__x"))
    med = exact_quantiles(long, [*keys, "__s"], "__x", {"__m": 0.5})
    return med.groupBy(*keys).agg(*[F.max(F.when(F.col("__s") == n, F.col("__m"))).alias(n) for n in cols.values()])
