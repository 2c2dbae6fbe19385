"""Reproducible sampling, splitting and numbering by key hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.ranking import attach_scalar, exact_row_number, join_on
from furrow.functions.scalar import hash_bin, hash_key


def stratified_sample(df: DataFrame, strata: Sequence[str], key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per stratum in hash order.

    The rank filter becomes a group limit ahead of the shuffle, so each task
    sends at most ``n`` rows of a stratum on.
    """
    w = Window.partitionBy(*strata).orderBy(hash_key(*key, seed=seed), *key)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def hash_rank(df: DataFrame, strata: Sequence[str], key: Sequence[str], seed: int = 42, name: str = "rn") -> DataFrame:
    """Position in hash order within the stratum, without sorting a whole stratum."""
    h = df.withColumn("__h", hash_key(*key, seed=seed))
    return exact_row_number(h, strata, ["__h", *key], hash_bin(*key, seed=seed), name).drop("__h")


def stratified_split(df: DataFrame, strata: Sequence[str], key: Sequence[str], train_share: float, seed: int = 42) -> DataFrame:
    """Exact share per stratum: the first ceil(share*n) rows in hash order train."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    ranked = hash_rank(df, strata, key, seed, "__rn")
    r = join_on(ranked, sizes, list(strata)) if strata else attach_scalar(ranked, sizes)
    return r.withColumn("is_train", F.col("__rn") <= F.ceil(F.col("__n") * F.lit(train_share))).drop("__rn", "__n")


def stratified_folds(df: DataFrame, strata: Sequence[str], key: Sequence[str], folds: int, seed: int = 42) -> DataFrame:
    return hash_rank(df, strata, key, seed, "__rn").withColumn("fold", ((F.col("__rn") - 1) % folds).cast("int")).drop("__rn")


def sequential_ids(df: DataFrame, group: Sequence[str], order: Sequence[str], bin_col: Column, name: str = "idx") -> DataFrame:
    """Consecutive numbers from 0 over a stable key."""
    out = exact_row_number(df, group, order, bin_col, "__rn")
    return out.withColumn(name, F.col("__rn") - 1).drop("__rn")


def padded_id(prefix: Column, idx: Column, width: int = 4) -> Column:
    """``prefix_0007``; longer numbers keep all their digits."""
    text = idx.cast("string")
    return F.concat_ws("_", prefix.cast("string"), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))
