"""Writers, resumable and replaceable partitions, named tables, and nested results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import drop_path, path_exists, scratch_path


def write_csv(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    df.select(*cols).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_stamped(df: DataFrame, path: str, partition: Sequence[str], stamp: Mapping[str, object]) -> None:
    """Parquet partitioned by year/event with constant metadata columns."""
    out = df.withColumns({k: F.lit(v) for k, v in stamp.items()})
    out.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_units(df: DataFrame, path: str, unit: str, valid: Column) -> tuple[str, str]:
    """One partition per unit; rows that fail ``valid`` go to a rejects table instead of failing the run."""
    ok = F.coalesce(valid, F.lit(False))
    good, bad = f"{path}/units", f"{path}/rejects"
    df.where(ok).write.mode("overwrite").partitionBy(unit).parquet(good)
    df.where(~ok).write.mode("overwrite").parquet(bad)
    return good, bad


def write_track_lines(parts: DataFrame, path: str, props: Sequence[str]) -> None:
    """GeoJSON lines: one feature per row."""
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), F.transform("line", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties"),
    ))
    parts.select(feature.alias("value")).write.mode("overwrite").text(path)


def read_track_lines(spark: SparkSession, path: str, props: str) -> DataFrame:
    schema = f"type string, geometry struct<type:string,coordinates:array<array<double>>>, properties struct<{props}>"
    return spark.read.schema(schema).json(path)


def write_nested(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flatten_metrics(df: DataFrame, keys: Sequence[str], metrics: str) -> DataFrame:
    """Nested map of metrics to (key, metric, value) rows."""
    return df.select(*keys, F.explode(F.map_entries(metrics)).alias("e")).select(*keys, F.col("e.key").alias("metric"), F.col("e.value").alias("value"))


# --- partitions replaced in place -----------------------------------------------------


def write_partitioned(df: DataFrame, path: str, partition: Sequence[str], mode: str = "errorifexists") -> None:
    """Parquet by partition; a partition of any size is split into files of the advised size."""
    df.hint("rebalance", *partition).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def refresh_partitions(new: DataFrame, path: str, partition: Sequence[str], replace: Column) -> None:
    """Replace the partitions of a written table that ``replace`` names, from ``new``; the files of others stay.

    ``replace`` reads partition columns only; rows of ``new`` outside it are left out. The rows are
    staged first, so ``new`` may be worked out from the table itself, and are moved in by the write's
    own commit: a run that breaks before it leaves the table as it was, and running again gives the
    same table. A named partition without new rows is emptied. NULL is a partition like any other.
    """
    spark, keys = new.sparkSession, list(partition)
    hit = F.coalesce(replace, F.lit(False))
    schema = spark.read.parquet(path).schema
    staged = scratch_path(spark, "staged")
    new.where(hit).select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(staged)
    rows = spark.read.schema(schema).parquet(staged)
    held = spark.read.schema(schema).parquet(path).where(hit).select(*keys).distinct()
    gone = held.join(rows.select(*keys).distinct(), [held[k].eqNullSafe(rows[k]) for k in keys], "left_anti").select("*", F.lit(1))
    gone = [tuple(r)[:-1] for r in gone.collect()]  # one row per emptied partition
    write_partitioned(rows, path, keys, "overwrite")
    for values in gone:
        drop_path(spark, "/".join([path, *(f"{k}={'__HIVE_DEFAULT_PARTITION__' if v is None else _escaped(spark, str(v))}" for k, v in zip(keys, values))]))
    drop_path(spark, staged)


def _escaped(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


# --- work that is taken up again --------------------------------------------------------


def append_pending(todo: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str]) -> str | None:
    """Work out the units of ``todo`` that the table at ``path`` has not finished, and append them.

    A run writes its rows to a folder of its own and then its units to the completion list, which
    makes them visible: rows of a run that broke off in between are never read, and its units are
    pending again. Units that ``compute`` gives no rows for are finished too. Returns the run's
    name, or None if nothing was pending.
    """
    spark, keys = todo.sparkSession, list(keys)
    units = todo.select(*keys).distinct()
    if path_exists(spark, f"{path}/finished"):
        done = spark.read.parquet(f"{path}/finished").select(*keys).distinct()
        units = units.join(done, [units[k].eqNullSafe(done[k]) for k in keys], "left_anti")
    run = uuid.uuid4().hex
    listed = scratch_path(spark, "pending")
    units.write.parquet(listed)  # the same units for the rows and for the list
    pending = spark.read.schema(units.schema).parquet(listed)
    try:
        if pending.isEmpty():
            return None
        compute(pending).write.parquet(f"{path}/rows/run={run}")
        pending.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/finished")
    finally:
        drop_path(spark, listed)
    return run


def finished_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the runs on the completion list."""
    runs = spark.read.parquet(f"{path}/finished").select("run").distinct()
    return spark.read.parquet(f"{path}/rows").join(runs, "run", "left_semi").drop("run")


# --- named tables ----------------------------------------------------------------------------


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """A catalogue table with one file per bucket: joins and groups on the key with tables of as many buckets move no rows."""
    w = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (w.option("path", path) if path else w).saveAsTable(name)


def pending_units(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units without output yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def refresh(current: DataFrame, new: DataFrame, replace: Column, order: Sequence[str]) -> DataFrame:
    """Keep the rows outside ``replace``, take those inside from ``new``; running it twice changes nothing."""
    hit = F.coalesce(replace, F.lit(False))
    return current.where(~hit).unionByName(new.where(hit)).orderBy(*order)


def missing_partitions(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), list(keys), "left_anti")
