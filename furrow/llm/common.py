"""Reading, scratch tables and batch sizes shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import scratch_path

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(n: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n (a NULL id counts as the text 'null')."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("null"))) % n


def short_batches(spark: SparkSession) -> None:
    """Fewer rows per Arrow batch than Spark's default: texts are long and workers' memory is bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, an execution's shuffle files go when it has ended; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the table's path, so that it can be dropped after its last reader."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: read more than once, safe from lost executors."""
    return written_at(df, name)[0]
