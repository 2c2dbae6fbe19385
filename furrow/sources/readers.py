"""Readers for owned and foreign tables, each with an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a long unit x year panel file.
PANEL_SCHEMA = (
    "district string, district_id string, year int, year_type string, cyclone_exposure string, cyclone_year_event string, "
    "pipeline string, metric string, median_doy double, p25_doy double, p75_doy double, boot_p025 double, boot_p975 double, n_pixels long"
)


class MissingColumns(ValueError):
    pass


def require_columns(columns: Sequence[str], required: Sequence[str]) -> None:
    missing = [c for c in required if c not in columns]
    if missing:
        raise MissingColumns(f"missing columns: {missing}")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV: an empty-schema read touches the header only."""
    return spark.read.option("header", True).csv(path).columns


def read_panel(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> DataFrame:
    """Owned panel CSV: columns are asserted, rows must match the schema; NaN becomes NULL."""
    cols = header_of(spark, path)
    require_columns(cols, required)
    declared = {f.name: f for f in T.StructType.fromDDL(schema).fields}
    full = T.StructType([declared.get(c, T.StructField(c, T.StringType())) for c in cols])
    df = spark.read.schema(full).option("header", True).option("mode", "FAILFAST").option("nullValue", "").csv(path)
    doubles = [f.name for f in full.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in doubles})


def read_tracks(spark: SparkSession, path: str, numeric: Sequence[str], keep: Sequence[str], season: str = "SEASON") -> DataFrame:
    """Foreign track CSV: units row dropped, blanks are NULL, numbers coerced."""
    raw = spark.read.option("header", True).option("nullValue", " ").option("ignoreLeadingWhiteSpace", False).csv(path)
    cols = [c for c in keep if c in raw.columns]
    df = raw.select(*cols)
    df = df.withColumns({c: F.expr(f"try_cast(nullif(trim(`{c}`), '') AS double)") for c in numeric if c in cols})
    df = df.withColumn(season, F.expr(f"try_cast(`{season}` AS int)"))
    return df.where(F.col(season).isNotNull())


def read_with_provenance(spark: SparkSession, paths: Sequence[str] | str, schema: str) -> DataFrame:
    """Many files as one table, each row with the name of its file."""
    df = spark.read.schema(schema).option("header", True).csv(paths)
    return df.select("*", F.col("_metadata.file_path").alias("src_file"))


FEATURE_TYPE = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_features(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """Nested feature collections: one row per feature, named properties as columns."""
    doc = spark.read.schema(FEATURE_TYPE).option("multiLine", True).json(path)
    f = doc.select(F.explode("features").alias("f"))
    return f.select(*[F.col("f.properties")[p].alias(p) for p in properties], F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))
