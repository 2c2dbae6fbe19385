"""Views that give the driver tables the shapes the operators work on.

Each view exists twice: as a DataFrame and as the text of a common table
expression for the SQL the result is checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow.functions.scalar import rnd  # noqa: F401  (re-exported for the plans)
from furrow.session import cut_lineage

GRID_WIDTH = 15
#: First day of the season and days per period; a period is a span of days since then, in any month or year.
SEASON_START = "2024-01-01"
PERIOD_DAYS = 3
BANDS = {"view": "b8", "click": "b4", "purchase": "b3", "error": "b11", "signup": "vh"}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is inferred on first use only."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# --- pixel observations from the event table -----------------------------------

def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observation: pixel (x,y), acquisition time, band and flag bits."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "ts",
        F.to_date("ts").alias("d"),
        "user_id",
        (F.col("user_id") % GRID_WIDTH).alias("x"),
        F.floor(F.col("user_id") / GRID_WIDTH).cast("long").alias("y"),
        "event_type",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        F.floor(F.datediff(F.to_date("ts"), F.lit(SEASON_START).cast("date")) / PERIOD_DAYS).cast("int").alias("p"),
    )


OBS = f"""obs AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS d, user_id, user_id % {GRID_WIDTH} AS x, user_id // {GRID_WIDTH} AS y,
         event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CAST(floor(date_diff('day', DATE '{SEASON_START}', CAST(ts AS DATE)) / {PERIOD_DAYS}.0) AS INTEGER) AS p
  FROM events),
gr AS (SELECT CAST(unnest(range(min(p), max(p) + 1)) AS INTEGER) AS p FROM obs)"""

_PERIODS: dict[str, list[int]] = {}


def periods(spark: SparkSession, sf_dir: str) -> list[int]:
    """All periods between the first and the last observation: the grid that series are laid out on."""
    if sf_dir not in _PERIODS:
        r = obs(spark, sf_dir).agg(F.min("p").alias("lo"), F.max("p").alias("hi")).first()
        _PERIODS[sf_dir] = list(range(r.lo, r.hi + 1)) if r.lo is not None else []
    return _PERIODS[sf_dir]


def band_mean(name: str):
    return F.avg(F.when(F.col("event_type") == name, F.col("value")))


def stack(o: DataFrame, keys: list[str]) -> DataFrame:
    """Bands of one pixel and date side by side, NULL where not observed."""
    return o.groupBy(*keys).agg(*[band_mean(e).alias(b) for e, b in BANDS.items()])


def stack_sql(keys: str) -> str:
    cols = ", ".join(f"avg(CASE WHEN event_type = '{e}' THEN value END) AS {b}" for e, b in BANDS.items())
    return f"stack AS (SELECT {keys}, {cols} FROM obs GROUP BY {keys})"


# --- pixel series ---------------------------------------------------------------

def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit x period mean, scaled by the unit's own maximum, gaps as rows."""
    s = obs(spark, sf_dir).groupBy("user_id", "p").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    top = s.groupBy("user_id").agg(F.max("m").alias("mx"))
    grid = top.withColumn("p", F.explode(F.array(*[F.lit(i) for i in periods(spark, sf_dir)])))
    return grid.join(s, ["user_id", "p"], "left").select(
        "user_id", "p", F.try_divide("m", "mx").alias("v"), F.coalesce("n", F.lit(0)).alias("n")
    )


SERIES = """s0 AS (SELECT user_id, p, avg(value) AS m, count(*) AS n FROM obs GROUP BY 1, 2),
top AS (SELECT user_id, max(m) AS mx FROM s0 GROUP BY 1),
series AS (SELECT t.user_id, g.p, s0.m / t.mx AS v, coalesce(s0.n, 0) AS n
  FROM top t CROSS JOIN gr g LEFT JOIN s0 ON s0.user_id = t.user_id AND s0.p = g.p)"""


# --- unit x year panels from the order tables ------------------------------------

#: Years that reports with a column per year show, and that a panel may hold.
YEARS = list(range(1995, 2002))
POST = [1997, 1998, 1999]
_YEARS: dict[str, dict[int, int]] = {}


def years(spark: SparkSession, sf_dir: str, complete: bool = False) -> list[int]:
    """The years of the orders; ``complete`` leaves those that have orders in all twelve months."""
    if sf_dir not in _YEARS:
        o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count_distinct(F.month("o_orderdate")).alias("months"))
        _YEARS[sf_dir] = {r.y: r.months for r in o.collect() if r.y is not None}  # a row per year
    return sorted(y for y, months in _YEARS[sf_dir].items() if months == 12 or not complete)


def orders_located(spark: SparkSession, sf_dir: str, complete: bool = False) -> DataFrame:
    """Orders with customer, nation and region keys; ``complete`` leaves the complete years."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    if complete:
        o = o.where(F.col("year").isin(years(spark, sf_dir, True)))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


LOCATED = """loc AS (
  SELECT o.*, c.*, n.n_nationkey, n.n_regionkey, n.n_name, CAST(year(o_orderdate) AS INTEGER) AS year
  FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey),
cy AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders GROUP BY 1 HAVING count(DISTINCT month(o_orderdate)) = 12)"""


def complete_sql(panel: str) -> str:
    """The same panel over the complete years."""
    return panel.replace("FROM loc GROUP BY", "FROM loc WHERE year IN (SELECT year FROM cy) GROUP BY")


def complete(panel_of):
    """The same panel over the complete years."""
    return lambda s, d: panel_of(s, d, True)


def nation_panel(spark: SparkSession, sf_dir: str, complete: bool = False) -> DataFrame:
    """nation x year mean price; nations of regions 0 and 1 are the treated units."""
    return (
        orders_located(spark, sf_dir, complete)
        .groupBy(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"), "year")
        .agg(
            F.avg("o_totalprice").alias("y"),
            F.count(F.lit(1)).alias("n"),
            F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("share"),
        )
        .withColumn("treat", (F.col("region") <= 1).cast("int"))
        .withColumn("post", F.col("year").isin(POST).cast("int"))
    )


NATION_PANEL = (
    LOCATED
    + """,
panel AS (
  SELECT n_nationkey AS unit, n_regionkey AS region, year, avg(o_totalprice) AS y, count(*) AS n,
         avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share,
         CASE WHEN n_regionkey <= 1 THEN 1 ELSE 0 END AS treat,
         CASE WHEN year IN (1997, 1998, 1999) THEN 1 ELSE 0 END AS post
  FROM loc GROUP BY 1, 2, 3)"""
)

METRICS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
DELTA = {"p25": 1400.0, "p50": 700.0, "p75": 2100.0}


def long_panel(spark: SparkSession, sf_dir: str, complete: bool = False) -> DataFrame:
    """product (raw/corrected) x metric (price quantile) x nation x year."""
    from furrow.functions.ranking import grouped_stats
    from furrow.operators.panel import unpivot_metrics

    loc = orders_located(spark, sf_dir, complete).select(
        F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"), "year", "o_totalprice", "o_orderstatus"
    )
    stats = grouped_stats(
        loc, ["unit", "region", "year"], "o_totalprice", METRICS,
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("share"),
    )
    long = unpivot_metrics(stats, ["unit", "region", "year", "n", "share"], list(METRICS), "metric", "raw")
    delta = F.create_map(*[F.lit(z) for kv in DELTA.items() for z in kv])
    hit = (F.col("region") <= 1) & F.col("year").isin(POST) & (F.col("share") >= 0.001)
    long = long.withColumn("corrected", F.when(hit, F.col("raw") - F.col("share") * delta[F.col("metric")]).otherwise(F.col("raw")))
    out = unpivot_metrics(long, ["unit", "region", "year", "n", "share", "metric"], ["raw", "corrected"], "product", "y")
    return out.withColumn("treat", (F.col("region") <= 1).cast("int")).withColumn("post", F.col("year").isin(POST).cast("int"))


LONG_PANEL = (
    LOCATED
    + """,
q AS (SELECT n_nationkey AS unit, n_regionkey AS region, year, count(*) AS n,
        avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share,
        quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75
      FROM loc GROUP BY 1, 2, 3),
m AS (SELECT unit, region, year, n, share, 'p25' AS metric, p25 AS raw, 1400.0 AS delta FROM q
      UNION ALL SELECT unit, region, year, n, share, 'p50', p50, 700.0 FROM q
      UNION ALL SELECT unit, region, year, n, share, 'p75', p75, 2100.0 FROM q),
lp AS (SELECT unit, region, year, n, share, metric, 'raw' AS product, raw AS y FROM m
       UNION ALL
       SELECT unit, region, year, n, share, metric, 'corrected',
         CASE WHEN region <= 1 AND year IN (1997, 1998, 1999) AND share >= 0.001 THEN raw - share * delta ELSE raw END FROM m),
long AS (SELECT *, CASE WHEN region <= 1 THEN 1 ELSE 0 END AS treat,
         CASE WHEN year IN (1997, 1998, 1999) THEN 1 ELSE 0 END AS post FROM lp)"""
)


def stored(panel_of, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel written once: estimators read it several times, the observations once."""
    return cut_lineage(panel_of(spark, sf_dir))


def tier_panel(spark: SparkSession, sf_dir: str, complete: bool = False) -> DataFrame:
    """Ten units (region x balance tier) x year: few clusters, exact enumeration."""
    return (
        orders_located(spark, sf_dir, complete)
        .withColumn("unit", (F.col("n_regionkey") * 2 + (F.col("c_acctbal") >= 5000).cast("int")).cast("int"))
        .groupBy("unit", "year")
        .agg(F.avg("o_totalprice").alias("y"), F.count(F.lit(1)).alias("n"))
        .withColumn("treat", (F.col("unit") < 5).cast("int"))
        .withColumn("post", F.col("year").isin(POST).cast("int"))
    )


TIER_PANEL = (
    LOCATED
    + """,
panel AS (
  SELECT CAST(n_regionkey * 2 + CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END AS INTEGER) AS unit, year,
         avg(o_totalprice) AS y, count(*) AS n,
         CASE WHEN n_regionkey * 2 + CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END < 5 THEN 1 ELSE 0 END AS treat,
         CASE WHEN year IN (1997, 1998, 1999) THEN 1 ELSE 0 END AS post
  FROM loc GROUP BY 1, 2, 5, 6)"""
)
