"""Mixing sources to target weights: capped water-filling, seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import WORD, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2.0
SEED = "mix-1:"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size) with ``target``: the water level times the weight, at most epochs x size.

    Sources in code-point order, NULL last, take the weights in turn. In order of cap per
    weight, a source is capped while the level that the rest would share lies above its cap;
    the level at the first uncapped source is final, which is the fixed point of clamping and
    resharing. One row per source, so the global windows stay small.
    """
    turn = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    rank = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    filled = F.coalesce(F.sum("cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(rank.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.lit(float(share)) * F.col("total") - filled) / rest)
    s = s.withColumn("final", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(Window.partitionBy()))
    return s.select("source", "source_size", F.when(F.col("ratio") < F.col("level"), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, times, taken, and the columns named in ``keep``.

    Every document is taken floor(target / source_size) times. What is left of the target is
    taken once more from the source's documents in the order of a seeded hash, up to the
    document whose middle passes the rest, so a source misses its target by at most half a
    document. The running size is a prefix over 4,096 hash bins of the source plus an order
    inside one bin: no source, however large, is sorted whole. NULL texts and texts without
    words have size 0 and are taken 0 words. Repeated rows count as often as they occur.
    """
    rows = docs.select(
        F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"),
        "doc_id",
        F.col("source"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("draw"),
    ).withColumn("bin", F.substring("draw", 1, 3))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, epochs)
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0))).drop("bin_size")
    named = lambda d: d.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("unnamed", F.col("source").isNull()).drop("source")
    bins = named(bins).join(named(goal), ["name", "unnamed"])
    j = named(rows).join(bins, ["name", "unnamed", "bin"])
    inside = Window.partitionBy("name", "unnamed", "bin").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    j = j.withColumn("start", start).withColumn("whole", whole)
    more = F.col("start") + F.col("size") / 2.0 < F.col("target") - F.col("whole") * F.col("source_size")
    j = j.withColumn("times", F.col("whole") + F.when(more, 1).otherwise(0))
    return j.select("doc_id", "size", "source_size", "target", F.col("times").cast("long").alias("times"), (F.col("size") * F.col("times")).cast("long").alias("taken"), *(["kept"] if keep else []))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row as many times as the mix takes it, same columns."""
    m = mix_sources(docs, keep=docs.columns, **options).where("times > 0")
    return m.select(F.explode(F.array_repeat("kept", F.col("times").cast("int"))).alias("row")).select("row.*")


#: The same as SQL over ``documents``.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
              2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, cap / w AS ratio FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * total::BIGINT - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
              / (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM s2),
s4 AS (SELECT source, source_size,
              CASE WHEN ratio < level THEN cap ELSE max(CASE WHEN ratio >= level THEN level END) OVER () * w END AS target FROM s3),
j AS (SELECT d.doc_id, d.size, s4.source_size, s4.target,
             CASE WHEN s4.source_size > 0 THEN floor(s4.target / s4.source_size) ELSE 0 END AS whole,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN start + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j"""
