"""Citations found in texts, resolved against a catalogue of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def citations(docs: DataFrame, doc_id: str, text: str, pattern: str) -> DataFrame:
    """One row per match of the whole text: (doc, position in the match list, target)."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))
    return docs.select(doc_id, F.posexplode(found).alias("pos", "target"))


def forward_counts(cites: DataFrame, catalogue: DataFrame, doc_id: str) -> DataFrame:
    """Mentions of every catalogue entry; entries never cited count zero."""
    # counted per target before the join, so a popular target moves one row
    c = cites.groupBy("target").agg(F.count(F.lit(1)).alias("n_mentions"), F.min(doc_id).alias("first_doc"))
    return catalogue.join(c, "target", "left").withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0)))


def unresolved(cites: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Cited targets without an entry, with their number of mentions."""
    c = cites.groupBy("target").agg(F.count(F.lit(1)).alias("n_mentions"))
    return c.join(catalogue.select("target"), "target", "left_anti")


def run_difference(previous: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """Findings that are new, fixed or carried between two runs, by canonical key."""

    def keyed(df: DataFrame, flag: str) -> DataFrame:
        return df.select(F.to_json(F.struct(*sorted(fields))).alias("key"), F.lit(1).alias(flag)).distinct()

    j = keyed(previous, "p").join(keyed(current, "c"), "key", "full")
    state = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "fixed").otherwise("carried")
    return j.select("key", state.alias("state"))
