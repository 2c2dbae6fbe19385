"""Bottom-k sketches of shingle hashes: mergeable, estimating resemblance, containment and distinct count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import SPACES, whole_text

K = 128
WORDS = 5
HASH_BITS = 48
SPAN_BITS = 10


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """48-bit hashes of all runs of ``words`` words; a shorter text gives one hash of all its words, one without words none."""
    w = F.transform(F.filter(F.split(text, SPACES), lambda x: x != ""), lambda x: F.xxhash64(x))

    def of(h: Column) -> Column:
        run = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(words)]), 64 - HASH_BITS)
        short = F.array(F.shiftrightunsigned(F.xxhash64(F.lit(-1), h), 64 - HASH_BITS))
        return (
            F.when(F.size(h) >= words, F.transform(F.sequence(F.lit(0), F.size(h) - words), run))
            .when(F.size(h) > 0, short)
            .otherwise(F.array().cast("array<bigint>"))
        )

    return F.element_at(F.transform(F.array(w), of), 1)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k smallest distinct shingle hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the two parts' union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold; two empty sets are alike."""
    u = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(u, a), b))
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**HASH_BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds."""
    r = resemblance(a, b, k)
    common = r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """Twelve hex digits per hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0")), "")


def with_next(rows: DataFrame, k: int = K) -> DataFrame:
    """Rows (doc_id, text) with their sketch and the next row's text and sketch (after the last, the first's).

    NULL ids come last; rows of one id in the order of their text's hash. Ids are cut into
    spans of 1,024, so order is a window inside a span. Only each span's first row travels to
    the span before it; which span that is comes from two further levels of the same kind
    over the span numbers alone.
    """
    span = F.when(F.col("doc_id").isNull(), F.lit(2**62)).otherwise(F.shiftright(F.col("doc_id").cast("long"), SPAN_BITS))
    rows = rows.select("doc_id", "text", span.alias("span"), F.xxhash64("text").alias("tie"))
    order = Window.partitionBy("span").orderBy("doc_id", "tie")
    first = rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("span", "text")

    spans = rows.select("span").distinct().withColumn("upper", F.shiftright("span", SPAN_BITS))
    links = spans.withColumn("to", F.lead("span").over(Window.partitionBy("upper").orderBy("span")))
    heads = spans.groupBy("upper").agg(F.min("span").alias("head"))
    around = Window.orderBy("upper")
    start = F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("upper", F.coalesce(F.lead("head").over(around), start).alias("after"))
    links = links.join(heads, "upper").select(F.col("span").alias("from"), F.coalesce("to", "after").alias("span"))
    sent = first.join(links, "span").select(F.col("from").alias("span"), F.struct(F.col("text").alias("next_text"), sketch(F.col("text"), k).alias("next_sketch")).alias("beyond"))

    rows = rows.withColumn("sketch", sketch(F.col("text"), k))
    following = F.lead(F.struct(F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"))).over(order)
    out = rows.withColumn("following", following).join(sent, "span")
    return out.select("doc_id", "text", "sketch", F.coalesce("following", "beyond").alias("n")).select("doc_id", "text", "sketch", "n.*")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document: its sketch, and how near its edited text and the next document are.

    The edited text replaces the last quarter (rounded down) of the code points by the first
    as many of the next document by doc_id. NULL is the empty text, whose sketch is empty;
    two empty sketches have likeness 1, an empty and another 0. Rows of one doc_id follow
    each other in the order of their text's hash. Other columns are ignored.
    """
    t = docs.select("doc_id", whole_text().alias("text"))
    rows = with_next(t, k)
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - q), F.substring(F.col("next_text"), F.lit(1), q))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_distinct"),
    )
