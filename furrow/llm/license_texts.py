"""Whole licence texts and their usual notices: Dice over word bigrams against runs of consecutive units.

A run is any number of consecutive sentences or lines, so a licence is found however its lines
are broken and whatever stands before and after it. Size bounds prune twice: a text is looked at
run by run only if it holds as many of a template's bigrams as the coefficient needs, and a run
has at most as many words as a run of all different bigrams could have. Texts that hold no
candidate, nearly all, pass through one projection; the bigrams of the others are joined with
the run starts of their own text, bucketed by the longest run.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import whole_text, written
from furrow.llm.licenses import LEAST, OTHER, UNIT_END, bounds, normal_words

FOLDER = Path(__file__).with_name("license_files")
FOUND = "array<struct<worse: double, k: int, start: int, stop: int>>"


def templates() -> list[tuple[str, str]]:
    """(licence, text) of every file; ``mit.txt`` is a whole text, ``gpl-3.0.notice.txt`` a notice."""
    return [(p.name.removesuffix(".txt").removesuffix(".notice"), p.read_text()) for p in sorted(FOLDER.glob("*.txt"))]


def bigram(a: str, b: str) -> int:
    """``xxhash64(a, b)`` of two words."""
    h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def longest(n_words: int, least: float) -> int:
    """Words of the longest run compared with a template of ``n_words``."""
    return bounds(n_words, least)[1]


def _longs(values: Sequence[int]) -> Column:
    """An array constant; one literal however many values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _grams(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))


def best_runs(texts: DataFrame, known: Sequence[tuple[list[str], list[int]]], least: float) -> DataFrame:
    """(text, k, worse, start, stop): the best run of each text and candidate template.

    ``texts`` has a key ``text``, the words of its ``units`` and its candidates ``ks``; ``known``
    the words and bigrams of each template. A run starts with a unit that holds one of the
    template's bigrams and has at most ``longest`` words. Of equal coefficients (``worse`` is
    the coefficient's negative) the first start counts, then the first end.
    """
    info = [F.struct(F.lit(k).alias("k"), F.lit(longest(len(w), least)).alias("most"), F.lit(len(own)).alias("n_own"), F.lit(bounds(len(own), least)[0]).alias("low"), F.lit(bounds(len(own), least)[1]).alias("high")) for k, (w, own) in enumerate(known)]
    owned = [F.struct(F.lit(k).alias("k"), _longs(own).alias("own")) for k, (_, own) in enumerate(known)]
    one = texts.sparkSession.range(1)
    own = one.select(F.explode(F.array(*owned)).alias("t")).select("t.k", F.explode("t.own").alias("h"), F.lit(1).alias("hit"))
    info = one.select(F.explode(F.array(*info)).alias("t")).select("t.*")

    ends = F.aggregate("units", F.array(F.lit(0)), lambda a, u: F.concat(a, F.array(F.element_at(a, -1) + F.size(u))))
    place = texts.select("text", "ks", F.flatten("units").alias("w"), ends.alias("ends"), F.flatten(F.transform("units", lambda u, i: F.array_repeat(i, F.size(u)))).alias("of"))
    at = place.select("text", "ks", "ends", "of", F.posexplode(_grams(F.col("w"))).alias("pos", "h"))
    first = F.get("of", F.col("pos"))
    at = at.select("text", "ks", "h", "pos", first.alias("unit"), F.get("ends", first).alias("start"), F.get("ends", F.get("of", F.col("pos") + 1) + 1).alias("stop"))
    at = at.withColumn("before", F.lag("pos").over(Window.partitionBy("text", "h").orderBy("pos")))
    at = written(at.withColumn("k", F.explode("ks")).drop("ks").join(F.broadcast(info), "k").join(F.broadcast(own), ["k", "h"], "left"), "license-bigrams")

    bucket = F.floor(F.col("pos") / F.col("most"))
    starts = at.where("hit = 1").select("text", "k", F.col("start").alias("s"), "most").distinct()
    starts = starts.select("text", "k", "s", F.explode(F.array(F.floor(F.col("s") / F.col("most")), F.floor(F.col("s") / F.col("most")) + 1)).alias("bucket"))
    met = at.withColumn("bucket", bucket).join(starts, ["text", "k", "bucket"]).where("pos >= s AND stop <= s + most AND (before IS NULL OR before < s)")
    # a bigram counts once in a run, where it first occurs after the start
    new = met.groupBy("text", "k", "s", "stop").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("c"), *[F.first(c).alias(c) for c in ("n_own", "low", "high")])
    upto = Window.partitionBy("text", "k", "s").orderBy("stop").rowsBetween(Window.unboundedPreceding, 0)
    runs = new.select("text", "k", "s", "stop", "n_own", "low", "high", F.sum("n").over(upto).alias("n"), F.sum("c").over(upto).alias("c")).where("n BETWEEN low AND high")
    dice = 2.0 * F.col("c") / (F.col("n") + F.col("n_own"))
    best = runs.groupBy("text", "k").agg(F.min(F.struct((-dice).alias("worse"), F.col("s").alias("start"), "stop")).alias("best"))
    return best.select("text", "k", "best.*").where(F.col("worse") <= -least)


def scan_license_texts(docs: DataFrame, known: Sequence[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, n_matches, licenses, best.

    Of each template the best run counts, from ``least`` up; of runs that overlap, the one of
    larger coefficient, then the first template. ``licenses`` lists the licences by name. NULL
    and empty texts match nothing; equal texts match alike and are compared once; repeated ids
    keep a row each; long texts are read whole. Other columns are ignored.
    """
    kept = [(name, w, sorted({bigram(*p) for p in zip(w, w[1:])})) for name, t in (templates() if known is None else known) if len(w := normal_words(t)) > 1]
    flat = F.regexp_replace(F.lower(F.regexp_replace("text", UNIT_END, "\n")), OTHER, " ")
    units = F.filter(F.transform(F.split(flat, "\n"), lambda u: F.filter(F.split(u, " "), lambda w: w != "")), lambda u: F.size(u) > 0)
    need = [bounds(len(own), least)[0] for _, _, own in kept]
    rows = docs.select("doc_id", whole_text().alias("text"))
    texts = rows.select(F.sha2("text", 256).alias("key"), units.alias("units"))
    words = F.flatten("units")
    texts = texts.select("key", "units", words.alias("w")).select("key", "units", F.when(F.size("w") > 1, F.array_distinct(_grams(F.col("w")))).otherwise(F.array().cast("array<bigint>")).alias("b"))
    # of a text with fewer bigrams than a template needs none is looked up
    hits = [F.when(F.size("b") >= n, F.when(F.size(F.array_intersect("b", _longs(own))) >= n, F.lit(k))) for k, ((_, _, own), n) in enumerate(zip(kept, need))]
    texts = texts.select("key", "units", F.array_compact(F.array(*hits)).alias("ks"))
    # written before it is filtered: a filter would be pushed below and repeat the projections
    texts = written(texts.select(F.col("key").alias("text"), F.when(F.size("ks") > 0, F.col("units")).alias("units"), "ks"), "license-candidates")
    texts = texts.where("units IS NOT NULL").groupBy("text").agg(F.first("units").alias("units"), F.first("ks").alias("ks"))
    runs = best_runs(texts, [(w, own) for _, w, own in kept], least)

    def add(taken: Column, f: Column) -> Column:
        apart = F.forall(taken, lambda o: (f["stop"] <= o["start"]) | (o["stop"] <= f["start"]))
        return F.when(apart, F.concat(taken, F.array(f))).otherwise(taken)

    found = runs.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("worse", "k", "start", "stop"))).cast(FOUND).alias("all"))  # a template each at most
    found = found.select(F.col("text").alias("key"), F.aggregate("all", F.array().cast(FOUND), add).alias("own"))
    found = written(found, "license-found")  # of known size: small, it is sent, and rows of one text stay where they are
    names = F.transform("own", lambda f: F.get(F.array(*[F.lit(name) for name, _, _ in kept]), f["k"]))
    out = rows.select("doc_id", F.sha2("text", 256).alias("key")).join(found, "key", "left")
    return out.select(
        "doc_id",
        F.when(F.col("own").isNull(), 0).otherwise(F.size("own")).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(F.sort_array(F.array_distinct(names)), ","), F.lit("")).alias("licenses"),
        F.coalesce(-F.array_min(F.col("own.worse")), F.lit(0.0)).alias("best"),
    )


def sql(known: Sequence[tuple[str, str]] | None = None, least: float = LEAST) -> str:
    """DuckDB SQL for the rows of ``scan_license_texts`` over ``documents``."""
    kept = [(name, w, len(set(zip(w, w[1:])))) for name, t in (templates() if known is None else known) if len(w := normal_words(t)) > 1]
    rows = ", ".join(f"({k}, '{name}', '{' '.join(w)}', {n}, {bounds(n, least)[0]}, {bounds(n, least)[1]}, {longest(len(w), least)})" for k, (name, w, n) in enumerate(kept))
    return f"""
WITH RECURSIVE t0(k, name, body, n_own, low, high, most) AS (VALUES {rows}),
t AS (SELECT *, string_split(body, ' ') AS w FROM t0),
own AS (SELECT k, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM t),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT text, row_number() OVER () AS id FROM (SELECT DISTINCT text FROM d)),
u0 AS (SELECT id, string_split(regexp_replace(lower(regexp_replace(text, '{UNIT_END}', chr(10), 'g')), '{OTHER}', ' ', 'g'), chr(10)) AS us FROM x),
u1 AS (SELECT id, list_filter(list_transform(us, lambda u: list_filter(string_split(u, ' '), lambda v: v <> '')), lambda u: len(u) > 0) AS us FROM u0),
u2 AS (SELECT id, unnest(us) AS u, generate_subscripts(us, 1) AS n FROM u1),
u AS (SELECT id, u, sum(len(u)) OVER (PARTITION BY id ORDER BY n) AS stop FROM u2),
w AS (SELECT id, stop, stop - len(u) AS start, unnest(u) AS word, stop - len(u) + generate_subscripts(u, 1) - 1 AS pos FROM u),
g0 AS (SELECT id, pos, start, word || ' ' || lead(word) OVER o AS g, lead(stop) OVER o AS stop FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT *, lag(pos) OVER (PARTITION BY id, g ORDER BY pos) AS before FROM g0 WHERE g IS NOT NULL),
c AS (SELECT id, k FROM g JOIN own USING (g) JOIN t USING (k) WHERE before IS NULL GROUP BY id, k, low HAVING count(*) >= low),
a AS (SELECT g.id, c.k, g.pos, g.start, g.stop, g.before, own.g IS NOT NULL AS hit FROM g JOIN c USING (id) LEFT JOIN own ON own.k = c.k AND own.g = g.g),
s AS (SELECT DISTINCT id, k, start AS s FROM a WHERE hit),
m AS (SELECT s.id, s.k, s.s, a.stop, count(*) AS n, count(*) FILTER (WHERE hit) AS c FROM s JOIN t USING (k) JOIN a ON a.id = s.id AND a.k = s.k AND a.pos >= s.s AND a.stop <= s.s + most AND (a.before IS NULL OR a.before < s.s) GROUP BY ALL),
r0 AS (SELECT id, k, s, stop, sum(n) OVER o AS n, sum(c) OVER o AS c FROM m WINDOW o AS (PARTITION BY id, k, s ORDER BY stop)),
r1 AS (SELECT id, k, s, stop, 2.0::DOUBLE * c / (n + n_own) AS dice FROM r0 JOIN t USING (k) WHERE n BETWEEN low AND high),
r2 AS (SELECT * FROM r1 WHERE dice >= {least} QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY dice DESC, s, stop) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dice DESC, k) AS rank FROM r2),
f(id, rank, took) AS (
  SELECT id, rank, [{{'s': s, 'stop': stop, 'k': k, 'dice': dice}}] FROM r WHERE rank = 1
  UNION ALL
  SELECT r.id, r.rank, CASE WHEN len(list_filter(took, lambda o: o.s < r.stop AND r.s < o.stop)) = 0 THEN list_append(took, {{'s': r.s, 'stop': r.stop, 'k': r.k, 'dice': r.dice}}) ELSE took END
  FROM f JOIN r ON r.id = f.id AND r.rank = f.rank + 1),
e AS (SELECT id, unnest(arg_max(took, rank)) AS o FROM f GROUP BY id),
b AS (SELECT text, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(o.dice) AS best FROM e JOIN t ON t.k = e.o.k JOIN x USING (id) GROUP BY text)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(names, '') AS licenses, coalesce(best, 0.0::DOUBLE) AS best FROM d LEFT JOIN b USING (text)"""
