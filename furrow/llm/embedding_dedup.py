"""Near-duplicate vectors by collision counting over many sorted one-dimensional projections.

Unit vectors at distance d differ by d times a standard normal along a random direction. Each
vector has ``tables`` projections; in a table, vectors of one cell are sorted by the projection
and a window of fixed half width is laid around each of them in turn: what falls inside collides
with it. The collisions of a pair are counted over all tables, and pairs that reach the count
that a pair just at the threshold misses with probability ``MISS`` are verified on the vectors.

A single projection separates too little: the share of unrelated vectors inside a window does
not fall as the data grow. A table's lists are therefore kept per cell, the joint interval of
``depth`` further projections, and depth follows the largest label so that an unrelated vector
seldom meets another (``calibrated``). Each pair is decided in the first table in which it
collides, so no pair is shuffled; cells beyond ``BLOCK`` vectors are compared block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import short_batches, written
from furrow.llm.near_dedup import components
from furrow.llm.words import mix

COSINE = 0.98
#: A cosine this near to the threshold may lie on its other side by rounding.
ROUNDED = 1e-12
MISS = 1e-4
SEED = 42
BLOCK = 2_000
PAIRS = 200_000
#: Interval of a cell and half width of a window, in distances of a pair at the threshold.
CELL, WINDOW = 10.0, 2.0
#: Collisions to expect of a pair at the threshold; unrelated vectors to expect in a cell.
EXPECTED, STRANGERS = 16.0, 0.25
_STEP = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Plan:
    depth: int
    tables: int
    count: int
    cell: float
    window: float


def _shared(ratio: float) -> float:
    """Probability that an interval of ``ratio`` standard deviations, at a random place, holds both ends of a normal difference."""
    return math.erf(ratio / math.sqrt(2)) - math.sqrt(2 / math.pi) / ratio * (1 - math.exp(-ratio * ratio / 2))


def calibrated(most: int, cosine: float = COSINE, miss: float = MISS) -> Plan:
    """Depth, tables and count for labels of at most ``most`` different vectors."""
    near, far = math.sqrt(2 * (1 - cosine)), math.sqrt(2)
    cell, window = CELL * near, WINDOW * near
    depth = max(1, math.ceil(math.log(max(most, 2) / STRANGERS) / -math.log(_shared(cell / far))))
    p = _shared(CELL) ** depth * math.erf(WINDOW / math.sqrt(2))
    tables = math.ceil(EXPECTED / p)
    below, term, count = 0.0, (1 - p) ** tables, 0
    while below + term <= miss:
        below += term
        term *= (tables - count) / (count + 1) * p / (1 - p)
        count += 1
    return Plan(depth, tables, max(count, 1), cell, window)


def directions(dim: int, plan: Plan, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Normal directions, a window's and a cell's for each table, and where the cells' intervals begin."""
    r = np.random.default_rng([seed, dim])
    return r.standard_normal((dim, plan.tables * (plan.depth + 1))), r.random((plan.tables, plan.depth))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def reaches(a: np.ndarray, b: np.ndarray, cosine: float) -> bool:
    """Whether the cosine of two vectors is at least the given one, without rounding."""
    a, b = ([Fraction(x) for x in v.tolist()] for v in (a, b))
    dot, least = sum(x * y for x, y in zip(a, b)), Fraction(cosine)
    return dot * abs(dot) >= least * abs(least) * sum(x * x for x in a) * sum(x * x for x in b)


def usable(v: Column) -> Column:
    """A vector without NULL or non-finite components and not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False), off


def projected(classes: DataFrame, plan: Plan, seed: int = SEED) -> DataFrame:
    """cid, cells (a 32-bit code per table) and places (the projection per table) of (cid, vector)."""
    short_batches(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            values, off = _lists(b.column(1))
            size = np.diff(off)
            cells, places = np.zeros((b.num_rows, plan.tables), np.int32), np.zeros((b.num_rows, plan.tables), np.float32)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                if dim not in known:
                    known[dim] = directions(int(dim), plan, seed)
                way, begin = known[dim]
                p = (unit(values[off[at][:, None] + np.arange(dim)].astype(float)) @ way).reshape(len(at), plan.tables, plan.depth + 1)
                places[at] = p[:, :, 0]
                code = np.full((len(at), plan.tables), 1, np.uint64)
                for k in range(plan.depth):
                    code = mix(code * _STEP + np.floor(p[:, :, k + 1] / plan.cell + begin[:, k]).astype(np.int64).view(np.uint64))
                cells[at] = (code >> np.uint64(32)).astype(np.uint32).view(np.int32)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * plan.tables)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))) for x in (cells, places)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["cid", "cells", "places"])

    return classes.select("cid", "vector").mapInArrow(run, "cid long, cells array<int>, places array<float>")


def window_pairs(left: np.ndarray, right: np.ndarray, half: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, other) with the other inside the query's window, some queries at a time."""
    order = np.argsort(right, kind="stable")
    line = right[order]
    first, last = np.searchsorted(line, left - half, "left"), np.searchsorted(line, left + half, "right")
    count = last - first
    total = np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(left):
        z = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
        n = count[a:z]
        query = np.repeat(np.arange(a, z), n)
        yield query, order[np.arange(len(query)) - np.repeat(total[a:z] - total[a], n) + np.repeat(first[a:z], n)]
        a = z


def links_of(part: pa.Table, plan: Plan, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links decided in one block: pairs (left, right) of row numbers of ``part``.

    The first table of all in which a pair collides decides it, and no other.
    """
    table, own, i, j = (part.column(c)[0].as_py() if c != "own" else part.column(c).to_numpy() for c in ("table", "own", "i", "j"))
    n = part.num_rows
    cells = part.column("cells").combine_chunks().values.to_numpy().reshape(n, -1)
    places = part.column("places").combine_chunks().values.to_numpy().reshape(n, -1)
    ids, group = (part.column(c).to_numpy() for c in ("cid", "grp"))
    raw = part.column("vector").combine_chunks().values.to_numpy().reshape(n, -1).astype(float)
    vector = unit(raw)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    out = []
    for x, y in window_pairs(places[left, table], places[right, table], np.float32(plan.window)):
        x, y = left[x], right[y]
        ok = (group[x] == group[y]) & ((ids[x] < ids[y]) if i == j else (ids[x] != ids[y]))
        x, y = x[ok], y[ok]
        hit = (cells[x] == cells[y]) & (np.abs(places[x] - places[y]) <= np.float32(plan.window))
        ok = hit[:, table] & ~hit[:, :table].any(axis=1) & (hit.sum(axis=1) >= plan.count)
        x, y = x[ok], y[ok]
        cos = np.einsum("ij,ij->i", vector[x], vector[y])
        ok = cos >= cosine
        for k in np.flatnonzero(np.abs(cos - cosine) < ROUNDED):
            ok[k] = reaches(raw[x[k]], raw[y[k]], cosine)
        out.append((x[ok], y[ok]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def spanning(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows, the least row that the links reach."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def decided(rows: DataFrame, plan: Plan, cosine: float) -> DataFrame:
    """(a, b, n): with b NULL, n more vectors linked to class a; else an edge of what the links join."""

    def one(t: pa.Table) -> pa.RecordBatch:
        ids, mult = t.column("cid").to_numpy(), t.column("n").to_numpy()
        x, y = links_of(t, plan, cosine)
        more = np.zeros(t.num_rows, np.int64)
        np.add.at(more, x, mult[y])
        np.add.at(more, y, mult[x])
        at, low = np.flatnonzero(more), spanning(t.num_rows, x, y)
        joins = np.flatnonzero(low != np.arange(len(low)))
        a = np.concatenate([ids[at], ids[joins]])
        b = pa.array(np.concatenate([np.zeros(len(at), np.int64), ids[low[joins]]]), mask=np.arange(len(a)) < len(at))
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([more[at], np.zeros(len(joins), np.int64)]))], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            k = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in k], axis=0)) + 1
            for s, e in zip([0, *new[:-1]], new):
                yield one(t.slice(s, e - s))
            held = t.slice(new[-1]) if len(new) else t  # the last block may go on in the next batch
        if held is not None and held.num_rows:
            yield one(held)

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cid")
    return dealt.mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, seed: int = SEED) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked with it), component_id, kept.

    Only vectors of equal, non-NULL labels and equal length are compared. NULL and zero vectors,
    and those with NULL or non-finite components, link with nothing and are components of their
    own. Equal vectors of a label are one class: always linked, compared once. Rows that repeat
    a vec_id are vectors of their own; a NULL vec_id never names a component while another id is
    reached. Classes are told apart by 64-bit hashes. Other columns are ignored.
    """
    good = F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = vectors.select("vec_id", "label", "embedding", F.when(good, F.xxhash64("label", "embedding")).alias("cid"))
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(
        F.first("embedding").alias("vector"), F.xxhash64(F.first("label"), F.size(F.first("embedding"))).alias("grp"),
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"),
    )
    classes = written(classes, "vector-classes")
    most = classes.groupBy("grp").count().agg(F.max("count")).first()[0]
    plan = calibrated(most or 1, cosine)
    codes = written(projected(classes, plan, seed), "vector-cells")

    spread = codes.join(classes.select("cid", "grp"), "cid").select("cid", "grp", F.posexplode("cells").alias("table", "cell"))
    spread = spread.select("cid", "table", F.xxhash64("grp", "table", "cell").alias("key"))
    crowd = spread.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    crowd = crowd.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    met = spread.join(crowd, "key").withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cid", "table", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = met.join(classes.select("cid", "grp", "n", "vector"), "cid").join(codes, "cid")
    found = written(decided(full.select("key", "i", "j", "table", "own", "cid", "grp", "n", "vector", "cells", "places"), plan, cosine), "vector-links")

    edges = found.where("b IS NOT NULL").select("a", "b").distinct()
    comp = components(edges).withColumnRenamed("id", "cid")
    more = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("more"))
    known = classes.select("cid", "n", "low").join(more, "cid", "left").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    known = written(known, "vector-known")
    least = known.groupBy("comp").agg(F.min("low").alias("component"))
    known = known.join(least, "comp").select("cid", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), "component")
    out = rows.select("vec_id", "cid").join(known, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: All pairs of a label, exactly; for small tables with unique ids.
SQL = f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT reach.id, p.b FROM reach JOIN p ON reach.r = p.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""
