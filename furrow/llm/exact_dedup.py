"""Exact deduplication: binary-fuse filters per snapshot, exact buckets, byte checks.

A snapshot is immutable, so each of its buckets gets a static filter once. A new batch is
grouped by digest first (copies inside the batch meet in a map-side combined aggregate, so
no group of copies reaches one task whole). Its distinct digests then pass the filters:
what no filter claims is new, the rest joins the snapshot's exact digests and is confirmed
on the normalised texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import SPACES, remainder, whole_text, written

BUCKET_KEYS = 32_768
_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    h = x + _U(seed)
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class BinaryFuse:
    """A 3-wise binary fuse filter with 16-bit fingerprints: no false negatives, 1 in 65,536 false positives.

    The three places of a key lie in consecutive segments; the filter is solved by peeling
    off, again and again, places that only one key is left on.
    """

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray):
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        start = ((h >> _U(32)) * _U(count)) >> _U(32)
        low = _mix(h, 1)
        at = [((start + _U(i)) * _U(segment) + ((low >> _U(20 * i)) & _U(segment - 1))).astype(np.int64) for i in range(3)]
        return np.stack(at), (h & _U(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, _U))
        n = len(keys)
        segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 4)))) + 3 * segment
        count = max(1, -(-size // segment) - 2)
        for seed in range(1, 1000):
            at, mark = cls._places(keys, seed, segment, count)
            m = (count + 2) * segment
            order = cls._peel(at, m)
            if order is None:
                continue
            cells = np.zeros(m, np.uint16)
            a, b, c = at.tolist()
            marks, out = mark.tolist(), [0] * m
            for k, own in reversed(order):
                x, y, z = a[k], b[k], c[k]
                out[own] = marks[k] ^ out[x] ^ out[y] ^ out[z]
            cells[:] = out
            return cls(seed, segment, count, cells)
        raise RuntimeError("no seed solves this filter")

    @staticmethod
    def _peel(at: np.ndarray, m: int) -> list[tuple[int, int]] | None:
        """Keys with the place each is alone on, in peeling order; None if some never get free."""
        n = at.shape[1]
        held = np.bincount(at.ravel(), minlength=m)
        sums = np.zeros(m, np.int64)
        np.bitwise_xor.at(sums, at.ravel(), np.tile(np.arange(n), 3))
        free = np.flatnonzero(held == 1).tolist()
        held, sums = held.tolist(), sums.tolist()
        places = at.T.tolist()
        order = []
        while free:
            p = free.pop()
            if held[p] != 1:
                continue
            k = sums[p]
            order.append((k, p))
            for q in places[k]:
                held[q] -= 1
                sums[q] ^= k
                if held[q] == 1:
                    free.append(q)
        return order if len(order) == n else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, mark = self._places(np.asarray(keys, _U), self.seed, self.segment, self.count)
        c = self.cells
        return (c[at[0]] ^ c[at[1]] ^ c[at[2]]) == mark

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], np.int64).tobytes() + self.cells.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> BinaryFuse:
        return cls(*np.frombuffer(raw, np.int64, 3).tolist(), np.frombuffer(raw, np.uint16, offset=24))


def _digests(docs: DataFrame) -> DataFrame:
    t = whole_text()
    return docs.select("doc_id", F.sha2(F.regexp_replace(t, SPACES, ""), 256).alias("digest"), F.length(t).cast("long").alias("n"))


def _best():
    """Order of survival inside a group: most code points, then smallest id, NULL ids last."""
    return F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"))


def _groups(d: DataFrame) -> DataFrame:
    key = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    return d.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(_best()).alias("best")).withColumn("key", key)


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One binary-fuse filter per bucket of a snapshot's digests: (bucket, filter)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, list[np.ndarray]] = {}
        for b in batches:
            k = b.column(0).to_numpy()
            where = k % buckets
            for i in np.unique(where):
                keys.setdefault(int(i), []).append(k[where == i])
        for i, parts in keys.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([BinaryFuse.build(np.concatenate(parts)).dump()], pa.binary())], ["bucket", "filter"])

    return groups.select("key").repartition(buckets, F.col("key") % buckets).mapInArrow(build, "bucket long, filter binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The batch's groups with ``claimed``: whether the filter of their bucket may hold the digest."""
    own = groups.select("digest", "key", (F.col("key") % buckets).alias("bucket"))

    def probe(batch: pa.Table, found: pa.Table) -> pa.Table:
        keys = batch.column("key").to_numpy()
        hit = BinaryFuse.load(found.column("filter")[0].as_py()).contains(keys) if found.num_rows else np.zeros(len(keys), bool)
        return pa.table({"digest": batch.column("digest"), "claimed": pa.array(hit)})

    return own.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, "digest string, claimed boolean")


def exact_groups(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per document of both: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``; NULL is the
    empty text, and empty texts equal one another. The row with the most code points stays,
    then the smallest doc_id; a NULL doc_id comes last. Of wholly equal rows (same id, same
    length) each is marked like the one that stays. Other columns are ignored.
    """
    rows = _digests(snapshot).withColumn("side", F.lit(0)).unionByName(_digests(batch).withColumn("side", F.lit(1)))
    rows = written(rows, "exact-rows")
    old, new = written(_groups(rows.where("side = 0")), "exact-snapshot"), written(_groups(rows.where("side = 1")), "exact-batch")
    buckets = max(1, -(-max(old.count(), new.count()) // BUCKET_KEYS))
    claimed = screen(new, build_filters(old, buckets), buckets).where("claimed").select("digest")
    pairs = (
        claimed.join(old.select("digest", F.col("size").alias("old_size"), F.col("best").alias("old_best")), "digest")
        .join(new.select("digest", F.col("size").alias("new_size"), F.col("best").alias("new_best")), "digest")
    )
    pairs = written(pairs, "exact-claimed")

    def texts(docs: DataFrame, side: str) -> DataFrame:
        want = pairs.select("digest", F.col(f"{side}_best.id").alias("want"))
        t = docs.select("doc_id", F.regexp_replace(whole_text(), SPACES, "").alias(f"{side}_text"))
        t = t.join(want.select("want").distinct(), F.col("doc_id").eqNullSafe(F.col("want"))).drop("want")
        t = t.withColumn("digest", F.sha2(f"{side}_text", 256)).join(want, "digest").where(F.col("doc_id").eqNullSafe(F.col("want")))
        return t.select("digest", f"{side}_text").dropDuplicates(["digest"])

    same = texts(snapshot, "old").join(texts(batch, "new"), "digest").where("old_text = new_text").select("digest")
    both = pairs.join(same, "digest").select("digest", (F.col("old_size") + F.col("new_size")).alias("both"), F.least("old_best", "new_best").alias("first"))
    both = written(both, "exact-confirmed")
    sides = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    final = sides.join(both, "digest", "left").select(
        "side", "digest", F.coalesce("both", "size").alias("group_size"), F.coalesce("first", "best").alias("best")
    )
    return rows.join(final, ["side", "digest"]).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n") == -F.col("best.less"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table as an earlier snapshot and a later batch, split by the hash of the id."""
    return docs.where(remainder(2) == 0), docs.where(remainder(2) == 1)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of fully repeated rows one stays."""
    keep = exact_groups(*halves(docs)).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest")).distinct()
    rows = docs.withColumn("__d", F.sha2(F.regexp_replace(whole_text(), SPACES, ""), 256)).withColumn("__n", F.length(whole_text()))
    out = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__digest")))
    best = F.struct(-F.col("__n"), F.xxhash64(*[F.col(c) for c in docs.columns]))
    return out.groupBy("__id", "__digest").agg(F.min_by(F.struct(*docs.columns), best).alias("__row")).select("__row.*")


#: The same as SQL over ``documents``.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER best AS keep_id, first_value(n) OVER best AS most, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = most AS kept, text_sha256 FROM r"""
