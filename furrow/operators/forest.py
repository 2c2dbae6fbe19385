"""Random forests on feature tables: training level by level, prediction and validation.

Rows are binned once (at most 32 bins a feature, as in Spark ML), rows of equal bins and label are one row
with a count, and some 260,000 of them make one block. A level of all trees is one job: each task counts
classes by (node, feature, bin) for some trees over one block, the counts of a tree are added up and its
best splits found. Work grows with rows x trees, what is shuffled with blocks x nodes, and the driver
holds the forest alone, in arrays of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import cut_lineage

BINS = 32
BLOCK_ROWS = 1 << 18
#: Trees that one task counts, and forests of a cross validation that are grown at a time.
TASK_TREES, AT_ONCE = 25, 2
#: How often a row is drawn into a tree's sample, by 16 random bits: Poisson with mean 1.
_DRAWN = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.int64)


def class_weights(counts: np.ndarray) -> np.ndarray:
    """Weight n/(classes*n_class) of every class that occurs."""
    return np.where(counts > 0, counts.sum() / ((counts > 0).sum() * np.maximum(counts, 1)), 0.0)


def thresholds(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """At most BINS - 1 rising thresholds a feature: between all values where these are few, else its quantiles."""
    probs = [i / BINS for i in range(1, BINS)]
    few = [F.approx_count_distinct(f).alias(f"n_{f}") for f in features]
    at = df.agg(*few, *[F.percentile_approx(f, probs, 10_000).alias(f"q_{f}") for f in features]).first()
    out = []
    for f in features:
        q = np.unique(np.array(at[f"q_{f}"] or [], float))
        if at[f"n_{f}"] < 2 * BINS:
            u = np.array(sorted(r[0] for r in df.select(f).where(F.col(f).isNotNull()).distinct().limit(BINS + 1).collect()), float)
            q = (u[:-1] + u[1:]) / 2 if len(u) <= BINS else q
        out.append(q)
    return out


def binned(cols: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(feature, row) bins: how many thresholds lie below a value."""
    if not all(np.isfinite(np.asarray(c, float)).all() for c in cols):
        raise ValueError("features must be finite numbers")
    return np.stack([np.searchsorted(t, np.asarray(c, float)).astype(np.uint8) for c, t in zip(cols, cuts)])


def blocks(df: DataFrame, features: Sequence[str], label: str, cuts: Sequence[np.ndarray]) -> DataFrame:
    """(block, n, rows, times): distinct binned rows with their label, and how often each occurs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *x, y = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            rows = np.vstack([binned(x, cuts), y.astype(np.uint8)]).T
            raw, w = np.ascontiguousarray(rows).tobytes(), len(features) + 1
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + w] for i in range(0, len(raw), w)], pa.binary())], ["row"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b"".join(b.column(0).to_pylist()), b.column(1).to_numpy().tobytes()) for b in batches]
        rows, times = (b"".join(x) for x in zip(*held)) if held else (b"", b"")
        if times:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([rows], pa.binary()), pa.array([times], pa.binary())], ["block", "rows", "times"])

    known = df.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("int"))
    counted = cut_lineage(known.mapInArrow(pack, "row binary").groupBy("row").agg(F.count(F.lit(1)).alias("times")))
    n = max(1, -(-counted.count() // BLOCK_ROWS))
    # by hash and in order, so that a block's rows and what is drawn for them do not depend on the run
    return counted.repartition(n, "row").sortWithinPartitions("row").mapInArrow(gather, "block int, rows binary, times binary")


class Forest:
    """Trees in heap order: ``feature`` (-1 at a leaf) and ``cut`` of every split, class shares ``p`` and weighted ``gain`` of every node."""

    def __init__(self, trees: int, depth: int, classes: int, cuts: Sequence[np.ndarray]):
        self.cuts, self.depth = list(cuts), depth
        self.feature, self.cut = np.full((trees, (1 << depth) - 1), -1, np.int8), np.zeros((trees, (1 << depth) - 1), np.uint8)
        self.p, self.gain = np.zeros((trees, (2 << depth) - 1, classes), np.float32), np.zeros((trees, (1 << depth) - 1), np.float32)

    def prune(self) -> None:
        """A split whose two leaves predict one class is a leaf."""
        best = self.p.argmax(axis=2)
        for lv in reversed(range(self.depth)):
            at = np.arange((1 << lv) - 1, (2 << lv) - 1)
            leaf = lambda i: self.feature[:, i] < 0 if lv < self.depth - 1 else np.ones((len(self.p), len(i)), bool)
            same = leaf(2 * at + 1) & leaf(2 * at + 2) & (best[:, 2 * at + 1] == best[:, 2 * at + 2])
            self.feature[:, at] = np.where(same, -1, self.feature[:, at])
        self.gain[self.feature < 0] = 0

    def probability(self, cols: Sequence[np.ndarray]) -> np.ndarray:
        """(row, class) mean of the trees' shares."""
        x = binned(cols, self.cuts)
        total = np.zeros((x.shape[1], self.p.shape[2]))
        for feature, cut, p in zip(self.feature, self.cut, self.p):
            total += p[routed(x, feature, cut, self.depth)]
        return total / len(self.p)

    def importances(self) -> np.ndarray:
        """Share of the weighted gain that each feature brought, every tree counted alike."""
        each = np.stack([np.bincount(f[f >= 0], weights=g[f >= 0], minlength=len(self.cuts)) for f, g in zip(self.feature, self.gain)])
        total = each.sum(axis=1, keepdims=True)
        mean = np.divide(each, total, out=np.zeros_like(each), where=total > 0).sum(axis=0)
        return mean / mean.sum() if mean.sum() > 0 else mean


def routed(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node that each column of bins reaches within so many levels."""
    n = x.shape[1]
    flat, node, at = x.reshape(-1), np.zeros(n, np.int32), np.arange(n)
    for _ in range(levels):
        f = feature[node[at]]
        if (f < 0).any():
            at, f = at[f >= 0], f[f >= 0]
        if not len(at):
            break
        here = node[at]
        node[at] = 2 * here + 1 + (flat[f.astype(np.int64) * n + at] > cut[here])
    return node


def _subsets(seed: int, tree: int, level: int, features: int, k: int) -> np.ndarray:
    """The features that each node of a level may split by."""
    return np.random.Generator(np.random.SFC64([seed, 1, tree, level])).random((1 << level, features)).argsort(axis=1)[:, :k]


def _drawn(seed: int, tree: int, block: int, times: np.ndarray) -> np.ndarray:
    """How often each row is in the tree's sample: Poisson with its count as mean."""
    rng = np.random.Generator(np.random.SFC64([seed, 2, tree, block]))
    out = _DRAWN[rng.integers(0, 1 << 16, len(times), dtype=np.uint16)]
    many = np.flatnonzero(times > 1)
    out[many] = rng.poisson(times[many])
    return out


def best_splits(counts: np.ndarray, weight: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """Of (node, slot, bin, class) counts: slot (-1: none) and bin of the split of most Gini gain, its weighted gain, counts left and in all."""
    left = counts.cumsum(axis=2)
    whole = left[:, :1, -1:, :]
    enough = (left.sum(axis=3) >= min_leaf) & ((whole - left).sum(axis=3) >= min_leaf)
    wl, wr, w = left * weight, (whole - left) * weight, whole * weight
    nl, nr, n = (c.sum(axis=3) for c in (wl, wr, w))
    over = lambda a, b: a / np.where(b > 0, b, 1.0)
    gini = lambda c, m: 1 - (over(c, m[..., None]) ** 2).sum(axis=-1)
    gain = gini(w, n) - over(nl * gini(wl, nl) + nr * gini(wr, nr), n)
    gain = np.where(enough, gain, -np.inf).reshape(len(counts), -1)
    at = gain.argmax(axis=1)
    i, some = np.arange(len(counts)), gain.max(axis=1) > 1e-12
    slot, cut = np.divmod(at, counts.shape[2])
    return np.where(some, slot, -1), cut, np.where(some, gain[i, at] * n[:, 0, 0], 0.0), left[i, slot, cut], whole[:, 0, 0]


def train_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 300, depth: int = 12, min_leaf: int = 5, subset: str = "3", balanced: bool = False, seed: int = 42) -> Forest:
    """Features must be finite and labels 0..k-1; ``balanced`` leaves out rows without a label."""
    spark, features = df.sparkSession, list(features)
    k = max(1, min(int(subset), len(features)) if subset.isdigit() else int(np.ceil(np.sqrt(len(features)))))
    if balanced:
        df = df.where(F.col(label).isNotNull())
    cuts = thresholds(df.select(*[F.col(f).cast("double") for f in features]), features)
    per_class = {r[0]: r[1] for r in df.groupBy(F.col(label).cast("int")).count().collect()}
    if not per_class or None in per_class:
        raise ValueError(f"no rows to learn from, or {label} is NULL")
    classes, width = max(per_class) + 1, len(features)
    weight = class_weights(np.array([per_class.get(c, 0) for c in range(classes)], float)) if balanced else np.ones(classes)
    groups = -(-trees // TASK_TREES)
    rows = cut_lineage(blocks(df, features, label, cuts))
    work = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    work = cut_lineage(work.repartition(max(1, rows.count()) * groups))
    forest = Forest(trees, depth, classes, cuts)
    live = np.ones((trees, 1), bool)
    for lv in range(depth):
        first, shape = (1 << lv) - 1, (k, BINS, classes)
        sent = spark.sparkContext.broadcast((forest.feature[:, :first].copy(), forest.cut[:, :first].copy(), live))

        def count(batches: Iterator[pa.RecordBatch], lv=lv, first=first, shape=shape, sent=sent) -> Iterator[pa.RecordBatch]:
            feature, cut, alive = sent.value
            for b in batches:
                for block, raw, times, group in zip(*(c.to_pylist() for c in b.columns)):
                    x = np.frombuffer(raw, np.uint8).reshape(-1, width + 1).T
                    y, x, times = x[-1].astype(np.int64), np.ascontiguousarray(x[:-1]), np.frombuffer(times, np.int64)
                    for t in range(group * TASK_TREES, min(trees, (group + 1) * TASK_TREES)):
                        if not alive[t].any():
                            continue
                        n = _drawn(seed, t, block, times)
                        at = np.flatnonzero(n)
                        xt = np.ascontiguousarray(x[:, at])
                        node = routed(xt, feature[t], cut[t], lv) - first
                        rank = np.where(alive[t], np.cumsum(alive[t]) - 1, -1)
                        here = np.where(node >= 0, rank[np.maximum(node, 0)], -1)
                        ok = np.flatnonzero(here >= 0)
                        here, c, times_in, mine = here[ok], y[at[ok]], n[at[ok]], _subsets(seed, t, lv, width, k)[node[ok]]
                        size = int(alive[t].sum()) * k * BINS * classes
                        flat, total = xt.reshape(-1), np.zeros(size)
                        for j in range(k):
                            bins = flat[mine[:, j] * len(at) + ok]
                            total += np.bincount(((here * k + j) * BINS + bins) * classes + c, weights=times_in, minlength=size)
                        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([total.astype(np.int32 if total.max(initial=0) < 1 << 31 else np.int64).tobytes()], pa.binary())], ["tree", "counts"])

        def split(batches: Iterator[pa.RecordBatch], lv=lv, shape=shape, sent=sent) -> Iterator[pa.RecordBatch]:
            now, held = -1, None

            def done() -> Iterator[pa.RecordBatch]:
                if held is not None:
                    slot, cut, gain, left, whole = best_splits(held.reshape(-1, *shape), weight, min_leaf)
                    mine = _subsets(seed, now, lv, width, k)[sent.value[2][now]]
                    feature = np.where(slot >= 0, mine[np.arange(len(slot)), np.maximum(slot, 0)], -1)
                    cols = (feature.astype(np.int8), cut.astype(np.uint8), gain.astype(np.float32), left, whole - left)
                    # a child that is pure or too small to be cut is a leaf
                    wide = [((c > 0).sum(axis=1) > 1) & (c.sum(axis=1) >= 2 * min_leaf) for c in cols[3:]]
                    share = [(c * weight / np.maximum((c * weight).sum(axis=1, keepdims=True), 1e-9)).astype(np.float32) for c in (*cols[3:], whole)]
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (*cols[:3], *share, *wide))], names)

            for b in batches:
                for t, raw in zip(*(c.to_pylist() for c in b.columns)):
                    n = int(sent.value[2][t].sum()) * int(np.prod(shape))
                    got = np.frombuffer(raw, np.int32 if len(raw) == 4 * n else np.int64)
                    if t != now:
                        yield from done()
                        now, held = t, np.zeros(n, np.int64)
                    held += got
            yield from done()

        names = ["tree", "feature", "cut", "gain", "left", "right", "whole", "wide_left", "wide_right"]
        counts = work.mapInArrow(count, "tree int, counts binary").repartition(groups, "tree").sortWithinPartitions("tree")
        found = counts.mapInArrow(split, "tree int, " + ", ".join(f"{c} binary" for c in names[1:])).toArrow()
        sent.destroy()
        after = np.zeros((trees, 2 << lv), bool)
        for t, feature, cut, gain, left, right, whole, wl, wr in zip(*(c.to_pylist() for c in found.columns)):
            at = np.flatnonzero(live[t])
            f = np.frombuffer(feature, np.int8)
            forest.feature[t, first + at], forest.cut[t, first + at] = f, np.frombuffer(cut, np.uint8)
            forest.gain[t, first + at] = np.frombuffer(gain, np.float32)
            forest.p[t, first + at] = np.frombuffer(whole, np.float32).reshape(-1, classes)
            for side, share, wide in ((0, left, wl), (1, right, wr)):
                child = 2 * at[f >= 0] + side
                forest.p[t, (2 << lv) - 1 + child] = np.frombuffer(share, np.float32).reshape(-1, classes)[f >= 0]
                after[t, child] = np.frombuffer(wide, bool)[f >= 0]
        live = after
        if not live.any():
            break
    forest.prune()
    return forest


def with_probability(model: Forest, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All rows with the forest's class probabilities as ``__p``."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # trees * 2^depth numbers at most, whatever the rows

    @F.pandas_udf("array<double>")
    def shares(*cols: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.probability(cols)))

    return df.withColumn("__p", shares(*[F.col(f).cast("double") for f in features]))


def predict(model: Forest, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    p = F.col("__p")
    return with_probability(model, df, features).select(*keep, (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("pred"))


def class_probability(model: Forest, df: DataFrame, features: Sequence[str], keep: Sequence[str], cls: int, name: str) -> DataFrame:
    return with_probability(model, df, features).select(*keep, F.col("__p")[cls].alias(name))


def importance(spark, model: Forest, features: Sequence[str]) -> DataFrame:
    """Ranked rows; one per feature."""
    vals = sorted(zip(features, model.importances().tolist()), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(i + 1, f, round(v, 6)) for i, (f, v) in enumerate(vals)], "rank int, feature string, gini double")


def cross_validate(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: int, keep: Sequence[str], **params) -> DataFrame:
    """Out-of-fold predictions of every row, pooled; a fold's forest goes once its rows are predicted."""

    def out_of(k: int) -> DataFrame:
        model = train_forest(df.where(F.col(fold) != k), features, label, **params)
        return cut_lineage(predict(model, df.where(F.col(fold) == k), features, [*keep, label, fold]))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = list(pool.map(inheritable_thread_target(df.sparkSession)(out_of), range(folds)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def pooled_scores(pred: DataFrame, label: str) -> DataFrame:
    """One row over all out-of-fold predictions: accuracy, macro F1 over the labels, the largest label's share."""
    hit = (F.col(label) == F.col("pred")).cast("long")
    rows = pred.groupBy(F.col(label).alias("k")).agg(F.count(F.lit(1)).alias("ref"), F.sum(hit).alias("tp"))
    cols = pred.groupBy(F.col("pred").alias("k")).agg(F.count(F.lit(1)).alias("got"))
    c = rows.join(cols, "k", "left").withColumn("f1", 2 * F.col("tp") / (F.col("ref") + F.coalesce("got", F.lit(0))))
    n = F.sum("ref")
    return c.agg(n.alias("n"), (F.sum("tp") / n).alias("oa"), F.avg("f1").alias("macro_f1"), (F.max("ref") / n).alias("majority"))


def fold_accuracy(pred: DataFrame, label: str, fold: str) -> DataFrame:
    """Overall accuracy and kappa per fold from marginal counts."""
    c = pred.groupBy(fold, label, "pred").agg(F.count(F.lit(1)).alias("n"))
    rows = c.groupBy(fold, F.col(label).alias("k")).agg(F.sum("n").alias("nr"))
    cols = c.groupBy(fold, F.col("pred").alias("k")).agg(F.sum("n").alias("nc"))
    tot = c.groupBy(fold).agg(F.sum("n").alias("n_val"), F.sum(F.when(F.col(label) == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    pe = rows.join(cols, [fold, "k"]).groupBy(fold).agg(F.sum(F.col("nr") * F.col("nc")).alias("agree"))
    j = tot.join(pe, fold, "left")
    oa, e = F.col("hit") / F.col("n_val"), F.coalesce("agree", F.lit(0)) / (F.col("n_val") * F.col("n_val"))
    return j.select(fold, "n_val", oa.alias("oa"), F.try_divide(oa - e, 1 - e).alias("kappa"))


def with_mean(scores: DataFrame, fold: str) -> DataFrame:
    """The folds' scores and a last row, fold NULL, with their mean and the rows of all folds."""
    mean = scores.agg(F.lit(None).cast("int").alias(fold), F.sum("n_val").alias("n_val"), F.avg("oa").alias("oa"), F.avg("kappa").alias("kappa"))
    return scores.select(fold, "n_val", "oa", "kappa").unionByName(mean)
