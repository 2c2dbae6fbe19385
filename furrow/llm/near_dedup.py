"""Near-duplicate detection: MinHash with tensored banding, candidates confirmed on full sets.

Two small collections of group values, A and B, are computed for each document; table (i, j)
is keyed by A's i-th and B's j-th value together. Twelve groups of two minhashes in each
collection give 144 tables of four minhashes from 48 computed ones instead of 576. A pair of
similarity 0.8 shares no key with probability about 1e-5 and one of 0.85 with 5e-7.

A key is formed only from values that some other document shares, so most documents form
none. Inside a bucket every member is compared with one representative, not with every other;
only buckets whose members then still lie in different components are compared pair by pair,
in blocks, by parity sketches: of each set, which of 1,024 bins hold an odd number of its
hashes. Bins that differ are at most as many as shingles that differ, so few pairs below the
threshold reach the full sets. The arithmetic of that last step grows with the square of the
number of documents that are alike but not alike enough, as in a passage common to many short
texts; the rows that it makes do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import short_batches, whole_text, written
from furrow.llm.words import chunks, mix, shingle_hashes, utf8_buffers, word_hashes

WORDS = 4
PERCENT = 80
GROUPS = 12
ROWS = 2
BINS = 1024
#: Odd bins of d hashes spread by at most sqrt(BINS) / 2 about their mean; beyond this many of those a linked pair falls with probability 1e-9.
SPREADS = 6
BLOCK = 2_000
BROADCAST_BYTES = 16 << 20

_SEEDS = mix(np.arange(1, 2 * GROUPS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sets(col: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, some texts at a time."""
    data, off = utf8_buffers(col)
    for i, j in chunks(off):
        h, at = shingle_hashes(*word_hashes(data, off[i : j + 1]), words)
        yield [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def _group_values(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """2 x GROUPS values of each non-empty set, and its parity sketch, 64 bins to a number."""
    flat = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = [np.minimum.reduceat((flat ^ s) * (s | np.uint64(1)), start) for s in _SEEDS]
    out = []
    for g in range(2 * GROUPS):
        v = np.full(len(sets), g, np.uint64)
        for m in low[g * ROWS : (g + 1) * ROWS]:
            v = mix(v * np.uint64(0x2545F4914F6CDD1D) + m)
        out.append(v)
    which = np.repeat(np.arange(len(sets)) * BINS, [len(s) for s in sets])
    count = np.bincount(which + (mix(flat) % np.uint64(BINS)).astype(np.int64), minlength=len(sets) * BINS)
    odd = np.packbits((count & 1).astype(np.uint8).reshape(len(sets), BINS), axis=1)
    return np.stack(out, axis=1).view(np.int64), odd.view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, set_id (16 bytes that equal sets share), groups and bits (empty without shingles)."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, groups, bits = [], [], [], []
            for sets in _sets(b.column(1), words):
                n += [len(s) for s in sets]
                full = [s for s in sets if len(s)]
                values = iter(zip(*_group_values(full))) if full else iter(())
                for s in sets:
                    ids.append(np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).tobytes())
                    g, k = next(values) if len(s) else ([], [])
                    groups.append(g)
                    bits.append(k)
            cols = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (groups, bits))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_shingles", "set_id", "groups", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id binary, groups array<long>, bits array<long>")


def tensored_keys(classes: DataFrame) -> DataFrame:
    """(key, id): a key for each pair of an A value and a B value that are both shared."""
    rows = classes.select("id", F.posexplode("groups").alias("g", "v"))
    shared = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g", "v")
    rows = written(rows.join(shared, ["g", "v"]), "near-shared")
    a = rows.where(F.col("g") < GROUPS).select("id", F.col("g").alias("ga"), F.col("v").alias("va"))
    b = rows.where(F.col("g") >= GROUPS).select("id", F.col("g").alias("gb"), F.col("v").alias("vb"))
    return a.join(b, "id").select(F.xxhash64("ga", "va", "gb", "vb").alias("key"), "id")


def most_bins(n: np.ndarray, percent: int) -> np.ndarray:
    """Bins in which two linked sets of n shingles together may differ."""
    d = np.floor(n * (100 - percent) / (100 + percent))
    return np.minimum(d, BINS / 2 * (1 - (1 - 2 / BINS) ** d) + SPREADS * BINS**0.5 / 2)


def alike(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """The test of close_pairs on columns: sizes, then bins that differ, allow a link."""
    d = F.floor((na + nb) * (100 - percent) / (100 + percent))
    most = F.least(d.cast("double"), BINS / 2 * (1 - F.pow(F.lit(1 - 2 / BINS), d)) + SPREADS * BINS**0.5 / 2)
    bins = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (bins <= most)


def close_pairs(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of one key, in different components, that size and parity sketches do not rule out.

    A bucket is cut into blocks of about BLOCK members by the hash of their id, and each pair of
    blocks is compared at once, so no task holds more than two blocks however large the bucket.
    """
    blocks = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c")).where("low <> high")
    blocks = blocks.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, "key").join(sizes, "id").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["key", "i", "j", "own", "id", "comp", "n", "bits"]
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select(*names)

    def pairs(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own, ids, comp, n = (part.column(c).to_numpy() for c in ("own", "id", "comp", "n"))
        bits = part.column("bits").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).view(np.uint64)
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        ok = (comp[left][:, None] != comp[right][None, :]) & (ids[left][:, None] != ids[right][None, :])
        if i == j:
            ok &= ids[left][:, None] < ids[right][None, :]
        x, y = n[left][:, None], n[right][None, :]
        ok &= 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
        at, to = np.nonzero(ok)
        x, y = left[at], right[to]
        most = most_bins(n[x] + n[y], percent)
        different = np.zeros(len(x), np.int64)
        for w in range(bits.shape[1]):
            different += np.bitwise_count(bits[x, w] ^ bits[y, w])
        near = different <= most
        x, y = x[near], y[near]
        return np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            k, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            cut = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            out = [pairs(t.slice(a, e - a)) for a, e in zip([0, *cut], [*cut, len(k)]) if e - a > 1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[s] for o in out])) for s in (0, 1)], ["a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            k, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            last = np.flatnonzero((k != k[-1]) | (i != i[-1]) | (j != j[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last run may go on in the next batch
            if whole:
                yield from done(t.slice(0, whole))
            held = t.slice(whole)
        if held is not None and held.num_rows:
            yield from done(held)

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets reach the similarity."""
    pairs = written(pairs, "near-candidates")
    want = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select("doc_id", whole_text().alias("text")).join(want, F.col("doc_id") == F.col("id")).select("id", "text")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for some in _sets(b.column(1), words) for s in some]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    sets = written(texts.mapInArrow(as_sets, "id long, own binary"), "near-sets").dropDuplicates(["id"])
    if (sets.agg(F.sum(F.length("own"))).first()[0] or 0) <= BROADCAST_BYTES:  # else the two joins shuffle them
        sets = F.broadcast(sets)
    j = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    return j.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each end of an edge can reach.

    Each round takes the smallest label among a vertex's neighbours and then that label's own
    label, and is written to the shared folder; it ends when a round changes nothing.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-links")
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "near-labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = label.join(near, "id").select("id", "comp", F.least("comp", "near").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("comp").alias("below"))
        step = written(step.join(jump, "low", "left").select("id", F.coalesce("below", "low").alias("next"), "comp"), "near-labels")
        if step.where("next <> comp").isEmpty():
            return label
        label = step.select("id", F.col("next").alias("comp"))


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of distinct word shingles reach the similarity; a
    component is all that links reach. NULL and empty texts have no shingles and no links.
    Rows of one doc_id belong together; of an id given to different texts one text's set is
    compared, so links of the others can be lost. A row without doc_id is linked with rows of the same
    set only, and has their smallest doc_id, or NULL, as component. Other columns are ignored.
    """
    sig = written(signatures(docs, words), "near-signatures")
    full = sig.where("n_shingles > 0")
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("groups").alias("groups"), F.first("bits").alias("bits"))
    classes = written(classes.withColumn("id", F.coalesce(F.col("rep").cast("long"), F.xxhash64("set_id"))), "near-classes")
    own = classes.where("rep IS NOT NULL").dropDuplicates(["id"])
    keyed = written(tensored_keys(own), "near-keys")
    sizes = own.select("id", "n", "bits")
    links, comp = None, None

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("comp", F.col("id")) if comp is None else rows.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def possible(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a")
        p = p.join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b")
        return p.where(alike(F.col("x"), F.col("y"), F.col("na"), F.col("nb"), percent)).select("a", "b")

    def take(pairs: DataFrame) -> None:
        nonlocal links, comp
        more = written(confirmed(pairs, docs, words, percent), "near-confirmed")
        links = more if links is None else links.union(more)
        comp = components(links)

    for end in (F.min, F.max):
        rows = placed(keyed)
        lead = rows.groupBy("key").agg(end(F.struct("id", "comp")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1")
        star = rows.join(lead, "key").where("comp <> lead.comp").select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()
        take(possible(star))

    take(close_pairs(placed(keyed), sizes, percent))

    label = classes.select("set_id", "rep", "id").join(comp, "id", "left").select("set_id", F.when(F.col("rep").isNotNull(), F.coalesce("comp", "id")).alias("component"))
    out = sig.select("doc_id", "n_shingles", "set_id").join(label, "set_id", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).cast(docs.schema["doc_id"].dataType)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The document of least id of every component, with all its columns; documents without words or id stay."""
    gone = near_groups(docs, words, percent).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
