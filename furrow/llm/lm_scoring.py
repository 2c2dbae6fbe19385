"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

A bigram seen c times is put into the filter 1 + floor(log2(c)) times, once for each level it
reaches; probing level after level until one is missing gives its count back, rounded down.
Without ``singles`` bigrams seen once stay out, and the levels of the others start at two.
Unigram counts are exact. The filter is built by segments of the hash space. Where all words
and the whole filter are small enough they are sent to every worker; else the texts' words and
bigrams are joined, a share of the texts at a time, to their part of the tables, which answers for
its own segments. Both ways ask the same filter, so the scores are the same. A bigram's share of its history is mixed with the unigram; the weights, one for
each power of two of the history's count, maximise the leave-one-out likelihood of the
training rows. As counts are rounded down while the history's is exact, a history's
probabilities sum to no more than one but for the filter's false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import remainder, short_batches, shuffles_dropped, whole_text, written_at
from furrow.llm.words import chunks, mix, utf8_buffers, word_hashes
from furrow.session import drop_path, scratch_path

SMOOTH = 0.1
#: Histogram bins of log2(bigram share / unigram), four to a doubling, for fitting the weights.
BINS, BIN_ZERO = 320, 120
#: Most words, at 16 bytes each, and most bytes of filter that are sent to every worker. Beyond
#: either, words and bigrams are joined to the tables; nothing is left out and no score changes.
HEAD_WORDS = 1 << 20
FILTER_BYTES = 256 << 20
#: Bits of filter for each entry.
ENTRY_BITS = 12
#: Segments of the hash space that one part of the joined tables holds.
PART_SEGMENTS = 4
PROBES = 8
SEGMENT_WORDS = 500_000
FLUSH = 1_500_000

#: The hash of the end token, which no word has but by chance.
END = mix(np.array([0x00E4D], np.uint64))[0]
_PROBE = mix(np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, token offsets per row): each row's words and one end."""
    words, rows = word_hashes(data, off)
    return np.insert(words, rows[1:], END), rows + np.arange(len(rows))


def bigrams(tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hash of each token after the one before it; 0 for the first of a row."""
    out = np.zeros(len(tokens), np.uint64)
    out[1:] = mix(tokens[:-1] * np.uint64(0x2545F4914F6CDD1D) + tokens[1:])
    out[rows[:-1]] = 0
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=counts, minlength=len(u)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of what ``of(data, off)`` gives, added up over some millions at a time."""
    held, size = [], 0
    for b in batches:
        data, off = utf8_buffers(b.column(0))
        for i, j in chunks(off):
            keys, n = np.unique(of(data, off[i : j + 1]), return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size > FLUSH:
                held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield held.pop()
                    size = 0
    if held:
        yield _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))


def word_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _counted(batches, lambda d, o: token_hashes(d, o)[0]):
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["token", "c"])

    return texts.mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def bigram_levels(texts: DataFrame, segments: int, singles: bool = False) -> DataFrame:
    """(segment, level, entries, hashes): bigrams by the power of two their count reaches, those seen once with ``singles`` alone.

    Partial counts travel as packed arrays, one for each task and segment of the hash space.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
            b = bigrams(*token_hashes(data, off))
            return b[b != 0]

        for keys, n in _counted(batches, of):
            where = keys % np.uint64(segments)
            order = np.argsort(where, kind="stable")
            keys, n, where = (keys[order] >> np.uint64(24)), n[order], where[order]
            cut = np.searchsorted(where, np.arange(segments + 1))
            seg, single, many, times = [], [], [], []
            for s in range(segments):
                k, c = keys[cut[s] : cut[s + 1]], n[cut[s] : cut[s + 1]]
                if len(k):
                    seg.append(s)
                    single.append(_pack(k[c == 1]))
                    many.append(_pack(k[c > 1]))
                    times.append(c[c > 1].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int32()), *(pa.array(x, pa.binary()) for x in (single, many, times))], ["segment", "single", "many", "times"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for s, one, many, times in zip(*(c.to_pylist() for c in b.columns)):
                k = _unpack(one)
                held.setdefault(s, []).append((k, np.ones(len(k), np.int64)))
                held[s].append((_unpack(many), np.frombuffer(times, np.uint32).astype(np.int64)))
        for s, parts in held.items():
            keys, n = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            level = np.log2(n).astype(np.int64) + singles
            some = [(lv, keys[level == lv]) for lv in range(1, int(level.max()) + 1)] if len(n) else []
            some = [(lv, k) for lv, k in some if len(k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * len(some), pa.int32()), pa.array([lv for lv, _ in some], pa.int32()), pa.array([len(k) for _, k in some], pa.int64()), pa.array([_pack(k) for _, k in some], pa.binary())],
                ["segment", "level", "entries", "hashes"],
            )

    parts = texts.mapInArrow(count, "segment int, single binary, many binary, times binary")
    return parts.repartition(max(1, segments // 4), "segment").mapInArrow(add, "segment int, level int, entries long, hashes binary")


def _pack(k: np.ndarray) -> bytes:
    """Five low bytes of each hash: with the segment, over 45 bits tell bigrams apart."""
    return k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _steps(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride of an entry's probes."""
    h = mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    return h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)


def _bits(keys: np.ndarray, level: int, size: np.uint64) -> Iterator[np.ndarray]:
    """Places of an entry, probe by probe."""
    a, b = _steps(keys, level)
    for i in range(PROBES):
        yield (a + np.uint64(i) * b) % size


def filter_bits(levels: DataFrame) -> DataFrame:
    """(segment, bits): the filter of every segment that holds a bigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for b in batches:
            for s, lv, raw in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(s, []).append((lv, _unpack(raw)))
        for s, parts in held.items():
            bits = np.zeros(-(-sum(lv * len(k) for lv, k in parts) * ENTRY_BITS // 8) * 8 + 64, bool)
            for top, k in parts:
                for lv in range(1, top + 1):
                    for at in _bits(k, lv, np.uint64(len(bits))):
                        bits[at] = True
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    rows = levels.select("segment", "level", "hashes")
    n = max(1, rows.select("segment").distinct().count() // 4)
    return rows.repartition(n, "segment").mapInArrow(run, "segment int, bits binary")


class LogFrequencyFilter:
    """Quantised counts of bigrams; 0 for those that are not in it."""

    def __init__(self, segments: int, parts: dict[int, bytes], singles: bool = False):
        self.segments, self.singles = segments, singles
        start, sizes, raw = np.zeros(segments, np.uint64), np.ones(segments, np.uint64), [b"\0" * 8]
        at = 64
        for s, part in sorted(parts.items()):
            start[s], sizes[s] = at, len(part) * 8
            raw.append(part)
            at += len(part) * 8
        self.start, self.sizes, self.bits = start, sizes, np.frombuffer(b"".join(raw), np.uint8)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count each bigram has at least, 0 for the key 0."""
        seg = (keys % np.uint64(self.segments)).astype(np.int64)
        level = self.levels(seg, (keys >> np.uint64(24)) & np.uint64((1 << 40) - 1), np.flatnonzero(keys != 0))
        return reached(level, self.singles)

    def levels(self, seg: np.ndarray, low: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """The level that each bigram reaches, of those alive; levels are probed until one is missing."""
        level, lv = np.zeros(len(seg), np.int64), 0
        while len(alive):
            lv += 1
            size, base = self.sizes[seg[alive]], self.start[seg[alive]]
            a, b = _steps(low[alive], lv)
            for i in range(PROBES):
                at = base + (a + np.uint64(i) * b) % size
                hit = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    alive, size, base, a, b = alive[hit], size[hit], base[hit], a[hit], b[hit]
                if not len(alive):
                    break
            level[alive] = lv
        return level


def reached(level: np.ndarray, singles: bool) -> np.ndarray:
    """The count that a level stands for, 0 for none."""
    return np.where(level > 0, 1 << np.maximum(level - singles, 0), 0)


def histories(c: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The count of the token before each one, 0 for the first of a row."""
    out = np.concatenate([[0], c[:-1]])
    out[rows[:-1]] = 0
    return out


class Model:
    """Totals and mixing weights; of a corpus small enough to be sent also the counts of all words and the filter."""

    def __init__(self, n: int, v: int, words: np.ndarray | None = None, counts: np.ndarray | None = None, grams: LogFrequencyFilter | None = None, singles: bool = False):
        self.n, self.v, self.words, self.counts, self.grams, self.singles = n, v, words, counts, grams, singles
        self.denominator = n + SMOOTH * (v + 1)
        self.weights = np.zeros(64)

    def parts(self, tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: its exact count (0: unseen) and the bigram's at least."""
        c = looked_up(tokens, self.words, self.counts)
        keys = bigrams(tokens, rows)
        keys[(histories(c, rows) == 0) | (c == 0)] = 0
        return c, self.grams.counts(keys)

    def histogram(self, c: np.ndarray, seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each (power of the history's count, share over unigram) occurs, each occurrence taken out of the counts.

        A count known as at least q is q / 2 at least without one of its occurrences, and none if q is the least kept.
        """
        history = histories(c, rows)
        seen = np.minimum(seen, np.minimum(history, c))
        use = (history > 1) & (c > 0)
        c, history, seen = c[use], history[use], seen[use]
        left = np.where(seen > (1 if self.singles else 2), seen / 2, 0.0)
        ratio = left / (history - 1) / ((c - 1 + SMOOTH) / self.denominator)
        place = np.where(ratio > 0, np.clip(np.floor(4 * np.log2(np.maximum(ratio, 1e-30))) + BIN_ZERO, 1, BINS - 1), 0).astype(np.int64)
        return np.bincount(np.log2(history).astype(np.int64) * BINS + place, minlength=64 * BINS)

    def fit_weights(self, histogram: np.ndarray) -> None:
        """The weight of the bigram's share that is likeliest for each row of the histogram."""
        ratio = np.where(np.arange(BINS) == 0, 0.0, 2.0 ** ((np.arange(BINS) - BIN_ZERO) / 4))
        grid = np.linspace(0, 0.95, 96)
        likely = histogram.reshape(64, BINS) @ np.log(1 - grid[None, :] + grid[None, :] * ratio[:, None])
        self.weights = grid[likely.argmax(axis=1)]

    def scores(self, c: np.ndarray, seen: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Per row: tokens, known tokens, base and model log10 probability."""
        history = histories(c, rows)
        seen = np.minimum(seen, np.minimum(history, c))
        unigram = (c + SMOOTH) / self.denominator
        some = np.maximum(history, 1)
        weight = np.where(history > 0, self.weights[np.log2(some).astype(np.int64)], 0.0)
        p = (1 - weight) * unigram + weight * seen / some
        total = lambda x: np.add.reduceat(x, rows[:-1])  # noqa: E731  every row has its end token
        return [np.diff(rows), total((c > 0).astype(np.int64)), total(np.log10(unigram)), total(np.log10(p))]


def looked_up(tokens: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count of each token by sorted words, 0 if it is none of them."""
    if not len(words):
        return np.zeros(len(tokens), np.int64)
    u, back = np.unique(tokens, return_inverse=True)
    at = np.minimum(np.searchsorted(words, u), len(words) - 1)
    return np.where(words[at] == u, counts[at], 0)[back]


class Counted:
    """Tables of all words and bigrams of some texts, and their totals."""

    def __init__(self, texts: DataFrame, singles: bool = False):
        self.spark, self.singles = texts.sparkSession, singles
        with shuffles_dropped(self.spark):
            self.words, self.at_words = written_at(word_counts(texts), "lm-words")
        self.n, self.v = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.segments = max(16, self.n // SEGMENT_WORDS)
        with shuffles_dropped(self.spark):
            self.levels, self.at_levels = written_at(bigram_levels(texts, self.segments, singles), "lm-bigrams")

    def drop(self) -> None:
        """Drop the tables, which nothing may read from here on."""
        for path in (self.at_words, self.at_levels):
            drop_path(self.spark, path)

    def small(self) -> bool:
        """Whether all words and the whole filter may be sent to every worker."""
        entries = self.levels.agg(F.sum(F.col("level") * F.col("entries"))).first()[0] or 0
        return self.v <= HEAD_WORDS and entries * ENTRY_BITS <= FILTER_BYTES * 8

    def sent_model(self) -> Model:
        """The model with all its tables, without weights."""
        got = self.words.toArrow()
        keys, c = got.column("token").to_numpy().view(np.uint64), got.column("c").to_numpy()
        order = np.argsort(keys)
        bits = filter_bits(self.levels).toArrow()
        grams = LogFrequencyFilter(self.segments, dict(zip(bits.column("segment").to_pylist(), bits.column("bits").to_pylist())), self.singles)
        return Model(self.n, self.v, keys[order], c[order], grams, self.singles)


TALLY = "at long, n long"


def tallied(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def collected(tallies: DataFrame) -> np.ndarray:
    got = tallies.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.zeros(64 * BINS)
    histogram[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return histogram


def weighed(model: Model, texts: DataFrame) -> Model:
    """The model with the weights likeliest for the texts."""
    sent = texts.sparkSession.sparkContext.broadcast(model)  # as bounded as the finished model

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64 * BINS, np.int64)
        for b in batches:
            data, off = utf8_buffers(b.column(0))
            for i, j in chunks(off):
                tokens, at = token_hashes(data, off[i : j + 1])
                total += sent.value.histogram(*sent.value.parts(tokens, at), at)
        yield tallied(total)

    model.fit_weights(collected(texts.mapInArrow(weigh, TALLY)))
    sent.unpersist()
    return model


def train(texts: DataFrame, singles: bool = False) -> tuple[Model, DataFrame]:
    """The model of all given texts with its tables, and the counts of all their words."""
    counted = Counted(texts, singles)
    return weighed(counted.sent_model(), texts), counted.words


def _rated(ids: pa.Array, held: pa.Array, each: list[list[np.ndarray]]) -> pa.RecordBatch:
    cols = [pa.array(np.concatenate([e[k] for e in each]) if each else np.zeros(0, t)) for k, t in enumerate((np.int64, np.int64, float, float))]
    return pa.RecordBatch.from_arrays([ids, held, *cols], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


#: Bytes of text in a block of the joined way.
BLOCK_BYTES = 8 << 20
#: Turns in which the blocks ask the tables: the files of one turn's exchanges go before the next.
TURNS = 4


def _squeezed(x: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte place, compressed: small numbers take little."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _spread(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _asked_words(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order in which a block asks for its words, by part, and the start of each part."""
    where = words.view(np.int64) % parts  # as pmod of the signed number
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(parts + 1))


def _asked_grams(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct bigrams in the order asked, by segment; start of each segment; place of each key among them, -1 for none)."""
    some = np.flatnonzero(keys)
    u, back = np.unique(keys[some], return_inverse=True)
    where = (u % np.uint64(segments)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    place = np.full(len(keys), -1, np.int64)
    place[some] = rank[back]
    return u[order], np.searchsorted(where[order], np.arange(segments + 1)), place


def _steps_up(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Forty high bits of each hash over its segment's number, as differences: keys ascend within a segment."""
    at = (np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(40)) | (keys >> np.uint64(24))
    return np.diff(at, prepend=np.uint64(0))


def text_blocks(rows: DataFrame) -> DataFrame:
    """(block, turn, ids, held, at, words, places): some megabytes of text as their distinct tokens, frequent ones first, and each token's place among them."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        block = partition << 32
        held: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def done() -> pa.RecordBatch:
            ids, out = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            tokens, at = np.concatenate([h[2] for h in held]), np.concatenate([[0], np.cumsum(np.concatenate([h[3] for h in held]))])
            u, back, n = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(u), np.uint32)
            rank[order] = np.arange(len(u), dtype=np.uint32)
            whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, out)]
            raw = [pa.array([x], pa.binary()) for x in (at.astype(np.int64).tobytes(), u[order].tobytes(), _squeezed(rank[back]))]
            turn = (partition + (block & 0xFFFFFFFF)) % TURNS
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([turn], pa.int32()), *whole, *raw], ["block", "turn", "ids", "held", "at", "words", "places"])

        for b in batches:
            data, off = utf8_buffers(b.column(2))
            for i, j in chunks(off):
                tokens, at = token_hashes(data, off[i : j + 1])
                held.append((b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), tokens, np.diff(at)))
                size += off[j] - off[i]
                if size >= BLOCK_BYTES:
                    yield done()
                    held, size, block = [], 0, block + 1
        if held:
            yield done()

    return rows.mapInArrow(run, f"block long, turn int, ids array<{kind}>, held array<boolean>, at binary, words binary, places binary")


class Block:
    """One row of ``text_blocks``, opened."""

    def __init__(self, at: bytes, words: bytes, places: bytes):
        self.at, self.words, self.places = np.frombuffer(at, np.int64), np.frombuffer(words, np.uint64), _spread(places, np.uint32)

    def grams(self) -> np.ndarray:
        return bigrams(self.words[self.places], self.at)


def _nothing(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


def packed_tables(counted: Counted) -> DataFrame:
    """(part, block, segment, words, grams): by part its words with their counts (block -2), and each segment's filter (block -1)."""
    parts = -(-counted.segments // PART_SEGMENTS)

    def packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            t, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(t % parts):
                held.setdefault(int(p), []).append((t[t % parts == p].view(np.uint64), c[t % parts == p]))
        for p, some in held.items():
            t, c = np.concatenate([t for t, _ in some]), np.concatenate([c for _, c in some])
            order = np.argsort(t)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x[order].tobytes()], pa.binary()) for x in (t, c))], ["part", "words", "grams"])

    words = counted.words.repartition(parts, F.pmod("token", F.lit(parts))).mapInArrow(packed_words, "part int, words binary, grams binary")
    bits = filter_bits(counted.levels).select(F.floor(F.col("segment") / PART_SEGMENTS).cast("int").alias("part"), F.lit(-1).cast("long").alias("block"), "segment", _nothing("binary", "words"), F.col("bits").alias("grams"))
    return words.select("part", F.lit(-2).cast("long").alias("block"), _nothing("int", "segment"), "words", "grams").union(bits)


def joined_counts(blocks: DataFrame, tables: DataFrame, segments: int) -> DataFrame:
    """Of each block, ``places`` with the ``counts`` of its distinct words, and every token's bigram ``levels``.

    A block asks each part of the tables once for its distinct words and bigrams, the latter as
    differences of their ascending hashes; the part answers in the order asked, and the answers meet the
    block again by its number. No task holds more than one part or one block.
    """
    parts = -(-segments // PART_SEGMENTS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, number in enumerate(b.column(0).to_pylist()):
                block = Block(*(b.column(x)[k].as_py() for x in (1, 2, 3)))
                order, wcut = _asked_words(block.words, parts)
                w, (g, gcut, _) = block.words[order], _asked_grams(block.grams(), segments)
                first = np.minimum(np.arange(parts + 1) * PART_SEGMENTS, segments)
                some = [p for p in range(parts) if wcut[p + 1] > wcut[p] or gcut[first[p + 1]] > gcut[first[p]]]
                cols = (
                    [w[wcut[p] : wcut[p + 1]].tobytes() for p in some],
                    [_squeezed(_steps_up(g[gcut[first[p]] : gcut[first[p + 1]]], np.diff(gcut[first[p] : first[p + 1] + 1]))) for p in some],
                )
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["block", "part", "words", "grams"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w, c, bits, grams = -1, np.zeros(0, np.uint64), np.zeros(0, np.int64), {}, None
        for b in batches:
            out: list[list] = [[], [], [], []]
            for part, block, segment, words, keys in zip(*(x.to_pylist() for x in b.columns)):
                if part != now:
                    now, w, c, bits, grams = part, np.zeros(0, np.uint64), np.zeros(0, np.int64), {}, None
                if block == -2:
                    w, c = np.frombuffer(words, np.uint64), np.frombuffer(keys, np.int64)
                elif block == -1:
                    bits[segment] = keys
                else:
                    grams = grams or LogFrequencyFilter(segments, bits)
                    at = np.cumsum(_spread(keys, np.uint64))
                    level = grams.levels(part * PART_SEGMENTS + (at >> np.uint64(40)).astype(np.int64), at & np.uint64((1 << 40) - 1), np.arange(len(at))).astype(np.uint8)
                    for x, y in zip(out, (block, part, _squeezed(looked_up(np.frombuffer(words, np.uint64), w, c)), _squeezed(level))):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "part", "words", "grams"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts, levels = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if head is not None:
                asked = np.concatenate([_spread(x, np.int64) for x in counts])
                order, _ = _asked_words(np.frombuffer(head.column(5)[0].as_py(), np.uint64), parts)
                c = np.empty(len(asked), np.int64)
                c[order] = asked
                place = _asked_grams(Block(*(head.column(k)[0].as_py() for k in (4, 5, 7))).grams(), segments)[2]
                lv = np.append(np.concatenate([_spread(x, np.uint8) for x in levels]), np.uint8(0))[place]
                yield pa.RecordBatch.from_arrays([*(head.column(k) for k in (2, 3, 4, 7)), *(pa.array([_squeezed(x)], pa.binary()) for x in (c, lv))], kept)

        for b in batches:
            for k, part in enumerate(b.column(1).to_pylist()):
                if part == -1:
                    yield from done()
                    head, counts, levels = b.slice(k, 1), [], []
                else:
                    counts.append(b.column(5)[k].as_py())
                    levels.append(b.column(6)[k].as_py())
        yield from done()

    kept = ["ids", "held", "at", "places", "counts", "levels"]
    asked = blocks.select("block", "at", "words", "places").mapInArrow(ask, "block long, part int, words binary, grams binary")
    questions = asked.select("part", "block", _nothing("int", "segment"), "words", "grams")
    answers = tables.union(questions).repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(answer, "block long, part int, words binary, grams binary")
    heads = blocks.select("block", F.lit(-1).alias("part"), "ids", "held", "at", "words", _nothing("binary", "grams"), "places")
    held = heads.unionByName(answers, allowMissingColumns=True)
    kind = blocks.schema["ids"].dataType.simpleString()
    return held.repartition("block").sortWithinPartitions("block", "part").mapInArrow(gather, f"ids {kind}, held array<boolean>, at binary, places binary, counts binary, levels binary")


def _tokens(b: pa.RecordBatch, k: int, singles: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, bigram counts and token offsets of one block."""
    at, places, counts, levels = (b.column(x)[k].as_py() for x in (2, 3, 4, 5))
    level = _spread(levels, np.uint8).astype(np.int64)
    return _spread(counts, np.int64)[_spread(places, np.uint32)], reached(level, singles), np.frombuffer(at, np.int64)


def joined_scores(rows: DataFrame, counted: Counted, kind: str) -> DataFrame:
    """Scores where the tables are too large to be sent.

    Each scratch table goes after its last reader, and the blocks meet the tables in ``TURNS`` turns, so
    that the disk never holds all questions and answers at once.
    """
    spark = rows.sparkSession
    singles = counted.singles
    model = Model(counted.n, counted.v, singles=singles)
    with shuffles_dropped(spark):
        tables, at_tables = written_at(packed_tables(counted), "lm-tables")
    counted.drop()
    blocks, at_blocks, at_joined = text_blocks(rows), scratch_path(spark, "lm-blocks"), scratch_path(spark, "lm-joined")
    blocks.write.partitionBy("turn").parquet(at_blocks)
    for turn in range(TURNS):
        some = spark.read.schema(blocks.schema).parquet(at_blocks).where(F.col("turn") == turn)
        met = joined_counts(some, tables, counted.segments)
        with shuffles_dropped(spark):
            met.write.mode("append").parquet(at_joined)
        drop_path(spark, f"{at_blocks}/turn={turn}")
    drop_path(spark, at_blocks)
    drop_path(spark, at_tables)
    joined = spark.read.schema(met.schema).parquet(at_joined)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64 * BINS, np.int64)
        for b in batches:
            for k in range(b.num_rows):
                c, seen, at = _tokens(b, k, singles)
                out = np.array(b.column(1)[k].as_py(), bool)
                held = np.repeat(out, np.diff(at))
                # rows stand on their own, so those held out can be taken out
                at = np.concatenate([[0], np.cumsum(np.diff(at)[~out])])
                if at[-1]:
                    total += model.histogram(c[~held], seen[~held], at)
        yield tallied(total)

    model.fit_weights(collected(joined.mapInArrow(weigh, TALLY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield _rated(b.column(0)[k].values, b.column(1)[k].values, [model.scores(*_tokens(b, k, singles))])

    return joined.mapInArrow(run, scored_schema(kind))


def scored_schema(kind: str) -> str:
    return f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_documents(docs: DataFrame, singles: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows whose crc32(doc_id as text) mod 10 is not 0. NULL is the
    empty text, whose one token is the end. With ``singles`` the filter holds every bigram, else
    those seen twice or more. Repeated rows score alike and count as often as they
    occur; without training rows all counts are 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select("doc_id", (remainder(10) == 0).alias("held_out"), whole_text().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = rows.where("NOT held_out").select("text")
    counted = Counted(texts, singles)
    if counted.small():
        sent = spark.sparkContext.broadcast(weighed(counted.sent_model(), texts))  # at most HEAD_WORDS * 16 bytes and FILTER_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for b in batches:
                each = []
                data, off = utf8_buffers(b.column(2))
                for i, j in chunks(off):
                    tokens, at = token_hashes(data, off[i : j + 1])
                    each.append(m.scores(*m.parts(tokens, at), at))
                yield _rated(b.column(0), b.column(1), each)

        scored = rows.mapInArrow(run, scored_schema(kind))
    else:
        scored = joined_scores(rows, counted, kind)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counted.n).cast("long").alias("train_tokens"), "base_score", "score")
