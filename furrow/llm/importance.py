"""Target-distribution importance resampling: draw documents that look like a target corpus.

Words are found for a whole batch at once. The texts of a batch are joined with a sentinel
that no word holds, one regex pass splits the joined text into words and gaps, and the lengths
of both give each word's place; ``searchsorted`` of the documents' offsets then tells which
words, and which runs of two or three, belong to one document. Runs that cross a document are
masked before ``bincount``.

A feature's bucket is the crc32 of its bytes. The crc32 of a concatenation follows from the
parts' by a linear map that depends on the length of the second part only, so runs are hashed
from their words without building their bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import short_batches, whole_text
from furrow.llm.ordering import positions
from furrow.llm.words import chunks, utf8_buffers

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42

_PARTS = re.compile(rb"([0-9a-z\x80-\xff]+)")  # on bytes with A-Z lowered; words and gaps in turn
_SENTINEL = b"\x00"
_TABLE_BITS = 8


def _zero_bytes(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The crc register after one more zero byte."""
    return table[crc & np.uint32(0xFF)] ^ (crc >> np.uint32(8))


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """For each byte of a crc: its image after n zero bytes, n below 256, and after 256 * 2^j."""
    byte = np.arange(256, dtype=np.uint32)
    table = byte.copy()
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1)).astype(np.uint32)
    image = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    small = [image]
    for _ in range(255):
        small.append(_zero_bytes(small[-1], table))
    double = [_zero_bytes(small[-1], table)]
    for _ in range(40):
        double.append(_apply(double[-1], double[-1]))
    return np.stack(small), double


def _apply(images: np.ndarray, crc: np.ndarray) -> np.ndarray:
    b = np.uint32(0xFF)
    return images[0][crc & b] ^ images[1][(crc >> np.uint32(8)) & b] ^ images[2][(crc >> np.uint32(16)) & b] ^ images[3][crc >> np.uint32(24)]


_SMALL, _DOUBLE = _shift_tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What each crc adds to the crc of a text that goes on for n more bytes."""
    b, low = np.uint32(0xFF), n & 0xFF
    flat = _SMALL.reshape(-1)
    at = low << 10
    out = flat[at + (crc & b)] ^ flat[at + 256 + ((crc >> np.uint32(8)) & b)] ^ flat[at + 512 + ((crc >> np.uint32(16)) & b)] ^ flat[at + 768 + (crc >> np.uint32(24))]
    high = n >> _TABLE_BITS
    j = 0
    while high.any():
        odd = np.flatnonzero(high & 1)
        out[odd] = _apply(_DOUBLE[j], out[odd])
        high = high >> 1
        j += 1
    return out


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32, bytes) of every word of the texts in order, and the word offsets of the texts."""
    joined = _SENTINEL.join(texts).lower()
    parts = _PARTS.split(joined)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    words = parts[1::2]
    starts = (np.cumsum(length) - length)[1::2]
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    begins = np.cumsum([0, *(len(t) + len(_SENTINEL) for t in texts)])
    return crc, length[1::2], np.searchsorted(starts, begins)


def runs(crc: np.ndarray, size: np.ndarray, at: np.ndarray, longest: int = LONGEST_RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length: the crc32 of the run that starts at each word, and whether it stays in its text."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    spaced = crc ^ shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), size)  # of " " and the word
    run = crc
    for n in range(1, longest + 1):
        if n > 1:
            run = shifted(run[:-1], size[n - 1 :] + 1) ^ spaced[n - 1 :]
        yield run, text[: len(run)] == text[n - 1 :]


def _texts(col: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    data, off = utf8_buffers(col)
    raw = data.tobytes()
    for i, j in chunks(off):
        yield i, j, [raw[a:b] for a, b in zip(off[i:j], off[i + 1 : j + 1])]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): features of all texts by bucket; each task adds up its own before the shuffle."""
    short_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, some in _texts(b.column(0)):
                for crc, inside in runs(*batch_words(some)):
                    total += np.bincount(crc[inside] % BUCKETS, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return texts.select(whole_text().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's over the corpus's smoothed share) of each bucket."""
    s, t, all_s, all_t = raw.astype(float), target.astype(float), float(raw.sum()), float(target.sum())
    ratio = (t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(doc_id: str | None, seed: int) -> int:
    """floor(1000 times a Gumbel draw) that only the id and the seed decide."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def document_scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, j, some in _texts(b.column(2)):
                crc, size, at = batch_words(some)
                words[i:j] = np.diff(at)
                sums = np.zeros(len(crc) + 1, np.int64)
                for run_crc, inside in runs(crc, size, at):
                    sums[1 : len(run_crc) + 1] += np.where(inside, gain[run_crc % BUCKETS], 0)
                weight[i:j] = np.diff(np.cumsum(sums)[at])
            features = sum(np.maximum(words - n, 0) for n in range(LONGEST_RUN))
            score = weight + np.array([noise(x, seed) for x in b.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name"), whole_text().alias("text"))
    return named.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def _filled(counts: DataFrame) -> np.ndarray:
    """At most BUCKETS rows, whatever the corpus holds."""
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (NULL if not drawn), all long but the id.

    NULL texts are empty: no words, no features, weight 0 and never drawn, as no text of fewer
    than 20 words is. A NULL doc_id draws its noise as the text 'null' and ranks after equal
    scores; rows that repeat an id share its noise, are ranked one after the other, and count
    one by one. An empty target leaves gains that favour rare buckets; no documents, no rows.
    Long texts are read whole, one at a time beyond 2 MB. Other columns are ignored.
    """
    gain = gains(_filled(bucket_counts(docs)), _filled(bucket_counts(target)))
    scored = document_scores(docs, gain, seed).withColumn("open", F.col("n_words") >= LEAST_WORDS).drop("n_words")
    placed = positions(scored, ["open"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "resample")
    drawn = F.col("open") & (F.col("position") < F.floor(F.col("total") * percent / 100))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("position") + 1).cast("long").alias("rank"))


_FEATURES_SQL = " UNION ALL ".join(
    f"SELECT corpus, id, array_to_string(w[i:i + {n - 1}], ' ') AS f FROM (SELECT corpus, id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words)" for n in range(1, LONGEST_RUN + 1)
)
#: For small tables: the crc32 of every distinct feature is worked out byte by byte.
SQL = rf"""WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
texts AS (SELECT 's' AS corpus, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (SELECT corpus, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS ({_FEATURES_SQL}),
counted AS (SELECT corpus, id, f, count(*) AS n FROM feats GROUP BY ALL),
bytes AS (SELECT f, list_transform(range(strlen(f)), lambda k: CAST('0x' || hex(encode(f))[2 * k + 1:2 * k + 2] AS BIGINT)) AS b FROM (SELECT DISTINCT f FROM counted)),
buckets AS (SELECT f, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc),
held AS (SELECT corpus, id, bucket, sum(n) AS n FROM counted JOIN buckets USING (f) GROUP BY ALL),
per AS (SELECT bucket, coalesce(sum(n) FILTER (corpus = 's'), 0) AS s, coalesce(sum(n) FILTER (corpus = 't'), 0) AS t FROM held GROUP BY bucket),
every AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM per),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + {BUCKETS}) / ((s + 1)::DOUBLE * (all_t + {BUCKETS})))) AS BIGINT) AS g FROM per, every),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM held JOIN gain USING (bucket) WHERE corpus = 's' GROUP BY id),
scored AS (SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{SEED}:' || w.id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words w LEFT JOIN weights ON weights.id = w.id WHERE corpus = 's'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM placed"""
