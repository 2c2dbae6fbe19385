"""Toxicity: a logistic classifier regularised by counterfactuals of identity mentions.

Each labelled sentence is paired with a copy in which its identity terms are swapped for
others of the same kind, or, where it has none, one is put in. The fit penalises the squared
change of score between the two, so mentioning a group by itself carries no weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import remainder, short_batches, whole_text

#: Rows of either class that the fit may use, drawn by the hash of their id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
FEATURES = 4_096
#: Standard errors by which a feature's log odds between the classes must differ from 0.
LEAST_GAIN = 2.5
BITS = 20
THRESHOLD = 0.7

# Terms that name people by group, by kind and language.
IDENTITY = {
    "gender": "woman man women men girl boy female male frau mann frauen männer femme homme femmes hommes mujer hombre mujeres hombres",
    "religion": "muslim christian jewish hindu buddhist atheist catholic muslime christen juden hindus musulman chrétien juif musulmán cristiano judío",
    "origin": "african asian european american arab latino german french spanish turkish chinese indian afrikaner asiaten africain asiatique africano asiático",
    "colour": "black white brown schwarze weiße noir blanc negro blanco",
    "orientation": "gay lesbian straight bisexual queer transgender schwul lesbisch lesbienne lesbiana",
    "status": "immigrant refugee migrant foreigner native disabled deaf blind elderly einwanderer flüchtling ausländer immigré réfugié inmigrante refugiado",
}
GROUPS = {w: words.split() for words in IDENTITY.values() for w in words.split()}
TERMS = sorted(GROUPS)
WORD = re.compile(r"[^\W\d_]+")
MASK = (1 << BITS) - 1


def word_features(word: str) -> tuple[int, ...]:
    """A word, and for longer ones their first four and five letters, as hashed features."""
    out = [zlib.crc32(word.encode()) & MASK]
    if len(word) > 4:
        out.append(zlib.crc32(b"4" + word[:4].encode()) & MASK)
    if len(word) > 5:
        out.append(zlib.crc32(b"5" + word[:5].encode()) & MASK)
    return tuple(out)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(words: set[str]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def counterfactual(words: set[str], salt: int) -> set[str]:
    """The same words with each identity term swapped for another of its kind, or with one put in."""
    found = [w for w in words if w in GROUPS]
    if not found:
        return words | {TERMS[salt % len(TERMS)]}
    out = words - set(found)
    for w in found:
        others = [x for x in GROUPS[w] if x != w]
        out.add(others[(salt + zlib.crc32(w.encode())) % len(others)])
    return out


@dataclass(frozen=True)
class Toxicity:
    """Weights of the features that carry any, and the intercept."""

    weights: dict[int, float]
    bias: float

    def scorer(self):
        """text -> score in 0..1; the cache of words is emptied whenever it is full."""
        weights, seen = self.weights, {}

        def hits(word: str) -> tuple[int, ...]:
            if len(seen) > 300_000:
                seen.clear()
            got = seen[word] = tuple(f for f in word_features(word) if f in weights)
            return got

        def score(text: str) -> float:
            on = set()
            for w in words_of(text):
                f = seen.get(w)
                if f is None:
                    f = hits(w)
                if f:
                    on.update(f)
            z = self.bias + sum(weights[f] for f in sorted(on))
            return float(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))

        return score


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """(text, toxic) of at most so many training rows of each class: those of least id hash.

    Training rows are those whose crc32(doc_id as text) mod 3 is not 1. A doc_id labelled more
    than once is toxic if any label says so; NULL labels and ids are left out.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(remainder(3) != 1)
    own = own.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("__toxic")).withColumn("__draw", F.xxhash64("__id"))
    parts = [own.where(where).orderBy("__draw", "__id").limit(n) for where, n in (("__toxic >= 1", toxic), ("__toxic < 1", clean))]
    small = parts[0].unionByName(parts[1])  # at most toxic + clean rows of three numbers
    return docs.join(F.broadcast(small), docs["doc_id"] == small["__id"]).select(whole_text().alias("text"), F.col("__toxic").cast("int").alias("toxic"))


def fit(sample: DataFrame, prior: float = 1.0, fairness: float = 1.0, steps: int = 250) -> Toxicity:
    """Train on the sample; what reaches the driver is its hashed features, bounded by the sample's size.

    Without labelled rows, or with one class only, the score is constant: near 0, or near 1 if all are toxic.
    """

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, twin = [], []
            for t in b.column(0).to_pylist():
                w = words_of(t)
                own.append(np.fromiter(sorted(features_of(w)), np.int32))
                twin.append(np.fromiter(sorted(features_of(counterfactual(w, zlib.crc32(t.encode())))), np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, kind), pa.array(twin, kind)], ["toxic", "own", "twin"])

    got = sample.mapInArrow(featurise, "toxic int, own array<int>, twin array<int>").toArrow()
    return solve(got, prior, fairness, steps)


def solve(got: pa.Table, prior: float, fairness: float, steps: int) -> Toxicity:
    got = got.combine_chunks()
    y = got.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Toxicity({}, -35.0 if not len(y) or y.max() < 1 else 35.0)

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        col = got.column(name).chunk(0) if isinstance(got.column(name), pa.ChunkedArray) else got.column(name)
        ids = col.flatten().to_numpy()
        return ids, np.repeat(np.arange(len(y)), np.diff(col.offsets.to_numpy()))

    (own, row), (twin, twin_row) = flat("own"), flat("twin")
    n1, n0 = y.sum(), len(y) - y.sum()
    d1 = np.bincount(own, weights=y[row], minlength=MASK + 1)
    d0 = np.bincount(own, minlength=MASK + 1) - d1
    gain = np.abs(np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1))) / np.sqrt(1 / (d1 + 0.5) + 1 / (d0 + 0.5))
    gain[(d1 + d0 < 3) | (gain < LEAST_GAIN)] = 0
    chosen = np.argsort(-gain, kind="stable")[:FEATURES]
    chosen = np.union1d(chosen[gain[chosen] > 0], sorted(f for t in TERMS for f in word_features(t)))
    place = np.full(MASK + 1, -1)
    place[chosen] = np.arange(len(chosen))

    def kept(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = place[ids]
        return at[at >= 0], rows[at >= 0]

    (f, r), (tf, tr) = kept(own, row), kept(twin, twin_row)
    k, n = len(chosen), len(y)
    w, b = np.zeros(k), 0.0
    share = np.where(y > 0, n / (2 * n1), n / (2 * n0))  # both classes weigh alike
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    dot = lambda w, f, r: np.bincount(r, weights=w[f], minlength=n)
    for step in range(1, steps + 1):
        z = dot(w, f, r)
        change = z - dot(w, tf, tr)
        e = share * (1 / (1 + np.exp(-np.clip(z + b, -35, 35))) - y)
        pull = 2 * fairness * change
        g = np.bincount(f, weights=(e + pull)[r], minlength=k) - np.bincount(tf, weights=pull[tr], minlength=k)
        g = np.append(g / n + prior / n * w, e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Toxicity({int(i): float(x) for i, x in zip(chosen, w) if abs(x) > 1e-3}, float(b))


def score_column(model: Toxicity, name: str = "text") -> Column:
    """Score of a whole text (NULL as empty), 0 to 1."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = model.scorer()
        for texts in batches:
            yield pa.array([score(t) for t in texts.to_pylist()], pa.float64())

    return scored(whole_text(name))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is an input of a score, so repeated texts score alike. Empty and NULL texts
    score by the intercept. Without labelled rows of both classes the score is near 0 (or 1 if
    all labels are toxic). Other columns are ignored.
    """
    short_batches(docs.sparkSession)
    model = fit(labelled_sample(docs, labels))
    s = docs.select("doc_id", (remainder(3) == 1).alias("held_out"), score_column(model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    short_batches(docs.sparkSession)
    model = fit(labelled_sample(docs, labels))
    return docs.withColumn("__score", score_column(model)).where(F.col("__score") < THRESHOLD).select(*docs.columns)
