"""Secret scans: fixed patterns, and spans that a character model takes for random strings.

Two order-2 character Markov models, one of random strings and one of ordinary words and
identifiers, are compared by log-likelihood ratio per character. Both are trained from labelled
samples: values that the fixed patterns find, and drawn strings, against words of the corpus and
identifiers made of them. Rows whose crc32(doc_id as text) mod 10 is 0 are never learnt from.
The ratio from which a candidate counts is learnt too, from words that neither model has seen.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import remainder, short_batches, whole_text

# The patterns, their kinds in the order of equal starts, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: A candidate of fewer different letters and digits is a rule or a filler, not a random string.
LEAST_DIFFERENT = 6
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(256, len(LETTERS), np.int64)
CODE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
#: Log-likelihood ratio per character, in nats, below which no candidate counts as random.
RATIO = 1.3
#: Share of the ordinary words kept apart that may reach the learnt ratio.
MAY_PASS = 0.0005
SAMPLE_VALUES, VALUE_CHARS = 200_000, 256
SAMPLE_TEXTS = 2_000
#: Labelled ordinary: words that names in code, settings and paths are made of, as the corpus may hold none of them.
CODE_WORDS = """
abstract access account action active adapter address after agent alias allow amount api app append application archive argument array
asset async attach attribute audit auth author auto backend background backup base batch before begin binary block body boolean boundary
branch bridge browser bucket buffer build bundle button byte cache callback cancel capacity category certificate change channel character
check checksum child chunk class clean client clock clone close cluster code collection color column command comment commit common
compare compile complete component compress config connection console constant container content context control convert cookie copy core
count create credential current cursor custom daemon dashboard data database date debug decode default delegate delete delta deploy depth
""".split()

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns as (kind, start, end) in code points, in order of start."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    # a run of the alphabet that is too short holds no longer one, so the least length may stand in the pattern
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Markov:
    """Order-2 character model over the candidates' alphabet, backed by order 1, with add-half smoothing there."""

    def __init__(self, samples: Iterable[str], weight: float = 5.0):
        n = len(LETTERS) + 1
        counts = np.zeros((n, n, n))
        for s in samples:
            a, b, c = self.triples(s)
            np.add.at(counts, (a, b, c), 1)
        one = counts.sum(axis=0) + 0.5
        one /= one.sum(axis=1, keepdims=True)
        self.log = np.log((counts + weight * one[None]) / (counts.sum(axis=2, keepdims=True) + weight))

    @staticmethod
    def triples(s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each character with the two before it; what stands before the first is the code outside the alphabet."""
        c = CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
        c = np.concatenate([np.full(2, len(LETTERS)), c])
        return c[:-2], c[1:-1], c[2:]


def apart(spans: list[Span]) -> list[tuple[int, int]]:
    """The spans as (start, end) without overlaps, in order; the spans come by start."""
    out: list[tuple[int, int]] = []
    for _, a, e in spans:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((a, e))
    return out


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Candidates that overlap none of the taken stretches, in one walk over both lists."""
    k = 0
    for m in CANDIDATE.finditer(text):
        a, e = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if (k == len(taken) or e <= taken[k][0]) and len({c for c in m.group() if c.isalnum()}) >= LEAST_DIFFERENT:
            yield a, e


class SecretModel:
    """Log-likelihood ratio of the two models per character, and the ratio from which a candidate is taken."""

    def __init__(self, random_strings: Iterable[str], ordinary: Iterable[str], kept_apart: Iterable[str] = ()):
        self.table = Markov(random_strings).log - Markov(ordinary).log
        plain = [self.ratio(w) for w in kept_apart]
        self.least = max(RATIO, float(np.quantile(plain, 1 - MAY_PASS)) if plain else RATIO)

    def ratio(self, s: str) -> float:
        return float(self.table[Markov.triples(s)].mean()) if s else -math.inf

    def found(self, text: str, taken: list[tuple[int, int]]) -> list[Span]:
        """What the models alone take for random, outside the taken stretches."""
        return [("random", a, e) for a, e in candidates(text, taken) if self.ratio(text[a:e]) >= self.least]

    def spans(self, text: str) -> list[Span]:
        """Base spans, and random-looking candidates that overlap none of them."""
        base = base_spans(text)
        return sorted(base + self.found(text, apart(base)), key=lambda s: (s[1], KINDS.index(s[0])))


def drawn_strings(n: int, seed: int = 7) -> list[str]:
    """Random strings over the alphabets secrets are written in."""
    r = random.Random(seed)
    kinds = [LETTERS[:62], LETTERS[:26] + LETTERS[52:62], "0123456789abcdef", LETTERS[:64], LETTERS[26:62], LETTERS]
    return ["".join(r.choices(kinds[i % len(kinds)], k=r.randint(12, 48))) for i in range(n)]


def identifiers(words: list[str], n: int, seed: int = 11) -> list[str]:
    """Ordinary names made of words, in snake, camel, kebab and path forms, and what else is written without spaces:
    numbers, dates and times, dashed groups, rules of one or two signs."""
    r, out = random.Random(seed), []
    if not words:
        return out
    number = lambda a, b: "".join(r.choices("0123456789", k=r.randint(a, b)))
    for i in range(n):
        some = r.choices(words, k=r.randint(1, 4))
        camel = "".join(w.capitalize() for w in some)
        forms = ("_".join(some), camel, "-".join(some), "/".join(some), "_".join(some).upper(), "".join(some) + number(1, 2), "/".join([*some, camel]), some[0] + camel,
                 number(8, 24), f"{number(4, 8)}-{number(2, 6)}-{number(2, 4)}", "-".join(number(3, 4) for _ in range(4)), "_".join(some) + number(1, 4) + "/" + some[0], "".join(r.choices("-=_/+", k=2)) * r.randint(3, 20))
        out.append(forms[i % len(forms)])
    return out


def train(docs: DataFrame, most: int = SAMPLE_TEXTS) -> SecretModel:
    """Fit both models on at most ``most`` texts, those of least id hash outside the held-out rows, and on drawn strings.

    Labels come from the patterns: what they find in the sample is random, its other words are
    ordinary. Only words and values leave the workers, at most 400 words a text, values by their
    first ``VALUE_CHARS`` characters, and of all these ``SAMPLE_VALUES`` of least hash. One word in
    five serves for the least ratio only. Without texts the models know drawn strings alone.
    """
    own = docs.where(remainder(10) != 0)
    picked = own.select("doc_id", F.xxhash64("doc_id").alias("draw")).distinct().orderBy("draw", "doc_id").limit(most)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, secret = [], []
            for t in b.column(0).to_pylist():
                base = base_spans(t)
                for kind, a, e in base:
                    m = ASSIGN.fullmatch(t, a, e) if kind == "assign" else None
                    value.append((m.group(2) if m else t[a:e])[:VALUE_CHARS])
                    secret.append(True)
                taken, k, plain = apart(base), 0, set()
                for m in re.finditer(r"[A-Za-z]{2,}", t):
                    while k < len(taken) and taken[k][1] <= m.start():
                        k += 1
                    if k == len(taken) or m.end() <= taken[k][0]:
                        plain.add(m.group()[:VALUE_CHARS])
                words = sorted(plain)[:: max(1, len(plain) // 400)]
                value += words
                secret += [False] * len(words)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.string()), pa.array(secret, pa.bool_())], ["value", "secret"])

    rows = own.join(F.broadcast(picked.select("doc_id")), "doc_id").select(whole_text().alias("text")).mapInArrow(label, "value string, secret boolean").distinct()
    rows = rows.orderBy(F.desc("secret"), F.xxhash64("value"), "value").limit(SAMPLE_VALUES).toArrow()
    value, secret = rows.column("value").to_pylist(), rows.column("secret").to_pylist()
    secrets = sorted(v for v, s in zip(value, secret) if s and len(v) >= 8)
    words = sorted(v for v, s in zip(value, secret) if not s)
    test = words[::5]
    learnt = [w for i, w in enumerate(words) if i % 5]
    plain = learnt + identifiers(learnt, 20_000) + identifiers(CODE_WORDS, 10_000)
    return SecretModel(secrets + drawn_strings(6_000), plain, [w for w in test + identifiers(test, 5_000, seed=13) if len(w) >= 12])


def scan_documents(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    NULL is the empty text: no spans, the digest of the empty string. Spans count code points
    of the whole text, however long: base spans and candidates are walked through once. Repeated rows give equal results; other columns are ignored.
    """
    import hashlib

    short_batches(docs.sparkSession)
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                spans = model.spans(t)
                base = [s for s in spans if s[0] != "random"]
                count = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                text = [",".join(f"{k}:{a}:{e}" for k, a, e in some) for some in (base, spans)]
                rows.append((*count, hashlib.sha256(text[0].encode()).hexdigest(), text[1]))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
