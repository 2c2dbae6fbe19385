from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

from furrow.llm import lm_scoring as L

SF = "/root/testdata/sf0.001"
END = object()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), END]


def brute(rows):
    """doc_id -> (n_tokens, n_known, base, score) from dictionaries, with counts of bigrams rounded down to powers of two."""
    docs = [(i, zlib.crc32(str(i).encode()) % 10 == 0, tokens(t)) for i, t in rows]
    train = [t for _, held, t in docs if not held]
    uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(uni.values()), len(uni)
    den = n + L.SMOOTH * (v + 1)
    level = {p: 1 << int(math.log2(c)) for p, c in bi.items() if c >= 2}
    hist = np.zeros((64, L.BINS))
    for t in train:
        for a, b in zip(t, t[1:]):
            if uni[a] > 1:
                seen = min(level.get((a, b), 0), uni[a], uni[b])
                ratio = (seen / 2 if seen > 2 else 0.0) / (uni[a] - 1) / ((uni[b] - 1 + L.SMOOTH) / den)
                hist[int(math.log2(uni[a])), min(max(math.floor(4 * math.log2(ratio)) + L.BIN_ZERO, 1), L.BINS - 1) if ratio > 0 else 0] += 1
    value = [0.0, *(2.0 ** ((k - L.BIN_ZERO) / 4) for k in range(1, L.BINS))]
    grid = np.linspace(0, 0.95, 96)
    weight = [grid[np.argmax([h @ np.log(1 - g + g * np.array(value)) for g in grid])] for h in hist]
    out = {}
    for i, _, t in docs:
        base = score = 0.0
        for k, w in enumerate(t):
            p = (uni[w] + L.SMOOTH) / den
            base += math.log10(p)
            past = uni[t[k - 1]] if k else 0
            if past:
                g = weight[int(math.log2(past))]
                p = (1 - g) * p + g * min(level.get((t[k - 1], w), 0), past, uni[w]) / past
            score += math.log10(p)
        out[i] = (len(t), sum(uni[w] > 0 for w in t), base, score)
    return out


def check(got, want):
    far = []
    for r in got:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (n, known) and math.isclose(r.base_score, base, rel_tol=1e-9)
        far.append(abs(r.score - score) / n)
    # the filter answers for a few bigrams that it does not hold
    assert max(far) < 0.05 and np.median(far) < 1e-3
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_scores_against_dictionaries_both_ways(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in d.collect()])
    check(L.score_documents(d).collect(), want)
    monkeypatch.setattr(L, "HEAD_WORDS", 5)
    monkeypatch.setattr(L, "BLOCK_BYTES", 20_000)
    check(L.score_documents(d.repartition(3)).collect(), want)


def with_singles(rows):
    """doc_id -> score as in ``brute``, of a filter that holds every bigram."""
    docs = [(i, zlib.crc32(str(i).encode()) % 10 == 0, tokens(t)) for i, t in rows]
    train = [t for _, held, t in docs if not held]
    uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(t, t[1:]))
    den = sum(uni.values()) + L.SMOOTH * (len(uni) + 1)
    level = {p: 1 << int(math.log2(c)) for p, c in bi.items()}
    model, hist = L.Model(sum(uni.values()), len(uni), singles=True), np.zeros((64, L.BINS))
    for t in train:
        for a, b in zip(t, t[1:]):
            if uni[a] > 1:
                seen = min(level[a, b], uni[a], uni[b])
                ratio = (seen / 2 if seen > 1 else 0.0) / (uni[a] - 1) / ((uni[b] - 1 + L.SMOOTH) / den)
                hist[int(math.log2(uni[a])), min(max(math.floor(4 * math.log2(ratio)) + L.BIN_ZERO, 1), L.BINS - 1) if ratio > 0 else 0] += 1
    model.fit_weights(hist.reshape(-1))
    out = {}
    for i, _, t in docs:
        out[i] = 0.0
        for k, w in enumerate(t):
            p, past = (uni[w] + L.SMOOTH) / den, uni[t[k - 1]] if k else 0
            if past:
                g = model.weights[int(math.log2(past))]
                p = (1 - g) * p + g * min(level.get((t[k - 1], w), 0), past, uni[w]) / past
            out[i] += math.log10(p)
    return out


def test_the_query_keeps_bigrams_seen_once(spark, monkeypatch):
    from furrow.llm.queries import QUERIES

    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = with_singles([(r.doc_id, r.text) for r in d.collect()])
    for name, most in ((None, None), ("HEAD_WORDS", 5)):
        if name:
            monkeypatch.setattr(L, name, most)
        got = QUERIES["op2_lm_scoring"](spark, SF).collect()
        far = [abs(r.score - want[r.doc_id]) / r.n_tokens for r in got]
        assert len(got) == len(want) and max(far) < 0.05 and np.median(far) < 1e-3


def test_every_bigram_reaches_a_level(spark):
    d = spark.createDataFrame([("a b " * 40,), ("c d",), ("c d",), ("e f",)], "text string")
    model, _ = L.train(d, singles=True)
    toks, at = L.token_hashes(*L.utf8_buffers(L.pa.array(["a b", "c d", "e f", "b c"])))
    assert model.grams.counts(L.bigrams(toks, at)).tolist() == [0, 32, 1, 0, 2, 2, 0, 1, 1, 0, 0, 0]


def test_blocks_meet_the_tables_in_turns(spark, monkeypatch, tmp_path):
    """The joined way never has all blocks' questions on disk at once, drops what it has read, and scores alike."""
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.3, 200) % 5_000)) for i in range(400)] + [(None, None), (7, "w1 w2")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    want = {repr(x) for x in L.score_documents(d, singles=True).select("doc_id", "n_tokens", "n_known").collect()}
    near = sorted((x.doc_id or 0, x.score) for x in L.score_documents(d, singles=True).collect())
    monkeypatch.setattr("furrow.session.checkpoint_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(L, "HEAD_WORDS", 5)
    met, seen = L.joined_counts, []

    def watched(blocks, *rest):
        seen.append((blocks.count(), {p.name.split("-")[2] for p in tmp_path.glob("furrow-lm-*")}))
        return met(blocks, *rest)

    monkeypatch.setattr(L, "joined_counts", watched)
    out = L.score_documents(d, singles=True)
    got = out.collect()
    total = sum(n for n, _ in seen)
    assert total >= 20 and max(n for n, _ in seen) <= 0.4 * total
    assert all(not {"words", "bigrams"} & names for _, names in seen)
    assert {p.name.split("-")[2] for p in tmp_path.glob("furrow-lm-*")} == {"joined"}
    assert {repr(x) for x in out.select("doc_id", "n_tokens", "n_known").collect()} == want
    assert np.allclose([s for _, s in sorted((x.doc_id or 0, x.score) for x in got)], [s for _, s in near], rtol=1e-9)
