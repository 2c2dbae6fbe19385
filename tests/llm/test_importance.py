from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from furrow.llm import importance, ordering

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    s, t, rows = Counter(), Counter(), []
    for text in target:
        t.update(features(text)[1])
    for i, text in docs:
        rows.append((i, *features(text)))
        s.update(rows[-1][2])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (S + 10_000) / ((s[k] + 1) * (T + 10_000)))) for k in range(10_000)]
    out = []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[k] for k in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for r, o in enumerate(drawn[: 5 * len(drawn) // 100]):
        o[4] = r + 1
    return sorted([tuple(o[:5]) for o in out], key=repr)


def check(docs, target):
    got = sorted(map(tuple, importance.resample(docs, target).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    return got


def test_whole_tables(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sum(r[4] is not None for r in got) > 5


def test_odd_rows(spark, odd, nothing):
    target = spark.createDataFrame([("Quick brown FOX",), (None,), ("",), ("word word",)], "text string")
    check(odd, target)
    check(odd, target.limit(0))
    assert importance.resample(nothing, target).count() == 0
    # many rows of one id: each counts, the equal ones are ranked one after the other
    many = odd.where("doc_id IN (1, 10)").crossJoin(spark.range(50).select(F.col("id").alias("again")))
    got = check(many, target)
    assert sorted(r[4] for r in got if r[4] is not None) == list(range(1, 5 * 50 // 100 + 1)) or len(got) == 100


def test_crc_of_runs_at_every_length():
    r = np.random.default_rng(3)
    size = np.array([0, 1, 2, 255, 256, 257, 511, 512, 70_000])
    tails = [bytes(r.integers(97, 123, n, dtype=np.uint8)) for n in size]
    head = b"some text"
    got = importance.shifted(np.full(len(size), zlib.crc32(head), np.uint32), size) ^ np.array([zlib.crc32(t) for t in tails], np.uint32)
    assert got.tolist() == [zlib.crc32(head + t) for t in tails]


def test_runs_stay_inside_their_text():
    texts = ["A b\tc d", "", "e", "F3 g-h i \x00 j", "日本 語 x"]
    crc, size, at = importance.batch_words([t.encode() for t in texts])
    assert np.diff(at).tolist() == [len(WORD.findall(t.lower())) for t in texts]
    want = [[zlib.crc32(" ".join(w[i : i + n]).encode()) for w in map(WORD.findall, map(str.lower, texts)) for i in range(len(w) - n + 1)] for n in (1, 2, 3)]
    assert [c[inside].tolist() for c, inside in importance.runs(crc, size, at)] == want


def test_positions(spark):
    rows = [(None if i % 4 == 0 else "hot" if i % 4 < 3 else f"k{i % 7}", i // 9, "same" if i % 2 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v long, x string")
    got = ordering.positions(df, ["k"], [F.col("v").desc()], "test").collect()
    assert sorted(((r.k, r.v, r.x) for r in got), key=repr) == sorted(rows, key=repr)
    for k in {r.k for r in got}:
        own = sorted((r for r in got if r.k == k), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own))) and {r.total for r in own} == {len(own)}
        assert [r.v for r in own] == sorted((r.v for r in own), reverse=True)
