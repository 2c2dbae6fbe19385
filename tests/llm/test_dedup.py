from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from furrow.llm import exact_dedup, near_dedup

SF = "/root/testdata/sf0.001"


def test_binary_fuse_filter():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000, 40_000):
        keys = r.integers(0, 2**60, n, dtype=np.uint64)
        f = exact_dedup.BinaryFuse.load(exact_dedup.BinaryFuse.build(np.append(keys, keys)).dump())
        assert f.contains(keys).all()
        assert f.contains(r.integers(2**60, 2**61, 50_000, dtype=np.uint64)).mean() < 0.001


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {(i, t): (min(groups[g])[3], len(groups[g]), hashlib.sha256(g.encode()).hexdigest()) for i, t in rows for g in [re.sub(r"[\x20\x09-\x0D]", "", t or "")]}


def test_exact_groups_on_odd_rows(odd, nothing):
    got = exact_dedup.exact_groups(*exact_dedup.halves(odd)).collect()
    want = brute_exact([(r.doc_id, r.text) for r in odd.collect()])
    assert len(got) == odd.count()
    assert sorted((r.keep_id or -1, r.group_size, r.text_sha256) for r in got) == sorted((want[r.doc_id, r.text][0] or -1, *want[r.doc_id, r.text][1:]) for r in odd.collect())
    assert exact_dedup.exact_groups(nothing, nothing).count() == 0
    stay = exact_dedup.drop_copies(odd)
    assert stay.columns == odd.columns
    # 3 differs in case; the three blank texts are one group, of which the longest stays
    assert sorted(r.doc_id or -1 for r in stay.collect()) == [-1, 1, 3, 6, 7, 9, 10, 11, 12]


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_near(rows, k=4):
    sets = {i: shingles(t, k) for i, t in rows}
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                p, q = sorted((find(a), find(b)))
                low[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_groups_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(d).collect()}
    assert got == brute_near([(r.doc_id, r.text) for r in d.collect()])


def test_near_groups_on_odd_rows(odd, nothing):
    got = near_dedup.near_groups(odd)
    want = brute_near([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None])
    rows = got.collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert near_dedup.near_groups(nothing).count() == 0
    assert sorted(r.doc_id or -1 for r in near_dedup.keep_one(odd).collect()) == [-1, 1, 4, 5, 6, 7, 9, 10, 11, 12, 12]


@pytest.mark.parametrize("copies", [400])
def test_a_large_group_and_a_common_passage(spark, copies):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, base.replace(f"w{i % 190} ", f"v{i} ")) for i in range(copies)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + i, passage + " " + " ".join(f"u{i}_{j}" for j in range(60))) for i in range(150)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {c for i, (_, c) in got.items() if i < copies} == {0}
    assert all(c == i for i, (_, c) in got.items() if i >= 1000)


def test_parity_sketch_keeps_linked_pairs():
    rng = np.random.default_rng(5)
    for n in (5, 40, 300, 4000):
        for _ in range(30):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[n // 9 :], rng.integers(0, 2**63, n // 9, dtype=np.uint64)])
            assert 100 * (n - n // 9) >= 80 * (n + n // 9)
            odd = near_dedup._group_values([np.unique(a), np.unique(b)])[1].view(np.uint64)
            assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= near_dedup.most_bins(np.array([2 * n]), 80)[0]
