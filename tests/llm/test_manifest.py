from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from furrow.llm import merkle


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def around(tree, i):
    out = []
    for nodes in tree[:-1]:
        a = i - i % 16
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 16])))
        i //= 16
    return out


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text)"""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = around(trees[s], i) + around(top, k)
            text = r[4]
            if zlib.crc32(("null" if r[0] is None else str(r[0])).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            h = leaf((*r[:4], text))
            for a, b in path:
                h = H(a + h + b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def check(df):
    rows = [tuple(r) for r in df.select(*merkle.FIELDS).collect()]
    assert sorted(map(tuple, merkle.manifest(df).collect()), key=repr) == brute(rows)


def test_odd_rows(odd, nothing):
    check(odd)
    assert merkle.manifest(nothing).count() == 0
    check(odd.where("doc_id = 7"))  # a lone leaf is root, and its proof is the hash of nothing


@pytest.mark.parametrize("n", [16, 17, 256, 257, 4_097, 8_500])
def test_ragged_trees(spark, n):
    """One source with n rows next to 18 with few: runs of one node, and rounds with stand-in partners."""
    i = F.col("doc_id")
    df = spark.range(n + 40).withColumnRenamed("id", "doc_id").select(
        "doc_id", F.when(i < n, F.lit("hot")).when(i % 3 > 0, F.concat(F.lit("s"), (i % 18).cast("string"))).alias("source"), F.lit("en").alias("lang"),
        F.length(i.cast("string")).cast("long").alias("n_chars"), F.concat(F.lit("Row "), i.cast("string")).alias("text"),
    )
    check(df)


def test_butterfly_gives_every_partition_its_path(spark):
    for count in (1, 2, 15, 16, 17, 31, 256, 300, 4_100):
        nodes = spark.range(count).select(F.lit("t").alias("tree"), F.col("id").alias("idx"), F.lit(count).cast("long").alias("count"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
        tree = levels([H(str(i)) for i in range(count)])
        got = {r.idx: (r.digest, [(p.left, p.right) for p in r.path]) for r in merkle.butterfly(nodes, count).collect()}
        assert got == {i: (tree[-1][0], around(tree, i)) for i in range(count)}
