"""Merkle manifest of a dataset: a root over all rows, and each row's proof of belonging to it.

Rows are leaves, ordered by id inside their source; every 16 consecutive nodes become one until
a source has one root, and the sources' roots form the upper tree in the same way. Leaves are
packed into aligned blocks of 256, the partitions of the exchange. Block roots then climb by a
butterfly: in round r the aligned group of up to 16 partitions that differ in the r-th digit of
their number swap the roots they have reached, and each hashes the parent itself. Every partition
so holds its ancestors and their siblings after the last round; nothing is handed down. In the
last, ragged group a smaller member sends its root to several partners, in place of those it lacks.
The trees over the sources climb in the same way, with one partition for each source.

A round shuffles one short row per partition, in groups of at most 16.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import written
from furrow.llm.ordering import positions

FANOUT = 16
BLOCK_LEVELS = 2
BLOCK = FANOUT**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 5


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its UTF-8 length in front; NULL is a dash."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z only; other letters and NULL stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and, where the row is tampered with, the digest of the changed row."""
    values = [F.col(f) for f in FIELDS]
    changed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % TAMPER == 0
    other = [lowered(v) if f == "text" else v for f, v in zip(FIELDS, values)]
    return docs.select("doc_id", "source", leaf_digest(values).alias("leaf"), F.when(changed, leaf_digest(other)).alias("tampered"))


def in_runs(nodes: list[str]) -> list[str]:
    return [sha("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)]


def block_levels(nodes: list[str], total: int) -> list[list[str]]:
    """The levels of a block whose tree has ``total`` leaves: up to its root, or the tree's."""
    out, step = [nodes], 1
    while step < min(total, BLOCK):
        out.append(in_runs(out[-1]))
        step *= FANOUT
    return out


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """(left, right) of the run's other nodes at each level below the last, for leaf i."""
    out = []
    for nodes in levels[:-1]:
        a = i - i % FANOUT
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + FANOUT])))
        i //= FANOUT
    return out


def butterfly(nodes: DataFrame, longest: int) -> DataFrame:
    """Trees of ``count`` partitions, numbered by ``idx``: each partition with its tree's root and its path.

    Takes (tree, idx, count, digest) and adds to them a ``path`` of (left, right) sibling digests,
    nearest first; ``digest`` becomes the root. ``longest`` is the largest count.
    """
    pair = "array<struct<left:string,right:string>>"
    d = nodes.select("tree", "idx", "count", "digest", F.array().cast(pair).alias("path"))
    step = 1
    while step < longest:
        low, above = F.col("idx") % step, F.floor(F.col("idx") / step)
        under = F.least(F.lit(step), F.col("count") - above * step)  # partitions below this ancestor
        most = F.least(F.lit(step), F.col("count")) - 1
        sent = d.withColumn("to", F.explode(F.sequence(low, F.greatest(low, most), under)))
        own = F.when(F.col("to") == low, F.struct("idx", "count", "path"))
        sent = sent.select("tree", F.floor(above / FANOUT).alias("group"), "to", F.struct((above % FANOUT).alias("digit"), "digest", own.alias("own")).alias("m"))
        met = sent.groupBy("tree", "group", "to").agg(F.sort_array(F.collect_list("m")).alias("all"))
        met = met.withColumn("me", F.explode(F.filter("all", lambda m: m["own"].isNotNull())))
        joined = lambda keep: F.array_join(F.transform(F.filter("all", keep), lambda m: m["digest"]), "")
        left, right = joined(lambda m: m["digit"] < F.col("me.digit")), joined(lambda m: m["digit"] > F.col("me.digit"))
        more = F.col("me.own.count") > step  # a tree with one node left is done
        d = met.select(
            "tree", F.col("me.own.idx").alias("idx"), F.col("me.own.count").alias("count"),
            F.when(more, F.sha2(joined(lambda m: F.lit(True)).cast("binary"), 256)).otherwise(F.col("me.digest")).alias("digest"),
            F.when(more, F.concat("me.own.path", F.array(F.struct(left.alias("left"), right.alias("right"))).cast(pair))).otherwise(F.col("me.own.path")).alias("path"),
        )
        step *= FANOUT
    return d


def _block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        roots = [block_levels([n["leaf"] for n in nodes], total)[-1][0] for nodes, total in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.string())], [*b.schema.names, "digest"])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, cols = [], [[] for _ in range(6)]
        for row in b.select(["total", "nodes", "subroot", "path", "upper", "root"]).to_pylist():
            levels = block_levels([n["leaf"] for n in row["nodes"]], row["total"])
            outer = [(p["left"], p["right"]) for p in row["path"] + row["upper"]]
            for i, n in enumerate(row["nodes"]):
                path = siblings(levels, i) + outer
                top = n["leaf"] if n["tampered"] is None else n["tampered"]
                for left, right in path:
                    top = sha(left + top + right)
                ids.append(n["doc_id"])
                for c, v in zip(cols, (n["leaf"], row["subroot"], row["root"], sha("".join(x + y for x, y in path)), top, top == row["root"])):
                    c.append(v)
        kind = b.schema.field("nodes").type.value_type.field("doc_id").type
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), *map(pa.array, cols[:5], [pa.string()] * 5), pa.array(cols[5], pa.bool_())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    NULL values have their own mark in a leaf and are not the same as empty ones; NULL sources are
    a source, the first one, and NULL ids come first inside it. Rows that repeat an id are leaves
    of their own, next to each other in order of their digests; equal rows are equal leaves. A row
    is tampered with by the hash of its id (a NULL id counts as the text 'null'), even where that
    changes nothing. No rows give no rows. Columns that the leaf does not name are ignored.
    """
    rows = leaves(docs)
    placed = positions(rows, ["source"], [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "merkle")
    block = F.floor(F.col("position") / BLOCK)
    packed = placed.groupBy("source", block.alias("block"), "total").agg(F.sort_array(F.collect_list(F.struct("position", "doc_id", "leaf", "tampered"))).alias("nodes"))
    source = packed.schema["source"].dataType.simpleString()
    nodes = packed.schema["nodes"].dataType.simpleString()
    blocks = written(packed.mapInArrow(_block_roots, f"source {source}, block long, total long, nodes {nodes}, digest string"), "merkle-blocks")

    most = blocks.agg(F.max("block")).first()[0]
    count = F.ceil(F.col("total") / BLOCK)
    low = butterfly(blocks.select(F.col("source").alias("tree"), F.col("block").alias("idx"), count.alias("count"), "digest"), (most or 0) + 1)
    low = written(low, "merkle-paths")

    heads = low.where("idx = 0").select(F.col("tree").alias("source"), "digest")
    heads = positions(heads, [], [F.col("source").asc_nulls_first()], "merkle-sources")
    heads = written(heads, "merkle-heads")
    sources = heads.count()
    top = butterfly(heads.select(F.lit(0).alias("tree"), F.col("position").alias("idx"), F.col("total").alias("count"), "digest"), sources)
    top = heads.select("source", "position").join(top.select(F.col("idx").alias("position"), F.col("digest").alias("root"), F.col("path").alias("upper")), "position")

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    low = low.select(F.col("tree").alias("s1"), "idx", F.col("digest").alias("subroot"), "path")
    full = blocks.drop("digest").join(low, same("source", "s1") & same("block", "idx"))
    full = full.join(top.select(F.col("source").alias("s2"), "root", "upper"), same("source", "s2"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return full.select("total", "nodes", "subroot", "path", "upper", "root").mapInArrow(_proofs, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _tree_sql(name: str, levels: int) -> str:
    """Level by level: nodes ``<name>0`` (tree, pos, h, cnt) upwards, and each node's siblings."""
    out = []
    for i in range(levels):
        near = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(
            f"{name}s{i} AS (SELECT tree, pos, cnt, coalesce(string_agg(h, '') OVER ({near} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo, "
            f"coalesce(string_agg(h, '') OVER ({near} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM {name}{i})"
        )
        out.append(
            f"{name}{i + 1} AS (SELECT tree, pos // 16 AS pos, CASE WHEN cnt = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, "
            f"(cnt + 15) // 16 AS cnt FROM {name}{i} GROUP BY tree, pos // 16, cnt)"
        )
    return ", ".join(out)


def _climb_sql(prefix: str, name: str, levels: int, tree: str, pos: str) -> str:
    """One CTE per level: the digest carried by a leaf and what it has seen of siblings."""
    return ", ".join(
        f"{prefix}{i + 1} AS (SELECT p.* EXCLUDE (f, proof), CASE WHEN s.cnt > 1 THEN sha256(s.lo || p.f || s.hi) ELSE p.f END AS f, "
        f"CASE WHEN s.cnt > 1 THEN p.proof || s.lo || s.hi ELSE p.proof END AS proof FROM {prefix}{i} p JOIN {name}s{i} s ON s.tree IS NOT DISTINCT FROM p.{tree} AND s.pos = p.{pos} // {16**i})"
        for i in range(levels)
    )


def sql(levels: int = 6, upper: int = 4) -> str:
    """DuckDB SQL of the manifest for up to 16^levels rows in a source and 16^upper sources."""
    size = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(size(c) for c in FIELDS[:-1])
    return f"""WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
h AS (SELECT doc_id, source, sha256({head} || {size("text")}) AS leaf, sha256({head} || {size(low)}) AS other,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {TAMPER} = 0 AS changed
  FROM documents, crc),
n AS (SELECT doc_id, source, leaf, CASE WHEN changed THEN other ELSE leaf END AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS cnt FROM h),
a0 AS (SELECT source AS tree, pos, leaf AS h, cnt FROM n), {_tree_sql("a", levels)},
b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS cnt, tree AS source FROM a{levels}), {_tree_sql("b", upper)},
p0 AS (SELECT n.doc_id, n.source, n.pos, n.leaf, n.f, '' AS proof, b0.h AS subroot, b0.pos AS place, 0 AS top FROM n JOIN b0 ON b0.source IS NOT DISTINCT FROM n.source), {_climb_sql("p", "a", levels, "source", "pos")},
q0 AS (SELECT * FROM p{levels}), {_climb_sql("q", "b", upper, "top", "place")}
SELECT doc_id, leaf, subroot, b{upper}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b{upper}.h AS verified FROM q{upper}, b{upper}"""
