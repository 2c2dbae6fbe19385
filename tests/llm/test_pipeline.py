from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from furrow.llm import bpe, mixing
from furrow.llm.queries import ORACLES, QUERIES
from tests.llm.test_dedup import brute_exact, brute_near
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    status, _, _, detail = compare(spark, name, QUERIES[name], ORACLES[name], SF, con)
    assert status == "ok", detail


def test_every_operator_has_its_query():
    assert {re.match(r"op\d+_", n).group() for n in QUERIES} == {f"op{i}_" for i in range(1, 14)}


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    def step(name, d):
        stages[name](spark, d, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    clean = step("toxicity", docs)
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.collect()}
    assert sum(i not in kept for i, t in lab.items() if not t) <= 0.03 * len(lab)
    single = step("exact dedup", clean)
    want = brute_exact([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({v[0] for v in want.values()})
    near = step("near dedup", single)
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c in brute_near([(r.doc_id, r.text) for r in single.collect()], 5).values()})
    mixed = step("mixing", near)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.times for r in mixing.mix_sources(near).collect() if r.times}
    assert Counter(r.doc_id for r in mixed.collect()) == want
    last = step("bpe", mixed)
    own = {r.doc_id: bpe.digester(bpe.default_path())(r.text or "") for r in mixed.collect()}
    assert last.count() == mixed.count()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == own[r.doc_id] for r in last.collect())
