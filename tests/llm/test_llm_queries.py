"""Queries with SQL agree with it; the pipeline keeps its promises and agrees with a brute-force version."""

import os

import duckdb
import pytest

from spindrift.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from .test_operators import brute_components

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, None
    from spindrift.llm.common import stored

    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, DATA), name)
        if name == "language_id":
            kept = {r.doc_id for r in docs.collect()}
            assert len(kept) >= 198
        if name == "ngram_jaccard_join":
            want = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in want.items() if i == c}
        if name != "source_mixing":
            assert docs.columns == columns
    words = sum(len((r.text or "").split()) for r in before.collect())
    blocks = docs.collect()
    assert 0.9 * words < sum(r.n_words for r in blocks) < 1.1 * words and all(len(r.text.split()) == r.n_words for r in blocks)


def test_workers_see_the_package():
    assert "spindrift" in os.listdir(os.environ["PYTHONPATH"].split(os.pathsep)[0])
