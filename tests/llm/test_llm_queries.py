import re

import pytest
from compare import connection, rows

import corpus_pipeline
from lexweave.llm import queries


def test_names():
    assert {re.match(r"op\d+_", name)[0] for name in queries.QUERIES} == {f"op{n}_" for n in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, data, name):
    assert rows(queries.QUERIES[name](spark, data).toPandas()) == rows(connection(data).sql(queries.ORACLE_SQL[name]).df())


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    last = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, last, data)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        n = out.count()
        assert 0.5 * last.count() < n <= last.count()
        last = corpus_pipeline.saved(out, "test")
    assert last.count() == last.select("doc_id").distinct().count()


def test_stages_on_odd_rows(spark, data, table):
    """Nulls, empty texts, repeated rows, clashing columns and empty tables, stage by stage."""
    rows = [(1, None), (2, ""), (2, ""), (3, "Alle meine Entchen schwimmen auf dem See"), (4, "alle meine entchen schwimmen auf dem see"), (5, "x " * 30000), (5, "x " * 30000), (None, "solo"), (None, None)]
    docs = table(rows).selectExpr("*", "'u' AS keep_id", "7 AS batch", "9 AS wanted")
    left = {"toxicity": 9, "exact_dedup": 4, "minhash_near_dedup": 6, "benchmark_decontamination": 9, "byte_bpe": 9}
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, data), stage(spark, docs.limit(0), data)
        assert (out.count(), none.count()) == (left[name], 0), name
        if name != "byte_bpe":
            assert out.columns == none.columns == docs.columns
            assert {(r.keep_id, r.batch, r.row_nr, r.wanted, r.score) for r in out.collect()} == {("u", 7, 2, 9, "x")}
