"""The registered queries and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from panelwright.llm import queries
from panelwright.llm.stored import stored


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, sf_dir).select(columns).collect()) == want


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        if name in ("toxicity", "ngram_jaccard"):
            assert 0.7 * before < docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
