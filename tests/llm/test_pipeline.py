"""The pipeline's stages on the smallest data set, each against the operator's own brute force, and the SQL of the corpus queries."""

import os

import pytest

import corpus_pipeline
from sievework.llm import quality, queries
from sievework.llm.common import table
from tests.llm.test_operators import near_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "shards"]
    good = stages["quality_rules"](spark, docs, SF)
    kept = {r.doc_id for r in quality.query(spark, SF).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns
    rows = sorted(good.collect())
    lone = stages["near_duplicates"](spark, good, SF)
    want = near_groups([r.text for r in rows])
    assert sorted(r.doc_id for r in lone.collect()) == sorted(rows[i].doc_id for i in set(want.values()))
    clean = stages["decontamination"](spark, lone, SF)
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    left = {r.doc_id for r in clean.collect()}
    assert not any(any(t in r.text for t in items) for r in clean.collect())
    assert all(r.doc_id in left or any(t in r.text for t in items) for r in lone.collect())
    mixed = stages["source_mix"](spark, clean, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= left
    placed = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in placed.collect()) == sorted(r.doc_id for r in mixed.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    import duckdb

    from tests.test_queries import TABLES, agree

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    agree(spark, con, name, queries.QUERIES, queries.ORACLES)
