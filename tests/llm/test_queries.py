"""The registered queries on the small tables, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from fathom.llm.common import Stage, read
from fathom.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    ours = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert ours
    if name in ORACLES:
        c = duckdb.connect()
        for t in ("documents", "embeddings", "labels", "conversations"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        r = c.execute(ORACLES[name])
        names = [x[0] for x in r.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert sorted(names) == sorted(df.columns)
        assert ours == sorted((tuple(row[i] for i in order) for row in r.fetchall()), key=str)


def test_pipeline(spark):
    stage = Stage(spark, "test")
    docs = read(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        docs = stage.write(function(spark, docs, SF), str(i))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    assert docs.where("n_tokens <> size(token_ids)").count() == 0
