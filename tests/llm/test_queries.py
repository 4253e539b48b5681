"""The queries against their SQL and the pipeline stage by stage."""

from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from colloquy.llm.queries import ORACLES, QUERIES
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="driver tables are not here")


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_its_sql(spark, key):
    assert compare(QUERIES[key](spark, FOLDER), connect(FOLDER), ORACLES[key]) is None


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_stages_keep_the_columns_and_pack_what_is_left(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.toArrow())
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[-1] > 0
    packed = corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct()
    assert sorted(r[0] for r in packed.collect()) == sorted(r[0] for r in docs.select("doc_id").distinct().collect())
