"""Registered corpus queries against their SQL, and the pipeline's stages on small tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm.queries import ORACLES, QUERIES, table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    out = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'").execute(ORACLES[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(out.fetchall())


def test_pipeline(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        assert after.join(before, "doc_id", "left_anti").isEmpty()
        before = after.cache()
    clean = before.join(labels.where("toxic = 1"), "doc_id").count()
    assert clean < 0.4 * labels.where("toxic = 1").count()
    assert before.select("text").distinct().count() == before.count()
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert out.count() == before.count() and out.where(F.col("taken") > 2 * F.col("size")).isEmpty()


def test_stages_of_odd_tables(spark):
    """Null ids and texts, empty and very long texts, repeated rows, columns whose names operators use themselves, and an empty table."""
    long = " ".join(f"w{i * i % 7919}" for i in range(20_000))
    rows = [(None, "no id here", "s", 1), (None, "no id here", "s", 2), (None, None, None, 3), (1, None, "s", 4), (1, "", "s", 5), (2, long, "t", 6), (3, long + " end", "t", 7), (4, "one two", "t", 8), (4, "one two", "t", 8)]
    schema = "doc_id long, text string, source string, row long"
    for extra in ("id", "kept_id"):
        for own in (rows, []):
            docs = spark.createDataFrame(own, schema).withColumnRenamed("row", extra)
            for _, stage in corpus_pipeline.STAGES[:-1]:
                after = stage(spark, docs, SF)
                assert after.columns == docs.columns
                docs = spark.createDataFrame(after.collect(), docs.schema)
            kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert not own or (len(kept) == len(set(kept)) and {i for i, _ in kept} == {None, 1, 2, 4})
            assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(kept)
