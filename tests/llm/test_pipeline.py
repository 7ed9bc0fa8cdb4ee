"""The stages of the corpus pipeline on a small fixture, and the registered queries with SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from scenelake.llm import jaccard, leakage, secrets
from scenelake.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_apply_their_decisions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == COLUMNS, name
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            classes = jaccard.join(docs).collect()
            assert set(after) == {r.component_id for r in classes}
        if name == "decontamination":
            assert set(after) == {r.doc_id for r in leakage.search(docs, items).collect() if not r.leaked}
        if name == "secrets":
            assert set(after) == set(before)
            assert out.where(F.length("text") != F.col("n_chars")).count() == 0
            found = {r.doc_id for r in secrets.scan(docs).collect() if r.found}
            assert {d for d in after if after[d] != before[d]} == found
        docs, before = spark.createDataFrame(out.collect(), out.schema), after
    packed = P.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.collect()} == set(before)


def test_run_gives_the_last_stage(spark):
    assert P.run(spark, FOLDER).columns[:3] == ["doc_id", "start", "length"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, map(tuple, df.select(names).collect()))) == sorted(map(str, want.fetchall()))
