"""What the check tool found in round 3: rows made, and what Python steps hold at once."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from scenelake.llm import brown, jaccard


def test_stages_bound_the_texts_that_a_python_step_holds(spark):
    key, folder = "spark.sql.execution.arrow.maxRecordsPerBatch", "/root/testdata/sf0.001"
    before = spark.conf.get(key)
    try:
        for stage in (P.good, P.distinct, P.unleaked, P.packed):
            spark.conf.set(key, 10_000)
            stage(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(20), folder)
            sizes = spark.range(0, 3000, 1, 1).mapInPandas(lambda parts: (pd.DataFrame({"n": [len(p)]}) for p in parts), "n long")
            assert sizes.agg(F.max("n")).first()[0] <= 1000
    finally:
        spark.conf.set(key, before)


def test_lists_of_one_class_are_not_opened(spark):
    lists = spark.createDataFrame([(7, 1, 1), (7, 1, 2), (7, 1, 3), (8, 1, 3), (8, 1, 4)], "key long, lead long, node long")
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, root long")
    # all of list 7 is of class 1; in list 8 node 4 is of its own
    assert {(r["lead"], r["node"]) for r in jaccard._apart(lists, roots).collect()} == {(1, 3), (1, 4)}


def test_transitions_are_summed_by_task_whatever_lies_outside_the_lexicon(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 500}" for _ in range(120)), i % 3 > 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(2)
    options = {"classes": 4, "clustered": 20, "lexicon": 40}
    model, table = brown.fit(docs.where("learn").select(F.col("text").alias("t")), **options)
    coded = brown.encode(docs.select(F.col("text").alias("t")), [w for w, _, _ in model.lexicon])
    classes = brown.np.array([h for _, _, h in model.lexicon])
    k = len(model.logt)
    assert table.where("c >= 10").count() > 100 and brown.links(coded, classes, k).count() <= k * k
    want = {r.doc_id: r for r in brown.score(docs, model, table).collect()}
    got = brown.fit_score(docs, F.col("learn"), **options).collect()
    assert len(got) == len(want) == 300
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (w.n_tokens, w.n_known, w.train_tokens)
        assert r.score == pytest.approx(w.score) and r.base_score == pytest.approx(w.base_score)
