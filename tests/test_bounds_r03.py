"""Tasks hold a bounded number of rows, and what is costly is worked out once."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scenelake.functions import geometry as G
from scenelake.operators import ordered
from scenelake.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_made_once_and_in_several_tasks(spark):
    plan = _plan(QUERIES["mcq_numeric"](spark, SMALL))
    assert plan.count("sha2(") <= 2 and "Repartition" in plan and "Generate explode" in plan


def test_partitions_grow_with_the_rows(spark):
    df = ordered.dealt(spark.range(120).withColumn("k", F.col("id") % 7), "k", most=50)
    assert df.rdd.getNumPartitions() == 3
    assert df.select("k", F.spark_partition_id().alias("p")).distinct().count() == 7


def test_the_kinematics_table_deals_its_states(spark):
    assert "RepartitionByExpression [sim_id" in _plan(QUERIES["kinematics_table"](spark, SMALL))


def test_matrices_of_a_batch_are_turned_by_one_call(monkeypatch):
    calls, svd = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda m: calls.append(1) or svd(m))
    c, s = np.cos(np.pi / 6), np.sin(np.pi / 6)
    turn = np.array([c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 2.0])
    got = G._matrix_euler(pd.Series([turn, None, np.eye(3).reshape(-1)]))
    assert len(calls) == 1 and got[1] is None
    assert np.allclose(got[0], [0, 0, 30]) and np.allclose(got[2], [0, 0, 0])
    assert len(G._matrix_euler(pd.Series([None], dtype=object))) == 1
