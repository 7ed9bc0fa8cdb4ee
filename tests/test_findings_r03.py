"""What the third round of findings named, on rows small enough to be known by hand or to be compared with SQL."""

import datetime

import duckdb
import numpy as np
from pyspark.sql import functions as F

from scenelake.functions import text as X
from scenelake.operators import blocks, joins, neighbours
from scenelake.plans.catalog import ORACLE, QUERIES
from scenelake.sources import outputs, records
from tests.test_queries import rows

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def same_as_sql(spark, folder, name, **tables):
    """Writes the tables, and compares a query with its SQL over them."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, str(folder))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(names, want.fetchall())
    return got


def events(spark, values, user=2):
    """Events of one user, one a second, whose ids hide no object."""
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(13 * i + 1, start + datetime.timedelta(seconds=i), user, "view", float(v)) for i, v in enumerate(values)], _EVENTS)


def test_f4_a_sharp_s_is_no_letter(spark):
    texts = ["ßa", "ﬁb", "ıc", "ſd", "12", ""]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.letter(F.col("t")).alias("x")).collect()]
    assert got == ["A", "B", "I", "S", "", ""]


def test_f5_a_half_but_for_noise_is_rounded_as_in_sql(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "scene_kinematics_distance_traveled_interval", events=events(spark, [0.16] * 14 + [0.51] * 2))
    assert [r[0] for r in got] == ["0.4"]


def test_f1_pairs_of_names_are_measured_once(spark, tmp_path):
    names = ["red bolt", "new anvil", "red bolt", "hot ring", None, "", "x", "red bolt"]
    part = spark.createDataFrame([(i, names[i % 8], f"Brand#{i % 3}" if i % 11 else None, "T") for i in range(300)], "p_partkey long, p_name string, p_brand string, p_type string")
    assert len(same_as_sql(spark, tmp_path, "bigram_jaccard", part=part)) > 10_000
    measured = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x, y):
        measured.add(1)
        return float(x == y)

    df = spark.range(600).select(F.lit(1).alias("s"), "id", (F.col("id") % 3).cast("string").alias("v"))
    got = joins.value_pairs(df, ["s"], "id", "v", told, most=50, block=100)
    assert got.agg(F.count(F.lit(1)), F.sum("metric"), F.count_distinct("a", "b")).first()[:] == (600 * 599 // 2, 3 * 200 * 199 / 2, 600 * 599 // 2)
    assert measured.value < 2_000  # pairs of lists, not of items


def test_f3_long_lists_of_answers_are_several_files(spark, tmp_path):
    rows = spark.range(1000).select(F.struct(F.col("id").cast("string").alias("idx"), F.when(F.col("id") % 4 > 0, "b").alias("answer")).alias("r"))
    outputs.write_lists(rows, f"{tmp_path}/model7.json", "r", F.col("r.idx"), 1000, most=100)
    files = list((tmp_path / "model7.json").glob("part-*"))
    assert 5 < len(files) <= 10 and max(f.stat().st_size for f in files) < 10_000
    valid, invalid = records.read_results(spark, [f"{tmp_path}/*"], name=r"([^/]+)\.json/[^/]+$", pattern="part-*")
    assert (valid.count(), invalid.count(), valid.first().model_id) == (750, 250, "model7")


def test_f7_f8_f11_only_near_rows_are_measured():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(300, 16)), np.full((40, 16), 0.5), r.normal(size=(300, 16)) * 1e-9 + 1e6])
    ids = np.arange(len(x))
    near, every = neighbours.near_first(5)(x, x), neighbours.distances(x, x)
    for got, want in zip(blocks.first_of(near, ids, ids, 5), blocks.first_of(every, ids, ids, 5)):
        assert (got == want).all()
    assert np.isfinite(near[:300]).sum() < 20 * 300  # of 640 rows each; the 40 equal rows stay in together
