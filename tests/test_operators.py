"""Operators against numpy, brute force and properties."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenelake.functions import geometry as G
from scenelake.functions import hashing
from scenelake.functions import text as X
from scenelake.operators import allocation as A
from scenelake.operators import joins, options, ordered, sampling

sizes = st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 50), min_size=1)


@given(st.integers(0, 300), sizes)
def test_even_is_capped_and_complete(target, caps):
    got = A.even(target, caps)
    assert all(0 <= got[g] <= caps[g] for g in caps)
    assert sum(got.values()) == min(target, sum(caps.values()))


@given(st.integers(0, 300), st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0.01, 1), st.integers(0, 60)), min_size=1))
def test_water_fill_is_the_loop(target, groups):
    weights, caps = {g: w for g, (w, _) in groups.items()}, {g: c for g, (_, c) in groups.items()}
    got = A.water_fill(target, weights, caps)
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(caps[g], mid * weights[g]) for g in caps) < target else (low, mid)
    assert sum(got.values()) == pytest.approx(min(target, sum(caps.values())), abs=1e-6)
    if target < sum(caps.values()):
        assert all(got[g] == pytest.approx(min(caps[g], low * weights[g]), abs=1e-3) for g in caps)


@given(st.integers(1, 100), sizes)
def test_percentages_sum_to_target(target, caps):
    got = A.percentages(target, {g: 1.0 for g in caps}, caps)
    assert sum(got.values()) == min(target, sum(caps.values())) and all(got[g] <= caps[g] for g in caps)


def test_modes_meet_both_margins():
    have = {("i", "x"): 5, ("i", "y"): 1, ("g", "x"): 1, ("g", "y"): 5}
    got = A.assign_modes({"x": 4, "y": 4}, {"i": 4, "g": 4}, have)
    assert sum(n for (m, _), n in got.items() if m == "i") == 4 and sum(n for (_, g), n in got.items() if g == "x") == 4
    assert all(got[k] <= have[k] for k in have)
    with pytest.raises(ValueError, match="short"):
        A.assign_modes({"x": 1, "y": 1}, {"i": 4}, have)


def test_trim_takes_from_the_furthest_over():
    assert A.trim({"a": 2, "b": 2}, {"a": 5, "b": 2}, 5) == {"a": 3, "b": 2}


def test_gradient_is_numpys(spark):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.random(12) + 0.1)
    f = t**2 * 3 - t
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, f)] + [(2, 0.0, 1.0)], "k int, t double, f double")
    got = {(r.k, r.t): r.g for r in ordered.central_gradient(df, ["k"], "t", "f", "g").collect()}
    want = np.gradient(f, t, edge_order=2)
    assert [got[1, x] for x in t] == pytest.approx(list(want))
    assert got[2, 0.0] is None


def test_runs_join_gaps_up_to_the_limit(spark):
    df = spark.createDataFrame([(1, t) for t in (0.0, 0.04, 0.12, 0.24, 0.28)], "k int, t double")
    got = {r.t: r.run for r in ordered.runs(df, ["k"], "t", 0.08 + 1e-9).collect()}
    assert got == {0.0: 1, 0.04: 1, 0.12: 1, 0.24: 2, 0.28: 2}
    assert ordered.runs(df, ["k"], "t", 0.08 + 1e-9, 3).count() == 3


def test_angular_velocity_of_a_steady_turn(spark):
    rows = [(1, 0.1 * i, [0.0, 0.0, float(np.sin(0.3 * i)), float(np.cos(0.3 * i))]) for i in range(40)]
    rows = [(k, t, [-x for x in q] if i % 3 == 0 else q) for i, (k, t, q) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k int, t double, q array<double>")
    got = [r.omega for r in ordered.angular_velocity(df, ["k"], "t", "q").orderBy("t").collect()]
    assert np.allclose(got, [[0, 0, 6.0]] * 40)


def test_projection_and_overlap(spark):
    p = G.project(G.vec(1, 2, 0), G.vec(0, 0, 10), G.vec(0, 0, 0), G.vec(0, 1, 0), F.lit(np.pi / 2), F.lit(200), F.lit(100))
    r = spark.range(1).select(p.alias("p")).first().p
    assert (r.u, r.v, r.depth) == pytest.approx((105.0, 40.0, 10.0))
    square = lambda x: [[x, 0.0], [x + 2, 0.0], [x + 2, 2.0], [x, 2.0], [x + 1, 1.0]]
    df = spark.createDataFrame([(square(0.0), square(1.0)), (square(0.0), square(5.0))], "a array<array<double>>, b array<array<double>>")
    assert [r.i for r in df.select(G.hull_iou("a", "b").alias("i")).collect()] == pytest.approx([1 / 3, 0.0])


def test_matrix_and_quaternion_agree(spark):
    q = np.array([0.1, -0.5, 0.3, 0.8])
    q /= np.linalg.norm(q)
    x, y, z, w = q
    m = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    df = spark.createDataFrame([([[float(v) for v in r] for r in m],)], "m array<array<double>>")
    r = df.select(G.matrix_quat(F.col("m")).alias("q"), G.matrix_euler("m").alias("e")).first()
    assert r.q == pytest.approx(list(q))
    e = spark.createDataFrame([tuple(np.radians(r.e).tolist())], "a double, b double, c double").select(G.euler_quat(F.col("a"), F.col("b"), F.col("c")).alias("q")).first().q
    assert abs(np.dot(e, q)) == pytest.approx(1.0)


def test_seed_is_the_digests_first_bytes(spark):
    got = spark.createDataFrame([("thing",)], "m string").select(hashing.seed_of(42, F.col("m")).alias("s")).first().s
    assert int(got) == int.from_bytes(hashlib.sha256(b"42:thing").digest()[:8], "big")


@settings(deadline=None, max_examples=5)
@given(st.lists(st.floats(0.001, 900), min_size=1, max_size=20))
def test_options_hold_the_truth_once(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    labels = options.numeric_options(F.col("v"), 1, F.col("k"))
    for r in df.select("v", labels.alias("l"), options.correct_index(labels, options.fixed(F.col("v"), 2)).alias("c")).collect():
        if r.l is not None:
            assert len(set(r.l)) == 4 and r.l[r.c] == f"{r.v:.2f}"


def test_cloud_distance_is_brute_force(spark):
    rng = np.random.default_rng(3)
    cloud, items = rng.random((400, 3)) * 3, rng.random((20, 3)) * 5
    c = spark.createDataFrame([("s", *map(float, p)) for p in cloud], "s string, x double, y double, z double")
    p = spark.createDataFrame([("s", i, *map(float, v)) for i, v in enumerate(items)], "s string, o int, x double, y double, z double")
    got = {r.o: r.distance for r in joins.cloud_distance(p, c, ["s"], "o", ("x", "y", "z"), 0.7).collect()}
    for i, v in enumerate(items):
        d = np.sort(np.linalg.norm(cloud - v, axis=1))[:20]
        assert got[i] == pytest.approx(np.median(d[:5]) if d[4] > 3 * d[0] else d[0])


def test_text_functions(spark):
    df = spark.createDataFrame([("Is <A> on <B> or <A>?", "b) text", "0_g", "7.5B")], "q string, a string, i string, p string")
    r = df.select(
        X.placeholders(F.col("q")).alias("names"), X.fill(F.col("q"), F.create_map(F.lit("A"), F.lit("x"))).alias("filled"), X.choice(F.col("a")).alias("choice"),
        X.base_id(F.col("i")).alias("base"), X.parameters(F.col("p")).alias("params"), X.choice(F.lit("")).alias("blank"), X.letter(F.lit("1) Answer")).alias("letter"),
        X.order_letters(F.array(F.lit(3), F.lit(1), F.lit(4), F.lit(2))).alias("order"), X.natural_key(F.lit("b12a")).alias("key"),
    ).first()
    assert r.names == ["A", "B"] and r.filled == "Is x on <B> or x?" and (r.choice, r.blank, r.letter) == ("B", "Wrong", "A")
    assert r.base == "0" and r.params == 7.5 and r.order == "B-D-A-C" and r.key == "b" + "12".rjust(20, "0") + "a"


def test_closed_trim_keeps_whole_bundles(spark):
    df = spark.createDataFrame([(f"{i}_{m}", "x" if i % 2 else "y") for i in range(10) for m in "ig"], "idx string, g string")
    sample = sampling.draw(df, ["g"], 3, "idx")
    out = sampling.closed_trim(df, sample, X.base_id(F.col("idx")), "g", 6)
    n = {r.b: r.n for r in out.groupBy(X.base_id(F.col("idx")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(n.values()) == {2} and sum(n.values()) <= 6


def test_a_spinning_object_moves(spark):
    rows = [(k, float(i), 0.0, 0.0, 0.0, 0.0, 0.0, turn * i) for k, turn in (("spins", 6.0), ("creeps", 1.0)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, t double, x double, y double, z double, a double, b double, c double")
    got = ordered.moved(df, ["k"], "t", ["x", "y", "z"], 0.05, 8, angles=["a", "b", "c"], turn=5.0).where("moved is not null")
    assert {(r.k, r.moved) for r in got.collect()} == {("spins", True), ("creeps", False)}
    assert {r.still for r in ordered.still(df, ["k"], "t", ["x", "y", "z"], 0.05, 8).where("still is not null").collect()} == {True}


def test_overlap_decides_the_relation_inside_options(spark):
    square = lambda x: [[x, 0.0], [x + 2.0, 0.0], [x + 2.0, 2.0], [x, 2.0]]
    df = spark.createDataFrame([("over", square(0.0), square(1.0)), ("apart", square(0.0), square(5.0))], "k string, p array<array<double>>, q array<array<double>>")
    rows = df.withColumn("rel", G.relation(G.hull_iou("p", "q"), F.lit(-3.0), F.lit(1.0), F.lit(-1.0)))
    labels = options.listed_options(F.col("rel"), F.array().cast("array<string>"), F.array(*[F.lit(x) for x in ("in front of", "behind", "left of", "right of")]), 1, F.col("k"))
    got = {r.k: (r.rel, r.labels) for r in rows.withColumn("labels", labels).collect()}
    assert got["over"][0] == "in front of" and got["apart"][0] == "left of" and all(rel in names for rel, names in got.values())


def test_curation_raises_on_what_does_not_fit(spark):
    from scenelake.operators import curation as C

    df = spark.createDataFrame([(1, 5.0), (2, 150.0)], "k int, p double")
    truth = spark.createDataFrame([(1, "x")], "k int, v string")
    assert {(r.k, r.v, r.found) for r in C.looked_up(df, truth, "k", "v").collect()} == {(1, "x", True), (2, None, False)}
    for bad in (C.looked_up(df, truth, "k", "v", strict=True), df.select(C.fraction(F.col("p"))), C.agreed(df.select(F.lit(1).alias("k"), "p"), ["k"], "p")):
        with pytest.raises(Exception, match="no entry for 2|no percentage|values disagree"):
            bad.collect()
    assert C.without_ids(df, "k", []).count() == 2 and C.pick_column(["a", "model_key"], ["idx"], "key") == "model_key" and C.pick_column(["a"], ["idx"]) is None
    assert spark.range(1).select(C.next_letter(F.lit("q")).alias("x")).first().x == "A"
