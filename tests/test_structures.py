"""Frames, poses, nested documents, point clouds, subtrees, names, neighbours, ranks, quantiles and outputs against plain versions."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.config import DEFAULT
from scenelake.functions import geometry as G
from scenelake.functions import poses
from scenelake.operators import aggregates, blocks, curation, names, neighbours, nested, options, ranks, similarity
from scenelake.sources import outputs, ply, records, scene, subtree


def test_time_keys(spark):
    got = spark.createDataFrame([(1,), (24,), (249,), (25000,)], "f int").select(curation.time_key(F.col("f"))).collect()
    assert [r[0] for r in got] == ["0000.050", "0000.970", "0009.970", "1000.010"]


# frames


def plain_ssim(a, b, size, weight):
    """The definition, window by window; weight None: whole boxes."""
    h, w = a.shape
    total, n = 0.0, 0
    span = range(h) if weight is not None else range(h - size + 1)
    for i in span:
        for j in range(w) if weight is not None else range(w - size + 1):
            if weight is None:
                x, y, k = a[i : i + size, j : j + size].ravel(), b[i : i + size, j : j + size].ravel(), np.full(size * size, 1 / size**2)
            else:
                pad = size // 2
                x, y = (np.pad(z, pad)[i : i + size, j : j + size].ravel() for z in (a, b))
                k = np.outer(weight, weight).ravel()
            mx, my = (k * x).sum(), (k * y).sum()
            vx, vy, c = (k * x * x).sum() - mx**2, (k * y * y).sum() - my**2, (k * x * y).sum() - mx * my
            total += (2 * mx * my + 0.0001) * (2 * c + 0.0009) / ((mx**2 + my**2 + 0.0001) * (vx + vy + 0.0009))
            n += 1
    return total / n


def test_similarity_is_the_definition():
    rng = np.random.default_rng(0)
    a, b = rng.random((3, 1, 12, 9)), rng.random((4, 1, 12, 9))
    at = np.arange(11) - 5
    weight = np.exp(-at * at / 4.5)
    weight /= weight.sum()
    box = similarity.ssim(a, b, lambda x: similarity.box_means(x, 4))
    gauss = similarity.ssim(a, b, similarity.gauss_means)
    for i in range(3):
        for j in range(4):
            assert box[i, j] == pytest.approx(plain_ssim(a[i, 0], b[j, 0], 4, None))
            assert gauss[i, j] == pytest.approx(plain_ssim(a[i, 0], b[j, 0], 11, weight))
    assert np.allclose(np.diag(similarity.ssim(a, a, similarity.gauss_means)), 1)


def test_least_similar_passes_over_broken_frames(spark):
    rng = np.random.default_rng(1)
    frames = [("s", i, rng.random(16).tolist()) for i in range(9)] + [("s", 20, [0.1] * 15), ("s", 21, None), ("s", 22, [None] * 16), (None, 23, [0.5] * 16), (None, 24, [0.4] * 16), ("t", 25, [0.5] * 16)]
    f = spark.createDataFrame(frames, "scene string, b long, vb array<double>")
    got = similarity.least_similar(f.select("scene", F.col("b").alias("a"), F.col("vb").alias("va")), f, ["scene"], (1, 4, 4), 2, window=3).collect()
    assert {r.a for r in got} == {*range(9), 23, 24} and all(r.b not in (20, 21, 22) and r.a != r.b for r in got)


# poses


def ladder(state, order="XYZ"):
    def turn(m):  # of scipy's kind: the quaternion of a rotation matrix, up to its sign
        m = np.array(m, float).reshape(3, 3)
        k = np.array([[m[0, 0] - m[1, 1] - m[2, 2], 0, 0, 0], [m[1, 0] + m[0, 1], m[1, 1] - m[0, 0] - m[2, 2], 0, 0], [m[2, 0] + m[0, 2], m[2, 1] + m[1, 2], m[2, 2] - m[0, 0] - m[1, 1], 0], [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1], m[0, 0] + m[1, 1] + m[2, 2]]]) / 3
        return np.linalg.eigh(k)[1][:, 3]

    if state[0] == "matrix":
        return turn(state[1])
    axes = {"X": 0, "Y": 1, "Z": 2}
    q = np.array([0, 0, 0, 1.0])
    for c in order:
        s = np.zeros(4)
        s[axes[c]], s[3] = math.sin(state[1][axes[c]] / 2), math.cos(state[1][axes[c]] / 2)
        (ax, ay, az, aw), (bx, by, bz, bw) = q, s
        q = np.array([aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz])
    return q


def test_pose_ladder_by_shape(spark):
    rng = np.random.default_rng(2)
    rows, want = [], []
    for i in range(24):
        m = np.linalg.qr(rng.standard_normal((3, 3)))[0]
        m *= np.sign(np.linalg.det(m))
        if i % 4 == 0:
            m = np.diag([[1, -1, -1], [-1, 1, -1], [-1, -1, 1]][i // 4 % 3]).astype(float)
        a = rng.uniform(-3, 3, 3).tolist()
        four = np.eye(4)
        four[:3, :3], four[:3, 3] = m, [1, 2, 3]
        doc, shape, q = [
            ({"obb": {"center": [1, 2, 3], "R": m.tolist()}}, "box", ladder(("matrix", m))), ({"obb": {"center": [1, 2, 3], "R": m.ravel().tolist()}, "transform": {"p": [0, 0, 0], "q": [0, 0, 0, 1]}}, "box", ladder(("matrix", m))),
            ({"transform": {"matrix": four.ravel().tolist()}}, "matrix", ladder(("matrix", m))), ({"transform": [1, 2, 3, *a]}, "six", ladder(("euler", a))),
        ][i % 4]
        rows.append((i, json.dumps(doc)))
        want.append((shape, q))
    broken = [None, "{", "7", "[]", "{}", '{"obb":{"center":[1,2]}}', '{"obb":{"center":[1,2,3],"R":[[1,0],[0,1]]}}', '{"transform":[1,2,3,4,5]}', '{"transform":{"p":[1,2,3]}}', '{"state":{"pose":{"p":[1,2,3],"q":[0,0,0,"w"]}}}', '{"obb":{"center":[1,null,3]}}']
    df = spark.createDataFrame(rows + [(100 + i, b) for i, b in enumerate(broken)], "i int, t string").select("i", F.try_parse_json("t").alias("s"))
    got = {r.i: r.pose for r in df.select("i", poses.pose(F.col("s")).alias("pose")).collect()}
    for i, (shape, q) in enumerate(want):
        assert got[i].shape == shape and list(got[i].p) == [1, 2, 3]
        assert abs(abs(np.dot(got[i].q, q)) - 1) < 1e-9, i
    assert all(got[100 + i] is None for i in range(len(broken)))
    zero = spark.range(1).select(poses.pose(F.parse_json(F.lit('{"transform":{"p":[1,2,3],"q":[0,0,0,0]}}')), "ZYX").alias("p")).first().p
    assert list(zero.q) == [0, 0, 0, 1]


def test_both_orders_of_angles(spark):
    a = [0.3, -1.1, 2.0]
    df = spark.range(1).select(*[F.lit(x).alias(f"a{i}") for i, x in enumerate(a)])
    for order in ("XYZ", "ZYX"):
        got = df.select(G.euler_quat(F.col("a0"), F.col("a1"), F.col("a2"), order).alias("q")).first().q
        assert np.allclose(got, ladder(("euler", a), order))
    with pytest.raises(ValueError):
        G.euler_quat(F.col("a0"), F.col("a1"), F.col("a2"), "XXZ")


# nested documents


def tree(rng, depth):
    kind = rng.randrange(4) if depth else 3
    if kind == 0:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind in (1, 2):
        out = {k: tree(rng, depth - 1) for k in rng.sample(["a", "b b", "c\"q", "é", "z"], rng.randrange(4))}
        if kind == 2:
            out["question"] = rng.choice(["What?\nA. x\nB. y", "", None, 7, "Which {[ one"])
            out |= rng.choice([{}, {"options": {"A": 1, "B": [tree(rng, 1)]}}, {"options": ["x"] * rng.choice([1, 26])}, {"options": {"Z": 0}, "option_files": {"Z": "f"}}])
        return out
    return rng.choice([1, -2.5, "t", "\\ \n \u001f", True, False, None, "", 12345678901])


def edited(x, option):
    if isinstance(x, list):
        return [edited(y, option) for y in x]
    if not isinstance(x, dict):
        return x
    if "question" not in x:
        return {k: edited(v, option) for k, v in x.items()}
    q = x["question"] if isinstance(x["question"], str) else "" if x["question"] is None else str(x["question"])
    o, new = x.get("options"), dict(x)
    after = lambda letters: "A" if not letters else chr(ord(max(letters)) + 1) if max(letters) < "Z" else f"Option {len(letters) + 1}"
    if isinstance(o, dict):
        label = after([k for k in o if len(k) == 1 and k.isupper()])
        new["options"] = {**o, label: option}
    elif isinstance(o, list):
        label = chr(65 + len(o)) if len(o) < 26 else f"Option {len(o) + 1}"
        new["options"] = [*o, option]
    else:
        label = after([line.strip()[0] for line in q.split("\n") if len(line.strip()) > 1 and line.strip()[1] == "." and line.strip()[0].isupper()])
        new["options"] = {label: option}
    new["question"] = (q.rstrip(" ") + "\n" if q.rstrip(" ") else "") + f"{label}. {option}\n"
    if isinstance(x.get("option_files"), dict) and label not in x["option_files"]:
        new["option_files"] = {**x["option_files"], label: None}
    return {k: v if k in ("options", "question", "option_files") and k in new else edited(v, option) for k, v in new.items()}


def count(x):
    return 1 + sum(map(count, x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()))


def test_nested_documents_are_opened_edited_and_built(spark):
    rng = random.Random(3)
    docs = [(i, json.dumps(tree(rng, 5))) for i in range(60)] + [(100, None), (101, ""), (102, "{no"), (103, "3"), (104, "{}"), (105, '{"question":"only"}')]
    df = spark.createDataFrame(docs, "id long, text string")
    walked = {r.id: r.n for r in nested.walk(df, "id", "text").groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.id: json.loads(r.text) for r in nested.edit(df, "id", "text", "question", nested.with_absurd_option(F.lit("odd"))).collect()}
    for i, t in docs:
        if i in (100, 101, 102):
            assert i not in walked and i not in got
            continue
        assert walked[i] == count(json.loads(t))
        assert got[i] == edited(json.loads(t), "odd"), (i, t)
    assert nested.edit(df.limit(0), "id", "text", "question", nested.with_absurd_option(F.lit("odd"))).count() == 0


# point clouds


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_point_clouds_in_any_ranges(spark, tmp_path, form):
    ply.register(spark)
    rng = np.random.default_rng(4)
    rows = [(*(float(np.float32(x)) for x in rng.standard_normal(2)), float(rng.standard_normal()), i) for i in range(500)]
    df = spark.createDataFrame(rows, "x float, y float, z double, n int").repartition(3)
    df.write.format("ply").option("format", form).mode("append").save(f"{tmp_path}/cloud")
    for split in (37, 1000, 1 << 20):
        got = spark.read.format("ply").option("split", split).load(f"{tmp_path}/cloud")
        assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect()), key=lambda r: r[3]) == rows


def test_point_cloud_headers(spark, tmp_path):
    ply.register(spark)
    head = "ply\nformat {}\ncomment made by hand\nelement {}vertex 2\nproperty float x\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_index\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head.format("ascii 1.0", "").encode() + b"1 2\n3 4\n3 0 1 1\n")
    assert [tuple(r) for r in spark.read.format("ply").option("split", 3).load(str(tmp_path / "a.ply")).collect()] == [(1.0, 2), (3.0, 4)]
    first = "ply\nformat binary_big_endian 1.0\nelement box 1\nproperty short s\nelement vertex 2\nproperty float x\nend_header\n"
    (tmp_path / "b.ply").write_bytes(first.encode() + struct.pack(">hff", 7, 1.5, -2.5))
    assert [r.x for r in spark.read.format("ply").load(str(tmp_path / "b.ply")).collect()] == [1.5, -2.5]
    for i, bad in enumerate(["plx\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n", "ply\nformat ascii 2.0\nend_header\n", "ply\nformat ascii 1.0\nelement vertex one\nend_header\n", "ply\nformat ascii 1.0\nelement vertex 1\nproperty flat x\nend_header\n", "ply\nformat ascii 1.0\nelement vertex 1\n", "ply\nformat ascii 1.0\nelement face 1\nproperty int x\nend_header\n"]):
        with pytest.raises(ValueError):
            ply.parse(bad.encode())
        (tmp_path / f"bad{i}.ply").write_text(bad)
        with pytest.raises(Exception, match="PLY|header|format|vertices|end_header"):
            spark.read.format("ply").load(str(tmp_path / f"bad{i}.ply")).collect()


# subtrees


def test_subtree_scan_reads_no_further(spark, tmp_path):
    tail = {f"{i:08.3f}": {"x": "y" * 50} for i in range(4000)}
    docs = {"a": {"scene": {"objects": "}]"}, "objects": {"1": {"n": "q\\\"]}"}, "2": {"n": "é"}}, "simulation": tail}, "b": {"simulation": tail, "objects": {"1": {"n": "x"}}}, "c": {"other": [{"objects": 1}]}, "d": {"objects": {}}}
    for k, d in docs.items():
        (tmp_path / k).mkdir()
        (tmp_path / k / "simulation.json").write_text(json.dumps(d))
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "simulation.json").write_text('{"objects": {"1": {"n"')
    for chunk in (1, 7, 4096):
        rows = {r.path.split("/")[-2]: r for r in subtree.read(spark, str(tmp_path), "objects", "map<string,struct<n:string>>", chunk=chunk).collect()} if chunk > 1 else None
        for k, d in docs.items():
            s, text = subtree.Scanner("objects"), json.dumps(d, ensure_ascii=False).encode()
            got = next((v for i in range(0, len(text), chunk) if (v := s.feed(text[i : i + chunk])) is not None), None) if chunk > 1 or k != "b" else b"-"
            if got != b"-":
                assert (json.loads(got) if got else None) == d.get("objects")
            if rows:
                assert {a: {"n": b.n} for a, b in (rows[k].value or {}).items()} == (d.get("objects") or {})
    assert rows["a"].bytes_read <= 4096 < rows["a"].bytes and rows["e"].value is None and rows["c"].value is None


# names


@pytest.mark.parametrize("sent", [1 << 20, 10])
def test_names_in_texts_both_ways(spark, sent):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 9)))
    known = [(word(), i) for i in range(80)] + [("", 90), (None, 91), ("abc", 92), ("abc", 93), ("zz", None)]
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(200, None), (201, ""), (202, "abc")]
    n, t = spark.createDataFrame(known, "name string, place long"), spark.createDataFrame(texts, "id long, text string")
    least = {}
    for name, p in known:
        if name and p is not None:
            least[name] = min(p, least.get(name, p))
    want = {(i, p) for i, x in texts for name, p in least.items() if x and name in x}
    assert {tuple(r) for r in names.contained(t, "text", ["id"], n, "name", "place", sent=sent, q=4).collect()} == want
    for last in (False, True):
        got = {r.id: r.place for r in names.picked(t, "text", ["id"], n, "name", "place", last=last, sent=sent, q=4).collect()}
        assert got == {i: (max if last else min)(p for j, p in want if j == i) for i in {j for j, _ in want}}
    assert names.contained(t, "text", ["id"], n.limit(0), "name", "place").count() == 0


# neighbours


@pytest.mark.parametrize("large", [10_000, 40])
def test_exact_neighbours(spark, large):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((5, 6)) * 3
    rows = [("s" if i % 5 else None, int(i), (centres[i % 5] + rng.standard_normal(6) * 0.3).tolist()) for i in range(260)] + [("s", 300 + i, [1.0] * 6) for i in range(60)] + [("one", 400, [0.0] * 6), ("two", 401, [0.0] * 6), ("two", 402, [3.0, None])]
    df = spark.createDataFrame(rows, "scene string, item long, v array<double>")
    got = neighbours.nearest(df, ["scene"], "item", "v", 3, pivots=6, large=large, block=32).collect()
    value = {i: np.nan_to_num(np.array((v + [0.0] * 6)[:6], float)) for _, i, v in rows}
    want = []
    for s, i, _ in rows:
        near = sorted((round(float(np.sqrt(((value[i] - value[j]) ** 2).sum())), 9), j) for r, j, _ in rows if r == s and j != i)[:3]
        want += [(i, j, d, k + 1) for k, (d, j) in enumerate(near)]
    assert sorted((r.a, r.b, round(r.distance, 9), r["rank"]) for r in got) == sorted(want)


def test_blocks_keep_ties_by_id():
    metric = np.array([[1.0, 1.0, 0.5, np.nan, 1.0]])
    i, j = blocks.first_of(metric, np.array([99]), np.array([7, 3, 9, 1, 5]), 3)
    assert j.tolist() == [2, 1, 4]


# ranks and quantiles


def test_running_sums_across_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None, ""]), rng.randint(0, 20), rng.randint(0, 5), i) for i in range(700)] + [("hot", 1, 1, 1000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, w int, id int").repartition(7)
    got = {r.id: r.s for r in ranks.running(df, ["g"], ["o", "id"], F.col("w"), "s").collect()}
    for g in {r[0] for r in rows}:
        total = 0
        for _, _, w, i in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[3])):
            total += w
            assert got[i] == total
    assert ranks.ordinal(df.limit(0), ["g"], ["o"]).count() == 0
    assert sorted(r.k for r in ranks.ordinal(df, [], ["o"], "k").collect()) == list(range(1, 1201))


def test_spearman_with_ties_and_one_group(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(x), float(y)) for g in ("p", "q") for x, y in zip(rng.integers(0, 9, 200), rng.integers(0, 50, 200))] + [("c", 1.0, float(i)) for i in range(5)] + [(None, 1.0, 2.0), (None, 2.0, 1.0), ("p", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    mean_rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    for by in (["g"], []):
        for r in ranks.spearman(df, by, "x", "y").collect():
            x, y = np.array([(a, b) for g, a, b in rows if a is not None and (not by or g == r.g)]).T
            assert r.n == len(x)
            if len(set(x)) == 1:
                assert r.rho is None
            else:
                assert r.rho == pytest.approx(np.corrcoef(mean_rank(x), mean_rank(y))[0, 1])


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(9)
    rows = [("a", float(x)) for x in rng.standard_normal(900)] + [("tied", float(x)) for x in rng.integers(0, 3, 800)] + [("same", 5.0)] * 300 + [("one", 1.0), (None, 2.0), (None, 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r for r in aggregates.percentiles(df, ["g"], "v", shares, accuracy).collect()}
    assert "none" not in got
    for g, r in got.items():
        v = np.array([x for k, x in rows if k == g and x is not None])
        assert r.n == len(v) and np.allclose(r.quantiles, np.quantile(v, shares), atol=1e-12), g
    whole = aggregates.describe(df, [], "v").first()
    v = np.array([x for _, x in rows if x is not None])
    assert (whole.n, whole.q1, whole.median, whole.q3) == pytest.approx((len(v), *np.quantile(v, [0.25, 0.5, 0.75])))


# outputs


def test_documents_are_enriched_and_read_again(spark, tmp_path):
    box = lambda x: {"R": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "center": [x, 0.0, 0.0], "extents": [1, 1, 1]}
    doc = {"scene": {"scene": "room"}, "more": [1, {"deep": None}], "simulation": {f"{0.04 * (k + 1):08.3f}": {"frame_idx": k, "objects": {"1": {"obb": box(k * k), "note": "kept", "kinematics": {"old": 1}}, "2": {"obb": box(1.0)}}} for k in range(5)}}
    for name, text in (("one", json.dumps(doc)), ("bad", "{"), ("empty", "{}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "simulation.json").write_text(text)
    states = scene.add_kinematics(scene.states(scene.steps(scene.read(spark, str(tmp_path)))))
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(str(tmp_path)).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("sim_id"), F.col("value").alias("text"))
    got = {r.sim_id: r.text for r in outputs.enriched(texts, states).collect()}
    assert got["bad"] == "{" and got["empty"] == "{}"
    new = json.loads(got["one"])
    assert new["scene"] == doc["scene"] and new["more"] == doc["more"] and list(new["simulation"]) == sorted(doc["simulation"])
    speeds = [s["objects"]["1"]["kinematics"]["speed"] for s in new["simulation"].values()]
    assert speeds[0] is None and speeds[1:] == pytest.approx([25 * (2 * k + 1) for k in range(4)])
    for k, s in doc["simulation"].items():
        for o, x in s["objects"].items():
            assert {a: b for a, b in new["simulation"][k]["objects"][o].items() if a != "kinematics"} == {a: b for a, b in x.items() if a != "kinematics"}


def test_a_run_is_written_as_three_outputs(spark, tmp_path):
    rows = [(s, q, m, f"{s}{q}", "B", "single", [f"{s}.png"]) for s in ("s1", "s2") for q in ("q1", "q2") for m in ("general", "image-only")]
    df = spark.createDataFrame(rows, "simulation_id string, question_id string, mode string, question string, answer string, choice_type string, file_name array<string>")
    paths = outputs.write_run(outputs.numbered(df, ["simulation_id", "question_id"]), str(tmp_path), "r1", DEFAULT)
    questions = spark.read.schema(records.QUESTION).json(paths["questions"]).collect()
    assert sorted((r.simulation_id, r.question_id, r.idx) for r in questions) == sorted((s, q, f"{2 * (s == 's2') + (q == 'q2')}_{m[0]}") for s, q, m, *_ in rows)
    assert {(r.answer, r.task_type) for r in spark.read.schema(records.ANSWER).json(paths["answers"]).collect()} == {("B", "factual")}
    assert json.loads(spark.read.text(paths["config"]).first().value)["seed"] == 42


def test_table_records(spark):
    items = spark.createDataFrame([("1_g", "s", " Where is the RED Ball? ", ["a", "b", "c"], 1, "cat", ["p2", "p1", "none"]), ("2_g", "t", "Nothing", None, None, None, None)], "idx string, sim_id string, question string, labels array<string>, correct int, category string, file_name array<string>")
    objects = spark.createDataFrame([("s", "red ball", "m1"), ("s", "lamp", "B"), ("s", "cup", "m3"), ("s", None, "a")], "sim_id string, name string, model string")
    images = spark.createDataFrame([("p1", bytearray(b"one")), ("p2", bytearray(b"two"))], "path string, content binary")
    a, b = outputs.table_records(items, objects, images).orderBy("index").collect()
    assert (a.A, a.B, a.C, a.D, a.answer, a.question, a.objects, a.images) == ("a", "b", "c", "", "B", "Where is the RED Ball?", ["lamp", "red ball"], ["dHdv", "b25l"])
    assert (b.A, b.answer, b.objects, b.images) == ("", "", [], [])


def test_result_scans_shares_caches_and_paths(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "m1.json").write_text(json.dumps([{"idx": " 1 ", "answer": "(b)"}, {"idx": "1", "answer": "C"}, {"idx": "2", "answer": "12"}, {"idx": "", "answer": "A"}, {"answer": "A"}, {"idx": 3, "answer": None}]))
    (tmp_path / "d" / "m2.json").write_text("{broken")
    (tmp_path / "m3.json").write_text(json.dumps([{"idx": 1, "answer": "d"}]))
    valid, invalid = records.read_results(spark, [f"{tmp_path}/d", f"{tmp_path}/m3.json"])
    assert sorted(map(tuple, valid.collect())) == [("m1", "1", "C"), ("m3", "1", "D")]
    assert sorted(map(tuple, invalid.collect())) == [("m1", "2", "12"), ("m1", "3", "")]
    (tmp_path / "p.json").write_text('{"a": 0.5, "b": 20}')
    assert records.percentage_map(spark, f"{tmp_path}/p.json") == records.percentage_map(spark, '{"a": 50, "b": 0.2}') == {"a": 0.5, "b": 0.2}
    for bad in ("{}", "[1]", '{"a": "x"}', '{"a": 101}', '{"a": -1}', "{a"):
        with pytest.raises(ValueError):
            records.percentage_map(spark, bad)
    made = []
    for _ in range(2):
        got = outputs.cached(spark, f"{tmp_path}/cache", lambda: made.append(1) or spark.range(3))
        assert got.count() == 3
    assert made == [1]
    files = spark.range(1).select(outputs.moved_paths(F.array(F.lit("/old/render/1.png"), F.lit("/old/x.png"), F.lit(None)), "/old", "/new").alias("f")).first().f
    assert files == ["/new/render/1.png", "/old/x.png", None]


def test_depths(spark, tmp_path):
    for p in ("simulation.json", "a/b/c/simulation.json", "a/b/c/d/simulation.json", "a/b/c/d/e/simulation.json"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("{}")
    got = scene.read(spark, scene.at_depths(str(tmp_path)), pattern="*.json").collect()
    assert sorted(r.path.split(tmp_path.name + "/")[1] for r in got) == ["a/b/c/d/simulation.json", "a/b/c/simulation.json"]
    assert scene.read(spark, str(tmp_path), limit=2).count() == 2


def test_options_for_a_number(spark):
    df = spark.createDataFrame([(123.456, 1), (0.5, 2), (7.0, 3)], "v double, id int")
    for r in df.select("v", options.options_for(F.col("v"), 1, F.col("id"), low=0.0).alias("f"), options.options_for(F.col("v"), 1, F.col("id"), decimals=1, low=0.0).alias("d"), options.options_for(F.col("v"), 1, F.col("id"), integer=True, high=200).alias("i")).collect():
        for labels in (r.f, r.d, r.i):
            assert len(set(labels)) == 4
        assert len({len(x.partition(".")[2]) for x in r.f}) == 1 and str(round(r.v)) in r.i


def test_strict_lookups_and_agreements_raise_whatever_is_read(spark):
    df, truth = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert {tuple(r) for r in curation.looked_up(df, truth, "k", "v").collect()} == {(1, "a", True), (2, None, False)}
    with pytest.raises(Exception, match="no entry for 2"):
        curation.looked_up(df, truth, "k", "v", strict=True).select("k").collect()
    two = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(Exception, match="values disagree for 1"):
        curation.agreed(two, ["k"], "v").select("k").collect()
