"""Scenes from JSON files to question records, with answers known by hand."""

import json

import pytest
from pyspark.sql import functions as F

from scenelake.plans import resolvers as R
from scenelake.sources import records, scene

STEPS = 60


def world(kind):
    """Three boxes of which one moves along x at 1 m/s, in 60 steps of 40 ms."""
    eye = [[0.0, 0.0, 5.0], [0.0, -5.0, 5.0], [0.0, 0.0, 0.0]]
    box = lambda x, y: {"R": eye and [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], "center": [x, y, 0.5], "extents": [1.0, 1.0, 1.0]}
    objects = {
        str(i): {"model": m, "sim": "rho-1_yms-soft_prs-1", "mass": mass, "volume": v, "props": {"rhos": 100.0 * i, "yms": 1e6 * i, "prs": 0.1 * i}, "description": {"material_group": mat, "category_gso": "toy", "object_name": m}}
        for i, m, mass, v, mat in ((1, "ball", 1.0, 0.001, "wood"), (2, "cube", 2.0, 0.002, "steel"), (3, "cone" if kind != "twins" else "cube", 4.0, 0.004, "foam"))
    }
    simulation = {}
    for s in range(STEPS):
        t = 0.04 * (s + 1)
        low = kind == "hidden"
        simulation[f"{t:08.3f}"] = {
            "frame_idx": 4 * s, "collisions": [[2, 0]] * (s == 20) + [[1, 2]] * (s == 30), "camera": {"eye": [0.0, -5.0 + (0.1 * s if kind == "camera" else 0), 5.0], "at": [0.0, 0.0, 0.0], "up": [0.0, 0.0, 1.0], "fov": 0.9, "width": 1000, "height": 562},
            "objects": {str(i): {"infov_pixels": 500.0 if not low else 100.0, "fov_visibility": 0.9, "obb": box(x, y), "stress": 0.0} for i, x, y in ((1, -2.0 + t, 0.0), (2, 2.0, 0.0), (3, 0.0, 3.0))},
        }
    return {"scene": {"scene": "room"}, "objects": objects, "simulation": simulation}


@pytest.fixture(scope="module")
def scenes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("scenes")
    for k in ("plain", "twins", "hidden", "camera"):
        (root / k).mkdir()
        (root / k / "simulation.json").write_text(json.dumps(world(k)))
    (root / "broken").mkdir()
    (root / "broken" / "simulation.json").write_text("{no json")
    worlds = scene.read(spark, str(root)).cache()
    assert {r.sim_id for r in worlds.where("bad").collect()} == {"broken"}
    more = "room kitchen shed".split()
    names = spark.createDataFrame([("ball", "Ball"), ("cube", "Cube"), ("cone", "Cone"), *[(m, m) for m in more]], "model string, name string")
    cloud = spark.createDataFrame([("room", 0.2 * i - 5, 0.2 * j - 5, 0.0) for i in range(50) for j in range(50)], "scene string, x double, y double, z double")
    s = R.Scenes.of(worlds, names, cloud)
    pixels = F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: ((i * (F.col("step") + 1)) % 256).cast("double"))
    s.images = s.steps.select("sim_id", F.lpad(F.col("frame_idx").cast("string"), 6, "0").alias("frame"), pixels.alias("pixels"))
    s.image_shape = (3, 8, 8)
    s.objects = s.objects.unionByName(spark.createDataFrame([("other", "room", str(i), m, "s", 1.0, 1.0, 1.0, 1.0, 0.1, f"stuff{i}", "toy", m, False) for i, m in enumerate(["vase", "lamp", "book", "cup"])], s.objects.schema))
    return s


def answers(scenes, name):
    return {r.sim_id: r for r in R.answer(scenes, [name]).collect()}


def test_tables(scenes):
    assert scenes.steps.where("sim_id = 'plain'").count() == STEPS
    v = scenes.states.where("sim_id = 'plain' and object_id = '1' and step > 1").agg(F.min("speed"), F.max("speed"), F.max("accel")).first()
    assert v[0] == pytest.approx(1.0) and v[1] == pytest.approx(1.0) and v[2] == pytest.approx(0.0, abs=1e-6)
    assert scenes.collisions.where("sim_id = 'plain'").count() == 2


TRUTHS = {
    "F_SIZE_OBJECT_BIGGER": "Cone", "F_SIZE_OBJECT_SMALLER": "Ball", "F_MASS_HEAVIEST_OBJECT": "Cone", "F_MASS_LIGHTEST_OBJECT": "Ball",
    "F_VIEWPOINT_CAMERA_ANGLE": "high angle", "F_FOCAL_LENGTH_CLASS": "wide", "F_VISIBILITY_PERCENTAGE_OBJECT": "75-100",
    "F_CAMERA_MOTION_DIRECTION": "static", "F_CAMERA_ZOOM_BEHAVIOR": "no zoom", "F_KINEMATICS_MOVING_OBJECT": "No Object",
}


@pytest.mark.parametrize("name", sorted(R.RESOLVERS))
def test_resolver(scenes, name):
    got = answers(scenes, name)
    assert "plain" in got or name in ("F_MASS_HEAVIEST_OBJECT", "F_MASS_LIGHTEST_OBJECT", "F_KINEMATICS_MOVING_OBJECT"), name
    for r in got.values():
        assert 0 <= r.correct < len(r.labels) == len(set(r.labels)) and r.frames
    if name in TRUTHS and "plain" in got:
        r = got["plain"]
        want = {TRUTHS[name]} | ({"Ball"} if name == "F_KINEMATICS_MOVING_OBJECT" else set())
        assert r.labels[r.correct] in want
    if name == "F_KINEMATICS_SPEED_OBJECT":
        r = got["plain"]
        assert float(r.labels[r.correct]) == pytest.approx(1.0 if r.attributes["OBJECT"] == "Ball" else 0.0, abs=0.01)
    if name == "F_DISTANCE_OBJECT_OBJECT":
        assert "twins" not in got and "hidden" not in got  # a model twice, or nothing visible: no answer
    if name == "F_COLLISION_OBJECT_SCENE_FRAME_MULTI":
        r = got["plain"]
        assert r.labels[r.correct] == "000080" and r.attributes["OBJECT"] == "Cube"
    if name == "F_COLLISION_OBJECT_OBJECT_FRAME_MULTI":
        assert got["plain"].labels[got["plain"].correct] == "000120"
    if name == "F_DISTANCE_OBJECT_GROUND":
        assert float(got["plain"].labels[got["plain"].correct]) == pytest.approx(0.5, abs=0.02)
    if name == "F_CAMERA_MOTION_DIRECTION" and "camera" in got:
        assert got["camera"].labels[got["camera"].correct] != "static"


def test_records_are_assembled(spark, scenes):
    templates = spark.createDataFrame([("F_SIZE_OBJECT", "spatial", "size", "How large is <OBJECT>?")], "question_id string, category string, sub_category string, question string")
    rows = {r.sim_id: r for r in R.records(R.answer(scenes, ["F_SIZE_OBJECT"]), templates).collect()}
    r = rows["plain"]
    assert r.question.startswith("<image>How large is ") and r.question.count("\n") == 4 and r.answer in "ABCD"
    with pytest.raises(KeyError, match="no resolver"):
        R.answer(scenes, ["F_NOTHING"])


def test_records_in_and_out(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": {"q1": {"task_splits": "x", "sub_category": "s", "choice": "c", "question": "Q?"}}} // note'.replace(" // note", ""))
    assert [tuple(r)[:2] for r in records.read_templates(spark, str(tmp_path / "t.json")).collect()] == [("a", "q1")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "model1.json").write_text('[{"idx": "0_i", "answer": "A"}, {"idx": "1_i", "answer": null}]')
    assert {(r.model_id, r.idx, r.answer) for r in records.read_predictions(spark, str(tmp_path / "m")).collect()} == {("model1", "0_i", "A"), ("model1", "1_i", None)}
    (tmp_path / "bad.json").write_text("[{]")
    with pytest.raises(Exception):
        records.read_list(spark, str(tmp_path / "bad.json"), records.ANSWER).collect()
    df = spark.createDataFrame([(1, [1, 2], None)], "b int, a array<int>, c string")
    assert records.text_table(df, ["c"]).first().asDict() == {"c": "", "a": "[1,2]", "b": "1"}
    records.write_tsv(df, str(tmp_path / "out"), ["c"])
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).columns == ["c", "a", "b"]
    nested = spark.createDataFrame([((1, (2,)),)], "s struct<a:int,t:struct<b:int>>")
    assert records.flatten(nested).columns == ["s.a", "s.t.b"]


def test_streaming_velocities(spark, tmp_path):
    from scenelake.streaming import kinematics

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, float(i), 2.0 * i) for i in range(5)], "k int, s double, x double").select("k", F.timestamp_seconds("s").alias("ts"), "x").write.parquet(src)
    stream = spark.readStream.schema("k int, ts timestamp, x double").parquet(src)
    q = kinematics.velocities(stream, "k", "ts", "x").writeStream.format("memory").queryName("vel").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.t, r.v) for r in spark.table("vel").collect() if r.v is not None) == [(float(i), 2.0) for i in range(1, 5)]


def test_a_catalogue_of_any_size_is_whole(spark):
    from types import SimpleNamespace

    s = SimpleNamespace(objects=spark.range(1500).selectExpr("cast(id as string) as name"))
    assert len(R._listed(s, spark.range(1)).first().catalogue) == 1500


def test_the_ledger_holds_every_scene_and_question(scenes, spark):
    names = ["F_SIZE_OBJECT", "F_MASS_COMPARE_OBJECTS"]
    worlds = spark.createDataFrame([(k, k == "broken") for k in ("plain", "twins", "hidden", "camera", "broken")], "sim_id string, bad boolean")
    rows, seen = R.tally(R.ledger(scenes, worlds, names), "test")
    got = {(r.sim_id, r.question_id): r.reason for r in rows.collect()}
    assert len(got) == seen.get["rows"] == seen.get["answered"] + seen.get["unanswered"] == 10
    assert got["plain", "F_SIZE_OBJECT"] is None and got["broken", "F_SIZE_OBJECT"] == "broken document" and got["hidden", "F_SIZE_OBJECT"] == "no visible object"


def test_placeholders_of_every_kind(scenes, spark):
    from scenelake.plans import placeholders as P

    text = " ".join(f"<{k}>" for k in P.KINDS if k != "OBJECT") + " <OBJECT_1> <OBJECT_2>"
    templates = spark.createDataFrame([("all", text), ("many", "<OBJECT_1> <OBJECT_2> <OBJECT_3> <OBJECT_4>"), ("odd", "<WHO>"), ("none", "plain")], "question_id string, question string")
    got = {(r.sim_id, r.question_id): r for r in P.resolve(scenes, templates).collect()}
    a = got["plain", "all"].attributes
    assert set(a) == {*P.KINDS, "OBJECT_1", "OBJECT_2"} - {"OBJECT"} and a["OBJECT_1"] != a["OBJECT_2"] and {a["OBJECT_1"], a["OBJECT_2"]} <= {"Ball", "Cube", "Cone"}
    assert a["CATEGORY"] == "toy" and a["MATERIAL"] in ("wood", "steel", "foam") and json.loads(a["CAMERA"])["width"] == 1000
    for k, (low, high) in P.RANGES.items():
        assert low - 0.05 <= float(a[k]) <= high + 0.05
    assert "<" not in got["plain", "all"].question and got["plain", "none"].question == "plain"
    for q in ("many", "odd"):  # three objects for four names, and a name of no kind
        assert got["plain", q].attributes is None and got["plain", q].question is None
    assert got["twins", "all"].attributes is None  # one object of a model of its own
