"""The scene questions over scenes made of the event table, with SQL that finds their answers by itself.

A user is a scene and their events, in time order, are its steps, 40 ms apart. Each scene has four objects whose places,
boxes, masses and visibility follow from the events; errors are contacts. Users divisible by 5 have a model twice.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered
from . import resolvers as R
from .registry import query, table

MATERIALS = ["wood", "steel", "foam", "glass", "clay"]


def scenes(spark, folder, rows: int | None = None) -> R.Scenes:
    """The long tables of the scenes, all derived from the events.

    With ``rows``, the number of states, the events are dealt by scene into tasks of about 50,000 states, and what is
    grouped by scene later stays where it is.
    """
    e = table(spark, folder, "events").where("user_id is not null and event_id is not null")
    e = e.withColumn("sim_id", F.col("user_id").cast("string"))
    if rows is not None:
        e = ordered.dealt(e, "sim_id", rows=rows)
    order = Window.partitionBy("user_id" if rows is None else "sim_id").orderBy(F.asc_nulls_first("ts"), "event_id")
    e = e.select("user_id", "sim_id", F.col("event_id").alias("id"), F.coalesce("value", F.lit(0.0)).alias("v"), "event_type", (F.row_number().over(order) - 1).alias("step"))
    u, n = F.col("user_id"), F.col("id")
    steps = e.select(
        "sim_id", "step", (F.col("step") / F.lit(25.0)).alias("t"), (F.col("step") * 4).cast("int").alias("frame_idx"), u.alias("u"), "id", "v", "event_type",
        F.struct(
            F.array(F.lit(0.0), F.lit(-5.0) - F.lit(0.02) * F.col("step") * (u % 3), (F.lit(3) + u % 4).cast("double")).alias("eye"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("at"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("up"),
            (F.lit(0.7) + F.lit(0.01) * F.col("step") * (u % 2)).alias("fov"), F.lit(1000).alias("width"), F.lit(562).alias("height"), F.lit(None).cast("string").alias("fov_axis"),
        ).alias("camera"),
    )
    o = steps.withColumn("i", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    i = F.col("i")
    hidden = (n % 13 == 0) & (n % 4 + 1 == i)
    turn = F.array(*[F.array(*[F.lit(float(r == c)) for c in range(3)]) for r in range(3)])
    user = F.col("u")
    centre = F.array(2 * i + F.when(user % 2 == 0, F.col("v")).otherwise(F.col("step") / F.lit(1000.0)), ((user + i) % 7) / F.lit(10.0), F.lit(0.5))
    states = o.select(
        "sim_id", "step", "t", "frame_idx", i.cast("string").alias("object_id"), F.when(hidden & (n % 2 == 0), 200.0).otherwise((500 + (n + i) % 50).cast("double")).alias("pixels"),
        F.when(hidden & (n % 2 == 1), F.lit(0.3)).otherwise(F.lit(0.75) + ((n + 3 * i) % 20) / F.lit(100.0)).alias("visibility"),
        F.struct(turn.alias("R"), centre.alias("center"), F.array(F.lit(1.0), F.lit(0.5), F.lit(0.8)).alias("extents")).alias("obb"), F.lit(None).cast("double").alias("speed"), F.lit(None).cast("double").alias("accel"), F.lit(0.0).alias("stress"),
    )
    from ..sources import scene

    users = e.select("user_id").distinct().withColumn("i", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    kind = (F.col("user_id") * 3 + F.when((F.col("user_id") % 5 == 0) & (F.col("i") == 4), 3).otherwise(F.col("i"))) % 9
    objects = users.select(
        F.col("user_id").cast("string").alias("sim_id"), F.lit("room").alias("scene"), i.cast("string").alias("object_id"), F.concat(F.lit("m"), kind.cast("string")).alias("model"), F.lit("s").alias("sim"),
        (F.lit(1.0) + (u + 2 * i) % 5).alias("mass"), ((1 + (u * i) % 7) / F.lit(1000.0)).alias("volume"), (F.lit(100.0) * (1 + (u + i) % 6)).alias("density"), (F.lit(1e6) * (1 + (u + i) % 4)).alias("young"), (F.lit(0.1) * i).alias("poisson"),
        F.element_at(F.array(*map(F.lit, MATERIALS)), ((u + i) % 5 + 1).cast("int")).alias("material"), F.lit("toy").alias("category"), F.concat(F.lit("Object "), kind.cast("string")).alias("name"),
        ((F.col("user_id") % 5 != 0) | ~i.isin(3, 4)).alias("unique"),
    )
    a = (n % 4 + 1).cast("int")
    hit = steps.where("event_type = 'error'")
    collisions = hit.select("sim_id", "step", "t", "frame_idx", a.alias("a"), F.when(n % 3 == 0, 0).otherwise(((n + 1) % 4 + 1).cast("int")).alias("b"))
    return R.Scenes(steps.select("sim_id", "step", "t", "frame_idx", "camera"), scene.add_kinematics(states), objects, collisions)


_BASE = """
e AS (SELECT user_id AS u, event_id AS id, coalesce(value, 0.0) AS v, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) - 1 AS step FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL),
ob AS (SELECT u, CAST(u AS VARCHAR) AS sim_id, i, 'Object ' || ((u * 3 + CASE WHEN u % 5 = 0 AND i = 4 THEN 3 ELSE i END) % 9) AS name, 1.0 + (u + 2 * i) % 5 AS mass, (1 + (u * i) % 7) / 1000.0 AS volume,
  100.0 * (1 + (u + i) % 6) AS density, 1e6 * (1 + (u + i) % 4) AS young, ['wood', 'steel', 'foam', 'glass', 'clay'][(u + i) % 5 + 1] AS material, u % 5 <> 0 OR i < 3 AS uniq FROM (SELECT DISTINCT u FROM e), range(1, 5) r(i)),
st AS (SELECT ob.*, e.step, e.id, 2 * i + CASE WHEN u % 2 = 0 THEN e.v ELSE e.step / 1000.0 END AS x, ((u + i) % 7) / 10.0 AS y, 0.5 AS z,
  CASE WHEN e.id % 13 = 0 AND e.id % 4 + 1 = i AND e.id % 2 = 0 THEN 200.0 ELSE 500 + (e.id + i) % 50 END AS px, CASE WHEN e.id % 13 = 0 AND e.id % 4 + 1 = i AND e.id % 2 = 1 THEN 0.3 ELSE 0.75 + ((e.id + 3 * i) % 20) / 100.0 END AS vis FROM e JOIN ob USING (u)),
cam AS (SELECT CAST(u AS VARCHAR) AS sim_id, step, -5.0 - 0.02 * step * (u % 3) AS ey, 3 + u % 4 AS ez, 0.7 + 0.01 * step * (u % 2) AS fov FROM e),
kin AS (SELECT *, sqrt(pow((x - lag(x) OVER w) * 25, 2) + pow((y - lag(y) OVER w) * 25, 2)) AS speed FROM st WINDOW w AS (PARTITION BY sim_id, i ORDER BY step)),
seen AS (SELECT * FROM kin WHERE uniq AND vis > 0.7 AND px >= 500), seen_mass AS (SELECT * FROM kin WHERE uniq AND vis >= 0.7 AND px > 500),
n AS (SELECT sim_id, step, count(*) AS shown FROM seen GROUP BY ALL), ready AS (SELECT seen.*, shown FROM seen JOIN n USING (sim_id, step) WHERE shown >= 4), ready1 AS (SELECT seen.*, shown FROM seen JOIN n USING (sim_id, step)),
nm AS (SELECT sim_id, step, count(*) AS shown FROM seen_mass GROUP BY ALL), ready_mass AS (SELECT seen_mass.*, shown FROM seen_mass JOIN nm USING (sim_id, step)),
hits AS (SELECT CAST(u AS VARCHAR) AS sim_id, step, id % 4 + 1 AS a, CASE WHEN id % 3 = 0 THEN 0 ELSE (id + 1) % 4 + 1 END AS b FROM e WHERE event_type = 'error'),
touch AS (SELECT sim_id, step, a AS i, b AS p FROM hits UNION ALL SELECT sim_id, step, b, a FROM hits WHERE b <> 0)"""


def _step(name, rows):
    """SQL of ``c``: the rows of the chosen step of each scene."""
    return f"s AS (SELECT sim_id, arg_min(step, sha256(concat_ws(':', '42', '{name}', sim_id, step))) AS step FROM (SELECT DISTINCT sim_id, step FROM ({rows})) GROUP BY 1), c AS (SELECT r.* FROM ({rows}) r JOIN s USING (sim_id, step))"


def _order(name):
    """SQL of ``k``: the rows of ``c`` numbered in hash order."""
    return f"k AS (SELECT *, row_number() OVER (PARTITION BY sim_id, step ORDER BY sha256(concat_ws(':', '42', '{name}', sim_id, i)), i) AS k, count(*) OVER (PARTITION BY sim_id, step) AS many FROM c)"


def _one(name, rows, answer, asked="name", more=""):
    return f"WITH {_BASE}, {_step(name, rows)}, {_order(name)} SELECT sim_id, step, {asked} AS asked, {answer} AS answer FROM k {more} WHERE k = 1"


def _two(name, rows, answer):
    return f"WITH {_BASE}, {_step(name, rows)}, {_order(name)} SELECT a.sim_id, a.step, a.name || '|' || b.name AS asked, {answer} AS answer FROM k a JOIN k b ON a.sim_id = b.sim_id AND a.k = 1 AND b.k = 2"


def _extreme(name, rows, expr, most, more=""):
    pick = f"row_number() OVER (PARTITION BY c.sim_id ORDER BY {expr} {'DESC' if most else 'ASC'}, i)"
    return f"WITH {_BASE}, {_step(name, rows)}, b AS (SELECT c.sim_id, c.step, name, {pick} AS k FROM c {more}) SELECT sim_id, step, '' AS asked, name AS answer FROM b WHERE k = 1"


def _margin(name, rows, most):
    order = f"ORDER BY mass {'DESC' if most else 'ASC'}, name"
    return f"""WITH {_BASE}, {_step(name, rows)}, b AS (SELECT *, row_number() OVER (PARTITION BY sim_id {order}) AS k, lead(mass) OVER (PARTITION BY sim_id {order}) AS second FROM c)
SELECT sim_id, step, '' AS asked, name AS answer FROM b WHERE k = 1 AND (second IS NULL OR abs(mass - second) >= 0.1 * least(mass, second))"""


_ALL2 = "SELECT * FROM ready WHERE shown >= 2"
_CAMERA = "JOIN cam USING (sim_id, step)"
_AWAY = "sqrt(pow(x, 2) + pow(y - ey, 2) + pow(z - ez, 2))"
#: Ready objects in runs without a gap of more than two steps, with their place in the run.
_RUNS = """
w AS (SELECT *, CASE WHEN step - lag(step) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM ready WINDOW w AS (PARTITION BY sim_id, i ORDER BY step)), r0 AS (SELECT *, sum(new) OVER (PARTITION BY sim_id, i ORDER BY step) AS run FROM w),
runs AS (SELECT *, count(*) OVER (PARTITION BY sim_id, i, run) AS long, row_number() OVER (PARTITION BY sim_id, i, run ORDER BY step) AS spot FROM r0),
far AS (SELECT *, sqrt((x - lag(x, 14) OVER w) * (x - lag(x, 14) OVER w) + (y - lag(y, 14) OVER w) * (y - lag(y, 14) OVER w)) AS displacement, abs(x - lag(x) OVER w) > 0.05 AS moves FROM runs WHERE long >= 16 WINDOW w AS (PARTITION BY sim_id, i, run ORDER BY step)),
flags AS (SELECT *, CASE WHEN spot >= 8 THEN coalesce(bool_or(moves) OVER (PARTITION BY sim_id, i, run ORDER BY step ROWS 6 PRECEDING), false) END AS moved FROM far),
place AS (SELECT sim_id, step, row_number() OVER (PARTITION BY sim_id ORDER BY step) - 1 AS spot FROM (SELECT DISTINCT sim_id, step FROM ready)),
f AS (SELECT flags.* FROM flags JOIN place USING (sim_id, step) WHERE moved IS NOT NULL AND place.spot BETWEEN 14 AND 30),
clip AS (SELECT CAST(u AS VARCHAR) AS sim_id, step FROM e WHERE step >= 14)"""


def _clip(name, rows, tail):
    return f"WITH {_BASE}, {_RUNS}, {_step(name, rows)}, {_order(name)} {tail}"


def _event(name, ground):
    rows = f"SELECT r.sim_id, r.step, r.i, r.name FROM ready r JOIN touch t ON r.sim_id = t.sim_id AND r.step = t.step AND r.i = t.i WHERE t.p {'=' if ground else '<>'} 0"
    return f"WITH {_BASE}, h AS ({rows}), f AS (SELECT *, row_number() OVER (PARTITION BY sim_id ORDER BY step, i) AS k FROM h) SELECT sim_id, step, name AS asked, lpad(CAST(step * 4 AS VARCHAR), 6, '0') AS answer FROM f WHERE k = 1 AND step >= 6"


_D = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"
SQL = {
    "F_DISTANCE_OBJECT_OBJECT": lambda n: _two(n, _ALL2, f"printf('%.2f', {_D})"),
    "F_DISTANCE_OBJECT_CAMERA_DISTANCE": lambda n: _one(n, "SELECT * FROM ready", f"printf('%.2f', {_AWAY})", more=_CAMERA),
    "F_CLOSEST_OBJECT_CAMERA": lambda n: _extreme(n, _ALL2, f"-{_AWAY}", True, "JOIN cam ON cam.sim_id = c.sim_id AND cam.step = c.step"),
    "F_CLOSEST_OBJECT_OBJECT": lambda n: f"WITH {_BASE}, {_step(n, _ALL2)}, {_order(n)}, d AS (SELECT a.sim_id, a.step, a.name AS asked, b.name AS answer, row_number() OVER (PARTITION BY a.sim_id ORDER BY {_D}, b.i) AS r FROM k a JOIN k b ON a.sim_id = b.sim_id AND a.k = 1 AND b.k > 1) SELECT sim_id, step, asked, answer FROM d WHERE r = 1",
    "F_SIZE_OBJECT": lambda n: _one(n, "SELECT * FROM ready", "printf('%.2f', volume * 1e6)"),
    "F_SIZE_OBJECT_BIGGER": lambda n: _extreme(n, _ALL2, "volume", True),
    "F_SIZE_OBJECT_SMALLER": lambda n: _extreme(n, _ALL2, "volume", False),
    "F_KINEMATICS_SPEED_OBJECT": lambda n: _one(n, "SELECT * FROM ready WHERE speed IS NOT NULL", "printf('%.2f', speed)"),
    "F_KINEMATICS_DISTANCE_TRAVELED_INTERVAL": lambda n: _clip(n, "SELECT * FROM far WHERE displacement IS NOT NULL", "SELECT sim_id, step, name AS asked, printf('%.1f', CAST(round(CAST(CAST(displacement AS VARCHAR) AS DECIMAL(30, 15)), 1) AS DOUBLE)) AS answer FROM k WHERE k = 1"),
    "F_KINEMATICS_MOVING_OBJECT": lambda n: _clip(n, "SELECT * FROM f", f", g AS (SELECT sim_id, step, arg_min(name, sha256(concat_ws(':', '42', '{n}', sim_id, i))) FILTER (moved) AS mover, count(*) FILTER (NOT moved) AS rest FROM k GROUP BY ALL) SELECT sim_id, step, '' AS asked, coalesce(mover, 'No Object') AS answer FROM g JOIN clip USING (sim_id, step) WHERE rest > 0"),
    "F_KINEMATICS_STILL_OBJECT": lambda n: _clip(n, "SELECT * FROM f", "SELECT k.sim_id, k.step, name AS asked, CASE WHEN moved THEN 'no' ELSE 'yes' END AS answer FROM k JOIN clip USING (sim_id, step) WHERE k = 1"),
    "F_COLLISION_OBJECT_OBJECT_FRAME_SINGLE": lambda n: f"WITH {_BASE}, h AS (SELECT r.sim_id, r.step, r.i, r.name, o.name AS answer, row_number() OVER (PARTITION BY r.sim_id ORDER BY r.step, r.i, r.name, o.name) AS k FROM ready r JOIN touch t ON r.sim_id = t.sim_id AND r.step = t.step AND r.i = t.i AND t.p <> 0 JOIN ob o ON o.sim_id = r.sim_id AND o.i = t.p) SELECT sim_id, step, name AS asked, answer FROM h WHERE k = 1",
    "F_COLLISION_OBJECT_OBJECT_FRAME_MULTI": lambda n: _event(n, False),
    "F_COLLISION_OBJECT_SCENE_FRAME_SINGLE": lambda n: _one(n, "SELECT * FROM ready", "CASE WHEN EXISTS (SELECT 1 FROM touch t WHERE t.sim_id = k.sim_id AND t.step = k.step AND t.i = k.i AND t.p = 0) THEN 'yes' ELSE 'no' END"),
    "F_COLLISION_OBJECT_SCENE_FRAME_MULTI": lambda n: _event(n, True),
    "F_MASS_OBJECT": lambda n: _one(n, "SELECT * FROM ready", "printf('%.2f', mass)"),
    "F_MASS_HEAVIEST_OBJECT": lambda n: _margin(n, "SELECT * FROM ready_mass WHERE shown >= 4", True),
    "F_MASS_LIGHTEST_OBJECT": lambda n: _margin(n, "SELECT * FROM ready_mass WHERE shown >= 2", False),
    "F_MASS_COMPARE_OBJECTS": lambda n: _two(n, "SELECT * FROM ready1 WHERE shown >= 2", "CASE WHEN a.mass < b.mass THEN 'no' ELSE 'yes' END"),
    "F_PHYSICS_PROPERTY_DENSITY_OBJECT": lambda n: _one(n, "SELECT * FROM ready1", "printf('%.1f', density)"),
    "F_PHYSICS_PROPERTY_YOUNG_MODULUS_OBJECT": lambda n: _one(n, "SELECT * FROM ready1", "printf('%.2e', young)"),
    "F_MATERIAL_IDENTIFICATION_OBJECT": lambda n: _one(n, "SELECT * FROM ready1", "material"),
    "F_VISIBILITY_OBJECT": lambda n: _one(n, "SELECT * FROM ready", "name", asked="''"),
    "F_VISIBILITY_PERCENTAGE_OBJECT": lambda n: _one(n, "SELECT * FROM kin WHERE uniq", "CASE WHEN vis * 100 < 25 THEN '0-25' WHEN vis * 100 < 50 THEN '25-50' WHEN vis * 100 < 75 THEN '50-75' ELSE '75-100' END"),
    "F_VIEWPOINT_CAMERA_ANGLE": lambda n: f"WITH {_BASE}, {_step(n, 'SELECT * FROM cam')}, p AS (SELECT *, degrees(asin(-ez / sqrt(ey * ey + ez * ez))) AS p FROM c) SELECT sim_id, step, '' AS asked, CASE WHEN p <= -60 THEN 'top-down' WHEN p <= -15 THEN 'high angle' WHEN p < 15 THEN 'eye level' WHEN p < 60 THEN 'low angle' ELSE 'bottom-up' END AS answer FROM p",
    "F_FOCAL_LENGTH_CLASS": lambda n: f"WITH {_BASE}, {_step(n, 'SELECT * FROM cam')}, p AS (SELECT *, degrees(2 * atan(tan(fov / 2) * 1000 / 562)) AS p FROM c) SELECT sim_id, step, '' AS asked, CASE WHEN p >= 100 THEN 'ultra-wide' WHEN p >= 60 THEN 'wide' WHEN p >= 20 THEN 'standard' ELSE 'telephoto' END AS answer FROM p",
    "F_CAMERA_ZOOM_BEHAVIOR": lambda n: f"WITH {_BASE}, z AS (SELECT *, lead(fov, 16) OVER w AS mid, lead(fov, 28) OVER w AS last FROM cam WINDOW w AS (PARTITION BY sim_id ORDER BY step)), {_step(n, 'SELECT * FROM z WHERE last IS NOT NULL')}, p AS (SELECT *, degrees(mid) - degrees(fov) AS a, degrees(last) - degrees(mid) AS b FROM c), q AS (SELECT *, CASE WHEN a < -5 THEN 'zoom in' WHEN a > 5 THEN 'zoom out' ELSE 'no zoom' END AS one, CASE WHEN b < -5 THEN 'zoom in' WHEN b > 5 THEN 'zoom out' ELSE 'no zoom' END AS two FROM p) SELECT sim_id, step, '' AS asked, CASE WHEN one = two THEN one ELSE one || ' then ' || two END AS answer FROM q",
}


def _register(name: str) -> None:
    def f(spark, folder):
        got = R.RESOLVERS[name](scenes(spark, folder))
        asked = F.array_join(F.map_values("attributes"), "|")
        return got.select("sim_id", F.col("step").cast("long").alias("step"), asked.alias("asked"), F.get("labels", F.col("correct")).alias("answer"))

    f.__name__ = "scene_" + name.removeprefix("F_").lower()
    f.__doc__ = f"Answers to {name} over the scenes of the events."
    query(SQL[name](name))(f)


for _name in SQL:
    _register(_name)


@query(f"""
WITH {_BASE}, q AS (SELECT unnest(['F_SIZE_OBJECT', 'F_MASS_COMPARE_OBJECTS', 'F_VIEWPOINT_CAMERA_ANGLE']) AS question_id), u AS (SELECT DISTINCT CAST(u AS VARCHAR) AS sim_id FROM e),
a AS (SELECT DISTINCT sim_id, 'F_SIZE_OBJECT' AS question_id FROM ready UNION SELECT DISTINCT sim_id, 'F_MASS_COMPARE_OBJECTS' FROM ready1 WHERE shown >= 2 UNION SELECT sim_id, 'F_VIEWPOINT_CAMERA_ANGLE' FROM u)
SELECT question_id, a.sim_id IS NOT NULL AS answered, CASE WHEN a.sim_id IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM seen WHERE seen.sim_id = u.sim_id) THEN 'too little for this question' ELSE 'no visible object' END END AS reason, count(*) AS n
FROM u CROSS JOIN q LEFT JOIN a USING (sim_id, question_id) GROUP BY ALL
""")
def answer_ledger(spark, folder):
    """How many scenes answer three of the questions, and why the others do not; together they are scenes times questions."""
    s = scenes(spark, folder)
    worlds = s.objects.select("sim_id", F.lit(False).alias("bad")).distinct()
    rows = R.ledger(s, worlds, ["F_SIZE_OBJECT", "F_MASS_COMPARE_OBJECTS", "F_VIEWPOINT_CAMERA_ANGLE"])
    return rows.groupBy("question_id", "answered", "reason").agg(F.count(F.lit(1)).alias("n"))


def _draw(n: str, name: str, low: float, high: float) -> str:
    return f"CAST(round({low} + CAST(CAST('0x' || substr(sha256(concat_ws(':', '42', sim_id, '{n}', '{name}')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * {high - low!r}, 1) AS VARCHAR)"


def _pick(n: str, name: str, items: str) -> str:
    return f"{items}[CAST(CAST('0x' || substr(sha256(concat_ws(':', '42', sim_id, '{n}', '{name}')), 1, 13) AS BIGINT) % len({items}) + 1 AS BIGINT)]"


@query(f"""
WITH {_BASE}, m AS (SELECT sim_id, list_sort(list(DISTINCT material)) AS materials, list(name ORDER BY sha256(concat_ws(':', '42', sim_id, 'q1', i))) FILTER (uniq) AS o1, list(name ORDER BY sha256(concat_ws(':', '42', sim_id, 'q2', i))) FILTER (uniq) AS o2 FROM ob GROUP BY 1),
t AS (SELECT CAST(u AS VARCHAR) AS sim_id, list_sort(list(DISTINCT step / 25.0)) AS times FROM e GROUP BY 1), p AS (SELECT * FROM m JOIN t USING (sim_id))
SELECT sim_id, 'q1' AS question_id, 'Is ' || o1[1] || ' of ' || {_pick('q1', 'MATERIAL', 'materials')} || ' nearer than ' || {_draw('q1', 'DISTANCE', 1.0, 5.0)} || ' to ' || o1[2] || ' at ' || CAST({_pick('q1', 'TIME', 'times')} AS VARCHAR) || '?' AS question FROM p
UNION ALL SELECT sim_id, 'q2', o2[1] || ' of ' || {_draw('q2', 'MASS', 0.1, 3.0)} || ', a toy' FROM p
UNION ALL SELECT sim_id, 'q3', NULL FROM p
""")
def filled_templates(spark, folder):
    """Three templates filled for every scene: objects, material, distance, time, mass and category; one has a name of no known kind."""
    from . import placeholders

    rows = [("q1", "Is <OBJECT_1> of <MATERIAL> nearer than <DISTANCE> to <OBJECT_2> at <TIME>?"), ("q2", "<OBJECT> of <MASS>, a <CATEGORY>"), ("q3", "What of <NOTHING>?")]
    return placeholders.resolve(scenes(spark, folder), spark.createDataFrame(rows, "question_id string, question string")).drop("attributes")
