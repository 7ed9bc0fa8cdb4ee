"""The catalogue of scene questions: each resolver is a plan over the scene tables that gives at most one answer a scene.

A resolver returns (sim_id, question_id, step, frames, attributes, labels, correct). Scenes that cannot answer have no row.
Choices of steps and objects are hashes of (seed, scene, question, candidate), so a plan gives the same rows on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import geometry as G
from ..functions import text as X
from ..functions.hashing import order_key
from ..operators import aggregates, joins, ordered, predicates, similarity
from ..operators import options as O
from ..sources import scene

ALL = -1
RESOLVERS: dict[str, Callable[["Scenes"], DataFrame]] = {}


def resolver(name: str):
    def add(f):
        RESOLVERS[name] = lambda s: f(s, name)
        return f

    return add


@dataclass
class Scenes:
    """The long tables of a set of scenes. ``visible`` has the uniquely named objects a step shows.

    ``images`` (sim_id, frame, pixels) holds rendered frames of ``image_shape`` (channels, height, width) with values of 0 to ``image_span``.
    """

    steps: DataFrame
    states: DataFrame
    objects: DataFrame
    collisions: DataFrame
    cloud: DataFrame | None = None
    config: EngineConfig = field(default=DEFAULT)
    images: DataFrame | None = None
    image_shape: tuple[int, int, int] = (3, 562, 1000)
    image_span: float = 255.0

    @classmethod
    def of(cls, worlds: DataFrame, names: DataFrame | None = None, cloud: DataFrame | None = None, config: EngineConfig = DEFAULT) -> "Scenes":
        steps = scene.steps(worlds)
        return cls(steps, scene.add_kinematics(scene.states(steps)), scene.objects(worlds, names), scene.collisions(steps), cloud, config)

    def visible(self, rule: str = "canonical") -> DataFrame:
        own = self.objects.where("unique").select("sim_id", "object_id", "name", "category", "material", "mass", "volume", "density", "young", "poisson")
        seen = predicates.visible(F.col("visibility"), F.col("pixels"), rule, self.config.min_visible_fraction, self.config.min_pixels)
        return self.states.where(seen).join(own, ["sim_id", "object_id"])

    def ready(self, need: int, rule: str = "canonical", floor: int = 1) -> DataFrame:
        """The visible objects of steps that show at least ``need`` of them (ALL: every object of the scene), and ``floor`` in any case."""
        seen = self.visible(rule)
        shown = seen.groupBy("sim_id", "step").agg(F.count(F.lit(1)).alias("shown"))
        if need == ALL:
            shown = shown.join(self.objects.groupBy("sim_id").agg(F.count(F.lit(1)).alias("all")), "sim_id").where("shown >= all")
        else:
            shown = shown.where(F.col("shown") >= need)
        return seen.join(shown.where(F.col("shown") >= floor).select("sim_id", "step", "shown"), ["sim_id", "step"])

    def key(self, name: str, *parts: str) -> Column:
        return order_key(self.config.seed, F.lit(name), *[F.col(p) for p in parts])

    def at_step(self, rows: DataFrame, name: str, listed: DataFrame | None = None) -> DataFrame:
        """The rows of one step of each scene, chosen by hash among those present.

        Questions over a clip take only steps from one clip's length on, up to the thirtieth, of the steps ``listed``.
        """
        steps = rows.select("sim_id", "step").distinct()
        if listed is not None:
            numbered = listed.select("sim_id", "step").distinct().withColumn("__i", F.row_number().over(Window.partitionBy("sim_id").orderBy("step")) - 1)
            first = (self.config.clip_frames - 1) * self.config.frame_stride
            steps = steps.join(numbered.where(F.col("__i").between(first, 30)).drop("__i"), ["sim_id", "step"])
        chosen = steps.groupBy("sim_id").agg(F.min_by("step", self.key(name, "sim_id", "step")).alias("step"))
        return rows.join(chosen, ["sim_id", "step"])

    def choose(self, rows: DataFrame, name: str, n: int = 1) -> DataFrame:
        """``n`` objects of each scene's step by hash, numbered from 1 in column k; scenes with fewer are dropped."""
        w = Window.partitionBy("sim_id", "step").orderBy(self.key(name, "sim_id", "object_id"), "object_id")
        out = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
        return out.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("sim_id", "step"))).where(F.col("__n") == n).drop("__n")

    def two(self, rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
        """Two chosen objects side by side, as columns with endings _1 and _2."""
        both = self.choose(rows, name, 2)
        side = lambda k: both.where(F.col("k") == k).select("sim_id", "step", *[F.col(c).alias(f"{c}_{k}") for c in columns])
        return side(1).join(side(2), ["sim_id", "step"])

    def finish(self, rows: DataFrame, name: str, labels: Column, truth: Column, attributes: dict[str, Column] | None = None, frames: DataFrame | None = None) -> DataFrame:
        """The resolver's rows, with the frame of the step unless other frames are given."""
        pairs = [x for k, v in (attributes or {}).items() for x in (F.lit(k), v.cast("string"))]
        made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        out = rows.select("sim_id", F.lit(name).alias("question_id"), "step", made.alias("attributes"), labels.alias("labels"), truth.alias("__t"))
        out = out.where(F.col("labels").isNotNull()).withColumn("correct", O.correct_index(F.col("labels"), F.col("__t"))).drop("__t")
        if frames is None:
            frames = self.steps.select("sim_id", "step", F.array(F.lpad(F.col("frame_idx").cast("string"), 6, "0")).alias("frames"))
        return out.join(frames, ["sim_id", "step"]).select("sim_id", "question_id", "step", "frames", "attributes", "labels", "correct")

    def clip(self) -> DataFrame:
        """For each step the frames of the clip that ends there; steps without a whole clip are left out."""
        named = self.steps.select("sim_id", "step", F.lpad(F.col("frame_idx").cast("string"), 6, "0").alias("frame"))
        return ordered.frames_before(named, ["sim_id"], "step", "frame", self.config.clip_frames, self.config.frame_stride).where("frames is not null").select("sim_id", "step", "frames")

    def clip_runs(self, need: int, length: int) -> DataFrame:
        """Ready objects in runs of at least ``length`` steps without a gap over two sampling periods."""
        return ordered.runs(self.ready(need), ["sim_id", "object_id"], "t", 2 * self.config.step_seconds + 1e-6, length)


def _names(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Adds ``present``, the other names of the scene's step."""
    return rows.join(others.groupBy("sim_id", "step").agg(F.array_sort(F.collect_set("name")).alias("present")), ["sim_id", "step"])


def _listed(s: Scenes, rows: DataFrame, column: str = "name") -> DataFrame:
    """Adds ``catalogue``: all values of a column of the objects, the models' names for instance, of which options are drawn."""
    one = s.objects.where(F.col(column).isNotNull()).agg(F.array_sort(F.collect_set(column)).alias("catalogue"))
    return rows.crossJoin(F.broadcast(one))  # one row


def _number(s: Scenes, name: str, rows: DataFrame, value: Column, decimals: int = 2, **bounds) -> DataFrame:
    rows = rows.withColumn("__v", value).where(F.col("__v").isNotNull())
    labels = O.numeric_options(F.col("__v"), s.config.seed, F.lit(name), F.col("sim_id"), decimals=decimals, **bounds)
    attrs = {c: F.col(x) for c, x in (("OBJECT", "name"), ("OBJECT_1", "name_1"), ("OBJECT_2", "name_2")) if x in rows.columns}
    return s.finish(rows, name, labels, O.fixed(F.col("__v"), decimals), attrs)


def _one(s: Scenes, name: str, need: int, floor: int = 1) -> DataFrame:
    return s.choose(s.at_step(s.ready(need, floor=floor), name), name)


def _named(s: Scenes, name: str, rows: DataFrame, truth: str, others: DataFrame, attributes: dict[str, Column] | None = None, frames: DataFrame | None = None) -> DataFrame:
    labels = O.listed_options(F.col(truth), F.col("present"), F.col("catalogue"), s.config.seed, F.lit(name), F.col("sim_id"))
    return s.finish(_listed(s, _names(rows, others)), name, labels, F.col(truth), attributes, frames)


def _center() -> Column:
    return F.col("obb.center")


def _fixed_labels(s: Scenes, name: str, rows: DataFrame, truth: Column, values: list[str], attributes: dict[str, Column] | None = None, frames: DataFrame | None = None) -> DataFrame:
    from ..functions.hashing import shuffle

    rows = rows.withColumn("__v", truth).where(F.col("__v").isNotNull())
    return s.finish(rows, name, shuffle(F.array(*map(F.lit, values)), s.config.seed, F.lit(name), F.col("sim_id")), F.col("__v"), attributes, frames)


# ---- space


@resolver("F_DISTANCE_OBJECT_OBJECT")
def distance_objects(s: Scenes, name: str) -> DataFrame:
    rows = s.two(s.at_step(s.ready(ALL, floor=2), name), name, ["name", "obb"])
    return _number(s, name, rows, joins.distance(F.col("obb_1.center"), F.col("obb_2.center")), low=0.0)


@resolver("F_DISTANCE_OBJECT_GROUND")
def distance_ground(s: Scenes, name: str) -> DataFrame:
    if s.cloud is None:
        raise ValueError("this resolver needs the scenes' point clouds")
    rows = _one(s, name, ALL)
    place = s.objects.select("sim_id", "scene").distinct()
    points = rows.select("sim_id", "object_id", *[F.get(_center(), F.lit(i)).alias(c) for i, c in enumerate("xyz")])
    gap = joins.cloud_distance(points, s.cloud.join(place, "scene").select("sim_id", "x", "y", "z"), ["sim_id"], "object_id", ("x", "y", "z"), 0.5)
    return _number(s, name, rows.join(gap, ["sim_id", "object_id"]), F.col("distance"), low=0.0)


def _with_camera(s: Scenes, rows: DataFrame) -> DataFrame:
    return rows.join(s.steps.select("sim_id", "step", "camera"), ["sim_id", "step"])


@resolver("F_DISTANCE_OBJECT_CAMERA_DISTANCE")
def distance_camera(s: Scenes, name: str) -> DataFrame:
    return _number(s, name, _with_camera(s, _one(s, name, ALL)), joins.distance(_center(), F.col("camera.eye")), low=0.0)


@resolver("F_CLOSEST_OBJECT_CAMERA")
def closest_camera(s: Scenes, name: str) -> DataFrame:
    rows = s.at_step(s.ready(ALL, floor=2), name)
    far = _with_camera(s, rows).withColumn("d", -joins.distance(_center(), F.col("camera.eye")))
    return _named(s, name, aggregates.best(far, ["sim_id", "step"], "d", ["name"], ["object_id"]), "name", rows)


@resolver("F_CLOSEST_OBJECT_OBJECT")
def closest_object(s: Scenes, name: str) -> DataFrame:
    rows = s.at_step(s.ready(ALL, floor=2), name)
    asked = s.choose(rows, name).select("sim_id", "step", F.col("object_id").alias("o"), F.col("name").alias("asked"), F.col("obb").alias("box"))
    near = rows.join(asked, ["sim_id", "step"]).where("object_id <> o").withColumn("d", joins.distance(_center(), F.col("box.center")))
    got = aggregates.best(near, ["sim_id", "step", "asked"], "d", ["name"], ["object_id"], largest=False)
    return _named(s, name, got, "name", near, {"OBJECT": F.col("asked")})


@resolver("F_SIZE_OBJECT")
def size_object(s: Scenes, name: str) -> DataFrame:
    return _number(s, name, _one(s, name, ALL), F.col("volume") * 1e6, low=0.0)


def _extreme(s: Scenes, name: str, metric: str, largest: bool) -> DataFrame:
    rows = s.at_step(s.ready(ALL, floor=2), name)
    return _named(s, name, aggregates.best(rows, ["sim_id", "step"], metric, ["name"], ["object_id"], largest), "name", rows)


@resolver("F_SIZE_OBJECT_BIGGER")
def bigger(s: Scenes, name: str) -> DataFrame:
    return _extreme(s, name, "volume", True)


@resolver("F_SIZE_OBJECT_SMALLER")
def smaller(s: Scenes, name: str) -> DataFrame:
    return _extreme(s, name, "volume", False)


@resolver("F_LAYOUT_POSITION_OBJECT_OBJECT")
def layout(s: Scenes, name: str) -> DataFrame:
    rows = _with_camera(s, s.two(s.at_step(s.ready(2, floor=2), name), name, ["name", "obb"]))
    cam = [F.col(f"camera.{c}") for c in ("eye", "at", "up")]
    lens = (G.radians_of(F.col("camera.fov")), F.col("camera.width"), F.col("camera.height"))
    for k in ("1", "2"):
        corners = G.box_corners(F.col(f"obb_{k}.center"), F.col(f"obb_{k}.extents"), F.col(f"obb_{k}.R"))
        seen = F.transform(corners, lambda c: G.project(c, *cam, *lens))
        rows = rows.withColumn(f"p{k}", F.transform(F.filter(seen, lambda p: p["u"].isNotNull()), lambda p: F.array(p["u"], p["v"])))
        rows = rows.withColumn(f"c{k}", G.project(F.col(f"obb_{k}.center"), *cam, *lens))
    where = G.relation(G.hull_iou("p1", "p2"), F.col("c1.u") - F.col("c2.u"), F.col("c1.v") - F.col("c2.v"), F.col("c1.depth") - F.col("c2.depth"))
    rows = rows.withColumn("rel", where)
    six = ["in front of", "behind", "left of", "right of", "above", "below"]
    labels = O.listed_options(F.col("rel"), F.array().cast("array<string>"), F.array(*map(F.lit, six)), s.config.seed, F.lit(name), F.col("sim_id"))
    return s.finish(rows, name, labels, F.col("rel"), {"OBJECT_1": F.col("name_1"), "OBJECT_2": F.col("name_2")})


# ---- motion


@resolver("F_KINEMATICS_SPEED_OBJECT")
def speed(s: Scenes, name: str) -> DataFrame:
    return _number(s, name, s.choose(s.at_step(s.ready(ALL).where("speed is not null"), name), name), F.col("speed"), low=0.0)


@resolver("F_KINEMATICS_ACCEL_OBJECT")
def accel(s: Scenes, name: str) -> DataFrame:
    return _number(s, name, s.choose(s.at_step(s.ready(ALL).where("accel is not null"), name), name), F.col("accel"), low=-100.0, high=100.0)


def _moving(s: Scenes) -> DataFrame:
    rows = s.clip_runs(ALL, 16).withColumns({c: F.get(_center(), F.lit(i)) for i, c in enumerate("xyz")})
    return ordered.net_displacement(rows, ["sim_id", "object_id", "run"], "t", ["x", "y", "z"], 14)


@resolver("F_KINEMATICS_DISTANCE_TRAVELED_INTERVAL")
def travelled(s: Scenes, name: str) -> DataFrame:
    # to fifteen decimals first: what a difference of places leaves beyond them does not decide a half
    told = F.col("displacement").cast("string").cast("decimal(30,15)").cast("double")
    return _number(s, name, s.choose(s.at_step(_moving(s).where("displacement is not null"), name), name), told, decimals=1, low=0.0)


def _flags(s: Scenes) -> DataFrame:
    rows = _moving(s).withColumn("euler", G.matrix_euler("obb.R"))
    rows = rows.withColumns({f"angle_{i}": F.get("euler", F.lit(i)) for i in range(3)})
    angles = ["angle_0", "angle_1", "angle_2"]
    return ordered.moved(rows, ["sim_id", "object_id", "run"], "t", ["x", "y", "z"], s.config.move_distance, 8, angles=angles, turn=s.config.move_degrees).where("moved is not null").drop("euler", *angles)


@resolver("F_KINEMATICS_MOVING_OBJECT")
def moving(s: Scenes, name: str) -> DataFrame:
    rows = s.at_step(_flags(s), name, s.ready(ALL))
    got = rows.groupBy("sim_id", "step").agg(F.coalesce(F.min_by("name", F.when(F.col("moved"), s.key(name, "sim_id", "object_id"))), F.lit("No Object")).alias("name"))
    return _named(s, name, got, "name", rows.where("not moved"), frames=s.clip())


@resolver("F_KINEMATICS_STILL_OBJECT")
def still(s: Scenes, name: str) -> DataFrame:
    rows = s.choose(s.at_step(_flags(s), name, s.ready(ALL)), name)
    return _fixed_labels(s, name, rows, F.when(F.col("moved"), "no").otherwise("yes"), ["yes", "no"], {"OBJECT": F.col("name")}, s.clip())


def _contacts(s: Scenes, ground: bool) -> DataFrame:
    """Contacts of visible objects, once for each partner that is no ground: (object_id, name, partner)."""
    rule = predicates.touches_ground if ground else predicates.between_objects
    pairs = s.collisions.where(rule(F.col("a"), F.col("b"))).select("sim_id", "step", F.explode(F.array(F.struct(F.col("a").alias("o"), F.col("b").alias("p")), F.struct(F.col("b").alias("o"), F.col("a").alias("p")))).alias("c"))
    pairs = pairs.where("c.o <> 0").select("sim_id", "step", F.col("c.o").cast("string").alias("object_id"), F.col("c.p").cast("string").alias("partner"))
    return s.ready(ALL).join(pairs, ["sim_id", "step", "object_id"])


def _partner(s: Scenes, rows: DataFrame) -> DataFrame:
    return rows.join(s.objects.select("sim_id", F.col("object_id").alias("partner"), F.col("name").alias("partner_name")), ["sim_id", "partner"])


@resolver("F_COLLISIONS_OBJ_OBJ_FIRST")
def first_partner(s: Scenes, name: str) -> DataFrame:
    asked = s.clip_runs(ALL, 8).groupBy("sim_id").agg(F.min_by(F.struct("object_id", "name"), s.key(name, "sim_id", "object_id")).alias("q")).select("sim_id", F.col("q.object_id").alias("object_id"), F.col("q.name").alias("name"))
    hit = _partner(s, _contacts(s, False).drop("name").join(asked, ["sim_id", "object_id"]))
    got = ordered.first_where(hit, ["sim_id", "object_id", "name"], ["step", "partner"], F.lit(True), ["partner_name"])
    last = s.ready(ALL).groupBy("sim_id").agg(F.max("step").alias("end"))
    rows = asked.join(got.select("sim_id", "step", "partner_name"), "sim_id", "left").join(last, "sim_id")
    rows = rows.select("sim_id", F.coalesce("step", "end").alias("step"), F.col("name").alias("asked"), F.coalesce("partner_name", F.lit("No Object")).alias("name"))
    return _named(s, name, rows, "name", s.ready(ALL).join(asked.select("sim_id", "object_id"), ["sim_id", "object_id"], "left_anti"), {"OBJECT": F.col("asked")})


@resolver("F_COLLISION_OBJECT_OBJECT_FRAME_SINGLE")
def contact_single(s: Scenes, name: str) -> DataFrame:
    hit = ordered.first_where(_partner(s, _contacts(s, False)), ["sim_id"], ["step", "object_id"], F.lit(True), ["name", "partner_name"])
    others = s.ready(ALL).join(hit.select("sim_id", F.col("name").alias("asked")), "sim_id").where("name <> asked")
    rows = hit.select("sim_id", "step", F.col("name").alias("asked"), F.col("partner_name").alias("name"))
    return _named(s, name, rows, "name", others, {"OBJECT": F.col("asked")})


def _frame_of(s: Scenes, name: str, hit: DataFrame) -> DataFrame:
    """Which of four frames, two steps apart, shows an event: the last one; labels are frames in hash order."""
    from ..functions.hashing import shuffle

    named = s.steps.select("sim_id", "step", F.lpad(F.col("frame_idx").cast("string"), 6, "0").alias("frame"))
    four = ordered.frames_before(named, ["sim_id"], "step", "frame", 4, s.config.frame_stride).where("frames is not null").select("sim_id", "step", "frames", "frame")
    rows = hit.join(four, ["sim_id", "step"])
    return s.finish(rows, name, shuffle(F.col("frames"), s.config.seed, F.lit(name), F.col("sim_id")), F.col("frame"), {"OBJECT": F.col("name")}, four.select("sim_id", "step", "frames"))


@resolver("F_COLLISION_OBJECT_OBJECT_FRAME_MULTI")
def contact_multi(s: Scenes, name: str) -> DataFrame:
    return _frame_of(s, name, ordered.first_where(_contacts(s, False), ["sim_id"], ["step", "object_id"], F.lit(True), ["name"]))


@resolver("F_COLLISION_OBJECT_SCENE_FRAME_SINGLE")
def ground_single(s: Scenes, name: str) -> DataFrame:
    rows = _one(s, name, ALL)
    touch = _contacts(s, True).select("sim_id", "step", "object_id", F.lit(True).alias("touch")).distinct()
    rows = rows.join(touch, ["sim_id", "step", "object_id"], "left")
    return _fixed_labels(s, name, rows, F.when(F.col("touch"), "yes").otherwise("no"), ["yes", "no"], {"OBJECT": F.col("name")})


@resolver("F_COLLISION_OBJECT_SCENE_FRAME_MULTI")
def ground_multi(s: Scenes, name: str) -> DataFrame:
    return _frame_of(s, name, ordered.first_where(_contacts(s, True), ["sim_id"], ["step", "object_id"], F.lit(True), ["name"]))


# ---- material


@resolver("F_MASS_OBJECT")
def mass(s: Scenes, name: str) -> DataFrame:
    return _number(s, name, _one(s, name, ALL), F.col("mass"), low=0.0)


def _by_margin(s: Scenes, name: str, need: int, largest: bool) -> DataFrame:
    rows = s.at_step(s.ready(need, "mass", floor=2), name)
    return _named(s, name, aggregates.with_margin(rows, ["sim_id", "step"], "mass", "name", s.config.mass_margin, largest), "name", rows)


@resolver("F_MASS_HEAVIEST_OBJECT")
def heaviest(s: Scenes, name: str) -> DataFrame:
    return _by_margin(s, name, ALL, True)


@resolver("F_MASS_LIGHTEST_OBJECT")
def lightest(s: Scenes, name: str) -> DataFrame:
    return _by_margin(s, name, 1, False)


@resolver("F_MASS_COMPARE_OBJECTS")
def compare_mass(s: Scenes, name: str) -> DataFrame:
    rows = s.two(s.at_step(s.ready(1, floor=2), name), name, ["name", "mass"])
    return _fixed_labels(s, name, rows, F.when(F.col("mass_1") < F.col("mass_2"), "no").otherwise("yes"), ["yes", "no"], {"OBJECT_1": F.col("name_1"), "OBJECT_2": F.col("name_2")})


@resolver("F_PHYSICS_PROPERTY_DENSITY_OBJECT")
def density(s: Scenes, name: str) -> DataFrame:
    return _number(s, name, _one(s, name, 1), F.col("density"), decimals=1, low=0.0)


@resolver("F_PHYSICS_PROPERTY_YOUNG_MODULUS_OBJECT")
def young(s: Scenes, name: str) -> DataFrame:
    rows = _one(s, name, 1).where("young > 0")
    labels = O.log_options(F.col("young"), s.config.seed, F.lit(name), F.col("sim_id"))
    return s.finish(rows, name, labels, F.format_string("%.2e", F.col("young")), {"OBJECT": F.col("name")})


@resolver("F_PHYSICS_PROPERTY_POISSON_RATIO_OBJECT")
def poisson(s: Scenes, name: str) -> DataFrame:
    rows = _one(s, name, 1).where("poisson is not null")
    labels = O.ratio_options(F.col("poisson"), s.config.seed, F.lit(name), F.col("sim_id"))
    return s.finish(rows, name, labels, O.fixed(F.col("poisson"), 2), {"OBJECT": F.col("name")})


@resolver("F_MATERIAL_IDENTIFICATION_OBJECT")
def material(s: Scenes, name: str) -> DataFrame:
    rows = _one(s, name, 1).where("material is not null")
    labels = O.listed_options(F.col("material"), F.array().cast("array<string>"), F.col("catalogue"), s.config.seed, F.lit(name), F.col("sim_id"))
    return s.finish(_listed(s, rows, "material"), name, labels, F.col("material"), {"OBJECT": F.col("name")})


# ---- view


@resolver("F_VISIBILITY_OBJECT")
def visibility(s: Scenes, name: str) -> DataFrame:
    rows = s.at_step(s.ready(ALL), name)
    one = s.choose(rows, name).join(rows.groupBy("sim_id", "step").agg(F.collect_set("name").alias("shown_names")), ["sim_id", "step"])
    one = _listed(s, one)
    absent = F.array_except(F.col("catalogue"), F.col("shown_names"))
    labels = O.listed_options(F.col("name"), F.array().cast("array<string>"), absent, s.config.seed, F.lit(name), F.col("sim_id"))
    return s.finish(one, name, labels, F.col("name"))


@resolver("F_VISIBILITY_PERCENTAGE_OBJECT")
def visible_share(s: Scenes, name: str) -> DataFrame:
    own = s.objects.where("unique").select("sim_id", "object_id", "name")
    rows = s.choose(s.at_step(s.states.where("visibility is not null").join(own, ["sim_id", "object_id"]), name), name)
    return _fixed_labels(s, name, rows, predicates.quarter_class(F.col("visibility") * 100), ["0-25", "25-50", "50-75", "75-100"], {"OBJECT": F.col("name")})


def _cameras(s: Scenes, name: str) -> DataFrame:
    return s.at_step(s.steps.where("camera is not null").select("sim_id", "step", "camera"), name)


def _classes(s: Scenes, name: str, rows: DataFrame, value: Column, classes: list[str] | Column, frames: DataFrame | None = None) -> DataFrame:
    rows = rows.withColumn("__c", value).where(F.col("__c").isNotNull())
    classes = classes if isinstance(classes, Column) else F.array(*map(F.lit, classes))
    labels = O.listed_options(F.col("__c"), F.array().cast("array<string>"), classes, s.config.seed, F.lit(name), F.col("sim_id"))
    return s.finish(rows, name, labels, F.col("__c"), None, frames)


@resolver("F_VIEWPOINT_CAMERA_ANGLE")
def camera_angle(s: Scenes, name: str) -> DataFrame:
    return _classes(s, name, _cameras(s, name), predicates.angle_class(G.pitch(F.col("camera.eye"), F.col("camera.at"))), ["top-down", "high angle", "eye level", "low angle", "bottom-up"])


@resolver("F_FOCAL_LENGTH_CLASS")
def focal_length(s: Scenes, name: str) -> DataFrame:
    c = lambda x: F.col(f"camera.{x}")
    return _classes(s, name, _cameras(s, name), predicates.focal_class(G.horizontal_fov(c("fov"), c("width"), c("height"))), ["ultra-wide", "wide", "standard", "telephoto"])


def _offsets(s: Scenes) -> DataFrame:
    """Steps with the camera half a clip and a whole clip later."""
    rows = s.steps.where("camera is not null").select("sim_id", "step", "camera", F.lpad(F.col("frame_idx").cast("string"), 6, "0").alias("frame"))
    return ordered.ahead(rows, ["sim_id"], "step", "camera", {"mid": 16, "end": 28}).where("mid is not null and end is not null")


@resolver("F_CAMERA_MOTION_DIRECTION")
def camera_motion(s: Scenes, name: str) -> DataFrame:
    rows = s.at_step(_offsets(s), name)
    basis = G.camera_basis(F.col("camera.eye"), F.col("camera.at"), F.col("camera.up"))
    rows = rows.withColumns(dict(zip(("right", "down", "forward"), basis)))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  worked out in a step of its own, not wherever it is named

    def move(a: str, b: str) -> Column:
        along = lambda d: F.array(G.dot(d, F.col("right")), -G.dot(d, F.col("down")), G.dot(d, F.col("forward")))
        return G.let(G.sub(F.col(f"{b}.eye"), F.col(f"{a}.eye")), along)

    def direction(m: str) -> Column:
        r, u, f = (F.get(m, F.lit(i)) for i in range(3))
        big = F.greatest(F.abs(r), F.abs(u), F.abs(f))
        return F.when(big < s.config.move_distance, "static").when(F.abs(f) == big, F.when(f > 0, "forward").otherwise("backward")).when(F.abs(r) == big, F.when(r > 0, "right").otherwise("left")).otherwise(F.when(u > 0, "up").otherwise("down"))

    rows = rows.withColumn("m1", once(move("camera", "mid"))).withColumn("m2", once(move("mid", "end")))
    rows = rows.withColumn("one", direction("m1")).withColumn("two", direction("m2"))
    rows = rows.withColumn("told", once(F.when(F.col("one") == F.col("two"), F.col("one")).otherwise(F.concat_ws(" then ", "one", "two"))))
    names = ["static", "forward", "backward", "right", "left", "up", "down"]
    turns = [f"{a} then {b}" for a, b in permutations(names, 2)]  # so that a truth of two parts does not stand alone
    wide = F.when(F.contains("told", F.lit(" then ")), F.array(*map(F.lit, turns))).otherwise(F.array(*map(F.lit, names)))
    return _classes(s, name, rows, F.col("told"), wide)


@resolver("F_CAMERA_ZOOM_BEHAVIOR")
def zoom(s: Scenes, name: str) -> DataFrame:
    rows = s.at_step(_offsets(s), name)
    fov = lambda c: F.degrees(G.radians_of(F.col(f"{c}.fov")))
    part = lambda d: F.when(d < -5, "zoom in").when(d > 5, "zoom out").otherwise("no zoom")
    one, two = part(fov("mid") - fov("camera")), part(fov("end") - fov("mid"))
    value = F.when(one == two, one).otherwise(F.concat_ws(" then ", one, two))
    return _classes(s, name, rows, value, ["zoom in", "zoom out", "no zoom", "zoom in then zoom out", "zoom out then zoom in"])


# ---- time


def _frames(s: Scenes, n: int, stride: int) -> DataFrame:
    rows = s.steps.select("sim_id", "step", F.lpad(F.col("frame_idx").cast("string"), 6, "0").alias("frame"))
    return ordered.frames_before(rows, ["sim_id"], "step", "frame", n, stride).where("frames is not null").select("sim_id", "step", "frames")


@resolver("F_TEMPORAL_SEQUENCE_IMAGES")
def sequence_images(s: Scenes, name: str) -> DataFrame:
    from ..functions.hashing import shuffle

    four = s.at_step(_frames(s, 4, 4), name).withColumn("mixed", shuffle(F.col("frames"), s.config.seed, F.lit(name), F.col("sim_id")))
    four = four.withColumn("truth", X.order_letters(F.col("mixed")))
    orders = ["-".join(o) for o in permutations("ABCD")]
    labels = O.listed_options(F.col("truth"), F.array().cast("array<string>"), F.array(*map(F.lit, orders)), s.config.seed, F.lit(name), F.col("sim_id"))
    return s.finish(four, name, labels, F.col("truth"), None, four.select("sim_id", "step", F.col("mixed").alias("frames")))


def _predict(s: Scenes, name: str, place: int) -> DataFrame:
    """Five frames, of which one is asked for; the wrong ones are the three frames, at least eight steps away, that look least like it."""
    if s.images is None:
        raise ValueError("this resolver needs the scenes' images")
    five = s.at_step(_frames(s, 5, 4), name)
    truth = F.get(F.col("frames"), F.lit(place))
    rows = five.withColumn("truth", truth).withColumn("shown", F.array_except("frames", F.array(truth)))
    named = s.steps.select("sim_id", F.col("step").alias("other"), F.lpad(F.col("frame_idx").cast("string"), 6, "0").alias("frame"))
    named = named.join(s.images.select("sim_id", "frame", "pixels"), ["sim_id", "frame"])
    asked = rows.join(named.select("sim_id", F.col("frame").alias("truth"), F.col("pixels").alias("va")), ["sim_id", "truth"]).select("sim_id", F.lit(-1).cast("long").alias("a"), "va")
    first, last = F.col("step") - 16, F.col("step")
    far = rows.select("sim_id", "step").join(named, "sim_id").where((F.col("other") < first - 8) | (F.col("other") > last + 8))
    least = similarity.least_similar(asked, far.select("sim_id", F.col("other").cast("long").alias("b"), F.col("pixels").alias("vb")), ["sim_id"], s.image_shape, 3, span=s.image_span)
    least = least.join(named.select("sim_id", F.col("other").cast("long").alias("b"), "frame"), ["sim_id", "b"])
    wrong = least.groupBy("sim_id").agg(F.array_sort(F.collect_list("frame")).alias("wrong"))
    rows = rows.join(wrong, "sim_id")
    labels = O.listed_options(F.col("truth"), F.col("wrong"), F.array().cast("array<string>"), s.config.seed, F.lit(name), F.col("sim_id"))
    return s.finish(rows, name, labels, F.col("truth"), None, rows.select("sim_id", "step", F.col("shown").alias("frames")))


@resolver("F_TEMPORAL_PREDICTION_NEXT_IMAGE")
def next_image(s: Scenes, name: str) -> DataFrame:
    return _predict(s, name, 4)


@resolver("F_TEMPORAL_PREDICTION_PREVIOUS_IMAGE")
def previous_image(s: Scenes, name: str) -> DataFrame:
    return _predict(s, name, 0)


@resolver("F_TEMPORAL_PREDICTION_MISSING_IMAGE")
def missing_image(s: Scenes, name: str) -> DataFrame:
    return _predict(s, name, 2)


def answer(s: Scenes, names: list[str] | None = None) -> DataFrame:
    """The rows of the named resolvers, or of all that the tables allow."""
    without = {n for n in RESOLVERS if s.cloud is None and n == "F_DISTANCE_OBJECT_GROUND" or s.images is None and n.startswith("F_TEMPORAL_PREDICTION")}
    wanted = names or [n for n in RESOLVERS if n not in without]
    unknown = [n for n in wanted if n not in RESOLVERS]
    if unknown:
        raise KeyError(f"no resolver {unknown}; there are {sorted(RESOLVERS)}")
    out = RESOLVERS[wanted[0]](s)
    for n in wanted[1:]:
        out = out.unionByName(RESOLVERS[n](s))
    return out


def ledger(s: Scenes, worlds: DataFrame, names: list[str]) -> DataFrame:
    """(sim_id, question_id, answered, reason): every scene with every question, once, and why a scene has no answer.

    The reasons: the document is broken; it has no object of a model of its own; no step shows one of them; or there are
    too few for this question, or nothing to choose from. Rows of the named resolvers are made once. Count with ``tally``.
    """
    asked = worlds.select("sim_id", "bad").withColumn("question_id", F.explode(F.array(*map(F.lit, names))))
    done = answer(s, names).select("sim_id", "question_id", F.lit(True).alias("answered")).distinct()
    unique = s.objects.where("unique").select("sim_id", F.lit(True).alias("named")).distinct()
    shown = s.visible().select("sim_id", F.lit(True).alias("shown")).distinct()
    out = asked.join(done, ["sim_id", "question_id"], "left").join(unique, "sim_id", "left").join(shown, "sim_id", "left")
    reason = F.when(F.col("answered"), None).when(F.col("bad"), "broken document").when(F.col("named").isNull(), "no object of its own model").when(F.col("shown").isNull(), "no visible object").otherwise("too little for this question")
    return out.select("sim_id", "question_id", F.coalesce("answered", F.lit(False)).alias("answered"), reason.alias("reason"))


def tally(rows: DataFrame, name: str = "answers") -> tuple[DataFrame, Observation]:
    """The ledger with an observation of its counts, which is filled while the rows are written: rows, answered, unanswered."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("answered").alias("answered"), F.count_if(~F.col("answered")).alias("unanswered")), seen


def records(answers: DataFrame, templates: DataFrame) -> DataFrame:
    """Question records: templates filled with attributes, assembled with frames and options, and the answer's letter."""
    df = answers.join(F.broadcast(templates.select("question_id", "category", "sub_category", "question")), "question_id")  # the catalogue: a row a template
    q = X.fill(F.col("question"), F.col("attributes"))
    return df.select("sim_id", "question_id", "category", "sub_category", F.col("frames").alias("file_name"), X.assemble(q, F.size("frames"), F.col("labels")).alias("question"), X.answer_letter(F.col("correct")).alias("answer"))
