"""Scenes: one JSON document each, read whole with a fixed schema and opened into long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import natural_key

_BOX = "struct<R:array<array<double>>,center:array<double>,extents:array<double>>"
_MOTION = "struct<v:array<double>,speed:double,a:array<double>,accel:double>"
_STATE = f"struct<infov_pixels:double,fov_visibility:double,obb:{_BOX},kinematics:{_MOTION},stress:double>"
_CAMERA = "struct<eye:array<double>,at:array<double>,up:array<double>,fov:double,width:int,height:int,fov_axis:string>"
_STEP = f"struct<frame_idx:int,collisions:array<array<int>>,camera:{_CAMERA},objects:map<string,{_STATE}>>"
_OBJECT = "struct<model:string,sim:string,mass:double,volume:double,props:struct<rhos:double,yms:double,prs:double>,description:struct<object_name:string,object_name_short:string,material_group:string,category:string,category_gso:string,vlm_category:string,visible_material_name:string>>"
SCHEMA = f"struct<scene:struct<scene:string,name:string>,encoding:struct<classes:array<array<int>>>,metadata:struct<world_up:array<double>>,objects:map<string,{_OBJECT}>,simulation:map<string,{_STEP}>>"


def _texts(spark: SparkSession, paths: str | list[str], pattern: str) -> DataFrame:
    """Whole files by path. Patterns that match nothing are left out, unless none matches."""
    reader = lambda: spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    listed = [paths] if isinstance(paths, str) else paths
    path = spark._jvm.org.apache.hadoop.fs.Path
    held = [p for p in listed if path(p).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path(p))]
    return reader().text(held or listed)


def read(spark: SparkSession, paths: str | list[str], pattern: str = "simulation*.json", limit: int | None = None) -> DataFrame:
    """(sim_id, path, world, bad): one row a file below the paths. Files that are no JSON object have a null world and ``bad``."""
    df = parsed(_texts(spark, paths, pattern).select(F.col("_metadata.file_path").alias("path"), "value"))
    return df.orderBy(natural_key(F.col("path")), "path").limit(limit) if limit is not None else df


def parsed(raw: DataFrame) -> DataFrame:
    """The rows of ``read`` from whole texts (path, value), or (sim_id, value) where scenes are named already. Each text is parsed once, in a step of its own."""
    df = raw.select(*[c for c in raw.columns if c != "value"], F.explode(F.array(F.from_json("value", SCHEMA))).alias("world"))
    df = df.withColumn("bad", F.col("world").isNull() | F.col("world.simulation").isNull())
    return df if "sim_id" in raw.columns else df.withColumn("sim_id", F.element_at(F.split("path", "/"), -2))


def at_depths(root: str, depths: tuple[int, ...] = (3, 4), name: str = "simulation.json") -> list[str]:
    """Path patterns for ``read`` that find files so many folders below a root, and none elsewhere."""
    return [f"{root.rstrip('/')}/{'*/' * d}{name}" for d in depths]


def steps(worlds: DataFrame) -> DataFrame:
    """(sim_id, step, t, frame_idx, camera, collisions, states), with ``step`` the place in the document."""
    df = worlds.where("not bad").select("sim_id", F.posexplode("world.simulation").alias("step", "t_key", "s"))
    return df.select("sim_id", "step", F.col("t_key").cast("double").alias("t"), "s.frame_idx", "s.camera", "s.collisions", F.col("s.objects").alias("states"))


def objects(worlds: DataFrame, names: DataFrame | None = None, material_patch: dict[str, str] | None = None) -> DataFrame:
    """The object catalogue, with display names from a dimension (model, name), patched materials and whether the model is unique."""
    from ..operators.predicates import unique_in_scene

    df = worlds.where("not bad").select("sim_id", F.col("world.scene.scene").alias("scene"), F.explode("world.objects").alias("object_id", "o"))
    d = "o.description."
    patch = F.coalesce(*[F.when(F.col("o.model") == k, F.lit(v)) for k, v in (material_patch or {}).items()], F.lit(None).cast("string"))
    df = df.select(
        "sim_id", "scene", "object_id", "o.model", "o.sim", "o.mass", "o.volume", F.col("o.props.rhos").alias("density"), F.col("o.props.yms").alias("young"), F.col("o.props.prs").alias("poisson"),
        F.coalesce(F.col(d + "material_group"), patch).alias("material"), F.coalesce(F.col(d + "category_gso"), F.col(d + "category")).alias("category"), F.coalesce(F.col(d + "object_name_short"), F.col(d + "object_name"), F.col("o.model")).alias("own_name"),
    )
    if names is not None:
        df = df.join(F.broadcast(names.select(F.col("model").alias("__m"), F.col("name").alias("__n"))), F.col("model") == F.col("__m"), "left").withColumn("name", F.coalesce("__n", "own_name")).drop("__m", "__n")
    else:
        df = df.withColumn("name", F.col("own_name"))
    single = unique_in_scene(df.select("sim_id", "object_id", "model"), ["sim_id"], "model").select("sim_id", "object_id", F.lit(True).alias("unique"))
    return df.drop("own_name").join(single, ["sim_id", "object_id"], "left").withColumn("unique", F.coalesce("unique", F.lit(False)))


def states(step_rows: DataFrame) -> DataFrame:
    """One row for each object and step."""
    df = step_rows.select("sim_id", "step", "t", "frame_idx", F.explode("states").alias("object_id", "o"))
    return df.select("sim_id", "step", "t", "frame_idx", "object_id", F.col("o.infov_pixels").alias("pixels"), F.col("o.fov_visibility").alias("visibility"), F.col("o.obb").alias("obb"), F.col("o.kinematics.speed").alias("speed"), F.col("o.kinematics.accel").alias("accel"), "o.stress")


def collisions(step_rows: DataFrame) -> DataFrame:
    """One row for each contact (a, b)."""
    return step_rows.select("sim_id", "step", "t", "frame_idx", F.explode("collisions").alias("c")).select("sim_id", "step", "t", "frame_idx", F.get("c", F.lit(0)).alias("a"), F.get("c", F.lit(1)).alias("b"))


def add_kinematics(state_rows: DataFrame) -> DataFrame:
    """Velocity and acceleration of box centres by backward differences, as vectors and lengths."""
    from ..functions.geometry import norm
    from ..operators.ordered import backward_difference

    df = state_rows.withColumns({c: F.get("obb.center", F.lit(i)) for i, c in enumerate(("x", "y", "z"))})
    df = backward_difference(df, ["sim_id", "object_id"], "t", ["x", "y", "z"])
    whole = lambda p: F.when(F.col(p + "x").isNotNull(), F.array(p + "x", p + "y", p + "z"))
    df = df.withColumn("v", whole("v_")).withColumn("a", whole("a_"))
    return df.withColumn("speed", F.when(F.col("v").isNotNull(), norm(F.col("v")))).withColumn("accel", F.when(F.col("a").isNotNull(), norm(F.col("a")))).drop(*[p + c for p in ("v_", "a_") for c in "xyz"])
