"""Values for the placeholders of question templates, drawn from a scene's own tables by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import order_key, pick, uniform
from .resolvers import Scenes

#: Ranges of the numbers that are drawn, to one decimal.
RANGES = {"DENSITY": (10.0, 600.0), "DISTANCE": (1.0, 5.0), "MASS": (0.1, 3.0), "STRESS-THRESHOLD": (0.0, 10.0), "VOLUME": (0.001, 0.5)}
KINDS = [*RANGES, "CAMERA", "CATEGORY", "OBJECT-CATEGORY", "MATERIAL", "OBJECT", "TIME"]


def pools(s: Scenes) -> DataFrame:
    """(sim_id, categories, materials, objects, times, camera): what a scene offers, one row a scene, values in order."""
    words = lambda c: F.array_sort(F.collect_set(X.blank_to_null(F.col(c))))
    named = s.objects.groupBy("sim_id").agg(words("category").alias("categories"), words("material").alias("materials"), F.array_sort(F.collect_list(F.when(F.col("unique"), F.struct("object_id", "name")))).alias("objects"))
    steps = s.steps.groupBy("sim_id").agg(F.array_sort(F.collect_set("t")).alias("times"), F.min_by("camera", "step").alias("camera"))
    return named.join(steps, "sim_id", "full")


def resolve(s: Scenes, templates: DataFrame) -> DataFrame:
    """(sim_id, question_id, attributes, question): every template filled for every scene.

    ``templates`` has question_id and question; they are a catalogue, a row a template, and go to every task. Names are
    <KIND> or <KIND_n>. Objects of one question are all different and of a model of their own; categories and materials
    are those of the scene, the camera that of its first step, a time one of its steps; other numbers come from fixed
    ranges. Every draw is a hash of (seed, scene, question, name). A name of no known kind, or one that the scene has
    nothing for, leaves ``attributes`` and ``question`` null: the question can't be put to that scene.
    """
    rows = pools(s).crossJoin(F.broadcast(templates.select("question_id", F.col("question").alias("__q"))))
    key = [F.col("sim_id"), F.col("question_id")]
    rows = rows.withColumn("__names", X.placeholders(F.col("__q")))
    mixed = F.transform(F.coalesce("objects", F.array().cast("array<struct<object_id:string,name:string>>")), lambda o: F.struct(order_key(s.config.seed, *key, o["object_id"]).alias("k"), o["name"].alias("name")))
    rows = rows.withColumn("__mixed", F.transform(F.array_sort(mixed), lambda o: o["name"]))
    kind = lambda name: F.regexp_replace(name, "_[0-9]+$", "")
    asked = F.filter("__names", lambda n: kind(n) == "OBJECT")
    rows = rows.withColumn("__asked", asked)

    def value(name: Column) -> Column:
        k = kind(name)
        drawn = [F.when(k == n, F.round(uniform(s.config.seed, *key, name, low=a, high=b), 1).cast("string")) for n, (a, b) in RANGES.items()]
        listed = lambda c: pick(F.coalesce(c, F.array().cast("array<string>")), s.config.seed, *key, name)
        return F.coalesce(
            *drawn, F.when(k.isin("CATEGORY", "OBJECT-CATEGORY"), listed(F.col("categories"))), F.when(k == "MATERIAL", listed(F.col("materials"))),
            F.when(k == "TIME", listed(F.transform("times", lambda t: t.cast("string")))), F.when(k == "CAMERA", F.to_json("camera")), F.when(k == "OBJECT", F.get("__mixed", (F.array_position("__asked", name) - 1).cast("int"))),
        )

    rows = rows.withColumn("__values", F.transform("__names", value))
    whole = F.forall("__values", lambda v: v.isNotNull())
    made = F.when(whole, F.map_from_arrays("__names", "__values"))
    return rows.select("sim_id", "question_id", made.alias("attributes"), F.when(whole, X.fill(F.col("__q"), made)).alias("question"))
