"""What a run leaves: documents with kinematics, the 28-column table, question, answer and configuration files, table records."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import geometry as G
from ..operators import ordered, ranks

AXES = ("x", "y", "z")
#: The columns of the kinematics table.
KINEMATICS = ["time", "object_id", *(p + a for p in ("p", "v", "a", "j") for a in AXES), "speed", "a_t", "a_n", "curvature", *("m" + a for a in AXES), "ke_trans", *(p + a for p in ("w", "alpha") for a in AXES)]


def once(c: Column) -> Column:
    """A value worked out in a step of its own, not wherever it is named."""
    return F.explode(F.array(c))


def _put(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sim_id, text) from (sim_id, text, told): the JSON texts that ``told`` lists by step and object, put into the documents."""
    mark = uuid.uuid4().hex  # before what goes into the text as it is: numbers that a float would not give back so, and places in ``told``

    @lru_cache(1 << 14)
    def number(x: str) -> float | str:
        return f if repr(f := float(x)) == x else mark + x

    def members(pairs: list) -> dict:
        if len(got := dict(pairs)) < len(pairs):
            raise ValueError("a name occurs twice")
        return got

    def refuse(x: str) -> None:
        raise ValueError(f"{x} is no JSON")

    marked = re.compile(f'"{mark}([^"]*)"')
    read = json.JSONDecoder(object_pairs_hook=members, parse_float=number, parse_constant=refuse).decode

    def write(doc: dict, told: list[tuple], escaped: bool) -> str:
        raw = lambda m: told[int(m[1][1:])][2] if m[1][0] == "k" else m[1]
        return marked.sub(raw, json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=escaped))

    def one(text: str | None, told: list[tuple]) -> str | None:
        if text is None or not told:
            return text
        try:
            doc = read(text)
        except (ValueError, RecursionError):
            return text
        if not isinstance(doc, dict) or not isinstance(doc.get("simulation"), dict):
            return text
        steps = list(doc["simulation"].values())  # in the order of the text, which is how scenes are read
        for i, (at, name, _) in enumerate(told):
            step = steps[at] if at < len(steps) else None
            objects = step.get("objects") if isinstance(step, dict) else None
            if isinstance(objects, dict) and isinstance(objects.get(name), dict):
                objects[name]["kinematics"] = f"{mark}k{i}"
        out = write(doc, told, False)
        try:
            out.encode()
        except UnicodeEncodeError:  # half of a pair of surrogates, which only an escape can tell
            out = write(doc, told, True)
        return out

    for batch in rows:
        ends, told = batch["told"].offsets.to_pylist(), list(zip(*(c.to_pylist() for c in batch["told"].values.flatten())))
        texts = pa.array([one(*x) for x in zip(batch["text"].to_pylist(), (told[a:b] for a, b in pairwise(ends)))], pa.string())
        yield pa.RecordBatch.from_arrays([batch["sim_id"], texts], names=["sim_id", "text"])


def enriched(docs: DataFrame, states: DataFrame) -> DataFrame:
    """(sim_id, text): the documents (sim_id, text) with the kinematics of ``states`` in each object of each step.

    ``states`` has sim_id, step (the place in the document), object_id, v, speed, a and accel. Its rows are folded to one
    list a document and joined to it, so no task holds more than a batch of documents with their rows; sides that are
    dealt by sim_id are not shuffled. What a document has besides is kept, with members in the order of their names and
    numbers as they are written; steps or objects without a row are left as they are. Documents that are no JSON object,
    or have no steps, come out as they went in. Python puts the rows in: variants would be built anew at every level.
    """
    kinematics = F.to_json(F.struct("a", "accel", "speed", "v"), {"ignoreNullFields": "false"})
    told = states.groupBy("sim_id").agg(F.collect_list(F.struct("step", "object_id", kinematics.alias("kinematics"))).alias("told"))
    return docs.join(told.hint("merge"), "sim_id", "left").select(F.col("sim_id").cast("string"), "text", "told").mapInArrow(_put, "sim_id string, text string")


def write_documents(docs: DataFrame, folder: str, name: str = "sim_id") -> None:
    """One file a document, each in a folder of its own that is named for it."""
    docs.select(F.col("text").alias("value"), name).write.mode("overwrite").partitionBy(name).text(folder)


def write_document_lines(docs: DataFrame, folder: str, name: str = "sim_id") -> None:
    """Documents as lines (name, text) of packed JSON files: for sets so large that a file each costs more than what is in it."""
    docs.select(name, "text").write.mode("overwrite").option("compression", "gzip").json(folder)


def read_document_lines(spark: SparkSession, folder: str, name: str = "sim_id") -> DataFrame:
    return spark.read.schema(f"`{name}` string, text string").json(folder)


def write_lists(records: DataFrame, folder: str, record: str, key: Column, rows: int, most: int = 50_000) -> None:
    """Records as JSON lists, a file each of about ``most`` of the ``rows``, dealt by the hash of a key: one line a file."""
    parts = max(1, -(-rows // most))
    dealt = records.select(F.pmod(F.xxhash64(key), F.lit(parts)).alias("__part"), F.col(record).alias("__r")).repartitionByRange(parts, "__part")
    lists = dealt.groupBy("__part").agg(F.to_json(F.collect_list("__r")).alias("value")).select("value")
    lists.write.option("maxRecordsPerFile", 1).text(folder)


def kinematics_table(states: DataFrame, keys: list[str] = ["sim_id", "object_id"], t: str = "t", mass: Column | None = None) -> DataFrame:  # noqa: B006
    """The long table of 28 columns besides ``sim_id``: place, velocity, acceleration, jerk and what follows from them, rotation rate and its gradient.

    ``states`` has the keys, t, obb and, unless ``mass`` says otherwise, mass. Derivatives are second-order gradients.
    """
    mass = F.col("mass") if mass is None else mass
    df = states.withColumns({c: F.get("obb.center", F.lit(i)) for i, c in enumerate(AXES)}).withColumn("__m", mass)
    # the matrix goes first: what is put in order and kept for the gradients is narrow
    df = df.withColumn("__q", once(G.unit_quat(G.matrix_quat(F.col("obb.R"))))).select(*keys, t, *AXES, "__m", "__q")
    df = ordered.motion(df, keys, t, list(AXES), F.col("__m"))
    df = ordered.angular_velocity(df, keys, t, "__q", "__w").withColumns({f"__w{c}": F.get("__w", F.lit(i)) for i, c in enumerate(AXES)})
    for c in AXES:
        df = ordered.central_gradient(df, keys, t, f"__w{c}", f"__alpha{c}")
    told = {"time": F.col(t), "object_id": F.col("object_id"), "speed": F.col("speed"), "a_t": F.col("a_t"), "a_n": F.col("a_n"), "curvature": F.col("curvature"), "ke_trans": F.col("kinetic")}
    for c in AXES:
        told |= {f"p{c}": F.col(c), f"v{c}": F.col(f"v_{c}"), f"a{c}": F.col(f"a_{c}"), f"j{c}": F.col(f"j_{c}"), f"m{c}": F.col("__m") * F.col(f"v_{c}"), f"w{c}": F.col(f"__w{c}"), f"alpha{c}": F.col(f"__alpha{c}")}
    return df.select(*[k for k in keys if k != "object_id"], *[told[c].alias(c) for c in KINEMATICS])


def write_kinematics(table: DataFrame, folder: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(folder)


def numbered(records: DataFrame, order: list[str], mode: str = "mode") -> DataFrame:
    """Adds ``idx``: the number of a question among all, from 0, and the first letter of its mode, such as 12_g.

    ``order`` names the columns that tell one question from the next and put them in order; the modes of one question
    share its number. Numbers come from ranges of the order.
    """
    one = ranks.ordinal(records.select(*order).distinct(), [], list(order), "__n").withColumnsRenamed({c: f"__{c}" for c in order})
    joined = records.join(one, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in order])
    return joined.withColumn("idx", F.concat((F.col("__n") - 1).cast("string"), F.lit("_"), F.substring(mode, 1, 1))).drop("__n", *[f"__{c}" for c in order])


def write_run(records: DataFrame, folder: str, run: str, config: EngineConfig) -> dict[str, str]:
    """Three outputs of a run: test_<run> (questions), val_answer_<run> (answers) and test_<run>_config_used, each a folder of JSON lines."""
    paths = {"questions": f"{folder}/{run}/test_{run}", "answers": f"{folder}/{run}/val_answer_{run}", "config": f"{folder}/{run}/test_{run}_config_used"}
    task = records.withColumn("task_type", F.lit("factual"))
    questions = [c for c in ("scene", "source", "simulation_id", "file_name", "description", "question", "mode", "idx", "split", "choice_type", "question_id", "category", "sub_category") if c in records.columns]
    records.select(*questions).write.mode("overwrite").option("ignoreNullFields", False).json(paths["questions"])
    task.select("idx", "answer", "task_type", "mode", "choice_type").write.mode("overwrite").option("ignoreNullFields", False).json(paths["answers"])
    records.sparkSession.createDataFrame([(json.dumps(asdict(config)),)], "value string").coalesce(1).write.mode("overwrite").text(paths["config"])
    return paths


def table_records(items: DataFrame, objects: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Records for a table of questions: index, A to D, question, answer letter, category, objects named in the question, images in base64.

    ``items`` has idx, sim_id, question, labels, correct, category, file_name; ``objects`` has sim_id, name and model.
    An object is named if the question contains its name in any case, or a label is its model, blanks as underscores.
    ``images`` (path, content), if given, are joined by path, in the order of ``file_name``; a missing one is left out.
    """
    named = objects.where("name is not null").groupBy("sim_id").agg(F.array_sort(F.collect_set(F.struct("name", F.lower("model").alias("model")))).alias("__objects"))
    df = items.join(named, "sim_id", "left")
    models = F.transform("labels", lambda x: F.lower(F.replace(x, F.lit(" "), F.lit("_"))))
    found = F.filter(F.coalesce("__objects", F.array().cast("array<struct<name:string,model:string>>")), lambda o: F.contains(F.lower("question"), F.lower(o["name"])) | F.coalesce(F.array_contains(models, o["model"]), F.lit(False)))
    letters = [F.coalesce(F.get("labels", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate("ABCD")]
    out = df.withColumn("objects", F.array_sort(F.array_distinct(F.transform(found, lambda o: o["name"])))).withColumn("answer", F.when(F.col("correct").between(0, 3), F.char(F.col("correct") + 65)).otherwise(""))
    kept = [F.col("idx").alias("index"), *letters, F.trim("question").alias("question"), "answer", "category", F.lit("simulation").alias("source"), "objects"]
    if images is None:
        return out.select(*kept)
    shown = items.select("idx", F.posexplode("file_name").alias("__at", "path")).join(images.select("path", F.base64("content").alias("__text")), "path")
    shown = shown.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__text"))), lambda x: x["__text"]).alias("images"))
    return out.join(shown, "idx", "left").select(*kept, F.coalesce("images", F.array().cast("array<string>")).alias("images"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path if it is there whole, else what ``make`` gives, written there first. A new path makes it anew."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def moved_paths(files: Column, old: str, new: str, marker: str = "/render/") -> Column:
    """File lists with one folder in place of another, in the paths that hold the marker."""
    return F.transform(files, lambda f: F.when(F.contains(f, F.lit(marker)), F.replace(f, F.lit(old), F.lit(new))).otherwise(f))
