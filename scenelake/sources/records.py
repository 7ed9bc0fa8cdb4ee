"""Question, answer and prediction records: JSON lists in, flat tables out, and the sinks that write them back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import letter

QUESTION = "scene string, source string, simulation_id string, file_name array<string>, question string, mode string, idx string, split string, choice_type string, question_id string, category string, sub_category string"
ANSWER = "idx string, answer string, task_type string, mode string, choice_type string"


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds a JSON list of records; one that is broken or no list raises when it is read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("allowComments", True).json(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """The template tree category -> question -> fields, as rows."""
    kind = "map<string,map<string,struct<task_splits:string,sub_category:string,choice:string,question:string>>>"
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", kind, {"allowComments": "true"}).alias("m"))
    rows = raw.select(F.explode("m").alias("category", "q")).select("category", F.explode("q").alias("question_id", "t"))
    return rows.select("category", "question_id", "t.*")


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one file for each model; the model is the file's name."""
    df = spark.read.schema("idx string, answer string").option("multiLine", True).json(folder)
    return df.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("model_id"), "idx", "answer")


def read_results(spark: SparkSession, paths: list[str], name: str = r"([^/]+)\.json$", pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Answers of models from files and folders, one file a model: (model_id, idx, letter), and (model_id, idx, answer) that have no letter.

    A file is read whole by one task. Where ``name`` takes the model from a folder, it may have any number of files.
    The letter is the first one anywhere in an answer; of several answers of a model to one id the last in its file
    counts, and of its files that with the last path. Records without an id, and files that are no JSON list, have no rows. Both tables are views of one scan.
    """
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(paths)
    model = F.regexp_extract("_metadata.file_path", name, 1).alias("model_id")
    items = raw.select(model, F.col("_metadata.file_path").alias("path"), F.explode(F.array(F.from_json("value", "array<struct<idx:string,answer:string>>"))).alias("items")).where("items is not null")
    rows = items.select("model_id", "path", F.posexplode("items").alias("spot", "r")).select("model_id", F.struct("path", "spot").alias("at"), F.trim("r.idx").alias("idx"), F.col("r.answer").alias("answer")).where("idx <> ''")
    rows = rows.withColumn("letter", F.coalesce(letter(F.col("answer")), F.lit("")))
    valid = rows.where("letter <> ''").groupBy("model_id", "idx").agg(F.max_by("letter", "at").alias("letter"))
    return valid, rows.where("letter = ''").select("model_id", "idx", F.coalesce("answer", F.lit("")).alias("answer"))


def percentage_map(spark: SparkSession, raw: str) -> dict[str, float]:
    """Shares by name from a JSON object, given as text or as the path of a file: 0 to 1 as they are, up to 100 as hundredths.

    An object that is empty, has a value that is no number or out of range, or text that is no JSON, raises ValueError.
    """
    text = raw if raw.lstrip()[:1] in ("{", "[", '"') else "\n".join(r[0] for r in spark.read.option("wholetext", True).text(raw).collect())  # one small file
    try:
        got = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"no JSON: {e}") from e
    if not isinstance(got, dict) or not got:
        raise ValueError("shares must be a JSON object with entries")
    bad = {k: v for k, v in got.items() if isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 100}
    if bad:
        raise ValueError(f"no shares: {bad}")
    return {k: v / 100 if v > 1 else float(v) for k, v in got.items()}


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct fields as columns with dotted names, at any depth; the plan is made from the schema alone."""
    def leaves(field: T.StructField, path: str, name: str):
        if isinstance(field.dataType, T.StructType):
            for f in field.dataType.fields:
                yield from leaves(f, f"{path}.`{f.name}`", f"{name}{sep}{f.name}")
        else:
            yield F.col(path).alias(name)

    return df.select([c for f in df.schema.fields for c in leaves(f, f"`{f.name}`", f.name)])


def text_table(df: DataFrame, first: list[str]) -> DataFrame:
    """All columns as text, the preferred ones first, the rest by name: nested values as JSON, null as the empty string."""
    names = [c for c in first if c in df.columns] + sorted(c for c in df.columns if c not in first)
    kind = dict(df.dtypes)
    as_text = lambda c: F.to_json(c) if kind[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    return df.select([F.coalesce(as_text(c), F.lit("")).alias(c) for c in names])


def write_tsv(df: DataFrame, path: str, first: list[str]) -> None:
    text_table(df, first).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
