"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may go without one: it then gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="scenelake-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` wrote and that no later step reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on a Python step of the session holds at most ``rows`` rows at once: whole texts are large rows.

    A session that asks for less keeps its own number. Only what is held at a time depends on it, no result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digest_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the folds of the contracts."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def tail(z: Column) -> Column:
    """Upper tail of the standard normal, within 0.2 per cent of a probability: 0.5 exp(-0.717 z - 0.416 z^2) for z >= 0."""
    a = F.abs(z)
    half = F.lit(0.5) * F.exp(-a * 0.717 - a * a * 0.416)
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def running(x: Column, zero: Column, plus) -> Column:
    """For each element of an array what ``plus``, an associative function, makes of all before it, from ``zero`` on.

    The array is taken in stretches of about the root of its length, so no list grows by an element at a time over all of it.
    """
    none = F.slice(F.array(zero), 1, 0)

    def scan(part, start):
        grown = lambda a, v: F.struct(plus(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), grown, lambda a: a["out"])

    def parted(x, step):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / step).cast("int")), lambda i: F.slice(x, i * step + 1, step))

    def joined(parts):
        starts = scan(F.transform(parts, lambda p: F.aggregate(p, zero, plus)), zero)
        return F.flatten(F.zip_with(parts, starts, scan))

    root = lambda x: F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(x)))).cast("int")
    whole = lambda x: F.when(F.size(x) > 16, let(let(root(x), lambda step: parted(x, step)), joined)).otherwise(scan(x, zero))
    return let(x, whole)


def matches(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: array of (start, end, match) for all leftmost non-overlapping matches, in code points, end exclusive.

    ``pattern`` never matches the empty string. The text is cut at the matches and the lengths of what lies between
    are summed, so no row-at-a-time Python is needed. Texts without a match cost one search.
    """
    bare = "array<struct<start:bigint,end:bigint,m:string>>"
    df = df.withColumn("__hit", F.col(text).rlike(pattern))
    df = df.withColumn("__hits", F.when(F.col("__hit"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))
    df = df.withColumn("__gaps", F.when(F.col("__hit"), F.transform(F.split(F.col(text), pattern, -1), lambda p: F.length(p).cast("bigint"))))
    sizes = F.zip_with(F.slice(F.col("__gaps"), F.lit(1), F.size("__hits")), F.col("__hits"), lambda g, m: g + F.length(m).cast("bigint"))
    df = df.withColumn("__before", F.when(F.col("__hit"), running(sizes, F.lit(0).cast("bigint"), lambda a, n: a + n)))
    # what lies before each match: the matches and gaps before it, and its own gap
    starts = F.zip_with("__before", F.slice(F.col("__gaps"), F.lit(1), F.size("__hits")), lambda b, g: b + g)
    found = F.zip_with(starts, F.col("__hits"), lambda b, m: F.struct(b.alias("start"), (b + F.length(m).cast("bigint")).alias("end"), m.alias("m")))
    return df.withColumn(out, F.when(F.col("__hit"), found).otherwise(F.array().cast(bare))).drop("__hit", "__hits", "__gaps", "__before")
