"""Which of many names stand in a text: one automaton over all names for a batch, or an index of rare pieces for a list too long to send."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of names that may be sent to every task; an automaton takes some fifty times as much.
SENT = 4 << 20


def _by_automaton(df: DataFrame, text: str, row: list[str], names: list[tuple[str, int]], found: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(names)
    kept: dict[str, object] = {}

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if "made" not in kept:
            made = ahocorasick.Automaton()
            for name, place in sent.value:
                made.add_word(name, place)
            made.make_automaton()
            kept["made"] = made
        for batch in parts:
            rows, hits = [], []
            for i, t in enumerate(batch.column("__text").to_pylist()):
                got = {p for _, p in kept["made"].iter(t)} if t else ()
                rows += [i] * len(got)
                hits += got
            took = pa.Table.from_batches([batch.drop_columns(["__text"])]).take(pa.array(rows, pa.int64())).combine_chunks()
            for part in took.append_column(found, pa.array(hits, pa.int64())).to_batches():
                yield part

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in row), f"{found} long"])
    return df.select(*row, F.col(text).alias("__text")).mapInArrow(look, schema)


def _by_index(df: DataFrame, text: str, row: list[str], names: DataFrame, found: str, q: int) -> DataFrame:
    """Each name is looked up by the piece of it, of ``q`` characters, that fewest names share; shorter names by themselves."""
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, n if not isinstance(n, int) else F.lit(n))))
    cut = names.withColumn("n", F.least(F.lit(q), F.length("name"))).withColumn("piece", F.explode(pieces(F.col("name"), F.col("n"))))
    shared = cut.groupBy("piece").agg(F.count(F.lit(1)).alias("c"))
    rare = cut.join(shared, "piece").groupBy("name", "place").agg(F.min_by("piece", F.struct("c", "piece")).alias("piece"))
    short = names.select(F.least(F.lit(q), F.length("name")).alias("n")).distinct().agg(F.array_sort(F.collect_set("n")).alias("ns"))  # q numbers at most
    lengths = (short.first() or [None])[0] or []
    if not lengths:
        return _nothing(df, row, found)
    told = F.array_distinct(F.flatten(F.array(*[F.when(F.length("__text") >= n, pieces(F.col("__text"), int(n))).otherwise(F.array().cast("array<string>")) for n in lengths])))
    hit = df.select(*row, F.col(text).alias("__text")).withColumn("piece", F.explode(told)).join(rare, "piece").where(F.contains("__text", F.col("name")))
    return hit.select(*row, F.col("place").alias(found))


def _nothing(df: DataFrame, row: list[str], found: str) -> DataFrame:
    return df.select(*row, F.lit(None).cast("long").alias(found)).where(F.lit(False))


def contained(df: DataFrame, text: str, row: list[str], names: DataFrame, name: str, place: str, *, found: str = "place", sent: int = SENT, q: int = 6) -> DataFrame:
    """(row, found): one row for each row of ``df`` and each name that its text contains, by the name's whole number ``place``.

    Names are compared literally. Null and empty names, and names of null place, are in no text; of equal names the
    smallest place stands for all. Names of up to ``sent`` bytes go to every task as one automaton, which reads each
    text once however many names there are. A longer list is not sent: names and texts meet by an equality join on
    pieces of ``q`` characters, and what meets is compared; no list is too long.
    """
    known = names.select(F.col(name).alias("name"), F.col(place).cast("long").alias("place")).where("name <> '' and place is not null")
    known = known.groupBy("name").agg(F.min("place").alias("place"))
    size = known.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    if size == 0:
        return _nothing(df, row, found)
    if size <= sent:
        return _by_automaton(df, text, row, [(r["name"], r["place"]) for r in known.collect()], found)
    return _by_index(df, text, row, known, found, q)


def picked(df: DataFrame, text: str, row: list[str], names: DataFrame, name: str, place: str, last: bool = False, **options) -> DataFrame:
    """(row, name, place): for each row the first contained name by place, or the last; rows without one have none."""
    hits = contained(df, text, row, names, name, place, found="__place", **options)
    best = hits.groupBy(*row).agg((F.max if last else F.min)("__place").alias("__place"))
    w = Window.partitionBy("__place").orderBy("__name")
    known = names.select(F.col(name).alias("__name"), F.col(place).cast("long").alias("__place")).where("__name <> '' and __place is not null")
    one = known.groupBy("__name").agg(F.min("__place").alias("__place")).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return best.join(one, "__place").select(*row, F.col("__name").alias(name), F.col("__place").alias(place))


def scene_hits(df: DataFrame, text: str, scene: str, named: DataFrame, name: str, by: str) -> DataFrame:
    """(by, n, hits): rows of each group, and those whose text contains a name that ``named`` (scene, name) has twice for their scene.

    The names that a scene has more than once are gathered for the scene, whose catalogue they are part of, and join its
    rows; a row counts once however many of them it contains. Empty and null names never count.
    """
    twice = named.where(F.col(name) != "").groupBy(scene, name).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    listed = twice.groupBy(F.col(scene).alias("__scene")).agg(F.collect_set(name).alias("__names"))
    joined = df.join(listed, F.col(scene) == F.col("__scene"), "left")
    hit = F.exists("__names", lambda n: F.contains(F.col(text), n))
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
