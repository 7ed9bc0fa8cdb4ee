"""Documents nested to any depth: all their nodes as rows, edits of some, and the documents built again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHILD = "struct<key:string,at:int,value:variant>"
_NEW = "array<struct<key:string,at:int,value:variant,json:string>>"


def depth_of(text: Column) -> Column:
    """How deep the brackets of a JSON text are nested; brackets in strings do not count."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda acc, c: F.when(c.isin("{", "["), F.struct((acc["now"] + 1).alias("now"), F.greatest(acc["most"], acc["now"] + 1).alias("most"))).otherwise(F.struct((acc["now"] - 1).alias("now"), acc["most"].alias("most")))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), zero, step, lambda acc: acc["most"])


def children(value: Column) -> Column:
    """The members of an object, in the order of their names, or the elements of an array; null for anything else."""
    members = F.try_variant_get(value, "$", "map<string,variant>")
    elements = F.try_variant_get(value, "$", "array<variant>")
    named = F.transform(F.map_entries(members), lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value")))
    listed = F.transform(elements, lambda e, i: F.struct(F.lit(None).cast("string").alias("key"), i.alias("at"), e.alias("value")))
    return F.coalesce(named, listed)


def _opened(docs: DataFrame, doc_id: str, text: str, depth: int | None, holds: str | None = None, change: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """The nodes, opened level by level: each level is one projection and one explode of the rows before it.

    An object with a member ``holds`` is opened with the members of ``change`` in place of its own; they are not opened.
    """
    if depth is None:
        depth = docs.agg(F.max(depth_of(F.col(text)))).first()[0] or 0
    rows = docs.select(F.col(doc_id).alias("id"), F.try_parse_json(text).alias("value")).where(F.col("value").isNotNull())
    rows = rows.select("id", F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("at"), "value", F.lit(None).cast("string").alias("json"), F.lit(True).alias("open"))
    none = F.array().cast(f"array<{_CHILD}>")
    for _ in range(depth):
        own = F.coalesce(children(F.col("value")), none)
        if change:
            hit = F.try_variant_get("value", f"$.{holds}", "variant").isNotNull()
            new = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(-1).alias("at"), F.lit(None).cast("variant").alias("value"), v.alias("json")) for k, v in change.items()])
            rows = rows.withColumn("new", F.when(F.col("open") & hit, F.filter(new, lambda n: n["json"].isNotNull())))
            own = F.filter(own, lambda c: F.col("new").isNull() | c["key"].isNull() | ~F.exists(F.coalesce("new", F.array().cast(_NEW)), lambda n: n["key"] == c["key"]))
        shut = F.struct("path", "key", "at", "value", "json", F.lit(False).alias("open"))
        below = F.transform(own, lambda c: F.struct(F.concat("path", F.array(c["at"])).alias("path"), c["key"].alias("key"), c["at"].alias("at"), c["value"].alias("value"), F.lit(None).cast("string").alias("json"), F.lit(True).alias("open")))
        told = [F.array(shut), below]
        if change:
            told.append(F.transform(F.coalesce("new", F.array().cast(_NEW)), lambda n, i: F.struct(F.concat("path", F.array(-1 - i)).alias("path"), n["key"].alias("key"), n["at"].alias("at"), n["value"].alias("value"), n["json"].alias("json"), F.lit(False).alias("open"))))
        rows = rows.select("id", F.explode(F.when(F.col("open"), F.concat(*told)).otherwise(F.array(shut))).alias("n")).select("id", "n.*")
    return rows.drop("open"), depth


def walk(docs: DataFrame, doc_id: str, text: str, depth: int | None = None) -> DataFrame:
    """One row a node: (id, path, depth, key, at, kind, value).

    ``path`` holds the place of each node on the way among its siblings, so paths sort as the document reads (members by
    name); ``kind`` is object, array or scalar. Nothing is shuffled and no document is opened in Python. ``depth`` is that
    of the deepest document; it is found by one pass over the texts if it is not given. Texts that are no JSON, or null,
    have no rows. Ids should be unique.
    """
    rows, _ = _opened(docs, doc_id, text, depth)
    return rows.select("id", "path", F.size("path").alias("depth"), "key", "at", _kind().alias("kind"), "value")


def _kind() -> Column:
    shape = F.schema_of_variant("value")
    return F.when(F.startswith(shape, F.lit("OBJECT")), "object").when(F.startswith(shape, F.lit("ARRAY")), "array").otherwise("scalar")


def build(nodes: DataFrame, depth: int) -> DataFrame:
    """(id, text): the documents of a table of nodes (id, path, depth, key, at, kind, json), with the text of scalars in ``json``.

    Levels are folded into their parents from the deepest up. Rows are dealt by document once, so all levels are folded
    where they are, and no task needs more than its documents. Members stand in the order of ``at``.
    """
    nodes = nodes.repartition("id")
    named = F.when(F.col("key").isNotNull(), F.concat(F.to_json(F.col("key").cast("variant")), F.lit(":"), F.col("json"))).otherwise(F.col("json"))
    for level in range(depth, 0, -1):
        deep = F.col("depth") == level
        place = F.when(deep, F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.col("path"))
        own = F.max(F.when(~deep, F.struct("depth", "key", "at", "kind", "json"))).alias("own")
        inside = F.collect_list(F.when(deep, F.struct("at", named.alias("told")))).alias("inside")
        folded = nodes.groupBy("id", place.alias("path")).agg(own, inside)
        text = F.array_join(F.transform(F.array_sort("inside"), lambda x: x["told"]), ",")
        whole = F.when(F.col("own.kind") == "object", F.concat(F.lit("{"), text, F.lit("}"))).otherwise(F.concat(F.lit("["), text, F.lit("]")))
        nodes = folded.select("id", "path", "own.depth", "own.key", "own.at", "own.kind", F.when(F.size("inside") > 0, whole).otherwise(F.col("own.json")).alias("json"))
    return nodes.select("id", F.col("json").alias("text"))


def edit(docs: DataFrame, doc_id: str, text: str, holds: str, change: dict[str, Column], depth: int | None = None) -> DataFrame:
    """(id, text): every object with a member ``holds``, at any depth, gets the members of ``change``; all else is unchanged.

    The values of ``change`` are columns over ``id`` and ``value``, the object as VARIANT, and give JSON text; null leaves
    a member as it is. A member that is there is replaced, and objects inside it are gone with it. Members of the result
    are in the order of their names. Texts that are no JSON, or null, have no rows; ids must be unique.
    """
    rows, depth = _opened(docs, doc_id, text, depth, holds, change)
    empty = F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]").otherwise(F.to_json("value"))
    rows = rows.withColumn("kind", F.when(F.col("json").isNotNull(), "scalar").otherwise(_kind())).withColumn("json", F.coalesce("json", empty))
    return build(rows.select("id", "path", F.size("path").alias("depth"), "key", F.coalesce(F.col("key"), F.lpad(F.col("at").cast("string"), 10, "0")).alias("at"), "kind", "json"), depth)


def with_absurd_option(option: Column) -> dict[str, Column]:
    """The changes, for ``edit``, that put one more option into a question object: in its options, its text and its files.

    Options may be an object, which gets the letter after its last, a list, which gets the letter of its length, or
    missing; then the letter follows the option lines of the question. After Z come numbered names.
    """
    as_json = lambda x: F.to_json(x.cast("variant"))
    named = F.try_variant_get("value", "$.options", "map<string,variant>")
    listed = F.try_variant_get("value", "$.options", "array<variant>")
    question = F.coalesce(F.try_variant_get("value", "$.question", "string"), F.lit(""))
    after = lambda letters: F.when(F.size(letters) == 0, "A").when(F.array_max(letters) < "Z", F.char(F.ascii(F.array_max(letters)) + 1)).otherwise(F.concat(F.lit("Option "), (F.size(letters) + 1).cast("string")))
    lines = F.transform(F.filter(F.split(question, "\n"), lambda x: F.trim(x).rlike(r"^[A-Z]\.")), lambda x: F.substring(F.trim(x), 1, 1))
    of_map = after(F.filter(F.map_keys(named), lambda k: k.rlike("^[A-Z]$")))
    of_list = F.when(F.size(listed) < 26, F.char(F.lit(65) + F.size(listed))).otherwise(F.concat(F.lit("Option "), (F.size(listed) + 1).cast("string")))
    label = F.when(named.isNotNull(), of_map).when(listed.isNotNull(), of_list).otherwise(after(lines))
    one = F.create_map(label, option.cast("variant"))
    options = F.when(named.isNotNull(), F.to_json(F.map_concat(named, one))).when(listed.isNotNull(), F.to_json(F.concat(listed, F.array(option.cast("variant"))))).otherwise(F.to_json(one))
    text = F.concat(F.when(F.rtrim(question) != "", F.concat(F.rtrim(question), F.lit("\n"))).otherwise(""), label, F.lit(". "), option, F.lit("\n"))
    files = F.try_variant_get("value", "$.option_files", "map<string,variant>")
    files = F.when(files.isNotNull() & ~F.map_contains_key(F.coalesce(files, F.create_map().cast("map<string,variant>")), label), F.to_json(F.map_concat(files, F.create_map(label, F.parse_json(F.lit("null"))))))
    return {"options": options, "question": as_json(text), "option_files": files}
