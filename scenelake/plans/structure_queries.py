"""Queries over frames, semi-structured documents, point clouds and names in texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import poses
from ..functions.hashing import pick
from ..operators import aggregates, names, nested, similarity
from ..sources import ply, stage, subtree
from .registry import query, table

#: Texts of options that fit no question.
ABSURD = ["A teapot made of fog", "Nine purple Tuesdays", "The colour of silence", "A staircase for fish", "Half of a whisper"]


def _frames(spark, folder):
    return table(spark, folder, "embeddings").where("label is not null and embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query("""
WITH w AS (SELECT r * 5 + c AS i, list_transform(range(16), lambda k: CAST((r + k // 4) * 8 + c + k % 4 + 1 AS BIGINT)) AS ix FROM range(5) t(r), range(5) u(c)),
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64),
f AS (SELECT vec_id, label, i, list_transform(ix, lambda k: e[k]) AS x FROM v, w),
m AS (SELECT *, list_sum(x) / 16 AS mu, list_dot_product(x, x) / 16 AS sq FROM f),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(avg((2 * a.mu * b.mu + 0.0001) * (2 * (list_dot_product(a.x, b.x) / 16 - a.mu * b.mu) + 0.0009)
  / ((a.mu * a.mu + b.mu * b.mu + 0.0001) * ((a.sq - a.mu * a.mu) + (b.sq - b.mu * b.mu) + 0.0009))), 9) AS similarity
  FROM m a JOIN m b ON a.label = b.label AND a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY ALL)
SELECT label, a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity, b) AS rank FROM s JOIN (SELECT vec_id AS a, label FROM v) USING (a) QUALIFY rank <= 3
""")
def least_similar_frames(spark, folder):
    """For every twentieth vector, read as a frame of 8 x 8 pixels, the three least similar frames of its label."""
    v = _frames(spark, folder)
    asked = v.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("a"), F.col("e").alias("va"))
    return similarity.least_similar(asked, v.select("label", F.col("vec_id").alias("b"), F.col("e").alias("vb")), ["label"], (1, 8, 8), 3, window=4)


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id % 9 AS m FROM embeddings),
k AS (SELECT *, e IS NOT NULL AND vec_id % 11 <> 0 AND vec_id % 13 <> 0 AS whole, sqrt(e[4]*e[4] + e[5]*e[5] + e[6]*e[6] + e[7]*e[7]) AS n FROM v),
p AS (SELECT vec_id, whole, e, m, CASE WHEN m IN (0, 6) THEN [0.0, 0.0, sin(e[4] / 2), cos(e[4] / 2)] WHEN m = 1 THEN [0.0, 0.0, 0.0, 1.0] WHEN m IN (7, 8) THEN
  [sin(e[4] / 2) * cos(e[5] / 2), cos(e[4] / 2) * sin(e[5] / 2), sin(e[4] / 2) * sin(e[5] / 2), cos(e[4] / 2) * cos(e[5] / 2)] ELSE [e[4] / n, e[5] / n, e[6] / n, e[7] / n] END AS q FROM k)
SELECT vec_id, CASE WHEN whole THEN ['box', 'centre', 'state', 'transform', 'transform pose', 'position', 'matrix', 'six', 'euler'][m + 1] END AS shape,
  CASE WHEN whole THEN list_transform(e[1:3], lambda x: round(x, 9) + 0.0) END AS p, CASE WHEN whole THEN list_transform(q, lambda x: round(x, 9) + 0.0) END AS q FROM p
""")
def pose_ladder(spark, folder):
    """Place and quaternion of every vector, written as a document of one of nine shapes and read through the ladder; some are null or broken."""
    v = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = lambda *at: F.concat(F.lit("["), F.concat_ws(",", *[x if not isinstance(x, int) else F.get("e", F.lit(x)).cast("string") for x in at]), F.lit("]"))
    say = lambda form, *parts: F.format_string(form, *parts)
    p, q, c, s = n(0, 1, 2), n(3, 4, 5, 6), F.cos(F.get("e", F.lit(3))).cast("string"), F.sin(F.get("e", F.lit(3))).cast("string")
    minus = (-F.sin(F.get("e", F.lit(3)))).cast("string")
    rows = [n(c, minus, F.lit("0")), n(s, c, F.lit("0")), n(F.lit("0"), F.lit("0"), F.lit("1"))]
    zero, last = F.lit("0"), n(F.lit("0"), F.lit("0"), F.lit("0"), F.lit("1"))
    of = lambda i: F.get("e", F.lit(i)).cast("string")
    nested_rows = n(n(c, minus, zero, of(0)), n(s, c, zero, of(1)), n(zero, zero, F.lit("1"), of(2)), last)
    flat_rows = n(c, minus, zero, of(0), s, c, zero, of(1), zero, zero, F.lit("1"), of(2), zero, zero, zero, F.lit("1"))
    forms = [
        say('{"obb":{"center":%s,"R":%s,"extents":[1,1,1]}}', p, n(*rows)), say('{"obb":{"center":%s}}', p), say('{"obb":7,"state":{"pose":{"p":%s,"q":%s}}}', p, q), say('{"transform":{"p":%s,"q":%s}}', p, q),
        say('{"state":{},"transform":{"pose":{"q":%s,"p":%s}}}', q, p), say('{"transform":{"position":%s,"rotation_quat":%s}}', p, q), say('{"transform":{"matrix":%s}}', F.when(F.col("vec_id") % 2 == 0, nested_rows).otherwise(flat_rows)),
        say('{"transform":%s}', n(0, 1, 2, 3, 4, zero)), say('{"transform":{"position":%s,"rotation_euler":%s}}', p, n(3, 4, zero)),
    ]
    doc = F.coalesce(*[F.when(F.col("vec_id") % 9 == i, f) for i, f in enumerate(forms)])
    broken = F.when(F.col("vec_id") % 2 == 0, F.lit('{"obb":{"center":[1,"x"')).otherwise(F.lit('{"transform":[1,2,3],"obb":{"center":[1,"x",2]}}'))
    doc = F.when((F.col("vec_id") % 11 == 0) | F.col("e").isNull(), None).when(F.col("vec_id") % 13 == 0, broken).otherwise(doc)
    got = v.select("vec_id", F.try_parse_json(doc).alias("state")).select("vec_id", poses.pose(F.col("state")).alias("pose"))
    tidy = lambda c: F.transform(c, lambda x: F.round(x, 9) + F.lit(0.0))
    return got.select("vec_id", F.col("pose.shape").alias("shape"), tidy(F.col("pose.p")).alias("p"), tidy(F.col("pose.q")).alias("q"))


def _files(spark, folder):
    """One nested document a conversation: user turns with options as an object, others as a list, every third without; odd turns one list deeper."""
    t = table(spark, folder, "conversations").where("conv_id is not null and turn is not null")
    text = F.to_json(F.coalesce("text", F.lit("")).cast("variant"))
    options = F.when(F.col("turn") % 3 == 2, "").when(F.col("role") == "user", '"options":{"A":"x","B":[{"deep":1}]},').otherwise('"options":["x"],')
    entry = F.concat(F.lit("{"), options, F.lit('"question":'), text, F.lit(',"z":{"turn":'), F.col("turn").cast("string"), F.lit("}}"))
    entry = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("[["), entry, F.lit("]]"))).otherwise(entry)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", entry.alias("j")))), lambda x: x["j"]), ",")
    return t.groupBy("conv_id").agg(F.concat(F.lit('{"blocks":['), listed, F.lit('],"conv":'), F.first("conv_id").cast("string"), F.lit("}")).alias("doc"))


_ENTRY = """
SELECT conv_id, turn, role, text, (ARRAY['A teapot made of fog', 'Nine purple Tuesdays', 'The colour of silence', 'A staircase for fish', 'Half of a whisper'])
    [1 + CAST(CAST('0x' || substr(sha256(concat_ws(':', '42', conv_id)), 1, 13) AS BIGINT) % 5 AS INTEGER)] AS nonsense FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
"""


@query(f"""
WITH e AS ({_ENTRY}), l AS (SELECT *, regexp_extract_all(coalesce(text, ''), '(?m)^ *([A-Z])\\.', 1) AS seen FROM e),
n AS (SELECT *, CASE WHEN len(seen) = 0 THEN 'A' WHEN list_max(seen) < 'Z' THEN chr(ascii(list_max(seen)) + 1) ELSE 'Option ' || (len(seen) + 1) END AS free FROM l),
o AS (SELECT *, CASE WHEN turn % 3 = 2 THEN free WHEN role = 'user' THEN 'C' ELSE 'B' END AS letter, rtrim(coalesce(text, ''), ' ') AS base FROM n),
j AS (SELECT conv_id, turn, role, text, '{{"options":' || CASE WHEN turn % 3 = 2 THEN '{{' || to_json(letter) || ':' || to_json(nonsense) || '}}' WHEN role = 'user' THEN '{{"A":"x","B":[{{"deep":1}}],"C":' || to_json(nonsense) || '}}' ELSE '["x",' || to_json(nonsense) || ']' END
  || ',"question":' || to_json(CASE WHEN base <> '' THEN base || chr(10) ELSE '' END || letter || '. ' || nonsense || chr(10)) || ',"z":{{"turn":' || turn || '}}}}' AS x FROM o)
SELECT conv_id, sha256('{{"blocks":[' || string_agg(CASE WHEN turn % 2 = 1 THEN '[[' || x || ']]' ELSE x END, ',' ORDER BY turn, role, text) || '],"conv":' || conv_id || '}}') AS doc_sha256 FROM j GROUP BY conv_id
""")
def absurd_options(spark, folder):
    """Every question of every nested document gets one more option; the rest of the documents is as it was."""
    option = pick(F.array(*map(F.lit, ABSURD)), 42, F.col("id"))
    edited = nested.edit(_files(spark, folder), "conv_id", "doc", "question", nested.with_absurd_option(option))
    return edited.select(F.col("id").alias("conv_id"), F.sha2("text", 256).alias("doc_sha256"))


@query("""
SELECT conv_id, CAST(3 + sum(CASE WHEN turn % 2 = 1 THEN 2 ELSE 0 END + 4 + CASE WHEN turn % 3 = 2 THEN 0 WHEN role = 'user' THEN 5 ELSE 2 END) AS BIGINT) AS nodes, count(*) AS questions,
  CAST(max(CASE WHEN turn % 2 = 1 THEN 2 ELSE 0 END + CASE WHEN turn % 3 <> 2 AND role = 'user' THEN 6 ELSE 4 END) AS INTEGER) AS depth
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id
""")
def nested_nodes(spark, folder):
    """Nodes, questions and depth of every nested document, found by opening it level by level."""
    nodes = nested.walk(_files(spark, folder), "conv_id", "doc")
    return nodes.groupBy(F.col("id").alias("conv_id")).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("key") == "question").alias("questions"), F.max("depth").alias("depth"))


@query("SELECT vec_id, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) >= 3")
def ply_round_trip(spark, folder):
    """The first three components of every vector, written as a point cloud and read again in ranges of bytes."""
    ply.register(spark)
    v = table(spark, folder, "embeddings").where("vec_id is not null and size(embedding) >= 3")
    points = v.select(*[F.get("embedding", F.lit(i)).cast("float").alias(c) for i, c in enumerate("xyz")], F.col("vec_id").cast("int").alias("vec_id"))
    path = stage.folder(spark)
    points.write.format("ply").option("format", "binary_big_endian").mode("append").save(path)
    return spark.read.format("ply").option("split", 1 << 16).load(path).select(F.col("vec_id").cast("long").alias("vec_id"), "x", "y", "z")


@query("""
WITH n AS (SELECT c_nationkey, c_mktsegment, max(c) AS c FROM (SELECT c_nationkey, c_mktsegment, floor(c_acctbal / 100) AS f, count(*) AS c FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL GROUP BY ALL) GROUP BY 1, 2)
SELECT count(*) AS scenes, count(*) FILTER (WHERE c > 1) AS with_duplicates, count(*) FILTER (WHERE c > 1) / nullif(count(*), 0) AS share, true AS less_read FROM n
""")
def subtree_census(spark, folder):
    """Scenes with a name more than once, from documents of which only the catalogue of objects is read; a long series stands after it."""
    c = table(spark, folder, "customer").where("c_nationkey is not null and c_mktsegment is not null and c_acctbal is not null")
    named = F.struct(F.col("c_custkey").cast("string").alias("key"), F.struct(F.struct(F.floor(F.col("c_acctbal") / 100).cast("string").alias("object_name")).alias("description")).alias("value"))
    objects = c.groupBy(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("scene")).agg(F.map_from_entries(F.collect_list(named)).alias("objects"))
    steps = F.concat(F.lit('{"0000.010":{"pad":"'), F.repeat(F.lit("0123456789abcdef"), 40 * F.size("objects") + 1000), F.lit('"}}'))
    docs = objects.select("scene", F.concat(F.lit('{"scene":{"objects":"}"},"objects":'), F.to_json("objects"), F.lit(',"simulation":'), steps, F.lit("}")).alias("value"))
    path = stage.folder(spark)
    docs.write.partitionBy("scene").text(path)
    got = subtree.read(spark, path, "objects", "map<string,struct<description:struct<object_name:string>>>", pattern="part-*", chunk=1 << 12)
    read = stage.staged(got)
    flat = read.select("path", F.explode("value").alias("key", "o")).select("path", F.col("o.description.object_name").alias("name"))
    less = read.agg((F.sum("bytes_read") < F.sum("bytes")).alias("less_read"))
    return aggregates.duplicate_census(flat, "path", "name").join(less)


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name <> ''), k AS (SELECT name, row_number() OVER (ORDER BY sha256(name)) AS k FROM (SELECT DISTINCT split_part(name, ' ', 2) AS name FROM n UNION SELECT DISTINCT split_part(name, ' ', 1) FROM n) WHERE name <> ''),
t AS (SELECT c_custkey, o FROM (SELECT o_custkey AS c_custkey, string_agg(p_name, '; ' ORDER BY l_orderkey, l_linenumber) AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1))
SELECT c_custkey, count(*) AS hits, arg_max(name, k) AS last_name, arg_min(name, k) AS first_name FROM t JOIN k ON contains(o, name) GROUP BY 1
""")
def names_in_texts(spark, folder):
    """Which words of part names stand in the list of parts that each customer has ordered: how many, the first and the last."""
    part = table(spark, folder, "part")
    word = lambda i: part.select(F.split_part("p_name", F.lit(" "), F.lit(i)).alias("name"))
    known = word(1).unionByName(word(2)).where("name <> ''").distinct()
    known = known.withColumn("k", F.row_number().over(Window.orderBy(F.sha2("name", 256))))  # a dimension: the words that part names are made of
    lines = table(spark, folder, "orders").join(table(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "p_name"))), lambda x: x["p_name"]), "; ")
    texts = lines.groupBy(F.col("o_custkey").alias("c_custkey")).agg(told.alias("o"))
    hits = names.contained(texts, "o", ["c_custkey"], known, "name", "k").join(F.broadcast(known), F.col("place") == F.col("k"))
    return hits.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("hits"), F.max_by("name", "k").alias("last_name"), F.min_by("name", "k").alias("first_name"))


@query("""
WITH w AS (SELECT conv_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{4,}'))) AS name FROM conversations WHERE role = 'assistant'),
d AS (SELECT conv_id, name FROM w GROUP BY ALL HAVING count(*) > 1),
h AS (SELECT c.conv_id, c.turn, c.role, max(CASE WHEN d.name IS NOT NULL AND contains(lower(c.text), d.name) THEN 1 ELSE 0 END) AS hit FROM conversations c LEFT JOIN d USING (conv_id) WHERE c.role IS NOT NULL GROUP BY ALL)
SELECT role, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM h GROUP BY role
""")
def scene_name_hits(spark, folder):
    """Turns of each role that contain a word which the assistant says more than once in their conversation."""
    c = table(spark, folder, "conversations").where("role is not null")
    words = c.where("role = 'assistant'").select("conv_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w"))
    return names.scene_hits(c.withColumn("low", F.lower("text")), "low", "conv_id", words.select("conv_id", F.lower("w").alias("name")), "name", "role")
