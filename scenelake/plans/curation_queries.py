"""Curation of record tables: filters, joins with answers, first rows, orders, counts, kinematics and option edits, on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import curation as C
from ..operators import ordered
from .registry import query, table


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')")
def category_filter(spark, folder):
    """Orders of wanted priorities, in any case."""
    return C.of_category(table(spark, folder, "orders"), "o_orderpriority", ["1-Urgent", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


@query("SELECT conv_id, turn, idx FROM (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || CASE WHEN turn % 2 = 0 THEN '_i' ELSE '_g' END AS idx FROM conversations) WHERE contains(idx, '_i')")
def idx_suffix(spark, folder):
    """Turns whose id has the ending of the image mode."""
    df = table(spark, folder, "conversations").select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.when(F.col("turn") % 2 == 0, "_i").otherwise("_g")).alias("idx"))
    return C.of_mode(df, "idx", "image-only")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (1, 2, 3) OR c_custkey IS NULL")
def exclude_ids(spark, folder):
    """Customers but for three."""
    return C.without_ids(table(spark, folder, "customer"), "c_custkey", [1, 2, 3]).select("c_custkey")


@query("SELECT n_nationkey, n_name FROM nation")
def keep_present(spark, folder):
    """Those wanted columns that the table has; the key is picked from a list of preferred names."""
    df = table(spark, folder, "nation")
    key = C.pick_column(df.columns, ["idx", "n_nationkey"], "key")
    return C.keep_present(df, [key, "n_name", "population"])


@query("""
SELECT page_id, [u || '#' || i FOR i IN range(0, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 3 END)] AS files, repeat('<image>', CASE WHEN page_id % 2 = 0 THEN 2 ELSE 3 END) || 'What is on ' || url || '?' AS question
FROM (SELECT page_id, url, 'frames/' || page_id AS u FROM pages WHERE url IS NOT NULL)
""")
def without_renders(spark, folder):
    """File lists without rendered copies, and questions with as many image marks."""
    name = F.concat(F.lit("frames/"), F.col("page_id").cast("string"))
    many = F.when(F.col("page_id") % 2 == 0, 2).otherwise(3)
    files = F.concat(F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.concat(name, F.lit("#"), i.cast("string"))), F.array(F.concat(name, F.lit("//render/0")), F.concat(name, F.lit("//render/1"))))
    kept, question = C.without_renders(F.col("f"), F.concat(F.repeat(F.lit("<image>"), F.size("f")), F.lit("What is on "), F.col("url"), F.lit("?")))
    return table(spark, folder, "pages").where("url is not null").select("page_id", "url", files.alias("f")).select("page_id", kept.alias("files"), question.alias("question"))


@query("SELECT a.conv_id, a.text AS text_question, b.text AS text_answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id WHERE a.turn = 0 AND b.turn = 1")
def questions_answers(spark, folder):
    """First turns with the second ones, by conversation; shared columns have endings."""
    df = table(spark, folder, "conversations")
    q, a = df.where("turn = 0").select("conv_id", "text"), df.where("turn = 1").select("conv_id", "text")
    return C.answered(q, a, C.shared_columns(q.columns, a.columns, ["idx", "conv_id"])[0])


@query("SELECT l_orderkey, l_linenumber, p_name, p_partkey IS NOT NULL AS found FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) p ON l_partkey = p_partkey")
def lookup_with_misses(spark, folder):
    """Lines with names of parts, and whether there is one."""
    parts = table(spark, folder, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return C.looked_up(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey", "p_name").select("l_orderkey", "l_linenumber", "p_name", "found")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def lookup_strict(spark, folder):
    """The same where every line must have a part: one without raises."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    out = C.looked_up(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey", "p_name", strict=True)
    return out.where("found").select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT doc_id, coalesce(text IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL), false) AS known FROM documents")
def text_membership(spark, folder):
    """Whether a text is one of those of a subset."""
    df = table(spark, folder, "documents").select("doc_id", "text")
    return C.has_text(df, "text", df.where("doc_id % 3 = 0"), "text").select("doc_id", "known")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_row_per_key(spark, folder):
    """The first event of each user."""
    return C.first_rows(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query("SELECT o_custkey, max(c_nationkey) AS c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def agreed_truth(spark, folder):
    """The nation of each customer, on which all their orders agree; orders that disagree would raise."""
    df = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "c_nationkey")
    return C.agreed(df, ["o_custkey"], "c_nationkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey % 10 = 0 OR l_partkey IS NULL OR l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL) GROUP BY 1")
def report_of_misses(spark, folder):
    """Parts without an entry, and how many lines name them."""
    parts = table(spark, folder, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    return C.misses(table(spark, folder, "lineitem"), parts, "l_partkey")


@query("""
WITH k AS (SELECT l_orderkey, count(*) AS objects FROM lineitem GROUP BY 1), h AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, CAST(contains(o_orderpriority, 'URGENT') AS INT) + CAST(contains(o_orderpriority, 'HIGH') AS INT) + CAST(contains(o_orderpriority, 'LOW') AS INT) + CAST(contains(o_orderpriority, '5-') AS INT) AS n FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL)
SELECT o_orderkey, CASE WHEN n = 1 THEN lower(o_orderstatus) || 'x' END AS stiffness, objects FROM h LEFT JOIN k ON l_orderkey = o_orderkey
""")
def record_conditions(spark, folder):
    """The stiffness part of each order's name where its text names one object, and how many lines it has."""
    o = table(spark, folder, "orders").where("o_orderpriority is not null and o_orderstatus is not null")
    sim = F.concat(F.lit("rho-"), F.col("o_custkey").cast("string"), F.lit("_yms-"), F.lower("o_orderstatus"), F.lit("x_prs-1"))
    names = F.array(*map(F.lit, ("URGENT", "HIGH", "LOW", "5-")))
    objects = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("objects"))
    return o.select("o_orderkey", X.stiffness(F.col("o_orderpriority"), sim, names).alias("stiffness")).join(objects, "o_orderkey", "left")


@query("SELECT conv_id, trim(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE trim(text) <> '') WHERE k = 1")
def answer_map(spark, folder):
    """The last text of each conversation that is not blank."""
    return C.answer_map(table(spark, folder, "conversations"), "conv_id", "text", "turn")


@query("SELECT count(*) FILTER (WHERE text IS NOT NULL AND regexp_matches(text, '[A-Za-z]')) AS valid, count(*) FILTER (WHERE text IS NULL OR NOT regexp_matches(text, '[A-Za-z]')) AS invalid FROM conversations")
def valid_and_invalid(spark, folder):
    """Sizes of the two views of one table, parted by whether a text has a letter."""
    ok, bad = C.parted(table(spark, folder, "conversations"), F.col("text").rlike("[A-Za-z]"))
    return ok.agg(F.count(F.lit(1)).alias("valid")).crossJoin(bad.agg(F.count(F.lit(1)).alias("invalid")))  # one row each


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 50")
def mixed_sort(spark, folder):
    """The first fifty orders by two keys down and one up, with their places."""
    top = C.mixed_order(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), [("o_orderstatus", True), ("o_totalprice", True), ("o_orderkey", False)]).limit(50)
    rows = top.agg(F.array_sort(F.collect_list(F.struct(F.lit(None).cast("int").alias("_"), "o_orderstatus", "o_totalprice", "o_orderkey")), lambda x, y: F.when(x["o_orderstatus"] != y["o_orderstatus"], F.when(x["o_orderstatus"] > y["o_orderstatus"], -1).otherwise(1)).when(x["o_totalprice"] != y["o_totalprice"], F.when(x["o_totalprice"] > y["o_totalprice"], -1).otherwise(1)).otherwise(F.when(x["o_orderkey"] < y["o_orderkey"], -1).otherwise(1))).alias("r"))  # fifty rows
    return rows.select(F.posexplode("r").alias("i", "x")).select("x.o_orderkey", (F.col("i") + 1).cast("long").alias("place"))


@query("SELECT event_type, count(*) AS n, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS place FROM events GROUP BY event_type")
def category_order(spark, folder):
    """Event types with their places in an order of one's own; others come last."""
    df = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("place", C.rank_of(F.col("event_type"), ["purchase", "error"])).orderBy("place", "event_type")


@query("SELECT event_type, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value NULLS LAST, event_id) AS rank FROM events) WHERE rank <= 3")
def three_smallest(spark, folder):
    """The three events of each type with the smallest values."""
    return C.smallest(table(spark, folder, "events"), ["event_type"], "value", ["event_id"], 3).select("event_type", "event_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey FROM part ORDER BY sha256(CAST(p_partkey AS VARCHAR)) LIMIT 10")
def shuffled_display(spark, folder):
    """Ten parts by hash."""
    return C.shown(table(spark, folder, "part"), F.sha2(F.col("p_partkey").cast("string"), 256), 10).select("p_partkey")


@query("""
WITH t AS (SELECT coalesce(source, 'Unknown') AS source, coalesce(lang, 'Unknown') AS lang FROM documents)
SELECT source, lang, count(*) AS n, CAST(grouping(source, lang) AS BIGINT) AS level FROM t GROUP BY ROLLUP (source, lang)
""")
def nested_counts(spark, folder):
    """Documents by source and language, with totals."""
    return C.nested_counts(table(spark, folder, "documents"), ["source", "lang"])


@query("""
WITH c AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, avg(m) AS average, count(m) AS cells FROM c GROUP BY 1
UNION ALL SELECT 'Total', avg(average), 0 FROM (SELECT avg(m) AS average FROM c GROUP BY o_orderpriority)
""")
def row_means_and_balanced_total(spark, folder):
    """The plain mean of each row's cells, and a last row of balanced means."""
    cells = table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    means = C.mean_of_rows(cells, "o_orderpriority", "m")
    return C.with_total(means, "o_orderpriority", means.agg(F.avg("average").alias("average"), F.lit(0).cast("long").alias("cells")))


@query("""
SELECT event_type, point, sum(exp(-((point - value) / 5.0) * ((point - value) / 5.0) / 2)) / (count(*) * 5.0 * sqrt(2 * pi())) AS density
FROM events, (SELECT unnest([0.0, 10.0, 20.0, 40.0]::DOUBLE[]) AS point) WHERE value IS NOT NULL GROUP BY event_type, point
""")
def kernel_density(spark, folder):
    """Gaussian densities of the values of each event type at four points."""
    return C.density(table(spark, folder, "events"), ["event_type"], "value", [0.0, 10.0, 20.0, 40.0], 5.0)


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE contains(text, 'the') OR contains(text, 'que')) AS hits FROM documents GROUP BY lang")
def name_hits(spark, folder):
    """Documents of each language, and those that contain a name."""
    return C.named_twice(table(spark, folder, "documents"), "text", F.array(F.lit("the"), F.lit("que")), "lang")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL ORDER BY o_orderkey LIMIT 20)")
def error_table(spark, folder):
    """The first twenty rows that are not of a status, in order of price."""
    return C.errors(table(spark, folder, "orders"), F.col("o_orderstatus") == "F", ["o_orderkey"], 20, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("""
SELECT vec_id, list_concat(coalesce(CAST(embedding AS DOUBLE[]), []), [0.0, 0.0, 0.0])[1:3] AS head, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS length,
  greatest(-0.1, least(0.1, CAST(embedding[1] AS DOUBLE))) AS clamped FROM embeddings
""")
def vector_values(spark, folder):
    """Vectors cut to three, their lengths, and their first component within bounds."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select("vec_id", C.padded(v).alias("head"), C.magnitude(F.lit(None).cast("double"), v, F.lit(None).cast("string")).alias("length"), C.clamp(F.get(v, F.lit(0)), -0.1, 0.1).alias("clamped"))


@query("""
SELECT p_partkey, CASE WHEN p_size <= 1 THEN p_size * 1.0 ELSE p_size / 100.0 END AS fraction, CAST(ceil(p_size * 10 / 32.0) * ceil(p_size * 7 / 32.0) AS BIGINT) AS tokens,
  printf('%04d.%02d0', (p_size * 4 + 1) // 100, (p_size * 4 + 1) % 100) AS time_key FROM part
""")
def small_values(spark, folder):
    """Percentages as fractions, image tokens, and time keys of frames."""
    size = F.col("p_size").cast("double")
    return table(spark, folder, "part").select("p_partkey", C.fraction(size).alias("fraction"), C.image_tokens(size * 10, size * 7).alias("tokens"), C.time_key(F.col("p_size")).alias("time_key"))


@query("""
SELECT p_partkey, [p_name, 'new', p_brand] AS put, ['<image>', p_name] AS labels, coalesce(NULL, p_type) AS kind,
  'Which?' || chr(10) || 'A. ' || p_name || chr(10) || 'B. ' || p_brand || chr(10) || 'C. a purple idea' AS question FROM part
""")
def option_edits(spark, folder):
    """A value put into a list, frames as image marks, the first known key, and one more option."""
    names = F.array("p_name", "p_brand")
    question = F.concat(F.lit("Which?\nA. "), F.col("p_name"), F.lit("\nB. "), F.col("p_brand"))
    return table(spark, folder, "part").select(
        "p_partkey", C.inserted(names, F.lit(1), F.lit("new")).alias("put"), C.image_labels(F.array(F.lit("000120"), F.col("p_name"))).alias("labels"),
        C.first_key(F.create_map(F.lit("type"), F.col("p_type")), ["kind", "type"]).alias("kind"), C.with_option(question, F.lit("a purple idea")).alias("question"),
    )


@query("SELECT p_partkey, [CAST(floor(0 + i * (p_size - 0) / 3.0) AS BIGINT) FOR i IN range(0, 4)] AS even, range(0, p_size, 4) AS stepped FROM part")
def frame_lists(spark, folder):
    """Frames at equal distances, and by start, stop and step."""
    last = F.col("p_size").cast("long")
    return table(spark, folder, "part").select("p_partkey", C.uniform_frames(F.lit(0).cast("long"), last, 4).alias("even"), C.stepped_frames(F.lit(0).cast("long"), last, 4).alias("stepped"))


def _slope(source: str, of: list[str]) -> str:
    """SQL of second-order gradients on uneven steps: columns d_<c> beside those of the source."""
    lags = ", ".join(f"lag({c}, 1) OVER w AS {c}_f1, lag({c}, 2) OVER w AS {c}_f2, lead({c}, 1) OVER w AS {c}_g1, lead({c}, 2) OVER w AS {c}_g2" for c in [*of, "t"])
    each = ", ".join(f"""CASE
      WHEN t_f1 IS NULL THEN -(2 * (t_g1 - t) + (t_g2 - t_g1)) / nullif((t_g1 - t) * (t_g2 - t), 0) * {c} + (t_g2 - t) / nullif((t_g1 - t) * (t_g2 - t_g1), 0) * {c}_g1 - (t_g1 - t) / nullif((t_g2 - t_g1) * (t_g2 - t), 0) * {c}_g2
      WHEN t_g1 IS NULL THEN (t - t_f1) / nullif((t_f1 - t_f2) * (t - t_f2), 0) * {c}_f2 - (t - t_f2) / nullif((t_f1 - t_f2) * (t - t_f1), 0) * {c}_f1 + (2 * (t - t_f1) + (t_f1 - t_f2)) / nullif((t - t_f1) * (t - t_f2), 0) * {c}
      ELSE ((t - t_f1) * (t - t_f1) * {c}_g1 + ((t_g1 - t) * (t_g1 - t) - (t - t_f1) * (t - t_f1)) * {c} - (t_g1 - t) * (t_g1 - t) * {c}_f1) / nullif((t - t_f1) * (t_g1 - t) * (t_g1 - t_f1), 0) END AS d_{c}""" for c in of)
    return f"SELECT * EXCLUDE ({', '.join(f'{c}_{k}' for c in [*of, 't'] for k in ('f1', 'f2', 'g1', 'g2'))}), {each} FROM (SELECT *, {lags} FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY t))"


@query(f"""
WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / 4.0 AS t, value AS x, CAST(event_id % 7 AS DOUBLE) AS y FROM events),
v AS ({_slope("p", ["x", "y"])}), a AS ({_slope("v", ["d_x", "d_y"])}), j AS ({_slope("a", ["d_d_x", "d_d_y"])}),
s AS (SELECT *, sqrt(d_x * d_x + d_y * d_y) AS speed FROM j), u AS (SELECT *, CASE WHEN speed > 1e-12 THEN (d_d_x * d_x + d_d_y * d_y) / speed ELSE 0.0 END AS a_t FROM s)
SELECT event_id, speed, a_t, sqrt(greatest(0.0, d_d_x * d_d_x + d_d_y * d_d_y - a_t * a_t)) AS a_n, sqrt(d_d_d_x * d_d_d_x + d_d_d_y * d_d_d_y) AS jerk,
  CASE WHEN speed > 1e-12 THEN abs(d_x * d_d_y - d_y * d_d_x) / (speed * speed * speed) ELSE 0.0 END AS curvature, 2.0 * speed AS momentum, speed * speed AS kinetic FROM u
""")
def kinematics_whole(spark, folder):
    """Speed, tangential and normal acceleration, jerk, curvature, momentum and kinetic energy of a point with a mass of 2."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) / F.lit(4.0)
    df = table(spark, folder, "events").select("user_id", "event_id", place.alias("t"), F.col("value").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"))
    return ordered.motion(df, ["user_id"], "t", ["x", "y"], F.lit(2.0)).select("event_id", "speed", "a_t", "a_n", "jerk", "curvature", "momentum", "kinetic")


@query("""
SELECT event_id, (lead(value) OVER w - lag(value) OVER w) / nullif(lead(t) OVER w - lag(t) OVER w, 0) AS v,
  (lead(value) OVER w - 2 * value + lag(value) OVER w) / nullif(((lead(t) OVER w - lag(t) OVER w) / 2) * ((lead(t) OVER w - lag(t) OVER w) / 2), 0) AS a
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / 4.0 AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t)
""")
def viewer_differences(spark, folder):
    """Velocity and acceleration of the viewer: central differences over three samples."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) / F.lit(4.0)
    df = table(spark, folder, "events").select("user_id", "event_id", "value", place.alias("t"))
    return ordered.three_samples(df, ["user_id"], "t", "value").select("event_id", "v", "a")
