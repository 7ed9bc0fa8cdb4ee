"""Labels, units, modes and colours of records, on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import predicates, sampling
from .registry import query, table


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'a_b')")
def fragment_filter(spark, folder):
    """Parts whose name contains one of several fragments, taken literally."""
    return table(spark, folder, "part").where(predicates.contains_any(F.col("p_name"), ["ring", "a_b"])).select("p_partkey")


@query("""
SELECT conv_id, turn, CASE WHEN m IS NULL OR m IN ('i', 'image', 'image-only', 'image_only') THEN 'image-only' WHEN m IN ('g', 'general', 'video') THEN 'general' ELSE m END AS mode
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'i' WHEN 2 THEN NULL ELSE lower(trim(role)) END AS m FROM conversations)
""")
def mode_inference(spark, folder):
    """The mode of a record from several candidates, blank ones passed over."""
    turn = F.col("turn") % 4
    first = F.when(turn == 0, " Video").when(turn == 1, "I").when(turn == 2, "  ")
    second = F.when(turn == 2, F.lit(None).cast("string")).otherwise(F.col("role"))
    return table(spark, folder, "conversations").select("conv_id", "turn", predicates.mode_of(first, second).alias("mode"))


@query("SELECT p_partkey, p_size || ' kg' AS mass, p_size || ' m/s' AS speed, CAST(p_size AS VARCHAR) AS bare FROM part")
def unit_lookup(spark, folder):
    """Values with the unit of a placeholder's kind; unknown kinds have none."""
    unit = lambda name: X.with_unit(F.lit(name), F.col("p_size"))
    return table(spark, folder, "part").select("p_partkey", unit("MASS_1").alias("mass"), unit("SPEED").alias("speed"), unit("COLOUR").alias("bare"))


@query("SELECT conv_id, turn, nullif(lower(trim(CASE WHEN turn % 2 = 0 THEN '  ' ELSE role END)), '') AS role FROM conversations")
def blank_to_null(spark, folder):
    """Trimmed lower-case text; blank is null."""
    return table(spark, folder, "conversations").select("conv_id", "turn", X.blank_to_null(F.when(F.col("turn") % 2 == 0, "  ").otherwise(F.col("role"))).alias("role"))


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 'Second' ELSE p_brand END AS label FROM part")
def label_title(spark, folder):
    """Labels in title case, with specials of their own."""
    return table(spark, folder, "part").select("p_partkey", X.title(F.lower("p_brand"), {"brand#2": "Second"}).alias("label"))


@query("""
SELECT p_partkey, 'How large is ' || CASE WHEN contains(p_name, ' ') THEN '<OBJECT>' ELSE p_name END || ' beside ' || p_type || '?' AS question, p_size % 4 AS images FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL
""")
def question_normal_form(spark, folder):
    """Questions without image marks and options, names as placeholders, and how many image marks there were."""
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda i: F.concat(F.char(F.lit(65) + i), F.lit(". a_b "), F.col("p_brand"))), "\n")
    q = F.concat(F.repeat(F.lit("<image>"), F.col("p_size") % 4), F.lit("\nHow large is "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" beside "), F.col("p_type"), F.lit("?\n"), lines)
    return table(spark, folder, "part").where("p_name is not null and p_type is not null").select("p_partkey", X.normal_question(q).alias("question"), X.image_marks(q).cast("int").alias("images"))


@query("SELECT coalesce(source, '<MISSING>') || '|' || coalesce(lang, '<MISSING>') AS label, count(*) AS n FROM documents GROUP BY 1")
def group_labels(spark, folder):
    """Documents counted by a label of two keys."""
    return table(spark, folder, "documents").groupBy(X.group_label(F.col("source"), F.col("lang")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT event_id, greatest(0.0, least(1.0, (value - 0) / (50.0 - 0))) AS t FROM events WHERE value IS NOT NULL)
SELECT event_id, [CAST(round(255 * greatest(0.0, least(1.0, 2 * t - 1))) AS INTEGER), CAST(round(255 * greatest(0.0, least(1.0, 1 - abs(2 * t - 1)))) AS INTEGER), CAST(round(255 * greatest(0.0, least(1.0, 1 - 2 * t))) AS INTEGER)] AS rgb FROM s
""")
def value_colours(spark, folder):
    """Values from 0 to 50 as colours from blue over green to red."""
    return table(spark, folder, "events").where("value is not null").select("event_id", G.stress_colour(F.col("value"), F.lit(0.0), F.lit(50.0)).alias("rgb"))


@query("""
SELECT vec_id, abs((e[1] - 1) * 0.6 + (e[2] - 2) * 0.8) AS plane, CASE WHEN e[3] = 0 THEN 0.0 ELSE round(e[3] * pow(10.0, 2 - floor(log10(abs(e[3]))))) / pow(10.0, 2 - floor(log10(abs(e[3])))) END AS three
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
""")
def plane_and_digits(spark, folder):
    """Distances of points to a plane, and a component with three significant digits."""
    v = F.col("embedding").cast("array<double>")
    at = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    return table(spark, folder, "embeddings").select("vec_id", G.plane_distance(F.slice(v, 1, 3), at(1, 2, 3), at(3, 4, 0)).alias("plane"), G.significant(F.get(v, F.lit(2)), 3).alias("three"))


@query("""
WITH w(event_type, target) AS (VALUES ('click', 10), ('none', 0), ('error', 3)), g AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, CAST(target AS BIGINT) AS target, coalesce(n, 0) AS n, abs(coalesce(n, 0) - target) <= greatest(1.0, target * 0.01) AS ok FROM w LEFT JOIN g USING (event_type)
""")
def ratio_check(spark, folder):
    """Counts of event types against targets."""
    return sampling.ratio_report(table(spark, folder, "events"), "event_type", {"click": 10, "none": 0, "error": 3})
