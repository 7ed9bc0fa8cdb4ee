"""Ordered analytics, predicates and geometry on the event stream, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import aggregates, joins, neighbours, ordered, predicates, ranks
from .registry import query, table

_E = "SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events"


def _events(spark, folder):
    return table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", ordered.seconds(F.col("ts")).alias("t"))


@query(f"""
WITH e AS ({_E}), v AS (
  SELECT *, (value - lag(value) OVER w) / nullif(t - lag(t) OVER w, 0) AS v FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)
), a AS (SELECT *, (v - lag(v) OVER w) / nullif(t - lag(t) OVER w, 0) AS a FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, count(*) AS n, avg(abs(v)) AS mean_speed, max(abs(a)) AS max_accel FROM a GROUP BY user_id
""")
def kin_backward_diff(spark, folder):
    """Mean speed and largest acceleration of each user's value."""
    df = ordered.backward_difference(_events(spark, folder), ["user_id"], "t", ["value"])
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("v_value")).alias("mean_speed"), F.max(F.abs("a_value")).alias("max_accel"))


@query(f"""
WITH e AS ({_E}), s AS (
  SELECT *, lag(value, 1) OVER w f1, lag(value, 2) OVER w f2, lead(value, 1) OVER w g1, lead(value, 2) OVER w g2,
    lag(t, 1) OVER w x1, lag(t, 2) OVER w x2, lead(t, 1) OVER w y1, lead(t, 2) OVER w y2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)
), d AS (SELECT *, t - x1 AS hs, y1 - t AS hd, y2 - y1 AS d2, x1 - x2 AS e1 FROM s)
SELECT event_id, CASE
  WHEN x1 IS NULL THEN -(2 * hd + d2) / nullif(hd * (hd + d2), 0) * value + (hd + d2) / nullif(hd * d2, 0) * g1 - hd / nullif(d2 * (hd + d2), 0) * g2
  WHEN y1 IS NULL THEN hs / nullif(e1 * (e1 + hs), 0) * f2 - (e1 + hs) / nullif(e1 * hs, 0) * f1 + (2 * hs + e1) / nullif(hs * (e1 + hs), 0) * value
  ELSE (hs * hs * g1 + (hd * hd - hs * hs) * value - hd * hd * f1) / nullif(hs * hd * (hd + hs), 0) END AS gradient FROM d
""")
def kin_central_gradient(spark, folder):
    """Second-order gradient of each user's value."""
    return ordered.central_gradient(_events(spark, folder), ["user_id"], "t", "value", "gradient").select("event_id", "gradient")


@query(f"""
WITH e AS ({_E}), f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 3600 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM f),
g AS (SELECT user_id, run, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM r GROUP BY ALL)
SELECT user_id, CAST(run AS BIGINT) AS run, n, first_t, last_t FROM g WHERE n >= 2
""")
def runs_gap_islands(spark, folder):
    """Runs of events at most an hour apart, of two events or more."""
    df = ordered.runs(_events(spark, folder), ["user_id"], "t", 3600.0, 2)
    return df.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"""
WITH e AS ({_E}), f AS (SELECT event_id, row_number() OVER w AS k, [lag(event_id, 6) OVER w, lag(event_id, 4) OVER w, lag(event_id, 2) OVER w, event_id] AS frames FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, array_to_string(frames, ',') AS frames FROM f WHERE k > 6
""")
def frames_before(spark, folder):
    """Four events ending at each event, two apart."""
    df = ordered.frames_before(_events(spark, folder), ["user_id"], "t", "event_id", 4, 2)
    return df.where("frames is not null").select("event_id", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@query(f"""
WITH e AS ({_E}), f AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counter FROM f
""")
def question_counter(spark, folder):
    """A counter that goes up when the event type changes."""
    return ordered.change_counter(_events(spark, folder), ["user_id"], ["t", "event_id"], "event_type").select("event_id", "counter")


_MOVED = f"""
WITH e AS ({_E}), f AS (SELECT *, abs(value - lag(value) OVER w) > 40 AS far, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
m AS (SELECT event_id, k, coalesce(bool_or(far) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), false) AS moved FROM f)
"""


@query(_MOVED + "SELECT event_id, CASE WHEN k >= 8 THEN moved END AS moved FROM m")
def moving_flag(spark, folder):
    """Whether any of seven moves was over 40."""
    return ordered.moved(_events(spark, folder), ["user_id"], "t", ["value"], 40.0, 8).select("event_id", "moved")


@query(_MOVED + "SELECT event_id, CASE WHEN k >= 8 THEN NOT moved END AS still FROM m")
def still_flag(spark, folder):
    """Whether none was."""
    return ordered.still(_events(spark, folder), ["user_id"], "t", ["value"], 40.0, 8).select("event_id", "still")


@query(f"WITH e AS ({_E}) SELECT event_id, abs(value - lag(value, 14) OVER (PARTITION BY user_id ORDER BY t)) AS displacement FROM e")
def net_displacement_14(spark, folder):
    """The distance to the value fourteen events before."""
    return ordered.net_displacement(_events(spark, folder), ["user_id"], "t", ["value"], 14).select("event_id", "displacement")


@query(f"WITH e AS ({_E}) SELECT event_id, lead(value, 16) OVER w AS mid, lead(value, 28) OVER w AS last FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)")
def start_mid_end(spark, folder):
    """The values sixteen and twenty-eight events ahead."""
    return ordered.ahead(_events(spark, folder), ["user_id"], "t", "value", {"mid": 16, "last": 28}).select("event_id", "mid", "last")


@query(f"WITH e AS ({_E}), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e WHERE event_type = 'error') SELECT user_id, event_id, t, value FROM k WHERE k = 1")
def first_contact(spark, folder):
    """The first error of each user."""
    return ordered.first_where(_events(spark, folder), ["user_id"], ["t", "event_id"], F.col("event_type") == "error", ["value"]).select("user_id", "event_id", "t", "value")


@query(f"WITH e AS ({_E}) SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS ordinal FROM e")
def ordinal_of_type(spark, folder):
    """Each event's number within its type."""
    return ranks.ordinal(_events(spark, folder).select("event_id", "event_type", "t"), ["event_type"], ["t", "event_id"]).select("event_id", "ordinal")


def _seen(name, rule, sql):
    def f(spark, folder):
        df = table(spark, folder, "lineitem")
        seen = predicates.visible(F.col("l_discount"), F.col("l_quantity"), rule, 0.05, 25)
        return df.where(seen).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("pixels"))

    f.__name__, f.__doc__ = name, f"Rows that the {rule} visibility rule keeps, discount as fraction and quantity as pixels."
    query(f"SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS pixels FROM lineitem WHERE {sql} GROUP BY 1")(f)


_seen("visible_filter_canonical", "canonical", "l_discount > 0.05 AND l_quantity >= 25")
_seen("visible_filter_strict", "strict", "l_discount > 0.05 AND l_quantity > 25")
_seen("visible_filter_mass", "mass", "l_discount >= 0.05 AND l_quantity > 25")


@query("SELECT p_partkey, p_brand, p_size FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part) WHERE n = 1")
def non_duplicate_models(spark, folder):
    """Parts whose size is alone in their brand."""
    return predicates.unique_in_scene(table(spark, folder, "part"), ["p_brand"], "p_size").select("p_partkey", "p_brand", "p_size")


@query("WITH s AS (SELECT l_suppkey, l_returnflag, count(*) FILTER (WHERE l_quantity >= 25) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, bool_and(n >= 2) AS ok FROM s GROUP BY 1")
def min_objects_visible(spark, folder):
    """Whether all of a supplier's flags have two large items."""
    return predicates.every_step_has(table(spark, folder, "lineitem"), ["l_suppkey"], "l_returnflag", F.col("l_quantity") >= 25, 2)


@query("SELECT CASE WHEN value < 25 THEN '0-25' WHEN value < 50 THEN '25-50' WHEN value < 75 THEN '50-75' ELSE '75-100' END AS class, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def bucket_visibility(spark, folder):
    """Events by quarter of their value."""
    return table(spark, folder, "events").where("value is not null").groupBy(predicates.quarter_class(F.col("value")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN a <= -60 THEN 'top-down' WHEN a <= -15 THEN 'high angle' WHEN a < 15 THEN 'eye level' WHEN a < 60 THEN 'low angle' ELSE 'bottom-up' END AS class, count(*) AS n FROM (SELECT p_size * 3.6 - 90 AS a FROM part) GROUP BY 1")
def angle_class(spark, folder):
    """Part sizes as camera angles."""
    return table(spark, folder, "part").groupBy(predicates.angle_class(F.col("p_size") * 3.6 - 90).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN a >= 100 THEN 'ultra-wide' WHEN a >= 60 THEN 'wide' WHEN a >= 20 THEN 'standard' ELSE 'telephoto' END AS class, count(*) AS n FROM (SELECT p_size * 2.5 AS a FROM part) GROUP BY 1")
def focal_class(spark, folder):
    """Part sizes as fields of view."""
    return table(spark, folder, "part").groupBy(predicates.focal_class(F.col("p_size") * 2.5).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_BEST = "SELECT l_orderkey, {m}, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice {d}, l_linenumber) AS k FROM lineitem) WHERE k = 1"


@query(_BEST.format(m="l_extendedprice", d="DESC"))
def size_bigger(spark, folder):
    """The dearest line of each order; the first line wins a tie."""
    return aggregates.best(table(spark, folder, "lineitem"), ["l_orderkey"], "l_extendedprice", ["l_linenumber"], ["l_linenumber"])


@query(_BEST.format(m="l_extendedprice", d="ASC"))
def size_smaller(spark, folder):
    """The cheapest line of each order."""
    return aggregates.best(table(spark, folder, "lineitem"), ["l_orderkey"], "l_extendedprice", ["l_linenumber"], ["l_linenumber"], largest=False)


_MARGIN = """
WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity {d}, l_linenumber) AS k FROM lineitem),
f AS (SELECT l_orderkey, max(CASE WHEN k = 1 THEN l_quantity END) AS first, max(CASE WHEN k = 2 THEN l_quantity END) AS second, max(CASE WHEN k = 1 THEN l_linenumber END) AS l_linenumber FROM k WHERE k <= 2 GROUP BY 1)
SELECT l_orderkey, l_linenumber, first, second FROM f WHERE second IS NULL OR abs(first - second) >= 0.1 * least(first, second)
"""


@query(_MARGIN.format(d="DESC"))
def heaviest_with_margin(spark, folder):
    """The line with the largest quantity, where it leads by a tenth."""
    return aggregates.with_margin(table(spark, folder, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber", 0.1)


@query(_MARGIN.format(d="ASC"))
def lightest_with_margin(spark, folder):
    """The line with the smallest quantity, likewise."""
    return aggregates.with_margin(table(spark, folder, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber", 0.1, largest=False)


_PAIRS = "SELECT a.label, a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id"
_V = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL)"


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").where("label is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query(f"{_V}, p AS ({_PAIRS}), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM p) SELECT a, b, distance FROM k WHERE rank = 1")
def closest_pair(spark, folder):
    """The nearest other vector of the same label."""
    return neighbours.nearest(_vectors(spark, folder), ["label"], "vec_id", "e").select("a", "b", "distance")


@query(f"{_V}, p AS ({_PAIRS}), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM p) SELECT a, avg(distance) AS mean, max(distance) AS far FROM k WHERE rank <= 20 GROUP BY a")
def knn_k20(spark, folder):
    """Mean and largest distance of the twenty nearest of the same label."""
    near = neighbours.nearest(_vectors(spark, folder), ["label"], "vec_id", "e", 20)
    return near.groupBy("a").agg(F.avg("distance").alias("mean"), F.max("distance").alias("far"))


@query(f"{_V}, p AS ({_PAIRS}), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM p), l AS (SELECT a, list(distance ORDER BY distance) AS d, median(distance) FILTER (WHERE rank <= 5) AS m FROM k WHERE rank <= 20 GROUP BY a) SELECT a, CASE WHEN d[least(5, len(d))] > 3 * d[1] THEN m ELSE d[1] END AS distance FROM l")
def robust_nn(spark, folder):
    """The nearest distance, or the median of five where the nearest stands out."""
    near = neighbours.nearest(_vectors(spark, folder), ["label"], "vec_id", "e", 20)
    return near.groupBy("a").agg(F.array_sort(F.collect_list("distance")).alias("d")).select("a", joins.robust_distance(F.col("d")).alias("distance"))


@query(f"""{_V}, m AS (SELECT label, i, avg(e[i]) AS c FROM v, (SELECT unnest(range(1, 4)) AS i) GROUP BY ALL), c AS (SELECT label, list(c ORDER BY i) AS c FROM m GROUP BY 1)
SELECT vec_id, sqrt((e[1]-c[1])*(e[1]-c[1]) + (e[2]-c[2])*(e[2]-c[2]) + (e[3]-c[3])*(e[3]-c[3])) AS distance FROM v JOIN c USING (label)""")
def camera_distance(spark, folder):
    """Distance in three dimensions to the label's centre, which stands for a camera."""
    v = _vectors(spark, folder)
    centre = v.groupBy("label").agg(F.array(*[F.avg(F.get("e", F.lit(i))) for i in range(3)]).alias("c"))
    return v.join(centre, "label").select("vec_id", joins.distance(F.slice("e", 1, 3), F.col("c")).alias("distance"))


_BOX = "SELECT vec_id, e[1] AS x, e[2] AS y, e[3] AS z, abs(e[4]) AS ex, abs(e[5]) AS ey, abs(e[6]) AS ez FROM v"


@query(f"{_V}, b AS ({_BOX}) SELECT vec_id, x - ex / 2 AS x0, y + ey / 2 AS y1, greatest(z - ez, 0) AS low, z + ez AS high FROM b")
def obb_corners(spark, folder):
    """Corners and heights of upright boxes made of vector parts."""
    v = _vectors(spark, folder)
    e = lambda i: F.get("e", F.lit(i))
    r = F.array(G.vec(1, 0, 0), G.vec(0, 1, 0), G.vec(0, 0, 1))
    center, size = F.slice("e", 1, 3), F.transform(F.slice("e", 4, 3), lambda x: F.abs(x))
    corners = G.box_corners(center, size, r)
    low, high = G.box_heights(center, size, r)
    return v.select("vec_id", G.at(F.get(corners, F.lit(0)), 0).alias("x0"), G.at(F.get(corners, F.lit(7)), 1).alias("y1"), low.alias("low"), high.alias("high"))


@query(f"{_V} SELECT vec_id, 500 / tan(0.5) * (e[1] * 10) / (10 - e[3]) + 960 AS u, -500 / tan(0.5) * (e[2] * 10) / (10 - e[3]) + 500 AS v, 10 - e[3] AS depth FROM v")
def project_pinhole(spark, folder):
    """Pixels of points seen by a camera ten units above, looking down."""
    v = _vectors(spark, folder)
    e = lambda i: F.get("e", F.lit(i))
    p = G.project(G.vec(e(0) * 10, e(1) * 10, e(2)), G.vec(0, 0, 10), G.vec(0, 0, 0), G.vec(0, 1, 0), F.lit(1.0), F.lit(1920), F.lit(1000))
    return v.select("vec_id", p.alias("p")).select("vec_id", "p.u", "p.v", "p.depth")


@query(f"""{_V}, q AS (SELECT vec_id, e[1:4] AS a, e[5:8] AS b FROM v)
SELECT vec_id, a[4]*b[1]+a[1]*b[4]+a[2]*b[3]-a[3]*b[2] AS x, a[4]*b[2]-a[1]*b[3]+a[2]*b[4]+a[3]*b[1] AS y, a[4]*b[3]+a[1]*b[2]-a[2]*b[1]+a[3]*b[4] AS z, a[4]*b[4]-a[1]*b[1]-a[2]*b[2]-a[3]*b[3] AS w FROM q""")
def quaternion_chain(spark, folder):
    """Products of quaternions made of vector parts."""
    q = G.quat_mul(F.slice("e", 1, 4), F.slice("e", 5, 4))
    return _vectors(spark, folder).select("vec_id", q.alias("q")).select("vec_id", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate("xyzw")])


@query(f"""
WITH e AS ({_E}), q AS (SELECT *, sin(value / 50 / 2) AS z, cos(value / 50 / 2) AS w FROM e),
f AS (SELECT *, CASE WHEN z * lag(z) OVER o + w * lag(w) OVER o < 0 THEN 1 ELSE 0 END AS flip FROM q WINDOW o AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, CASE WHEN sum(flip) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) % 2 = 1 THEN -1.0 ELSE 1.0 END AS sign FROM f),
c AS (SELECT event_id, user_id, t, z * sign AS z, w * sign AS w FROM s),
n AS (SELECT event_id, coalesce(lag(z) OVER o, z) AS z0, coalesce(lag(w) OVER o, w) AS w0, coalesce(lead(z) OVER o, z) AS z1, coalesce(lead(w) OVER o, w) AS w1, coalesce(lead(t) OVER o, t) - coalesce(lag(t) OVER o, t) AS dt FROM c WINDOW o AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT event_id, dt, w0 * z1 - z0 * w1 AS tz, w0 * w1 + z0 * z1 AS tw FROM n),
g AS (SELECT event_id, dt, CASE WHEN tw < 0 THEN -tz ELSE tz END AS tz, abs(tw) AS tw FROM r)
SELECT event_id, CASE WHEN dt <> 0 AND tz IS NOT NULL THEN 0.0::DOUBLE END AS wx, CASE WHEN dt <> 0 AND tz IS NOT NULL THEN 0.0::DOUBLE END AS wy,
  tz * CASE WHEN abs(tz) < 1e-12 THEN 2.0 ELSE 2 * atan2(abs(tz), tw) / abs(tz) END / nullif(dt, 0) AS wz FROM g
""")
def angular_velocity(spark, folder):
    """Turning rates of a series of rotations made of event values."""
    df = _events(spark, folder).withColumn("q", G.axis_angle_quat(G.vec(0, 0, 1), F.col("value") / 50))
    df = ordered.angular_velocity(df, ["user_id"], "t", "q")
    return df.select("event_id", *[(F.get("omega", F.lit(i)) + F.lit(0.0)).alias(c) for i, c in enumerate(("wx", "wy", "wz"))])  # no negative zeros


@query()
def polygon_iou(spark, folder):
    """Overlap of the hulls of two sets of points made of vector parts."""
    points = lambda k: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array(F.get("e", i * 2 + k), F.get("e", i * 2 + k + 1)))
    return _vectors(spark, folder).select("vec_id", G.hull_iou(points(0), points(16)).alias("iou"))


@query("SELECT event_id, (CASE WHEN v < 100 THEN 'top' WHEN v < 200 THEN 'middle' ELSE 'bottom' END) || ' ' || (CASE WHEN u < 300 THEN 'left' WHEN u < 600 THEN 'center' ELSE 'right' END) AS zone FROM (SELECT event_id, value * 7 AS u, (event_id % 300) AS v FROM events WHERE value IS NOT NULL)")
def image_zone(spark, folder):
    """Ninths of an image of 900 by 300 that events fall in."""
    return table(spark, folder, "events").where("value is not null").select("event_id", G.zone(F.col("value") * 7, F.col("event_id") % 300, 900.0, 300.0).alias("zone"))
