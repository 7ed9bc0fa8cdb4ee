"""Evaluation marts on the order tables, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, joins, names, ranks
from .registry import query, table


def _t(spark, folder, name):
    return table(spark, folder, name)


def _rated(spark, folder):
    docs = _t(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(_t(spark, folder, "labels"), "doc_id")


@query("""
SELECT n_name, o_orderpriority, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
""")
def star_eval_join(spark, folder):
    """Lines with their order, customer and nation."""
    facts = _t(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    df = joins.star(facts, [
        (_t(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "l_orderkey", "o_orderkey"),
        (_t(spark, folder, "customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey"),
        (_t(spark, folder, "nation").select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey"),
    ])
    return df.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def semi_subset(spark, folder):
    """Documents labelled poor."""
    poor = _t(spark, folder, "labels").where("quality = 0")
    return joins.members(_t(spark, folder, "documents").select("doc_id", "lang", "source"), poor, "doc_id")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_missing(spark, folder):
    """Documents without a label."""
    return joins.missing(_t(spark, folder, "documents").select("doc_id", "lang", "source"), _t(spark, folder, "labels"), "doc_id")


@query("SELECT doc_id, min(item_id) AS item_id, arg_min(b.text, item_id) AS fragment FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id")
def theta_contains(spark, folder):
    """The first benchmark passage that a document contains literally."""
    items = _t(spark, folder, "benchmark").select("item_id", F.col("text").alias("fragment"))
    return names.picked(_t(spark, folder, "documents"), "text", ["doc_id"], items, "fragment", "item_id")


@query("SELECT l_partkey, arg_min(l_returnflag, struct_pack(a := l_orderkey, b := l_linenumber)) AS l_returnflag, count(DISTINCT l_returnflag) <= 1 AS agrees FROM lineitem GROUP BY 1")
def gt_consistency(spark, folder):
    """The first flag of each part and whether all its lines have it."""
    df = _t(spark, folder, "lineitem").withColumn("ord", F.col("l_orderkey") * 1000 + F.col("l_linenumber"))
    return joins.consistent(df, ["l_partkey"], "l_returnflag", "ord")


@query("SELECT lang, source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS correct, sum(quality) / count(*) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def accuracy_summary(spark, folder):
    """Share of good documents by language and source."""
    return aggregates.accuracy(_rated(spark, folder), ["lang", "source"], F.col("quality") == 1)


@query("SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS correct, sum(quality) / nullif(count(*), 0) AS accuracy FROM documents JOIN labels USING (doc_id)")
def overall_accuracy(spark, folder):
    """Share of good documents."""
    return aggregates.accuracy(_rated(spark, folder), [], F.col("quality") == 1)


@query("""
WITH a AS (SELECT lang, source, toxic, avg(CAST(quality = 1 AS INT)) AS x FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
b AS (SELECT lang, source, avg(x) AS x FROM a GROUP BY ALL) SELECT lang, avg(x) AS accuracy FROM b GROUP BY 1
""")
def balanced_accuracy(spark, folder):
    """Means of means by language: over sources, and in these over toxicity."""
    return aggregates.balanced_accuracy(_rated(spark, folder), ["lang"], ["source", "toxic"], F.col("quality") == 1)


@query("""
SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN grouping(o_orderstatus) = 1 THEN 'Total' ELSE o_orderstatus END AS o_orderstatus,
  count(o_totalprice) AS n, sum(o_totalprice) / count(o_totalprice) AS mean FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)
""")
def margins_total_average(spark, folder):
    """Mean price by priority and status, with margins."""
    return aggregates.margins(_t(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", F.col("o_totalprice"))


@query("SELECT quality, count(*) FILTER (WHERE toxic = 0) AS clean, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY 1")
def confusion_pivot(spark, folder):
    """Quality against toxicity."""
    df = _t(spark, folder, "labels").withColumn("p", F.when(F.col("toxic") == 0, "clean").otherwise("toxic"))
    return aggregates.confusion(df, [], "quality", "p", ["clean", "toxic"])


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, n / sum(n) OVER () AS share, repeat('#', CAST(floor(n / sum(n) OVER () * 40) AS INT)) AS bar FROM c")
def histogram_pct(spark, folder):
    """Event types with shares and bars."""
    return aggregates.histogram(_t(spark, folder, "events"), [], "event_type")


@query("WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY o_orderpriority) AS share, repeat('#', CAST(floor(n / sum(n) OVER (PARTITION BY o_orderpriority) * 40) AS INT)) AS bar FROM c")
def grouped_histogram(spark, folder):
    """Order status within each priority."""
    return aggregates.histogram(_t(spark, folder, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("SELECT count(*) FILTER (WHERE lang IS NULL) AS lang, count(*) FILTER (WHERE quality IS NULL) AS quality, count(*) FILTER (WHERE toxic IS NULL) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def null_counts(spark, folder):
    """Nulls after a left join to the labels."""
    df = _t(spark, folder, "documents").select("doc_id", "lang").join(_t(spark, folder, "labels"), "doc_id", "left")
    return aggregates.null_counts(df, ["lang", "quality", "toxic"])


@query("SELECT count(DISTINCT lang) AS lang, count(DISTINCT source) AS source FROM documents")
def nunique(spark, folder):
    """Distinct languages and sources."""
    return aggregates.distinct_counts(_t(spark, folder, "documents"), ["lang", "source"])


@query("SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1")
def pearson(spark, folder):
    """Correlation of quantity and price by flag."""
    return aggregates.pearson(_t(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("""
WITH k AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS y FROM part)
SELECT p_brand, count(*) AS n, corr(x, y) AS rho FROM k GROUP BY 1
""")
def spearman(spark, folder):
    """Rank correlation of size and price by brand."""
    return ranks.spearman(_t(spark, folder, "part"), ["p_brand"], "p_size", "p_retailprice")


@query("SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1")
def ols(spark, folder):
    """The line of price on quantity by flag."""
    return aggregates.line(_t(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("""
WITH l AS (SELECT p_brand, regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part GROUP BY 1), r AS (SELECT p.p_brand, p_retailprice - (s * p_size + i) AS residual FROM part p JOIN l USING (p_brand))
SELECT p_brand, count(residual) AS n, stddev_samp(residual) AS std, min(residual) AS min, quantile_cont(residual, 0.25) AS q1, quantile_cont(residual, 0.5) AS median, quantile_cont(residual, 0.75) AS q3, max(residual) AS max FROM r GROUP BY 1
""")
def residual_describe(spark, folder):
    """Residuals of price on size, described by brand; their mean is 0 but for rounding, so it is left out."""
    df = aggregates.residuals(_t(spark, folder, "part"), ["p_brand"], "p_size", "p_retailprice")
    return aggregates.describe(df, ["p_brand"], "residual").drop("mean")


@query("WITH m AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY ALL) SELECT o_orderpriority, avg(m) AS mean, min(m) AS min, max(m) AS max, count(*) AS groups FROM m GROUP BY 1")
def two_level_means(spark, folder):
    """Mean, least and largest of the means by status, for each priority."""
    return aggregates.two_level(_t(spark, folder, "orders"), ["o_orderpriority"], ["o_orderstatus"], F.col("o_totalprice"))


@query("WITH n AS (SELECT l_orderkey, max(c) AS c FROM (SELECT l_orderkey, l_suppkey, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY 1) SELECT count(*) AS scenes, count(*) FILTER (WHERE c > 1) AS with_duplicates, count(*) FILTER (WHERE c > 1) / nullif(count(*), 0) AS share FROM n")
def duplicate_census(spark, folder):
    """Orders with a supplier more than once."""
    return aggregates.duplicate_census(_t(spark, folder, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT c_mktsegment, sum(w) AS total FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) JOIN (SELECT n_nationkey AS c_nationkey, CAST(n_regionkey + 0.5 AS DOUBLE) AS w FROM nation) USING (c_nationkey) GROUP BY 1")
def weighted_category_sums(spark, folder):
    """Weights of the distinct nations of each segment."""
    weights = _t(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") + F.lit(0.5)).alias("w"))
    return aggregates.weighted_sums(_t(spark, folder, "customer"), "c_mktsegment", "c_nationkey", weights, "w")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_k_annotate(spark, folder):
    """The ten richest customers: the report's own limit."""
    return _t(spark, folder, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT s_name, row_number() OVER (ORDER BY lpad(regexp_extract(s_name, '[0-9]+'), 20, '0'), s_name) AS k FROM supplier")
def natural_sort(spark, folder):
    """Suppliers numbered in natural order of their names; numbers come from ranges, so no task sorts all rows."""
    from ..functions.text import natural_key

    df = _t(spark, folder, "supplier").select("s_name", natural_key(F.col("s_name")).alias("key"))
    return ranks.ordinal(df, [], ["key", "s_name"], "k").select("s_name", "k")
