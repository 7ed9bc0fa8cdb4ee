"""Text functions, options and samples of question records, on parts, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import order_key, seed_of, uniform
from ..operators import joins, options, ordered, sampling
from ..sources import outputs
from .registry import query, table

_HASH = "sha256(concat_ws(':', {}))"


@query(r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([^<>]*)>', 1))), '|') AS names FROM pages")
def extract_placeholders(spark, folder):
    """The distinct tags of each page, sorted."""
    return table(spark, folder, "pages").select("page_id", F.array_join(F.array_sort(X.placeholders(F.col("html"))), "|").alias("names"))


@query("SELECT p_partkey, 'What is the size of ' || p_name || ' by ' || p_brand || '?' AS question FROM part")
def fill_template(spark, folder):
    """A template filled for each part."""
    values = F.create_map(F.lit("OBJECT"), F.col("p_name"), F.lit("BRAND"), F.col("p_brand"))
    return table(spark, folder, "part").select("p_partkey", X.fill(F.lit("What is the size of <OBJECT> by <BRAND>?"), values).alias("question"))


@query(r"SELECT conv_id, turn, text, array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches(s, '^[A-Za-z]\.')), chr(10)) AS question, CAST(len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^[A-Za-z]\.'))) AS BIGINT) AS options FROM conversations WHERE text IS NOT NULL")
def parse_question_options(spark, folder):
    """Turns parted into question and option lines."""
    df = table(spark, folder, "conversations").where("text is not null")
    return df.select("conv_id", "turn", "text", X.question_text(F.col("text")).alias("question"), F.size(X.options(F.col("text"))).cast("long").alias("options"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower('Is  <OBJECT_1> ' || p_name || chr(10) || ' ok'), '<object_[0-9]+>', '<object>', 'g'), '[ \t\r\n]+', ' ', 'g')) AS template FROM part")
def normalise_template(spark, folder):
    """Templates in normal form."""
    t = F.concat(F.lit("Is  <OBJECT_1> "), F.col("p_name"), F.lit("\n ok"))
    return table(spark, folder, "part").select("p_partkey", X.normal_template(t).alias("template"))


@query(r"SELECT conv_id, turn, regexp_replace(role || '_' || CASE WHEN turn % 2 = 0 THEN 'g' ELSE 'i' END, '_[gi]$', '') AS base FROM conversations")
def base_idx(spark, folder):
    """Ids without their mode."""
    idx = F.concat(F.col("role"), F.lit("_"), F.when(F.col("turn") % 2 == 0, "g").otherwise("i"))
    return table(spark, folder, "conversations").select("conv_id", "turn", X.base_id(idx).alias("base"))


@query("SELECT CASE WHEN text IS NULL THEN NULL WHEN upper(substr(trim(text), 1, 1)) IN ('A', 'B', 'C', 'D') THEN upper(substr(trim(text), 1, 1)) ELSE 'Wrong' END AS choice, count(*) AS n FROM conversations GROUP BY 1")
def choice_normalise(spark, folder):
    """Turns as choices, counted."""
    return table(spark, folder, "conversations").groupBy(X.choice(F.col("text")).alias("choice")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(regexp_extract(upper(text), '[A-Z]', 0), '') AS letter, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def letter_normalise(spark, folder):
    """The first letter of each turn, counted."""
    return table(spark, folder, "conversations").where("text is not null").groupBy(X.letter(F.col("text")).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT lang, CAST(sum(n) AS BIGINT) AS tokens, avg(n) AS mean, max(n) AS most, arg_max(doc_id, struct_pack(a := n, b := -doc_id)) AS longest FROM (SELECT doc_id, lang, len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]')) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def token_image_stats(spark, folder):
    """Tokens of documents by language, and the longest one."""
    df = table(spark, folder, "documents").where("text is not null").select("doc_id", "lang", X.word_count(F.col("text")).alias("n"))
    return df.groupBy("lang").agg(F.sum("n").alias("tokens"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("longest"))


@query("""
WITH b AS (SELECT p_partkey, p_brand, p_type, list_distinct(list_transform(range(1, greatest(length(p_name), 1)), lambda i: substr(p_name, i, 2))) AS g FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.g, b.g)) / nullif(len(list_distinct(list_concat(a.g, b.g))), 0) AS jaccard FROM b a JOIN b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey
""")
def bigram_jaccard(spark, folder):
    """Similarity of the names of parts of one brand and type."""
    df = table(spark, folder, "part").withColumn("name", F.coalesce("p_name", F.lit("")))
    return joins.value_pairs(df, ["p_brand", "p_type"], "p_partkey", "name", X.set_jaccard, X.bigrams).withColumnRenamed("metric", "jaccard")


@query(f"SELECT p_partkey, {_HASH.format(chr(39) + '42' + chr(39) + ', p_partkey')} AS material FROM part")
def seed_material(spark, folder):
    """The digest from which each part's seed comes."""
    return table(spark, folder, "part").select("p_partkey", order_key(42, F.col("p_partkey")).alias("material"))


@query("""
WITH o AS (SELECT p_partkey, p_size, list_sort(list_transform(list_filter(range(1, 51), lambda x: x <> p_size), lambda x: struct_pack(d := abs(x - p_size), x := x)))[1:5] AS near FROM part),
w AS (SELECT p_partkey, p_size, list_transform(list_sort(list_transform(near, lambda s: struct_pack(k := sha256(concat_ws(':', '42', p_partkey, s.x)), x := CAST(s.x AS VARCHAR)))), lambda s: s.x)[1:3] AS wrong FROM o)
SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(list_concat([CAST(p_size AS VARCHAR)], wrong), lambda x: struct_pack(k := sha256(concat_ws(':', '42', p_partkey, x)), x := x))), lambda s: s.x), ',') AS labels FROM w
""")
def mcq_integer(spark, folder):
    """Options for a part's size."""
    labels = options.integer_options(F.col("p_size").cast("int"), 1, 50, 42, F.col("p_partkey"))
    return table(spark, folder, "part").select("p_partkey", F.array_join(labels, ",").alias("labels"))


def _numeric(spark, folder, name, labels, truth):
    # each row's labels are made once, in tasks of a bounded number of rows whatever the files' sizes
    part = ordered.dealt(table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_size"))
    df = part.select("p_partkey", outputs.once(labels).alias("labels"), truth.alias("truth")).where("labels is not null")
    return df.select("p_partkey", F.array_join("labels", ",").alias("labels"), options.correct_index(F.col("labels"), F.col("truth")).alias("correct"))


@query("""
WITH b AS (SELECT p_partkey, p_retailprice AS g, 1.5 + CAST(CAST('0x' || substr(sha256(concat_ws(':', '42', p_partkey)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * 2.5 AS s FROM part WHERE p_retailprice >= 1),
c AS (SELECT p_partkey, printf('%.2f', g) AS truth, list_transform(list_filter(list_transform([-3.0, -2.0, -1.0, 1.0, 2.0, 3.0], lambda x: (x + s) / s * g), lambda x: abs(x - g) > 0 AND x >= 0), lambda x: printf('%.2f', x)) AS w FROM b),
l AS (SELECT p_partkey, truth, list_concat([truth], list_filter(w, lambda x: x <> truth)[1:3]) AS labels FROM c),
h AS (SELECT p_partkey, truth, list_transform(list_sort(list_transform(labels, lambda x: struct_pack(k := sha256(concat_ws(':', '42', p_partkey, x)), x := x))), lambda s: s.x) AS labels FROM l WHERE len(labels) = 4 AND len(list_distinct(labels)) = 4)
SELECT p_partkey, array_to_string(labels, ',') AS labels, CAST(list_position(labels, truth) - 1 AS INT) AS correct FROM h
""")
def mcq_numeric(spark, folder):
    """Options for a part's price."""
    g = F.when(F.col("p_retailprice") >= 1, F.col("p_retailprice"))
    return _numeric(spark, folder, "mcq_numeric", options.numeric_options(g, 42, F.col("p_partkey"), low=0.0), options.fixed(F.col("p_retailprice"), 2))


@query("""
WITH b AS (SELECT p_partkey, p_retailprice * 1000 AS g, unnest([1.0, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1e1, 1e2, 1e3, 1e4, 1e5]::DOUBLE[]) AS f, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], 1) AS i FROM part WHERE p_retailprice > 0),
x AS (SELECT p_partkey, i, f * g AS x FROM b WHERE i = 1 OR f * g > 100),
d AS (SELECT p_partkey, i, CAST(CAST(x AS VARCHAR) AS DECIMAL(38, 16)) AS d, CAST(floor(log10(x)) AS BIGINT) AS e FROM x),
u AS (SELECT p_partkey, i, d, e, CAST(pow(10, e - 2) AS BIGINT) AS u FROM d),
m AS (SELECT p_partkey, i, e, CAST(floor(d + CAST(u * 0.5 AS DECIMAL(38, 16))) AS BIGINT) // u AS m FROM u),
n AS (SELECT p_partkey, i, CASE WHEN m = 1000 THEN e + 1 ELSE e END AS e, CASE WHEN m = 1000 THEN 100 ELSE m END AS m FROM m),
t AS (SELECT p_partkey, i, (m // 100) || '.' || lpad(CAST(m % 100 AS VARCHAR), 2, '0') || 'e+' || lpad(CAST(e AS VARCHAR), 2, '0') AS t FROM n),
c AS (SELECT p_partkey, list(t ORDER BY i) FILTER (i = 1) AS one, list(t ORDER BY i) FILTER (i > 1) AS w FROM t GROUP BY 1),
l AS (SELECT p_partkey, one[1] AS truth, list_concat(one, list_filter(w, lambda x: x <> one[1])[1:3]) AS labels FROM c),
h AS (SELECT p_partkey, truth, list_transform(list_sort(list_transform(labels, lambda x: struct_pack(k := sha256(concat_ws(':', '42', p_partkey, x)), x := x))), lambda s: s.x) AS labels FROM l WHERE len(labels) = 4 AND len(list_distinct(labels)) = 4)
SELECT p_partkey, array_to_string(labels, ',') AS labels, CAST(list_position(labels, truth) - 1 AS INT) AS correct FROM h
""")
def mcq_log(spark, folder):
    """Options a few powers of ten away from a part's price in mills."""
    return _numeric(spark, folder, "mcq_log", options.log_options(F.col("p_retailprice") * 1000, 42, F.col("p_partkey"), least=100.0), F.format_string("%.2e", F.col("p_retailprice") * 1000))


@query("""
WITH b AS (SELECT p_partkey, p_size / 150.0 AS r FROM part),
c AS (SELECT p_partkey, printf('%.2f', r) AS truth, list_transform(list_filter(list_transform([-3.0, -2.0, -1.0, 1.0, 2.0, 3.0], lambda x: (x + 3) / 3 * r), lambda x: x >= 0 AND x <= 0.5), lambda x: printf('%.2f', x)) AS w FROM b),
l AS (SELECT p_partkey, truth, list_concat([truth], list_filter(w, lambda x: x <> truth)[1:3]) AS labels FROM c),
h AS (SELECT p_partkey, truth, list_transform(list_sort(list_transform(labels, lambda x: struct_pack(k := sha256(concat_ws(':', '42', p_partkey, x)), x := x))), lambda s: s.x) AS labels FROM l WHERE len(labels) = 4 AND len(list_distinct(labels)) = 4)
SELECT p_partkey, array_to_string(labels, ',') AS labels, CAST(list_position(labels, truth) - 1 AS INT) AS correct FROM h
""")
def mcq_poisson(spark, folder):
    """Options for a ratio made of a part's size."""
    ratio = F.col("p_size") / 150.0
    return _numeric(spark, folder, "mcq_poisson", options.ratio_options(ratio, 42, F.col("p_partkey")), options.fixed(ratio, 2))


@query("""
WITH c AS (SELECT DISTINCT p_brand, p_type FROM part), t AS (SELECT p_brand, min(p_type) AS truth FROM part GROUP BY 1),
x AS (SELECT t.p_brand, truth, 0 AS tier, p_type FROM t JOIN c ON c.p_brand = t.p_brand UNION ALL SELECT t.p_brand, truth, 1, a.p_type FROM t, (SELECT DISTINCT p_type FROM part) a),
b AS (SELECT p_brand, truth, p_type, min(tier) AS tier FROM x WHERE p_type <> truth GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, sha256(concat_ws(':', '42', p_type)), p_type) AS k FROM b),
w AS (SELECT p_brand, truth, list(p_type ORDER BY k) AS w FROM k WHERE k <= 3 GROUP BY ALL)
SELECT p_brand, truth, array_to_string(list_transform(list_sort(list_transform(list_concat([truth], w), lambda x: struct_pack(k := sha256(concat_ws(':', '42', p_brand, x)), x := x))), lambda s: s.x), ',') AS labels FROM w WHERE len(w) = 3
""")
def mcq_categorical(spark, folder):
    """Types as options: of the same brand first, then others."""
    part = table(spark, folder, "part")
    truth = part.groupBy("p_brand").agg(F.min("p_type").alias("truth"))
    own = truth.join(part.select("p_brand", "p_type").distinct(), "p_brand").select("p_brand", "truth", F.lit(0).alias("tier"), F.col("p_type").alias("name"))
    kinds = part.select(F.col("p_type").alias("name")).distinct()
    every = truth.crossJoin(kinds).select("p_brand", "truth", F.lit(1).alias("tier"), "name")  # brands times types: two small dimensions
    out = options.categorical_options(own.unionByName(every), ["p_brand"], "truth", "tier", "name")
    return out.select("p_brand", "truth", F.array_join("labels", ",").alias("labels"))


@query("WITH k AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256(concat_ws(':', '42', event_id)), event_id) AS k FROM events) SELECT event_id, event_type FROM k WHERE k <= 20")
def stratified_sample(spark, folder):
    """Twenty events of each type, by hash: a sampling operator."""
    return sampling.draw(table(spark, folder, "events").select("event_id", "event_type"), ["event_type"], 20, "event_id")


@query("""
WITH c AS (SELECT event_type, count(*) AS n, count(*) OVER () AS g FROM events GROUP BY 1), k AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256(concat_ws(':', '42', event_id)), event_id) AS k FROM events)
SELECT event_id, event_type FROM k JOIN c USING (event_type) WHERE k <= least(n, 200 // g)
""")
def even_sample(spark, folder):
    """Two hundred events in equal shares of the five types."""
    return sampling.even(table(spark, folder, "events").select("event_id", "event_type"), ["event_type"], 200, "event_id")


@query("""
WITH c AS (SELECT o_orderpriority, floor(count(*) * 0.1) AS take FROM orders GROUP BY 1), k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(concat_ws(':', '42', o_orderkey)), o_orderkey) AS k FROM orders)
SELECT o_orderkey, o_orderpriority FROM k JOIN c USING (o_orderpriority) WHERE k <= take
""")
def percentage_sample(spark, folder):
    """A tenth of the orders of each priority."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    fractions = {g: 0.1 for g in sampling.sizes(df, "o_orderpriority")}
    return sampling.percentage(df, ["o_orderpriority"], fractions, None, "o_orderkey")


@query()
def mode_ratio_sample(spark, folder):
    """Sixty orders in shares by priority and a ratio of two statuses at once."""
    df = table(spark, folder, "orders").where("o_orderstatus in ('F', 'O')").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    groups = sampling.sizes(df, "o_orderpriority")
    return sampling.percentage_with_modes(df, "o_orderpriority", "o_orderstatus", {g: 1 / len(groups) for g in groups}, {"F": 2, "O": 1}, 60, "o_orderkey")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY sha256(concat_ws(':', '42', conv_id)), conv_id LIMIT 25)")
def idx_group_sample(spark, folder):
    """All turns of twenty-five conversations: a sampling operator."""
    return sampling.bundles(table(spark, folder, "conversations").select("conv_id", "turn", "role"), "conv_id", 25)


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE c.conv_id IN (SELECT conv_id FROM conversations WHERE turn = 3)")
def idx_closure(spark, folder):
    """All turns of the conversations of a sample of turns."""
    df = table(spark, folder, "conversations").select("conv_id", "turn")
    return sampling.closure(df, df.where("turn = 3"), F.col("conv_id"))


@query("SELECT 5 + CAST(CAST('0x' || substr(sha256(concat_ws(':', '7', p_partkey)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * 10 AS u, p_partkey FROM part")
def hash_uniform(spark, folder):
    """A number in [5, 15) for each part."""
    return table(spark, folder, "part").select("p_partkey", uniform(7, F.col("p_partkey"), low=5.0, high=15.0).alias("u"))


@query(f"SELECT p_partkey, CAST(CAST('0x' || substr({_HASH.format(chr(39) + '42' + chr(39) + ', p_partkey')}, 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM part")
def seed_numbers(spark, folder):
    """Seeds as 64-bit unsigned numbers."""
    return table(spark, folder, "part").select("p_partkey", seed_of(42, F.col("p_partkey")).cast("string").alias("seed"))


@query(r"SELECT event_id, CASE WHEN regexp_matches(props, '^\{') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_field(spark, folder):
    """A field of the events' JSON."""
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
