"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, chat, jaccard, language, leakage, lines, negatives, packing, periodic, pii, quality, secrets, vectors
from .common import WORD, digest_bucket, let, table


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-model scores of every document, learned on six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    fold = digest_bucket(F.col("doc_id"), 7)
    return brown.fit_score(docs, fold != 2).withColumn("held_out", fold == 2)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal numbers, dates and mailboxes under pseudonyms; the key is the session's ``scenelake.pii.key``."""
    key = spark.conf.get("scenelake.pii.key", "a key for tests")
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in pii.KINDS], F.size("pii").cast("long").alias("n_pii"), "text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, chance of the top grade and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades_of(table(spark, sf_dir, "labels")), levels=3)
    return quality.score(docs, model).withColumn("kept", F.col("tail") >= 0.5)


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of embeddings of cosine 0.95 or more."""
    return vectors.near(table(spark, sf_dir, "embeddings"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by Jaccard similarity 0.9 of three-word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered and read back from the rendered text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = rows.unionByName(two)
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("op"), F.lit(None).cast("long").alias("target"), "role", "text")
    out = chat.render(chat.fold(events)).withColumn("turns", chat.parse(F.col("formatted")))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda x: chat.unescape(F.substr(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    out = leakage.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "best_score", "best_overlap", "leaked")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned on three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = digest_bucket(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out))
    out = language.predict(docs, model)
    return out.select("doc_id", (digest_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that an earlier document holds."""
    out = lines.dedupe(table(spark, sf_dir, "documents"), least=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector for its first positives."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document; one document in ten is first made periodic from some word on, by its id."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: at(i)), " "))

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))
    found = periodic.runs(docs, least=24, times=3)
    longer = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    top = F.aggregate("runs", none, lambda best, x: F.when(best.isNull() | longer(x, best), x).otherwise(best))
    told = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON a = vec_id
"""

OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.b AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

OP8_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), sized AS (
  SELECT *, length(replace(replace(replace(role || text, '\\', '--'), '<', '--'), '[', '--')) + length('[INST][/INST]</s>') AS n FROM rows
), agg AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    CAST(sum(n) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM agg
"""

OP11_SQL = """
WITH parted AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM parted
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeats AS (
  SELECT k, min(doc_id) AS low FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (low <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (low IS NULL OR low = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN repeats USING (k) GROUP BY r, doc_id
"""

OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS s, a.label = b.label AS same
  FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id NULLS LAST, b) AS k FROM scores WHERE same QUALIFY k <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.k ORDER BY n.s DESC, n.vec_id NULLS LAST, n.b) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scores n ON p.a = n.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s QUALIFY rank <= 3
"""

QUERIES = {f.__name__: f for f in (op1_brown, op2_pii, op3_quality, op4_vectors, op5_jaccard, op6_secrets, op7_packing, op8_chat, op9_leakage, op10_language, op11_lines, op12_negatives, op13_periodic)}
ORACLE: dict[str, str] = {"op4_vectors": OP4_SQL, "op5_jaccard": OP5_SQL, "op8_chat": OP8_SQL, "op11_lines": OP11_SQL, "op12_negatives": OP12_SQL}
