"""Curation of record tables: filters, joins of questions with answers, first rows, orders, counts and option edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The ending of an id for each mode.
MODE_ENDINGS = {"image-only": "_i", "general": "_g"}


# ---- filters


def of_category(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows whose category or mode is one of the wanted ones, in any case; null is none."""
    return df.where(F.lower(F.col(column)).isin([w.lower() for w in wanted]))


def of_mode(df: DataFrame, idx: str, mode: str) -> DataFrame:
    """Rows whose id has the ending of a mode anywhere; the underscore is meant literally."""
    return df.where(F.col(idx).contains(MODE_ENDINGS[mode]))


def without_ids(df: DataFrame, key: str, excluded: list) -> DataFrame:
    """Rows whose key is none of a short list; null keys stay."""
    return df.where(~F.coalesce(F.col(key).isin(excluded), F.lit(False))) if excluded else df


def keep_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that the table has, in the order given."""
    return df.select(*[c for c in columns if c in df.columns])


def pick_column(columns: list[str], preferred: list[str], part: str = "") -> str | None:
    """The first preferred column that is there, else the first whose name contains ``part``, else none."""
    for c in preferred:
        if c in columns:
            return c
    return next((c for c in columns if part and part in c.lower()), None)


def shared_columns(a: list[str], b: list[str], preferred: list[str]) -> list[str]:
    """Columns of both tables, the preferred ones first, the rest by name."""
    both = set(a) & set(b)
    return [c for c in preferred if c in both] + sorted(both - set(preferred))


def without_renders(files: Column, question: Column) -> tuple[Column, Column]:
    """File lists without rendered copies, and the question with one image mark for each file that is left."""
    kept = F.filter(files, lambda f: ~F.contains(f, F.lit("//render")))
    return kept, F.concat(F.repeat(F.lit("<image>"), F.size(kept)), F.regexp_replace(question, "^(?:<image>)+", ""))


# ---- joins and first rows


def answered(questions: DataFrame, answers: DataFrame, key: str, endings: tuple[str, str] = ("_question", "_answer")) -> DataFrame:
    """Questions with their answers by an equal key; columns of both get endings of their own."""
    both = {c for c in questions.columns if c in answers.columns and c != key}
    named = lambda df, end: df.select(*[F.col(c).alias(c + end if c in both else c) for c in df.columns])
    return named(questions, endings[0]).join(named(answers, endings[1]), key)


def looked_up(df: DataFrame, truth: DataFrame, key: str, value: str, strict: bool = False) -> DataFrame:
    """Rows with the value of a table of unique keys, and ``found``; ``strict`` raises when there is a row without one, whatever is read of it."""
    known = truth.select(key, F.col(value), F.lit(True).alias("found"))
    out = df.join(known, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if strict:
        told = F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        out = out.where(F.when(F.col("found"), True).otherwise(F.raise_error(told).cast("boolean")))
    return out


def misses(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The keys that a table of known ones lacks, with their rows: the report of a look-up. A null key is missing too."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(known.select(F.col(key).alias("__k")), counts[key] == F.col("__k"), "left_anti")


def has_text(df: DataFrame, text: str, known: DataFrame, other: str) -> DataFrame:
    """Adds ``known``: whether a row's text is one of those of another table."""
    texts = known.select(F.col(other).alias("__known")).where("__known is not null").distinct()
    return df.join(texts, F.col(text) == F.col("__known"), "left").withColumn("known", F.col("__known").isNotNull()).drop("__known")


def first_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The first row of each key by a total order, as a partial aggregate."""
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__first"))
    return got.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in columns])


def agreed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key with its value; rows of a key that disagree raise an error, whatever is read of them."""
    got = df.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias(value))
    same = F.col("__low").eqNullSafe(F.col(value))
    told = F.concat(F.lit("values disagree for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    return got.where(F.when(same, True).otherwise(F.raise_error(told).cast("boolean"))).drop("__low")


def answer_map(df: DataFrame, key: str, answer: str, order: str) -> DataFrame:
    """The last answer of each key that is not blank, trimmed."""
    text = F.nullif(F.trim(F.col(answer)), F.lit(""))
    return df.where(text.isNotNull()).groupBy(key).agg(F.max_by(text, F.col(order)).alias(answer))


def parted(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid rows as two filtered views of one table; unknown is invalid."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


# ---- orders


def mixed_order(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Sorted by several keys, each ascending or (True) descending, nulls last."""
    return df.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys])


def rank_of(x: Column, order: list[str]) -> Column:
    """The place of a value in a list; those that are not in it come after all that are."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), x), F.lit(0)), F.lit(len(order) + 1)).cast("long")


def smallest(df: DataFrame, keys: list[str], metric: str, ties: list[str], k: int) -> DataFrame:
    """The ``k`` rows of each key with the smallest metric; Spark ranks them before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(metric), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shown(df: DataFrame, key: Column, k: int) -> DataFrame:
    """``k`` rows for display: those whose key is smallest, so the choice does not depend on partitions."""
    return df.orderBy(key).limit(k)


# ---- aggregates


def nested_counts(df: DataFrame, levels: list[str], default: str = "Unknown") -> DataFrame:
    """Counts of each value down a hierarchy, with the totals of each level, in one aggregate; null is ``default``."""
    named = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c) for c in levels])
    return named.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def mean_of_rows(cells: DataFrame, row: str, value: str) -> DataFrame:
    """The Average column of a matrix given as cells: the plain mean of a row's cells, whatever they count."""
    return cells.groupBy(row).agg(F.avg(value).alias("average"), F.count(value).alias("cells"))


def with_total(df: DataFrame, row: str, total: DataFrame, label: str = "Total") -> DataFrame:
    """A table with a last row that was computed elsewhere, such as a balanced overall score."""
    return df.unionByName(total.withColumn(row, F.lit(label)).select(*df.columns))


def density(df: DataFrame, keys: list[str], value: str, grid: list[float], width: float) -> DataFrame:
    """A Gaussian kernel density of a value at the points of a short grid: sums that combine before the shuffle."""
    points = df.where(F.col(value).isNotNull()).withColumn("point", F.explode(F.array(*map(F.lit, grid))))
    z = (F.col("point") - F.col(value)) / width
    return points.groupBy(*keys, "point").agg((F.sum(F.exp(-z * z / 2)) / (F.count(F.lit(1)) * width * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def named_twice(df: DataFrame, text: str, names: Column, by: str) -> DataFrame:
    """For each group its rows, and those whose text contains one of the row's names."""
    hit = F.exists(names, lambda n: F.contains(F.col(text), n))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))


def errors(df: DataFrame, correct: Column, order: list[str], k: int, then: list[str]) -> DataFrame:
    """The first ``k`` wrong rows by one order, shown in another."""
    return df.where(~F.coalesce(correct, F.lit(False))).orderBy(*order).limit(k).orderBy(*then)


# ---- values


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def padded(v: Column, size: int = 3) -> Column:
    """A vector cut or filled with zeros to a size."""
    return F.slice(F.concat(F.coalesce(v, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), size)), 1, size)


def magnitude(number: Column, vector: Column, text: Column) -> Column:
    """A number, else the length of a vector, else a number written as text."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.coalesce(number, length, F.trim(text).try_cast("double"))


def fraction(x: Column) -> Column:
    """A percentage as a fraction: up to 1 as it is, up to 100 by hundredths; anything else raises an error."""
    bad = F.raise_error(F.concat(F.lit("no percentage: "), x.cast("string"))).cast("double")
    return F.when(x.isNull() | x.between(0, 1), x).when((x > 1) & (x <= 100), x / 100).otherwise(bad)


def image_tokens(width: Column, height: Column, patch: int = 32) -> Column:
    return (F.ceil(width / patch) * F.ceil(height / patch)).cast("long")


def time_key(frame: Column) -> Column:
    """The time of a frame number at four steps a frame and one hundredth a step, as the key of a step: 0000.050 for 1."""
    return F.lpad(F.format_string("%.2f0", (frame * 4 + 1) / F.lit(100.0)), 8, "0")


def inserted(values: Column, at: Column, value: Column) -> Column:
    """A list with a value put in at an index from 0."""
    return F.concat(F.slice(values, F.lit(1), at), F.array(value), F.slice(values, at + 1, F.greatest(F.size(values) - at, F.lit(0))))


def image_labels(labels: Column) -> Column:
    """Labels that name a frame of six digits as image marks."""
    return F.transform(labels, lambda x: F.when(x.rlike("^[0-9]{6}$"), F.lit("<image>")).otherwise(x))


def first_key(values: Column, names: list[str]) -> Column:
    """The value of the first of several keys that a map has."""
    return F.coalesce(*[F.try_element_at(values, F.lit(n)) for n in names])


def next_letter(question: Column) -> Column:
    """The letter after the highest one that begins an option line; A where there is none."""
    letters = F.transform(F.filter(F.split(question, "\n"), lambda s: s.rlike(r"^[A-Z]\.")), lambda s: F.ascii(s))
    return F.char(F.coalesce(F.array_max(letters) + 1, F.lit(65)))


def with_option(question: Column, label: Column) -> Column:
    """A question with one more option line under the next letter."""
    return F.concat(question, F.lit("\n"), next_letter(question), F.lit(". "), label)


def uniform_frames(first: Column, last: Column, n: int) -> Column:
    """``n`` frames from first to last at equal distances, rounded down."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(first + i * (last - first) / F.lit(max(1, n - 1))).cast("long"))


def stepped_frames(start: Column, stop: Column, step: int) -> Column:
    """Every ``step``-th frame from start up to before stop."""
    return F.when(stop > start, F.sequence(start, stop - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
