"""Chat formatting with DataFrame functions only: an event log becomes messages, and messages a text with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: OPEN role MIDDLE text CLOSE. Every "<" and "[" of a role or text is escaped, so none of these occurs in one.
OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    """Backslash, "<" and "[" as backslash and a letter."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: each backslash of an escaped text begins a pair, so the order here is safe."""
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def fold(events: DataFrame, *, conv: str = "conv_id", seq: str = "seq", op: str = "op", target: str = "target", role: str = "role", text: str = "text") -> DataFrame:
    """Replays a log of chat events: one row (conv, slot, role, text) for each final message.

    Events apply in order of ``seq``; ties go by op, role and text. ``message`` begins a message, ``delta`` appends to the
    one last begun, ``regenerate`` empties that one and begins its text again, ``edit`` replaces the text of message number
    ``target`` (from 1; null: the one last begun). A delta before any message makes message 0; edits of messages that
    have not begun are dropped, and so are unknown ops. Null text is empty, a null role is the empty role, a null
    conversation is one of its own, a null seq comes first. Other columns are ignored.
    """
    df = events.select(F.col(conv).alias("__c"), F.col(seq).alias("__q"), F.col(op).alias("__o"), F.col(target).cast("long").alias("__g"), F.coalesce(F.col(role), F.lit("")).alias("__r"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    df = df.where(F.col("__o").isin("message", "delta", "regenerate", "edit"))
    order = Window.partitionBy("__c").orderBy(F.col("__q").asc_nulls_first(), F.when(F.col("__o") == "message", 0).otherwise(1), "__o", "__r", "__t")
    df = df.withColumn("__n", F.row_number().over(order)).withColumn("__k", F.sum(F.when(F.col("__o") == "message", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    df = df.where((F.col("__o") != "edit") | F.col("__g").isNull() | F.col("__g").between(0, F.col("__k")))
    df = df.withColumn("__k", F.when(F.col("__o") == "edit", F.coalesce("__g", "__k")).otherwise(F.col("__k")))
    began = F.col("__o") != "delta"
    parts = F.array_sort(F.collect_list(F.struct("__n", "__t")))
    out = df.groupBy("__c", "__k").agg(
        parts.alias("parts"), F.max(F.when(began, F.col("__n"))).alias("reset"), F.min_by("__r", "__n").alias("__r"),
        F.max(F.col("__o").isin("message", "delta")).alias("real"),
    ).where("real")
    whole = F.array_join(F.transform(F.filter("parts", lambda p: p["__n"] >= F.coalesce("reset", F.lit(0))), lambda p: p["__t"]), "")
    return out.select(F.col("__c").alias(conv), F.col("__k").alias("slot"), F.col("__r").alias(role), whole.alias(text))


def render(messages: DataFrame, *, conv: str = "conv_id", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row for each conversation: (conv, formatted, loss_spans), spans (start, length) in code points over the texts of role ``learn``."""
    segment = F.concat(F.lit(OPEN), escape(F.col(role)), F.lit(MIDDLE), escape(F.col(text)), F.lit(CLOSE))
    order = Window.partitionBy(conv).orderBy("slot")
    df = messages.select(conv, "slot", segment.alias("seg"), F.length(escape(F.col(role))).alias("head"), F.length(escape(F.col(text))).alias("len"), (F.col(role) == learn).alias("on"))
    end = F.sum(F.length("seg")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("start", end - F.length("seg") + len(OPEN) + len(MIDDLE) + F.col("head"))
    df = df.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("slot", "seg", "start", F.col("len").cast("long").alias("len"), "on"))).alias("m"))
    spans = F.transform(F.filter("m", lambda x: x["on"]), lambda x: F.struct(x["start"].alias("start"), x["len"].alias("length")))
    return df.select(conv, F.array_join(F.transform("m", lambda x: x["seg"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The messages (role, text) of a rendered conversation."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    cut = lambda p: F.split(p, r"\[/INST\]", 2)
    return F.transform(parts, lambda p: F.struct(unescape(F.substr(F.get(cut(p), F.lit(0)), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.get(cut(p), F.lit(1))).alias("text")))
