"""Requests on their way to a model: system prompts, empty answers, nudges, audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank

MODES = ("replace", "prefix", "suffix", "prefix_env")


def override_system(messages: DataFrame, prompt: str, mode: str = "replace") -> DataFrame:
    """Messages (session, seq, role, text) with the leading system messages made one by a prompt of our own.

    replace drops the host's text, prefix and suffix put ours before or after it, prefix_env
    keeps only its <env> block.  A session without system messages gets one, as message -1.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    talk = F.sum((F.col("role") != "system").cast("long")).over(Window.partitionBy("session").orderBy("seq"))
    rows = messages.withColumn("talk", talk)
    lead = rows.withColumn("line", F.when(F.col("talk") == 0, F.coalesce("text", F.lit("")))).groupBy("session").agg(F.coalesce(F.expr("listagg(line, '\\n\\n') WITHIN GROUP (ORDER BY seq)"), F.lit("")).alias("host"))
    gap, own, host = F.lit("\n\n"), F.lit(prompt), F.col("host")
    env = F.regexp_extract(host, r"(?s)<env>.*?</env>", 0)
    text = {
        "replace": own,
        "prefix": F.when(host == "", own).otherwise(F.concat(own, gap, host)),
        "suffix": F.when(host == "", own).otherwise(F.concat(host, gap, own)),
        "prefix_env": F.when(env == "", own).otherwise(F.concat(own, gap, env)),
    }[mode]
    head = lead.select("session", F.lit(-1).cast("long").alias("seq"), F.lit("system").alias("role"), text.alias("text"))
    return head.unionByName(rows.where("talk > 0").select("session", "seq", "role", "text"))


def is_turn(tools) -> Column:
    """Whether a request counts as a turn: auxiliary requests carry no tools."""
    return F.size(F.coalesce(tools, F.array().cast("array<string>"))) > 0


def is_empty(text, tool_calls) -> Column:
    """Whether an answer has neither text nor tool calls."""
    return blank(text) & (F.coalesce(F.size(tool_calls), F.lit(0)) <= 0)


def nudged(messages: DataFrame, replies: DataFrame, nudge: str = "please continue.") -> DataFrame:
    """messages with each session's empty reply (session, text) and a user message that asks to go on, for one retry."""
    last = messages.groupBy("session").agg(F.max("seq").alias("last")).join(replies.select("session", F.col("text").alias("said")), "session")
    extra = F.array(F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.coalesce("said", F.lit("")).alias("text")), F.struct(F.lit(2).alias("k"), F.lit("user").alias("role"), F.lit(nudge).alias("text")))
    more = last.select("session", "last", F.explode(extra).alias("x")).select("session", (F.col("last") + F.col("x.k")).alias("seq"), "x.role", "x.text")
    return messages.select("session", "seq", "role", "text").unionByName(more)


def recall_record(key, found) -> Column:
    return F.to_json(F.struct(F.lit("recall").alias("event"), key.alias("key"), found.alias("found")))


def member_files(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(concept_id, files): the files of each concept's members (concept_id, node_id), distinct, in order, comma-joined."""
    rows = members.join(entities.select("node_id", "file"), "node_id")
    return rows.groupBy("concept_id").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))
