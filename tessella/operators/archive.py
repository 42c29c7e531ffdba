"""Recall of archived turns, audit records, and forks of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import archive_key
from .turns import summaries, transcripts


def archive_turns(marked: DataFrame) -> DataFrame:
    """Archive rows (session, archive_key, turn, label, summary, detail) of the finished turns of segmented messages."""
    done = marked.where("bucket = 'done'")
    detail = transcripts(done, "session", "turn").select("session", "turn", F.col("transcript").alias("detail"))
    return summaries(done).join(detail, ["session", "turn"]).select("session", "archive_key", "turn", F.lit("turn").alias("label"), F.col("snippet").alias("summary"), "detail")


def recall(requests: DataFrame, archive: DataFrame) -> DataFrame:
    """(session, archive_key, found, text) of each request (session, archive_key), hits rendered, misses named."""
    got = requests.join(archive, ["session", "archive_key"], "left")
    found = F.col("turn").isNotNull()
    text = F.concat(F.lit("Recalled turn "), F.col("turn").cast("string"), F.lit(" (key "), "archive_key", F.lit(") — "), "label", F.lit("\nSummary was: "), "summary", F.lit("\n--- full detail ---\n"), "detail")
    miss = F.concat(F.lit("No archived turn found for key '"), "archive_key", F.lit("'."))
    return got.select("session", "archive_key", found.alias("found"), F.when(found, text).otherwise(miss).alias("text"))


def rendered_blocks(messages: DataFrame) -> DataFrame:
    """The lines that a recall shows for each message's blocks, one text for each session and turn."""
    head = lambda mark: F.concat(F.lit("["), "role", F.lit(mark))
    b = F.col("b")
    line = (
        F.when(b["type"] == "text", F.concat(head("] "), b["text"]))
        .when(b["type"] == "thinking", F.concat(head(":thinking] "), b["thinking"]))
        .when(b["type"] == "tool_use", F.concat(head(":tool_use "), b["name"], F.lit("] "), b["input"]))
        .when(b["type"] == "tool_result", F.concat(head(":tool_result"), F.when(b["is_error"], " (error)").otherwise(""), F.lit("] "), b["content"]))
        .when(b["type"] == "image", F.concat(head(":image] "), b["source"]))
    )
    rows = messages.select("session", "turn", "seq", "role", F.posexplode("blocks").alias("place", "b")).withColumn("line", line)
    return rows.groupBy("session", "turn").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY seq, place)").alias("text"))


def audit_compaction(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compaction records: messages and estimated tokens of each session before and after."""
    size = lambda rows, tag: rows.groupBy("session").agg(F.count("*").alias(f"messages_{tag}"), F.floor(F.sum(F.length("text")) / 4).cast("long").alias(f"tokens_{tag}"))
    return size(before, "before").join(size(after, "after"), "session", "left").na.fill(0).withColumn("event", F.lit("rework"))


def fork(messages: DataFrame, source, target) -> DataFrame:
    """messages with those of session source again under target; to be checked: source exists and target does not."""
    return messages.unionByName(messages.where(F.col("session") == source).withColumn("session", F.lit(target).cast(messages.schema["session"].dataType)))


def recall_tool(shape: str) -> dict:
    """The tool by which a model asks for an archived turn, as either provider wants it described."""
    params = {"type": "object", "properties": {"key": {"type": "string", "description": "Archive key of the turn, such as turn-0003."}}, "required": ["key"]}
    about = "Returns an archived turn in full, by the key that its summary names."
    if shape.lower() == "anthropic":
        return {"name": "recall_turn", "description": about, "input_schema": params}
    if shape.lower() == "openai":
        return {"type": "function", "function": {"name": "recall_turn", "description": about, "parameters": params}}
    raise ValueError(f"unknown tool shape {shape!r}")


def keys_of(turns):
    return archive_key(turns)
