"""The driver's tables seen as messages, tool calls, files and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: the column turn is a message's place."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls derived from events: session = user, turn = day, tool by event type, path by the number in props."""
    k = F.get_json_object("props", "$.k")
    e = F.col("event_type")
    name = F.when(e == "view", "Read").when(e == "click", "bash").when(e == "purchase", "apply_patch").when(e == "signup", "write_file").otherwise("glob")
    path = F.concat(F.lit("src/f"), k, F.lit(".py"))
    body = (
        F.when(e == "click", F.concat(F.lit('{"command":"cat '), path, F.lit(' | wc -l"}')))
        .when(e == "view", F.concat(F.lit('{"filePath":"'), path, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"path":" '), path, F.lit(' "}')))
    )
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.dayofyear("ts").cast("long").alias("turn"), F.col("event_id").alias("seq"), name.alias("name"), body.alias("input"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of a source tree."""
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".py"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("file"), "text")


def sources(spark: SparkSession, sf_dir: str, *, salt: Column | str = "") -> DataFrame:
    """documents as Python files (doc_id, file, content, hash): a class that calls one other class for each line of the text.

    Which one follows from the line's md5 (with the salt behind it) and lies within 48 ids.
    """
    d = F.col("doc_id").cast("string")
    salt = F.lit(salt) if isinstance(salt, str) else salt
    lines = files(spark, sf_dir).withColumn("lines", F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")))
    call = lambda line: F.concat(F.lit("        Doc"), F.abs(F.col("doc_id") + F.conv(F.substring(F.md5(F.concat(line, salt).cast("binary")), 1, 4), 16, 10).cast("long") % 97 - 48).cast("string"), F.lit("(x)\n"))
    head = F.concat(F.lit("class Doc"), d, F.lit("(Doc"), F.greatest(F.lit(0), F.col("doc_id") - 1 - F.col("doc_id") % 8).cast("string"), F.lit("):\n    def run(self, x):\n"))
    tail = F.concat(F.lit("        return self.step"), d, F.lit("(x)\n    def step"), d, F.lit("(self, x):\n        return x"))
    content = F.concat(head, F.array_join(F.transform("lines", call), ""), tail)
    return lines.select("doc_id", "file", content.alias("content")).withColumn("hash", F.sha1(F.col("content").cast("binary")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct link targets of every page."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(hrefs)).alias("target"))
