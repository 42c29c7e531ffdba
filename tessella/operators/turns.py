"""Turns, buckets, recency windows and assembled histories of ordered messages.

Messages are rows (session, seq, role, text); a turn begins with each user message.  The
windows of one session share one shuffle; running counts stream, so a long session costs
memory only for the maxima of its partition, which Spark spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import archive_key, blank, snippet

LISTED = "listagg(line, '\\n\\n') WITHIN GROUP (ORDER BY seq)"


def segment(messages: DataFrame, *, most_pinned: int = 4) -> DataFrame:
    """messages with turn (running count of user messages), last_user, and bucket pinned, done or live."""
    in_order = Window.partitionBy("session").orderBy("seq")
    whole = Window.partitionBy("session")
    user = (F.col("role") == "user").cast("long")
    marked = messages.select(
        "*",
        F.sum(user).over(in_order).alias("turn"),
        F.sum((F.col("role") != "system").cast("long")).over(in_order).alias("talk"),
        F.row_number().over(in_order).alias("place"),
        F.coalesce(F.max(F.when(F.col("role") == "user", F.col("seq"))).over(whole), F.lit(0)).alias("last_user"),
    )
    pinned = (F.col("talk") == 0) & (F.col("place") <= most_pinned)
    bucket = F.when(pinned, "pinned").when(F.col("seq") >= F.col("last_user"), "live").otherwise("done")
    return marked.withColumn("bucket", bucket).drop("talk", "place")


def classify(messages: DataFrame, *, most_pinned: int = 4) -> DataFrame:
    """bucket of tagged messages (kind may be pinned, summary, full_turn or file_ledger): by tag, pinned first; the rest is new activity."""
    in_order = Window.partitionBy("session").orderBy("seq")
    leads = F.sum(((F.col("role") != "system") | F.coalesce("kind", F.lit("")).isin("summary", "full_turn", "file_ledger")).cast("long")).over(in_order) == 0
    pinned = (F.col("kind") == "pinned") | (leads & (F.row_number().over(in_order) <= most_pinned))
    tagged = F.when(F.col("kind").isin("summary", "full_turn", "file_ledger"), F.col("kind")).otherwise("new_activity")
    return messages.withColumn("bucket", F.when(F.coalesce(pinned, F.lit(False)), "pinned").otherwise(tagged))


def bucket_counts(messages: DataFrame, buckets: list[str]) -> DataFrame:
    """One row for each session with the rows of each bucket."""
    return messages.groupBy("session").pivot("bucket", buckets).agg(F.count(F.lit(1))).na.fill(0, buckets)


def transcripts(messages: DataFrame, *keys: str) -> DataFrame:
    """"[role] text" of the non-blank messages of each group, in order, with an empty line between."""
    line = F.when(~blank(F.col("text")), F.concat(F.lit("["), "role", F.lit("] "), "text"))
    return messages.withColumn("line", line).groupBy(*keys).agg(F.coalesce(F.expr(LISTED), F.lit("")).alias("transcript"), F.min("seq").alias("seq"))


def summaries(done: DataFrame) -> DataFrame:
    """One row for each finished turn: snippet of its transcript, archive key, and the rendered summary."""
    rows = transcripts(done, "session", "turn").withColumn("snippet", snippet(F.col("transcript")))
    key = archive_key(F.col("turn"))
    return rows.select("session", "turn", "seq", "snippet", key.alias("archive_key"), F.concat(F.lit("[turn] "), "snippet", F.lit(" (recall: "), key, F.lit(")")).alias("summary"))


def token_estimate(rows: DataFrame, *keys: str) -> DataFrame:
    """A quarter of the characters of each group, rounded down after summing."""
    return rows.groupBy(*keys).agg(F.floor(F.coalesce(F.sum(F.length("text")), F.lit(0)) / 4).cast("long").alias("tokens"))


def recency(marked: DataFrame, size: int) -> DataFrame:
    """Finished turns in one form each: the last `size` as they are, older ones as their summary."""
    done = marked.where("bucket = 'done'")
    now = F.max("turn").over(Window.partitionBy("session"))
    done = done.withColumn("recent", F.col("turn") > now - size)
    full = done.where("recent").select("session", F.lit("full_turn").alias("kind"), "turn", "seq", "role", "text")
    old = summaries(done.where("NOT recent")).select("session", F.lit("summary").alias("kind"), "turn", "seq", F.lit("assistant").alias("role"), F.col("summary").alias("text"))
    return full.unionByName(old)


def demote(reps: DataFrame, size: int) -> DataFrame:
    """Tagged turns (summary and full_turn rows) in one form each.

    The last summary of a turn counts, and a full turn outranks it; full turns that are no
    longer recent become the summary that their first message carries.
    """
    reps = reps.withColumn("turn", F.coalesce("turn", F.lit(0)))
    turn = Window.partitionBy("session", "turn")
    has_full = F.max((F.col("kind") == "full_turn").cast("int")).over(turn) == 1
    now = F.max("turn").over(Window.partitionBy("session"))
    first = F.row_number().over(turn.orderBy(F.col("kind"), "seq"))
    last = F.row_number().over(turn.orderBy(F.col("kind"), F.col("seq").desc()))
    rows = reps.select("*", has_full.alias("has_full"), (F.col("turn") > now - size).alias("recent"), first.alias("first"), last.alias("last"))
    full = rows.where("has_full AND kind = 'full_turn' AND recent").select("session", "turn", "seq", F.lit("full_turn").alias("kind"), "text")
    old = rows.where("has_full AND kind = 'full_turn' AND NOT recent AND first = 1").select("session", "turn", "seq", F.lit("summary").alias("kind"), F.col("summary").alias("text"))
    plain = rows.where("NOT has_full AND kind = 'summary' AND last = 1").select("session", "turn", "seq", F.lit("summary").alias("kind"), "text")
    return full.unionAll(old).unionAll(plain)


def assemble(marked: DataFrame, body: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Pinned rows, the body by turn, the ledger, live rows: each with its section number."""
    part = lambda name, n: marked.where(F.col("bucket") == name).select("session", F.lit(name).alias("kind"), F.lit(n).alias("section"), "turn", "seq", "role", "text")
    out = part("pinned", 0).unionByName(body.withColumn("section", F.lit(1))).unionByName(part("live", 3))
    if ledger is not None:
        out = out.unionByName(ledger.select("session", F.lit("file_ledger").alias("kind"), F.lit(2).alias("section"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("seq"), F.lit("assistant").alias("role"), "text"))
    return out


def compact(messages: DataFrame, size: int, ledger: DataFrame | None = None) -> DataFrame:
    """The compacted history of every session."""
    marked = segment(messages)
    return assemble(marked, recency(marked, size), ledger)


def kept_blocks(blocks):
    """The blocks of a full turn: text that isn't blank, tool calls and results; no images, no thinking."""
    return F.filter(blocks, lambda b: ((b["type"] == "text") & ~blank(b["text"])) | b["type"].isin("tool_use", "tool_result"))


def full_turns(messages: DataFrame) -> DataFrame:
    """Messages with the blocks that a full turn keeps; messages left empty go, the first of a turn is marked as its head."""
    rows = messages.withColumn("blocks", kept_blocks("blocks")).where(F.size("blocks") > 0)
    return rows.withColumn("head", F.row_number().over(Window.partitionBy("session", "turn").orderBy("seq")) == 1)


def block_text(b):
    """A block as plain text."""
    return (
        F.when(b["type"] == "text", b["text"])
        .when(b["type"] == "thinking", b["thinking"])
        .when(b["type"] == "tool_use", F.concat(b["name"], F.lit("("), b["input"], F.lit(")")))
        .when(b["type"] == "tool_result", b["content"])
        .when(b["type"] == "image", F.concat(F.lit("[image "), b["source"], F.lit("]")))
    )


def message_text(blocks):
    return F.array_join(F.transform(blocks, block_text), "\n")


def fresh(messages: DataFrame, folded: DataFrame) -> DataFrame:
    """Messages at or after each session's fold pointer (session, folded); a session without one is all fresh."""
    return messages.join(folded, "session", "left").where(F.col("seq") >= F.coalesce("folded", F.lit(0))).drop("folded")
