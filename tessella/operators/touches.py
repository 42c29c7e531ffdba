"""Files that tool calls read or write, and the ledger of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import EVIDENCE, first_command, first_path, json_string, none_if_blank, read_paths, shell_words

#: Names of tools that write, read, or run a shell.
WRITE_TOOLS = ("str_replace_editor", "str_replace_based_edit_tool", "edit", "apply_patch", "patch", "write", "write_file", "create", "notebook_edit", "multiedit")
READ_TOOLS = ("read", "read_file", "open", "view", "cat_file", "view_image", "read_image")
SHELL_TOOLS = ("bash", "shell", "run", "run_command", "execute", "sh", "terminal")


def tool_kind(name, write=(), read=(), shell=()):
    """write, read or shell by tool name (any case), in this order of precedence; null for other tools."""
    low = F.lower(name)
    names = lambda own, extra: [*own, *(x.lower() for x in extra)]
    return F.when(low.isin(*names(WRITE_TOOLS, write)), "write").when(low.isin(*names(READ_TOOLS, read)), "read").when(low.isin(*names(SHELL_TOOLS, shell)), "shell")


def detect(calls: DataFrame, *, write: tuple[str, ...] = (), read: tuple[str, ...] = (), shell: tuple[str, ...] = (), path_keys: tuple[str, ...] = ()) -> DataFrame:
    """Touches (session, turn, seq, place, path, kind, evidence) of tool calls (session, turn, seq, name, input).

    input is JSON.  Only shell calls pass through Python, for their quotes.
    """
    kinds = calls.withColumn("tool", tool_kind(F.col("name"), write, read, shell)).where("tool IS NOT NULL")
    cols = ("session", "turn", "seq")
    direct = kinds.where("tool <> 'shell'").select(*cols, F.lit(0).alias("place"), first_path(F.col("input"), path_keys).alias("path"), F.col("tool").alias("kind"), F.col("name").alias("evidence"))
    listed = F.array_join(F.try_variant_get(F.try_parse_json("input"), "$.command", "array<string>"), " ")
    line = F.coalesce(json_string(F.col("input"), "command"), listed, json_string(F.col("input"), "cmd"))
    commands = kinds.where("tool = 'shell'").select(*cols, line.alias("command")).where("command IS NOT NULL")
    words = commands.withColumn("words", shell_words(first_command(F.col("command"))))
    shelled = words.select(*cols, F.posexplode(read_paths(F.col("words"))).alias("place", "path"), F.lit("read").alias("kind"), F.substring("command", 1, EVIDENCE).alias("evidence"))
    return direct.where("path IS NOT NULL").unionByName(shelled)


def ledger(touches: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """One row for each session and path: first and last turn, reads, writes, description."""
    out = touches.groupBy("session", "path").agg(
        F.min("turn").alias("first_seen_turn"),
        F.max("turn").alias("last_touched_turn"),
        F.count_if(F.col("kind") != "write").alias("reads"),
        F.count_if(F.col("kind") == "write").alias("writes"),
    )
    if descriptions is None:
        return out.withColumn("description", F.lit(""))
    return out.join(descriptions, ["session", "path"], "left").withColumn("description", F.coalesce("description", F.lit("")))


def merge_ledgers(prior: DataFrame, now: DataFrame) -> DataFrame:
    """Counts of two ledgers together; the later description counts if it isn't blank."""
    both = prior.withColumn("age", F.lit(0)).unionByName(now.withColumn("age", F.lit(1)))
    return both.groupBy("session", "path").agg(
        F.min("first_seen_turn").alias("first_seen_turn"),
        F.max("last_touched_turn").alias("last_touched_turn"),
        F.sum("reads").alias("reads"),
        F.sum("writes").alias("writes"),
        F.coalesce(F.max_by("description", F.when(none_if_blank(F.col("description")).isNotNull(), F.col("age"))), F.lit("")).alias("description"),
    )


def refine(own: DataFrame, refined: DataFrame) -> DataFrame:
    """Ledger rows with refined descriptions (session, path, refined) where these aren't blank."""
    return own.join(refined, ["session", "path"], "left").withColumn("description", F.coalesce(none_if_blank(F.col("refined")), F.col("description"))).drop("refined")


def evidence(touches: DataFrame) -> DataFrame:
    """Paths of each session and turn in order of first touch, with what was done to them."""
    rows = touches.withColumn("line", F.concat("kind", F.lit(" ("), "evidence", F.lit(")"))).withColumn("at", F.col("seq") * 1000 + F.col("place"))
    return rows.groupBy("session", "turn", "path").agg(F.min("at").alias("first_at"), F.expr("listagg(line, '; ') WITHIN GROUP (ORDER BY at)").alias("evidence"))


def rendered(own: DataFrame) -> DataFrame:
    """One text for each session, a line for each path in order."""
    line = F.concat(F.lit("- "), "path", F.lit(" — "), F.coalesce(none_if_blank(F.col("description")), F.lit("(no description yet)")), F.format_string("  [r%d/w%d]", "reads", "writes"))
    rows = own.withColumn("line", line).groupBy("session").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY path)").alias("body"))
    return rows.select("session", F.concat(F.lit("File ledger (files the agent has touched):\n"), "body").alias("text"))


def allowed_tools(tools: DataFrame, allow: tuple[str, ...] = (), deny: tuple[str, ...] = ("glob",)) -> DataFrame:
    """Tools (JSON in `tool`) by name: those allowed, or if none are named those not denied."""
    doc = F.try_parse_json("tool")
    name = F.coalesce(F.try_variant_get(doc, "$.function.name", "string"), F.try_variant_get(doc, "$.name", "string"))
    rows = tools.withColumn("name", name)
    if allow:
        return rows.where(F.col("name").isin(*allow))
    return rows.where(~F.coalesce(F.col("name").isin(*deny), F.lit(False))) if deny else rows


def tool_choice(requests: DataFrame, tools: DataFrame) -> DataFrame:
    """requests (request, choice) with the choice reset to auto where its tool (request, name) is gone."""
    kept = tools.select("request", F.col("name").alias("choice"), F.lit(True).alias("kept")).distinct()
    general = F.col("choice").isin("auto", "none", "required") | F.col("choice").isNull()
    return requests.join(kept, ["request", "choice"], "left").select("request", F.when(general | F.col("kept"), F.col("choice")).otherwise("auto").alias("choice"))
