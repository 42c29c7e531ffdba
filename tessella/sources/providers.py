"""Chats in two provider shapes, read into and written from one message shape.

Chats are rows (session, seq, message) with a message as JSON; JSON stays variant inside,
so that nothing of a tool's input is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BLOCK, BLOCK_TYPES, ROLES
from ..operators.turns import message_text

_TEXT_PARTS = ("text", "input_text", "output_text")


def _string(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _block(**fields: Column) -> Column:
    names = [f.split(":")[0] for f in BLOCK[len("struct<") : -1].split(",")]
    kinds = dict(f.split(":") for f in BLOCK[len("struct<") : -1].split(","))
    return F.struct(*[fields.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names])


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def block_message_blocks(message: Column) -> Column:
    """Blocks of a message of the shape {role, content: string | [block]}."""
    content = F.try_variant_get(message, "$.content", "variant")
    parts = F.try_variant_get(message, "$.content", "array<variant>")

    def one(b: Column) -> Column:
        kind = _string(b, "$.type")
        inner = F.try_variant_get(b, "$.content", "array<variant>")
        joined = F.array_join(F.transform(inner, lambda c: F.coalesce(_string(c, "$.text"), F.when(_is_string(c), _string(c, "$")), F.lit(""))), "\n")
        text = lambda path: F.coalesce(_string(b, path), F.lit(""))
        return (
            F.when(_is_string(b), _block(type=F.lit("text"), text=_string(b, "$")))
            .when(kind == "text", _block(type=kind, text=text("$.text")))
            .when(kind == "thinking", _block(type=kind, thinking=text("$.thinking")))
            .when(kind == "tool_use", _block(type=kind, id=text("$.id"), name=text("$.name"), input=F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("{}"))))
            .when(kind == "tool_result", _block(type=kind, tool_use_id=text("$.tool_use_id"), content=F.coalesce(joined, text("$.content")), is_error=F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False))))
            .when(kind == "image", _block(type=kind, source=text("$.source")))
            .otherwise(_block(type=F.lit("text"), text=F.to_json(b)))
        )

    plain = F.array(_block(type=F.lit("text"), text=_string(message, "$.content")))
    return F.when(content.isNull() | _is_string(content), F.when(content.isNull(), F.array(_block(type=F.lit("text"), text=F.lit("")))).otherwise(plain)).otherwise(F.transform(parts, one))


def from_block_chat(chat: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """Messages of chats whose content is text or blocks; systems (session, system) come first, as message -1."""
    m = F.try_parse_json("message")
    role = F.coalesce(_string(m, "$.role"), F.lit("user"))
    out = chat.select("session", "seq", role.alias("role"), block_message_blocks(m).alias("blocks"))
    if systems is not None:
        lead = systems.where(F.length("system") > 0).select("session", F.lit(-1).cast("long").alias("seq"), F.lit("system").alias("role"), F.array(_block(type=F.lit("text"), text=F.col("system"))).alias("blocks"))
        out = lead.unionByName(out)
    return out


def _block_json(b: Column) -> Column:
    out = F.to_json(F.struct(F.lit("text").alias("type"), F.coalesce(b["text"], F.lit("")).alias("text")))
    shapes = {
        "thinking": F.to_json(F.struct(b["type"].alias("type"), b["thinking"].alias("thinking"))),
        "tool_use": F.to_json(F.struct(b["type"].alias("type"), b["id"].alias("id"), b["name"].alias("name"), F.try_parse_json(b["input"]).alias("input"))),
        "tool_result": F.to_json(F.struct(b["type"].alias("type"), b["tool_use_id"].alias("tool_use_id"), b["content"].alias("content"), b["is_error"].alias("is_error"))),
        "image": F.to_json(F.struct(b["type"].alias("type"), b["source"].alias("source"))),
    }
    for kind, shape in shapes.items():
        out = F.when(b["type"] == kind, shape).otherwise(out)
    return out


def to_block_chat(messages: DataFrame) -> DataFrame:
    """(session, seq, message) of messages; leading system messages are one row with seq null and their text joined."""
    from pyspark.sql import Window

    talk = F.sum((F.col("role") != "system").cast("long")).over(Window.partitionBy("session").orderBy("seq"))
    rows = messages.withColumn("talk", talk)
    body = F.concat(F.lit('{"role":'), F.to_json(F.struct("role")).substr(F.lit(9), F.length("role") + 2), F.lit(',"content":['), F.array_join(F.transform("blocks", _block_json), ","), F.lit("]}"))
    rest = rows.where("talk > 0").select("session", "seq", body.alias("message"))
    lead = rows.where("talk = 0").withColumn("line", message_text("blocks")).where(F.length("line") > 0)
    return rest.unionByName(lead.groupBy("session").agg(F.expr("listagg(line, '\\n\\n') WITHIN GROUP (ORDER BY seq)").alias("message")).select("session", F.lit(None).cast("long").alias("seq"), "message"))


def from_function_chat(chat: DataFrame) -> DataFrame:
    """Messages of chats with tool_calls and role "tool"; unknown roles are users, bad arguments are kept as _raw."""
    m = F.try_parse_json("message")
    raw = F.coalesce(_string(m, "$.role"), F.lit("user"))
    content = F.try_variant_get(m, "$.content", "variant")
    text = _string(m, "$.content")
    parts = F.filter(F.try_variant_get(m, "$.content", "array<variant>"), lambda c: _string(c, "$.type").isin(*_TEXT_PARTS))
    none = F.array().cast(f"array<{BLOCK}>")
    texts = (
        F.when(_is_string(content), F.when(F.length(text) > 0, F.array(_block(type=F.lit("text"), text=text))).otherwise(none))
        .otherwise(F.coalesce(F.transform(parts, lambda c: _block(type=F.lit("text"), text=F.coalesce(_string(c, "$.text"), F.lit("")))), none))
    )

    def call(c: Column) -> Column:
        args = F.try_variant_get(c, "$.function.arguments", "variant")
        own = _string(c, "$.function.arguments")
        parsed = F.when(F.try_parse_json(own).isNotNull(), own).otherwise(F.to_json(F.struct(own.alias("_raw"))))
        body = F.when(args.isNull(), "{}").when(_is_string(args), parsed).otherwise(F.to_json(args))
        return _block(type=F.lit("tool_use"), id=F.coalesce(_string(c, "$.id"), F.lit("")), name=F.coalesce(_string(c, "$.function.name"), F.lit("")), input=body)

    calls = F.coalesce(F.transform(F.try_variant_get(m, "$.tool_calls", "array<variant>"), call), none)
    result = F.array(_block(type=F.lit("tool_result"), tool_use_id=F.coalesce(_string(m, "$.tool_call_id"), F.lit("")), content=F.coalesce(text, F.lit("")), is_error=F.lit(False)))
    blocks = F.when(raw == "tool", result).otherwise(F.concat(texts, calls))
    return chat.select("session", "seq", F.when(raw.isin(*ROLES), raw).otherwise("user").alias("role"), blocks.alias("blocks"))


def to_function_chat(messages: DataFrame) -> DataFrame:
    """(session, seq, part, message): each tool result is a message of role "tool", then text and calls, if there are any."""
    results = F.filter("blocks", lambda b: b["type"] == "tool_result")
    texts = F.filter("blocks", lambda b: b["type"] == "text")
    calls = F.filter("blocks", lambda b: b["type"] == "tool_use")
    other = F.exists("blocks", lambda b: b["type"].isin("thinking", "image"))
    answered = F.transform(results, lambda b: F.to_json(F.struct(F.lit("tool").alias("role"), b["tool_use_id"].alias("tool_call_id"), b["content"].alias("content"))))
    shape = lambda b: F.struct(b["id"].alias("id"), F.lit("function").alias("type"), F.struct(b["name"].alias("name"), b["input"].alias("arguments")).alias("function"))
    text = F.when(other, message_text("blocks")).otherwise(F.array_join(F.transform(texts, lambda b: b["text"]), "\n"))
    called = F.when(F.size(calls) > 0, F.transform(calls, shape))
    body = F.to_json(F.struct("role", text.alias("content"), called.alias("tool_calls")))
    whole = F.when((F.size(results) > 0) & (F.size(texts) == 0) & (F.size(calls) == 0) & ~other, answered).otherwise(F.concat(answered, F.array(body)))
    return messages.select("session", "seq", F.posexplode(whole).alias("part", "message"))


def from_event_stream(chunks: DataFrame) -> DataFrame:
    """Assistant messages (stream, role, content, tool_calls) of streamed chunks (stream, at, data).

    Lines may break across chunks; lines that aren't "data:" with JSON are passed over.  Parts
    of a tool call are joined by its index.
    """
    whole = chunks.groupBy("stream").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY at)").alias("body"))
    lines = whole.select("stream", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    lines = lines.withColumn("doc", F.try_parse_json(F.trim(F.regexp_extract(F.trim("line"), r"^data:(.*)$", 1)))).where("doc IS NOT NULL")
    deltas = lines.select("stream", "at", F.explode(F.try_variant_get("doc", "$.choices", "array<variant>")).alias("choice")).select("stream", "at", F.try_variant_get("choice", "$.delta", "variant").alias("d"))
    said = deltas.groupBy("stream").agg(
        F.coalesce(F.max_by(_string(F.col("d"), "$.role"), F.when(F.length(_string(F.col("d"), "$.role")) > 0, F.col("at"))), F.lit("assistant")).alias("role"),
        F.coalesce(F.expr("listagg(try_variant_get(d, '$.content', 'string')) WITHIN GROUP (ORDER BY at)"), F.lit("")).alias("content"),
    )
    calls = deltas.select("stream", "at", F.explode(F.try_variant_get("d", "$.tool_calls", "array<variant>")).alias("c"))
    index = F.coalesce(F.try_variant_get("c", "$.index", "int"), F.lit(0)).alias("index")
    field = lambda path: F.max_by(_string(F.col("c"), path), F.when(F.length(_string(F.col("c"), path)) > 0, F.col("at")))
    joined = calls.groupBy("stream", index).agg(
        field("$.id").alias("id"),
        F.coalesce(field("$.function.name"), F.lit("")).alias("name"),
        F.coalesce(F.expr("listagg(try_variant_get(c, '$.function.arguments', 'string')) WITHIN GROUP (ORDER BY at)"), F.lit("")).alias("arguments"),
    )
    listed = joined.groupBy("stream").agg(F.to_json(F.sort_array(F.collect_list(F.struct("index", "id", "name", "arguments")))).alias("tool_calls"))
    return said.join(listed, "stream", "left")


def unknown_blocks(messages: DataFrame) -> DataFrame:
    """Blocks whose type no reader knows."""
    return messages.select("session", "seq", F.explode("blocks").alias("b")).where(~F.col("b.type").isin(*BLOCK_TYPES))
