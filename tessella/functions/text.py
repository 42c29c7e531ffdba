"""Column functions on text, paths and JSON."""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SNIPPET = 280
EVIDENCE = 80
CODE_CAP, BLOCK_CAP = 6000, 8000
#: Keys under which a tool call may name a path, in order of preference.
PATH_KEYS = ("path", "file_path", "filePath", "file", "filename", "fileName", "target_file", "targetFile", "notebook_path", "notebookPath")
#: Shell commands that only read.
READ_ONLY = ("cat", "head", "tail", "less", "more", "nl", "grep", "rg", "sed", "awk", "od", "hexdump", "xxd", "wc", "diff", "file")


def trim_all(x: Column) -> Column:
    """x without white space (all of Unicode) at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    return F.coalesce(F.length(trim_all(x)) == 0, F.lit(True))


def none_if_blank(x: Column) -> Column:
    y = trim_all(x)
    return F.when(F.length(y) > 0, y)


def snippet(x: Column, size: int = SNIPPET) -> Column:
    """White space collapsed, trimmed, cut to size characters."""
    return F.substring(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), 1, size)


def archive_key(turn: Column) -> Column:
    return F.format_string("turn-%04d", turn)


def session_key(x: Column) -> Column:
    """x with everything but letters, digits, "-", "_" and "." replaced (keys may collide; keep the real one too)."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}\-_.]", "_")


def basename(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


def extension(x: Column) -> Column:
    return F.regexp_extract(basename(x), r"(\.[^.]+)$", 1)


def fence(path: Column) -> Column:
    """The fence language of a file."""
    ext = extension(path)
    out = F.lit("")
    for lang, exts in (("python", (".py",)), ("tsx", (".tsx", ".jsx")), ("typescript", (".ts", ".mts", ".cts")), ("javascript", (".js", ".mjs"))):
        out = F.when(ext.isin(*exts), lang).otherwise(out)
    return out


def lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (1-based, inclusive, clamped), or nothing for an unreadable text."""
    all_lines = F.split(F.coalesce(text, F.lit("")), r"\R")
    start = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(all_lines, start, F.greatest(last - start + 1, F.lit(0))), "\n")


def _string_at(doc: Column, key: str) -> Column:
    value = F.try_variant_get(doc, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", none_if_blank(F.try_variant_get(doc, f"$.{key}", "string")))


def first_string(doc: Column, keys: tuple[str, ...]) -> Column:
    """The first value, in the order of keys, at a top-level key of a JSON object that is a string and not blank.

    The document is parsed once: it is bound as the only element of an array.
    """
    return F.get(F.transform(F.array(F.try_parse_json(doc)), lambda v: F.coalesce(*[_string_at(v, k) for k in keys])), F.lit(0))


def json_string(doc: Column, key: str) -> Column:
    """The value at a top-level key of a JSON object, if it is a string and not blank."""
    return first_string(doc, (key,))


def first_path(doc: Column, extra: tuple[str, ...] = ()) -> Column:
    """The path that a tool call's input names: the first key, in order, with a non-blank string."""
    return first_string(doc, (*PATH_KEYS, *extra))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: the whole, or what stands between the outermost braces; else null."""
    plain = trim_all(F.regexp_replace(text, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.coalesce(*[F.when(c.startswith("{") & F.try_parse_json(c).isNotNull(), c) for c in (plain, inner)])


def looks_like_path(x: Column) -> Column:
    return (F.length(x) > 0) & ~x.startswith("-") & (x.contains("/") | (x.contains(".") & ~x.endswith(".")))


def first_command(x: Column) -> Column:
    """A shell line up to the first of | & ; > <."""
    return trim_all(F.element_at(F.split(x, r"[|&;><]", 2), 1))


@F.pandas_udf(ArrayType(StringType()))
def shell_words(x: pd.Series) -> pd.Series:
    """Words of a shell command, quotes respected; split at white space where quotes don't close."""

    def split(line: str | None) -> list[str]:
        try:
            return shlex.split(line or "")
        except ValueError:
            return (line or "").split()

    return x.map(split, na_action=None)


def read_paths(words: Column) -> Column:
    """Paths among the arguments of a read-only command, given its words; empty for others."""
    reads = (F.size(words) > 0) & basename(F.get(words, F.lit(0))).isin(*READ_ONLY)
    return F.when(reads, F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), looks_like_path)).otherwise(F.array().cast("array<string>"))


def csv_set(x: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(x, ","), trim_all), lambda y: y != ""))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 1e-12 added to each norm."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-12) * (F.sqrt(dot(b, b)) + 1e-12))
