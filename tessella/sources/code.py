"""Source trees: which files count, their snapshots, and entities and edges parsed from them."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename

#: Extensions of source files and their languages.
LANGUAGES = {".py": "python", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "tsx", ".mjs": "javascript"}
#: Folders that hold no code of the project.
SKIPPED_FOLDERS = (
    ".git", ".hg", ".svn", "__pycache__", "venv", ".venv", "env", ".env", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".hypothesis",
    "site-packages", ".eggs", "node_modules", "bower_components", ".pnpm-store", ".yarn", ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache",
    "dist", "build", "out", "target", "vendor", "coverage", ".coverage", ".cache", ".gradle", ".idea", ".vscode", ".DS_Store",
)
#: Endings of generated files.
GENERATED = (".min.js", ".min.ts", ".min.mjs", ".min.cjs", ".bundle.js", ".d.ts")


def size_limit(raw: str | None, default_kb: int = 512) -> int:
    """Bytes that a source file may have; a bad number means the default, the least is 1 KB."""
    try:
        return max(1, int(raw)) * 1024 if raw is not None else default_kb * 1024
    except ValueError:
        return default_kb * 1024


def skipped_folder(name: Column, extra: tuple[str, ...] = ()) -> Column:
    return name.isin(*SKIPPED_FOLDERS, *extra) | name.startswith(".") | name.endswith(".egg-info")


def is_source(path: Column, length: Column, *, limit: int = 512 * 1024, extra: tuple[str, ...] = ()) -> Column:
    """Whether a path (relative to the root) is a source file outside of skipped folders and within the size limit."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    known = F.regexp_extract(basename(path), r"(\.[^.]+)$", 1).isin(*LANGUAGES)
    generated = F.lit(False)
    for end in GENERATED:
        generated = generated | F.lower(path).endswith(end)
    return known & ~generated & (length <= limit) & ~F.exists(folders, lambda f: skipped_folder(f, extra))


def language(path: Column, languages: tuple[str, ...] = ("python", "typescript")) -> Column:
    """The language of a file that is parsed: one of languages; tsx always, others never."""
    lang = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[F.regexp_extract(basename(path), r"(\.[^.]+)$", 1)]
    return F.when(lang.isin(*languages, "tsx"), lang)


def scan(spark: SparkSession, root: str, *, limit: int = 512 * 1024, extra: tuple[str, ...] = ()) -> DataFrame:
    """(file, content, hash, mtime) of the source files under root; size is pushed to the file listing."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= limit)
    home = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace(F.element_at(F.split("path", F.lit(home.replace(".", "\\.") + "/"), 2), -1), "^/+", "")
    rows = rows.withColumn("file", relative).where(is_source(F.col("file"), F.col("length"), limit=limit, extra=extra))
    return rows.select("file", F.decode("content", "UTF-8").alias("content"), F.sha1("content").alias("hash"), F.col("modificationTime").alias("mtime"))


def codebase_key(root: str) -> str:
    return hashlib.sha1(root.encode()).hexdigest()


class _Source:
    """A file's bytes with the places of its lines, as the parser counts them."""

    def __init__(self, content: str):
        self.raw = content.encode("utf-8", "replace")
        self.lines = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", self.raw))]

    def place(self, line: int, column: int) -> int:
        return self.lines[line - 1] + column

    def text(self, start: int, end: int) -> str:
        return self.raw[start:end].decode("utf-8", "replace")

    def of(self, node: ast.AST) -> str:
        return self.text(self.place(node.lineno, node.col_offset), self.place(node.end_lineno, node.end_col_offset))


def _header(node: ast.AST, source: _Source) -> str:
    """The first three lines of what stands before the body."""
    first = node.body[0]
    line, column = min((x.lineno, x.col_offset) for x in [first, *getattr(first, "decorator_list", [])])
    if getattr(first, "decorator_list", None):
        column = source.raw[: source.place(line, column)].rfind(b"@") - source.lines[line - 1]
    return "\n".join(source.text(source.place(node.lineno, node.col_offset), source.place(line, column)).strip().splitlines()[:3])


def _called(node: ast.AST, source: _Source) -> list[str]:
    """Names called in a definition, nested ones included, but not in its own decorators."""
    out, left = [], [x for x in ast.iter_child_nodes(node) if x not in getattr(node, "decorator_list", [])][::-1]
    while left:
        x = left.pop()
        if isinstance(x, ast.Call) and (name := source.of(x.func).split(".")[-1].split("(")[0].strip()):
            out.append(name)
        left += [*ast.iter_child_nodes(x)][::-1]
    return out


def python_entities(file: str, content: str) -> list[dict]:
    """The classes, functions and methods of a Python file; nothing for one that doesn't parse.

    Ids are file::qualified.name, qualified by classes only; what is defined anywhere inside a
    class but isn't a class is a method.  A class's calls include those of its methods; repeated
    calls are kept.  Code and header leave decorators out.
    """
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    source, out = _Source(content), []

    def visit(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                visit(child, owner)
                continue
            qual = f"{owner}.{child.name}" if owner else child.name
            is_class = isinstance(child, ast.ClassDef)
            bases = [source.of(x).split(".")[-1].strip() for x in sorted([*child.bases, *child.keywords], key=lambda x: (x.lineno, x.col_offset))] if is_class else []
            out.append({
                "node_id": f"{file}::{qual}", "kind": "class" if is_class else "method" if owner else "function", "file": file, "name": child.name,
                "span_start": child.lineno, "span_end": child.end_lineno, "code_hash": hashlib.sha1(source.of(child).encode()).hexdigest(),
                "signature": _header(child, source), "bases": bases, "calls": _called(child, source),
            })
            visit(child, qual if is_class else owner)

    visit(tree, "")
    return out


ENTITIES = "node_id string, kind string, file string, name string, span_start int, span_end int, code_hash string, signature string, bases array<string>, calls array<string>"


def parse(files: DataFrame) -> DataFrame:
    """Entities of files (file, content); the last of equal ids counts.  Python is parsed here; other languages need a parser of their own."""
    fields = [c.split()[0] for c in ENTITIES.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.list_(pa.string())] * 2

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):  # few files' entities at a time
                part, last = b.slice(i, 256), {}
                for file, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for e in python_entities(file, content or ""):
                        last[e["node_id"]] = e
                rows = list(last.values())
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], k) for f, k in zip(fields, kinds, strict=True)], names=fields)

    return files.where(language(F.col("file")) == "python").select("file", "content").mapInArrow(apply, ENTITIES)
