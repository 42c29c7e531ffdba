"""A store of several tables that change together: versions of data, each made visible by one pointer written last.

Layout under the root: data/<unique>/<table> holds Parquet, commits/<number>.json is a version.  A
version names the place of each of its tables, so a table that a commit doesn't touch is carried
over, not copied.  Tables are written first, the manifest last of them, and the pointer after all;
it is created only where none of its number exists, so of two writers with one base one fails.
Readers hold a version number and see its tables whatever is committed later; data without a
pointer, and a pointer cut short, are as if they weren't there.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version that follows the base."""


class SnapshotStore:
    LAST = "manifest"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _pointer(self, version: int) -> dict | None:
        path, fs = self._path(f"commits/{version:012d}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}\n") else None

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("commits") if n.endswith(".json")]

    def versions(self) -> list[int]:
        """Numbers of the committed versions, in order."""
        return [n for n in self._numbers() if self._pointer(n) is not None]

    def latest(self) -> int | None:
        return next((n for n in reversed(self._numbers()) if self._pointer(n) is not None), None)

    def exists(self) -> bool:
        """Whether anything was ever committed."""
        return self.latest() is not None

    def note(self, version: int) -> dict:
        """What the writer of a version has noted with it."""
        return self._pointer(version)["note"]

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of a version, of the latest if none is named; none of an empty store."""
        version = self.latest() if version is None else version
        pointer = None if version is None else self._pointer(version)
        if version is not None and pointer is None:
            raise KeyError(f"version {version} isn't committed")
        return {name: self.spark.read.parquet(f"{self.root}/{place}") for name, place in (pointer or {"tables": {}})["tables"].items()}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.tables(version)[table]

    def commit(self, tables: dict[str, DataFrame], *, base: int | None = None, note: dict | None = None) -> int:
        """Writes tables and makes them, with what else the base holds, the version after the base; returns its number.

        The base is the version that the tables were made from, none for the first; an old one is a Conflict.
        """
        numbers = self._numbers()
        if base is None and numbers and self.latest() is not None:
            raise Conflict("the store has versions; name the one that the tables were made from")
        if base is not None and self.latest() != base:
            raise Conflict(f"version {base} isn't the latest")
        places = dict(self._pointer(base)["tables"]) if base is not None else {}
        unique = uuid.uuid4().hex
        for name in sorted(tables, key=lambda n: (n == self.LAST, n)):
            places[name] = f"data/{unique}/{name}"
            tables[name].write.parquet(f"{self.root}/{places[name]}")
        version = max(numbers, default=0) + 1  # a pointer that was cut short keeps its number
        path, fs = self._path(f"commits/{version:012d}.json")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} was committed meanwhile") from None
            raise
        out.write(bytearray(json.dumps({"tables": places, "note": note or {}}).encode() + b"\n"))
        out.close()
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Deletes versions before the last `keep`, and data that no version left names.  No writer may be at work."""
        kept = self.versions()[-keep:]
        used = {place.split("/")[1] for n in kept for place in self._pointer(n)["tables"].values()}
        for folder, names, own in (("commits", self._names("commits"), {f"{n:012d}.json" for n in kept}), ("data", self._names("data"), used)):
            for n in names:
                if n not in own and not n.startswith("."):
                    path, fs = self._path(f"{folder}/{n}")
                    fs.delete(path, True)
