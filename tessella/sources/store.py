"""Tables of archived turns, session state and audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class SessionStore:
    """Archive, state and audit of sessions under one folder, as Parquet (archive, state) and JSON lines (audit).

    The archive is partitioned by session, so that a lookup reads one session's files.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str, form: str = "parquet") -> DataFrame:
        try:
            return self.spark.read.format(form).schema(schema).load(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    ARCHIVE = "archive_key string, turn long, label string, summary string, messages string, session string"
    STATE = "session string, turn_index long, ledger string, live string"
    AUDIT = "session string, event string, at long, detail string"

    def write_archive(self, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in self.ARCHIVE.split(", ")]).write.mode("append").partitionBy("session").parquet(f"{self.root}/archive")

    def archive(self) -> DataFrame:
        return self._read("archive", self.ARCHIVE)

    def keys(self, session: str) -> DataFrame:
        return self.archive().where(F.col("session") == session).select("archive_key").orderBy("archive_key")

    def write_state(self, rows: DataFrame) -> None:
        """Replaces the states of the sessions in rows; a new version is written before the pointer to it."""
        old = self.state().join(rows.select("session"), "session", "left_anti")
        version = rows.sparkSession.sql("SELECT unix_micros(now())").first()[0]
        old.unionByName(rows.select(*old.columns)).write.parquet(f"{self.root}/state/v{version:020d}")

    def state(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state/*/_SUCCESS")
        complete = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        versions = [s.getPath().getParent().toString() for s in complete]
        if not versions:
            return self.spark.createDataFrame([], self.STATE)
        return self.spark.read.schema(self.STATE).parquet(max(versions))

    def append_audit(self, rows: DataFrame) -> None:
        rows.write.mode("append").json(f"{self.root}/audit")

    def audit(self) -> DataFrame:
        return self._read("audit", self.AUDIT, "json")

    def fork(self, source: str, target: str) -> None:
        """Copies a session; an absent source or a present target is an error."""
        state = self.state()
        here = {r[0] for r in state.where(F.col("session").isin(source, target)).select("session").distinct().collect()}
        if source not in here:
            raise KeyError(f"no session {source!r}")
        if target in here:
            raise ValueError(f"session {target!r} exists")
        self.write_archive(self.archive().where(F.col("session") == source).withColumn("session", F.lit(target)))
        self.write_state(state.where(F.col("session") == source).withColumn("session", F.lit(target)))
