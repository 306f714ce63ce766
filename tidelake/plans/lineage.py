"""Immutable dataset versions: one Parquet folder per (session, version), published by a catalog entry.

Data is written before its entry, so a failed append leaves nothing visible. Entries are small JSON tables, a folder each; the version's
number is the first that no writer has claimed. Writers may append at the same time."""
from __future__ import annotations

import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import ROW
from ..operators.sketches import changed, merged, sketched
from ..sources.readers import with_row_index

CATALOG = "id string, session_id string, version int, agent_name string, description string, created_at string, path string"


class LineageStore:
    def __init__(self, spark: SparkSession, root: str, profiles: bool = False):
        """profiles: keep a mergeable profile with each version, made when it is written."""
        self.spark, self.root, self.profiles = spark, root.rstrip("/"), profiles

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def versions(self, session: str) -> DataFrame:
        """The session's catalog entries by version."""
        path = f"{self.root}/catalog/{session}"
        df = self.spark.read.schema(CATALOG).option("recursiveFileLookup", True).json(path) if self._exists(path) else self.spark.createDataFrame([], CATALOG)
        return df.orderBy("version")

    def latest_number(self, session: str) -> int:
        return self.versions(session).agg(F.max("version")).first()[0] or 0

    def _claimed(self, session: str, n: int) -> bool:
        """Whether this call made the session's claim on version n: an empty file that one writer only can create."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/{session}/{n}")
        fs = at.getFileSystem(conf)
        fs.mkdirs(at.getParent())
        try:
            if fs.getUri().getScheme() == "file":  # there Hadoop looks before it creates, which isn't one step
                none = self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
                jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(at.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)), none)
            else:
                fs.create(at, False).close()
            return True
        except Exception as e:  # py4j wraps the JVM's
            if "AlreadyExists" in str(e):
                return False
            raise

    def append(self, session: str, df: DataFrame, agent: str, description: str = "") -> int:
        """Publishes df as the next version. Data is written first; then the first free number is claimed, which one writer only gets, and the entry
        published. Writers at the same time so get different versions, in the order of their claims; data that can't be published is removed."""
        ident = uuid.uuid4().hex
        path = f"{self.root}/data/{session}/{ident}"
        try:
            (df if ROW in df.columns else with_row_index(df)).write.parquet(path)
            if self.profiles:
                sketched(self.spark.read.parquet(path)).coalesce(1).write.parquet(f"{self.root}/profiles/{session}/{ident}")
            n = self.latest_number(session) + 1
            while not self._claimed(session, n):
                n += 1
            row = [(ident, session, n, agent, description, datetime.now(UTC).isoformat(), path)]
            self.spark.createDataFrame(row, CATALOG).coalesce(1).write.json(f"{self.root}/catalog/{session}/{n}")
        except Exception:
            for made in (path, f"{self.root}/profiles/{session}/{ident}"):
                at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            raise
        return n

    def append_chunks(self, session: str, chunks: list[DataFrame], agent: str, description: str = "") -> int:
        """Publishes the union of chunks as one version; their columns are matched by name, and a chunk's missing columns are null."""
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chunks)
        return self.append(session, whole, agent, description)

    def append_file(self, session: str, path: str, agent: str, description: str = "") -> int:
        from ..sources.readers import ingest

        return self.append(session, ingest(self.spark, path), agent, description)

    def read(self, session: str, version: int | None = None, ordered: bool = False) -> DataFrame:
        """A version (null: the latest). Its rows carry their index; ordered sorts them by it, for previews and downloads."""
        n = self.latest_number(session) if version is None else version
        found = self.versions(session).where(F.col("version") == n).select("path").first()
        if found is None:
            raise KeyError(f"{session} has no version {n}")
        df = self.spark.read.parquet(found[0])
        return df.orderBy(ROW) if ordered else df

    def profile(self, session: str, *versions: int) -> DataFrame:
        """The profile of the union of versions (none: the latest), from what is kept with them; a version without one is scanned."""
        rows = {r["version"]: r for r in self.versions(session).select("version", "id", "path").collect()}
        wanted = versions or (max(rows, default=0),)
        if lacking := [n for n in wanted if n not in rows]:
            raise KeyError(f"{session} has no version {lacking[0]}")
        parts = []
        for n in wanted:
            kept = f"{self.root}/profiles/{session}/{rows[n]['id']}"
            parts.append(self.spark.read.parquet(kept) if self._exists(kept) else sketched(self.spark.read.parquet(rows[n]["path"])))
        return merged(reduce(DataFrame.unionByName, parts))

    def profile_change(self, session: str, before: int, after: int) -> DataFrame:
        """How each column changed between two versions, read from their profiles."""
        return changed(self.profile(session, before), self.profile(session, after))

    def register_views(self, session: str) -> list[str]:
        """Temporary views v1 .. vN, raw_data (v1), clean_data and dataset (the latest)."""
        rows = self.versions(session).select("version", "path").collect()
        names = []
        for r in rows:
            df = self.spark.read.parquet(r["path"]).drop(ROW)
            also = ["raw_data"] * (r["version"] == 1) + ["clean_data", "dataset"] * (r["version"] == rows[-1]["version"])
            for name in [f"v{r['version']}", *also]:
                df.createOrReplaceTempView(name)
                names.append(name)
        return names


def session_id(session: str | None = None, project: str | None = None, path: str | None = None) -> str:
    """The first of session, project and the path's stem that is a UUID."""
    from pathlib import PurePosixPath

    for x in (session, project, PurePosixPath(path).stem if path else None):
        try:
            return str(uuid.UUID(str(x)))
        except ValueError:
            continue
    raise ValueError("no session id")


def key_difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of before that after lacks, nulls equal to each other: what a deduplication removed altogether."""
    of = lambda df: df.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    return of(before).exceptAll(of(after))


def source_order(spark: SparkSession, path: str) -> list[str]:
    """Column names in the order of a source's header or schema; only that is read."""
    from ..sources.readers import ingest

    return [c for c in ingest(spark, path).columns if c != ROW]


def reorder(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns that exist first, the others after them."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in first + [c for c in df.columns if c not in first]])
