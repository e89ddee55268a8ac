"""Where analysed repositories are kept: one Parquet table per kind of row.

Tables are partitioned by repository, and a write replaces the partitions of the
repositories it holds rows for. Small tables that are not about one repository's
history (memories, runs, meta) are written whole. Rows of several tables that belong
together are staged as a batch, and one empty file makes the batch visible.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitloom import schemas
from gitloom.operators.lifecycle import REPO
from gitloom.session import materialise

SCHEMA_VERSION = "1"
CACHE_VARIABLE = "GITLOOM_CACHE_DIR"
HISTORY = ["commits", "commit_parents", "commit_files", "file_versions", "definition_versions"]
BATCHES, PUBLISHED = "batches", "published"


class StoreError(RuntimeError):
    pass


def store_path(root: str) -> str:
    """The store of one repository, named by where it lives."""
    base = os.environ.get(CACHE_VARIABLE) or os.path.expanduser("~/.cache/gitloom")
    return os.path.join(base, hashlib.sha256(os.path.realpath(root).encode()).hexdigest()[:16])


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], schemas.TABLES[table])

    def read(self, table: str) -> DataFrame:
        """The table, or no rows where it was never written. One that cannot be read is an error."""
        paths = [self._path(table)] if self._files().exists(self._at(table)) else []
        batches = self._names(BATCHES, table) & self._names(BATCHES, PUBLISHED)
        paths += [f"{self.base}/{BATCHES}/{table}/{batch}" for batch in sorted(batches)]
        if not paths:
            return self.empty(table)
        return self.spark.read.schema(schemas.TABLES[table]).parquet(*paths)

    def _names(self, *parts: str) -> set[str]:
        """What lies in a folder of the store."""
        if not self._files().exists(self._at(*parts)):
            return set()
        return {status.getPath().getName() for status in self._files().listStatus(self._at(*parts))}

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))

    def _files(self):
        return self._at("meta").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def shaped(self, table: str, frame: DataFrame) -> DataFrame:
        """The table's columns of *frame*, in its order and types."""
        return frame.to(self.empty(table).schema)

    def replace_repositories(self, table: str, frame: DataFrame, repos: DataFrame | None = None) -> None:
        """Replace the partitions *frame* holds rows for, and empty those of other *repos*."""
        shaped = self.shaped(table, frame)
        emptied = []
        if repos is not None:
            # Of the repositories asked for, those that lose all their rows.
            held = self.read(table).select(REPO).distinct().join(repos.select(REPO), REPO, "left_semi")
            emptied = held.join(shaped.select(REPO).distinct(), REPO, "left_anti").collect()
        (
            shaped.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(REPO)
            .parquet(self._path(table))
        )
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in emptied:
            self._files().delete(self._at(table, f"{REPO}={escaped(row[REPO])}"), True)

    def append(self, table: str, frame: DataFrame) -> None:
        writer = self.shaped(table, frame).write.mode("append")
        (writer.partitionBy(REPO) if table in HISTORY else writer).parquet(self._path(table))

    def append_together(self, frames: dict[str, DataFrame]) -> None:
        """Append to several tables so that a reader sees all of the rows or none.

        A job that stops before the last step leaves files nobody reads.
        """
        batch = uuid.uuid4().hex
        for table, frame in frames.items():
            self.shaped(table, frame).write.parquet(f"{self.base}/{BATCHES}/{table}/{batch}")
        self._publish(batch)

    def _publish(self, batch: str) -> None:
        self._files().create(self._at(BATCHES, PUBLISHED, batch), False).close()

    def replace(self, table: str, frame: DataFrame) -> None:
        """Write a table whole; what is read for it is fixed first."""
        fixed = materialise(self.shaped(table, frame), f"replace-{table}")
        fixed.write.mode("overwrite").parquet(self._path(table))

    # ------------------------------------------------------------------ meta

    def meta(self, key: str) -> str | None:
        row = self.read("meta").where(F.col("key") == key).select("value").first()
        return row[0] if row else None

    def set_meta(self, values: dict[str, str], more: DataFrame | None = None) -> None:
        new = self.spark.createDataFrame(list(values.items()), schemas.META)
        if more is not None:
            new = materialise(new.unionByName(more.select("key", "value")), "meta")
        kept = self.read("meta").join(new.select("key"), "key", "left_anti")
        self.replace("meta", kept.unionByName(new))

    def require(self, root: str) -> None:
        """Refuse a store that is missing, of another version, or of another repository."""
        version = self.meta("schema_version")
        if version is None:
            raise StoreError(f"{root} has not been analysed; run analyze first")
        if version != SCHEMA_VERSION:
            raise StoreError(f"the store has schema version {version}, not {SCHEMA_VERSION}; run analyze")
        held = self.meta("repository_root")
        if held != root:
            raise StoreError(f"the store is about {held}, not {root}")

    def violations(self) -> DataFrame:
        """Rows of any table that break its rules."""
        found = [
            schemas.violations(t, self.read(t)).select(F.lit(t).alias("table"), "rule", "key", "rows")
            for t in schemas.KEYS
        ]
        return reduce(DataFrame.unionByName, found)
