"""Versioned tables: readers see the old or the new version, whatever fails in between.

A version's tables are written into a folder of their own, and only then a file named by
the version's number is created, with the folder's name in it. Creating it is the one
step that counts, and it fails if another writer took the number. Folders
without such a file, and files without a readable name, are as if they weren't there.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Versions that ``expire`` leaves.
KEPT = 2


class Conflict(RuntimeError):
    """Another writer has committed the version that this one began from."""


class Snapshots:
    """A folder of versions of one or several tables."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _commits(self) -> list[tuple[int, str, bool]]:
        """Number, folder, and whether the version stands for itself, of each committed version in order."""
        found = []
        for name in self._names("_commits"):
            if not name.isdigit():
                continue
            stream = self._fs.open(self._at(f"_commits/{name}"))
            try:
                said = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
            finally:
                stream.close()
            if len(said) == 2 and said[1] in ("whole", "more") and self._fs.exists(self._at(said[0])):
                found.append((int(name), said[0], said[1] == "whole"))
        return found

    def version(self) -> int:
        """The number of the last version, 0 before the first."""
        commits = self._commits()
        return commits[-1][0] if commits else 0

    def write(self, more: bool = False, after: int | None = None, **tables: DataFrame) -> int:
        """Write a version and return its number.

        With ``more`` its rows come beside those of the versions before it, else it stands for itself. With ``after`` the
        write is refused if the last version isn't that one.
        """
        numbers = [int(n) for n in self._names("_commits") if n.isdigit()]
        number = (numbers[-1] if numbers else 0) + 1 if after is None else after + 1
        folder = f"v{number}-{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(f"{self.path}/{folder}/{name}")
        self._fs.mkdirs(self._at(folder))
        try:
            out = self._fs.create(self._at(f"_commits/{number:010d}"), False)
        except Py4JJavaError as error:
            raise Conflict(f"version {number} of {self.path} is taken") from error
        out.writeBytes(f"{folder} {'more' if more else 'whole'}")
        out.close()
        return number

    def read(self, table: str, schema: StructType | str, version: int | None = None) -> DataFrame:
        """A table as of a version, the last by default; empty if no version has it."""
        commits = [c for c in self._commits() if version is None or c[0] <= version]
        start = max((i for i, c in enumerate(commits) if c[2]), default=0)
        paths = [f"{self.path}/{folder}/{table}" for _, folder, _ in commits[start:] if self._fs.exists(self._at(f"{folder}/{table}"))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def schema(self, table: str) -> StructType:
        """The schema of a table in the last version that has it."""
        for _, folder, _ in reversed(self._commits()):
            if self._fs.exists(self._at(f"{folder}/{table}")):
                return self.spark.read.parquet(f"{self.path}/{folder}/{table}").schema
        raise ValueError(f"no version of {self.path} has {table}")

    def load(self, table: str, schema: StructType | str) -> DataFrame:
        """As ``read``, but empty if what is there can't be read."""
        try:
            found = self.read(table, schema)
            found.limit(1).collect()
            return found
        except (AnalysisException, Py4JJavaError, OSError) as error:
            print(f"{self.path} is not readable, so it counts as empty: {type(error).__name__}")
            return self.spark.createDataFrame([], schema)

    def reset(self, **empty: DataFrame) -> int:
        """A version of empty tables; earlier ones stay readable by number until they expire."""
        return self.write(**{name: table.limit(0) for name, table in empty.items()})

    def expire(self, keep: int = KEPT) -> None:
        """Delete the folders of all but the last ``keep`` versions that stand for themselves, and of those that were never committed.

        To be called when no writer is at work, as a folder that is being written isn't committed yet.
        """
        commits = self._commits()
        whole = [i for i, c in enumerate(commits) if c[2]]
        live = {c[1] for c in commits[whole[-keep] if len(whole) >= keep else 0 :]}
        for name in self._names(""):
            if name.startswith("v") and name not in live:
                self._fs.delete(self._at(name), True)
