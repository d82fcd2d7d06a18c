"""Where tables live: immutable Parquet layers, and one manifest for each revision.

A revision is published by putting its whole manifest in its place, which fails
if another writer was first; nothing that a reader has open is ever overwritten,
and no reader sees a part of a file.  This needs a file system that renames in
one step and not over another file (local ones, HDFS); on a store of objects
without that, a database must have one writer at a time.  All access goes
through Spark's file systems, so the location may be any that Spark can reach.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError
from .catalog import Catalog, Step, TableDef, quoted, read_step, read_table

#: A first layer so many times as large as all later ones together is not written anew with them.
LARGER = 4


class Store:
    def __init__(self, spark: SparkSession, location: str | None = None):
        self.spark = spark
        self.temporary = location is None
        if location is None:
            shared = spark.conf.get("spark.checkpoint.dir", None)
            if not shared and not spark.sparkContext.master.startswith("local"):
                raise EngineError("INVALID_LOCATION", "a cluster has no folder of its own for a temporary database: name a location, or set spark.checkpoint.dir")
            location = f"{shared.rstrip('/')}/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="relforge-")
        self.location = location.rstrip("/")
        self._jvm = spark._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.location).getFileSystem(spark._jsc.hadoopConfiguration())

    # Files

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Put a new file in its place, whole; False if there is one."""
        target, staged = self._path(path), self._path(f"{self.location}/_staged/{uuid.uuid4().hex}")
        stream = self._fs.create(staged, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self._fs.mkdirs(target.getParent())
            if self._fs.getScheme() == "file":  # whose rename replaces what is there; a link doesn't
                os.link(staged.toUri().getPath(), target.toUri().getPath())
            else:
                hadoop = self._jvm.org.apache.hadoop.fs
                kinds = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
                hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, target, kinds)
        except FileExistsError:
            return False
        except Exception as error:  # noqa: BLE001  the file system's own error for a file that exists
            if "AlreadyExists" in str(error):
                return False
            raise
        finally:
            if self._fs.exists(staged):
                self._fs.delete(staged, False)
        return True

    def _manifest(self, revision: int) -> str:
        return f"{self.location}/_manifests/{revision:016d}.json"

    # Revisions

    def latest(self) -> tuple[int, Catalog]:
        """The newest revision and its definitions; 0 and none where nothing was published."""
        folder = self._path(f"{self.location}/_manifests")
        if not self._fs.exists(folder):
            return 0, Catalog()
        numbers = [int(f.getPath().getName()[:16]) for f in self._fs.listStatus(folder) if f.getPath().getName()[:16].isdigit()]
        if not numbers:
            return 0, Catalog()
        for revision in sorted(numbers, reverse=True):  # a torn manifest never was a revision
            if (catalog := self._whole(revision)) is not None:
                return revision, catalog
        raise EngineError("RECOVERY_REQUIRED", "no manifest is complete")

    def _whole(self, revision: int) -> Catalog | None:
        try:
            return Catalog.from_json(json.loads(self._read(self._manifest(revision))))
        except (ValueError, KeyError, TypeError):
            return None

    def publish(self, base: int, catalog: Catalog, changes: list[dict]) -> int:
        """Make `catalog` the revision after `base`; WRITE_CONFLICT if another writer was first."""
        revision = base + 1
        while self._fs.exists(self._path(self._manifest(revision))) and self._whole(revision) is None:
            revision += 1
        if not self._create(self._manifest(revision), json.dumps(catalog.as_json())):
            raise EngineError("WRITE_CONFLICT", f"revision {revision} was published by another writer")
        if changes:
            lines = "\n".join(json.dumps({"revision": revision, "table": c["table"], "keys": None if c["keys"] is None else json.dumps(c["keys"])}) for c in changes)
            self._create(f"{self.location}/_changes/{revision:016d}.json", lines + "\n")
        return revision

    # Layers

    def write(self, df: DataFrame, by: Sequence[str] = (), ranged: bool = False) -> str:
        """A new layer of the rows, sorted in its files by the columns `by`; if `ranged`, each file also has a range of them of its own.

        So a filter on those columns skips row groups, or whole files, by their least and greatest values.
        """
        path = f"{self.location}/layers/{uuid.uuid4().hex}"
        columns = [quoted(c) for c in by]
        if columns:
            df = (df.repartitionByRange(*columns) if ranged else df).sortWithinPartitions(*columns)
        df.write.parquet(path)
        return path

    def _bytes(self, step: Step) -> int:
        return self._fs.getContentSummary(self._path(step.path)).getLength()

    def compacted(self, table: TableDef, most: int, by: Sequence[str] = ()) -> TableDef:
        """The table in few layers, sorted by the columns `by`, if it has more than `most`.

        Where the first layer is by far the largest it stays, and the others
        become two: all keys that they take out, and the rows that they leave;
        else all become one.
        """
        if len(table.steps) <= most:
            return table
        from dataclasses import replace

        first, *rest = table.steps
        if first.kind == "put" and LARGER * sum(map(self._bytes, rest)) < self._bytes(first):
            takes = [read_step(self.spark, table, step) for step in rest if step.kind == "take"]
            steps = [first]
            if takes:
                keys = takes[0]
                for more in takes[1:]:
                    keys = keys.unionByName(more)
                steps.append(Step("take", self.write(keys.distinct())))
            if any(step.kind == "put" for step in rest):
                steps.append(Step("put", self.write(read_table(self.spark, replace(table, steps=tuple(rest))), by)))
            return replace(table, steps=tuple(steps))
        return replace(table, steps=(Step("put", self.write(read_table(self.spark, table), by, ranged=True)),))

    def vacuum(self, catalog: Catalog, older_than: float) -> int:
        """Delete layers that `catalog` does not use and that are older than so many seconds; how many went."""
        folder = self._path(f"{self.location}/layers")
        if not self._fs.exists(folder):
            return 0
        used = {step.path.rpartition("/")[2] for table in catalog.tables.values() for step in table.steps}
        before, gone = (time.time() - older_than) * 1000, 0
        for found in self._fs.listStatus(folder):
            if found.getPath().getName() not in used and found.getModificationTime() < before:
                gone += bool(self._fs.delete(found.getPath(), True))
        return gone

    def remove(self) -> None:
        self._fs.delete(self._path(self.location), True)
