"""Tables in folders by bucket, published by versions.

A version is one small file that names the folders of each bucket and the batches applied so far. Writers put new folders
beside the old ones and publish the next version by a rename that fails if that version is there already, so a reader sees
all of a batch or nothing, a writer that broke off leaves only folders that no version names, and of two writers at once one
fails. The rename is atomic on HDFS and local disks; on an object store it is only as atomic as the store's own rename.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The partition column of a bucket's folder, and versions that `vacuum` keeps.
BUCKET, KEPT_VERSIONS = "_bucket", 2


@dataclass(frozen=True)
class Version:
    """folders: by bucket, paths relative to the table. applied: by writer, disjoint ascending ranges of batch numbers."""

    number: int = 0
    folders: dict[int, tuple[str, ...]] = field(default_factory=dict)
    applied: dict[str, tuple[tuple[int, int], ...]] = field(default_factory=dict)
    notes: dict[str, int] = field(default_factory=dict)

    def has(self, writer: str, batch: int) -> bool:
        return any(first <= batch <= last for first, last in self.applied.get(writer, ()))

    def with_batch(self, writer: str, batch: int) -> Version:
        ranges: list[tuple[int, int]] = []
        for first, last in sorted([*self.applied.get(writer, ()), (batch, batch)]):
            if ranges and first <= ranges[-1][1] + 1:
                ranges[-1] = ranges[-1][0], max(last, ranges[-1][1])
            else:
                ranges.append((first, last))
        return replace(self, applied={**self.applied, writer: tuple(ranges)})


class Versioned:
    """The folders and versions of one table at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _at(self, path: str) -> tuple:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def numbers(self) -> list[int]:
        system, where = self._at("versions")
        names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, the newest if no number is given; without one the empty table."""
        known = self.numbers()
        if not known:
            return Version()
        system, where = self._at(f"versions/{known[-1] if number is None else number}")
        stream = system.open(where)
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        said = json.loads(text)
        return Version(said["number"], {int(b): tuple(f) for b, f in said["folders"].items()}, {w: tuple(map(tuple, r)) for w, r in said["applied"].items()}, said["notes"])

    def publish(self, old: Version, new: Version) -> Version:
        """new as the version after old; an error if another writer has published one meanwhile."""
        new = replace(new, number=old.number + 1)
        system, draft = self._at(f"versions/draft-{uuid.uuid4().hex}")
        stream = system.create(draft, False)
        stream.write(json.dumps({"number": new.number, "folders": new.folders, "applied": new.applied, "notes": new.notes}).encode())
        stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(hadoop, "Options$Rename").NONE
        hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, self._at(f"versions/{new.number}")[1], options)
        return new

    def folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def write(self, rows: DataFrame) -> dict[int, tuple[str, ...]]:
        """rows, which have the column _bucket, in a new folder, a subfolder and a file or more for each bucket; their paths."""
        folder = self.folder()
        rows.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        system, where = self._at(folder)
        names = [s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()]
        return {int(n.partition("=")[2]): (f"{folder}/{n}",) for n in names if n.startswith(f"{BUCKET}=")}

    def read(self, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), or of some of its buckets. Without rows the table is a limit of 0, which Spark
        plans as a local relation: for a table of no Python rows it would start a Python worker in every task."""
        version = version or self.version()
        chosen = version.folders if buckets is None else {b: version.folders[b] for b in buckets if b in version.folders}
        paths = [f"{self.path}/{f}" for folders in chosen.values() for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema).limit(0)

    def vacuum(self, keep: int = KEPT_VERSIONS) -> None:
        """Deletes versions but the last `keep`, drafts, and folders that none of those names: what broken-off writers left
        too, so no writer may be at work."""
        known = self.numbers()
        used = {f for n in known[-keep:] for folders in self.version(n).folders.values() for f in folders}
        for number in known[:-keep]:
            self._delete(f"versions/{number}")
        for name in self._names("versions"):
            if name.startswith("draft-"):
                self._delete(f"versions/{name}")
        for name in self._names("data"):
            for inner in self._names(f"data/{name}"):
                if inner.startswith(f"{BUCKET}=") and f"data/{name}/{inner}" not in used:
                    self._delete(f"data/{name}/{inner}")
            if not any(f.startswith(f"data/{name}/") for f in used):
                self._delete(f"data/{name}")

    def _names(self, path: str) -> list[str]:
        system, where = self._at(path)
        return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []

    def _delete(self, path: str) -> None:
        system, where = self._at(path)
        system.delete(where, True)


def values_of(rows: DataFrame, column: str) -> list[int]:
    """The distinct values of a bucket column: no more than there are buckets."""
    return [r[0] for r in rows.select(column).distinct().collect()]
