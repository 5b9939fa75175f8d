"""A table in versioned folders behind numbered pointers: readers see one version whole.

``root/data/<name>`` holds a version's files, ``root/pointers/<number>`` names
the folder of a version. A version is published by creating its pointer, which
only one writer can do; a pointer without its closing line end is one whose
writer has not finished (or died), and readers pass over it. So a reader sees
the old or the new version, a failed write leaves the old one, and of two
writers that started from one version the second is told so.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# A pointer that stays unfinished for longer than this belongs to a dead writer.
DEAD_AFTER_S = 600


class Conflict(RuntimeError):
    """Somebody else published, or is publishing, the version that a write meant to be."""


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that the session reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


class VersionedFolder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, version: int) -> str:
        return f"{self.root}/pointers/{version:012d}"

    def _pointers(self) -> dict[int, object]:
        """The status of every pointer file by its number."""
        fs, folder = file_system(self.spark, f"{self.root}/pointers")
        if not fs.exists(folder):
            return {}
        return {int(s.getPath().getName()): s for s in fs.listStatus(folder) if s.getPath().getName().isdigit()}

    def _named(self, version: int) -> str | None:
        """The folder that a pointer names; None while it is unfinished."""
        fs, p = file_system(self.spark, self._pointer(version))
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return f"{self.root}/data/{text[:-1]}" if text.endswith("\n") else None

    def current(self) -> tuple[int, str] | None:
        """(number, folder) of the last published version."""
        for version in sorted(self._pointers(), reverse=True):
            folder = self._named(version)
            if folder:
                return version, folder
        return None

    def read(self) -> DataFrame | None:
        at = self.current()
        return None if at is None else self.spark.read.parquet(at[1])

    def next_version(self) -> int:
        """The number for a write that starts from the current version."""
        at, pointers = self.current(), self._pointers()
        fresh = [v for v, s in pointers.items() if v > (at[0] if at else -1)
                 and time.time() - s.getModificationTime() / 1000 < DEAD_AFTER_S]
        if fresh:
            raise Conflict(f"version {max(fresh)} of {self.root} is being published")
        return max(pointers, default=0) + 1

    def publish(self, df: DataFrame, version: int) -> str:
        """Write ``df`` and make it ``version``; raises ``Conflict`` if that number is taken."""
        name = f"{version}-{uuid.uuid4().hex}"
        folder = f"{self.root}/data/{name}"
        df.write.parquet(folder)
        fs, pointer = file_system(self.spark, self._pointer(version))
        fs.mkdirs(pointer.getParent())
        taken = self.spark._jvm.org.apache.hadoop.fs.FileAlreadyExistsException
        try:
            stream = None if fs.exists(pointer) else fs.create(pointer, False)
        except Exception as e:
            if taken.__name__ not in str(e) and not fs.exists(pointer):
                raise
            stream = None
        if stream is None:
            fs.delete(file_system(self.spark, folder)[1], True)
            raise Conflict(f"version {version} of {self.root} exists")
        stream.write(bytearray(f"{name}\n".encode()))
        stream.close()
        return folder

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions, and what dead writers left.

        A reader of a version older than those loses it; so ``keep`` says how
        many publications a reader may take.
        """
        named = {v: self._named(v) for v in self._pointers()}
        last = sorted(v for v, f in named.items() if f)[-max(1, keep):]
        fs, data = file_system(self.spark, f"{self.root}/data")
        held = {named[v] for v in last}
        for status in fs.listStatus(data) if fs.exists(data) else []:
            # Folders above the last pointer may belong to a write under way.
            name = status.getPath().getName()
            if f"{self.root}/data/{name}" not in held and int(name.split("-")[0]) <= (last[-1] if last else -1):
                fs.delete(status.getPath(), True)
        for v in named:
            if last and v < last[0]:
                fs.delete(file_system(self.spark, self._pointer(v))[1], False)
