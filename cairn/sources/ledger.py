"""Locks, and tables that are replaced whole: versions are committed by creating a pointer file that nobody may overwrite.

A file system's create-if-absent is the only means of agreement: of several writers that ask for one name, one gets it. A table
is a folder of data folders and of pointers ``_versions/<number>``, each naming a data folder. Readers take the
highest pointer, so they see the old table or the new one, never a part, and a writer that dies leaves no trace in it.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class Taken(Exception):
    """Another writer has the name."""


class Files:
    """The Hadoop file system of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.none = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self.folder = folder.rstrip("/")
        self.files = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def create(self, name: str, text: str) -> None:
        """A new file, whole at once for its readers; ``Taken`` if the name exists."""
        target, fresh = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        self.files.mkdirs(target.getParent())
        stream = self.files.create(fresh, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.files.getScheme() == "file":  # a hard link fails where the name exists; a rename here would replace it
                nio = self.jvm.java.nio.file
                local = lambda p: nio.Path.of(self.files.makeQualified(p).toUri())
                nio.Files.createLink(local(target), local(fresh))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
                context.rename(fresh, target, self.none)
        except Exception as error:
            if self.files.exists(target):
                raise Taken(name) from error
            raise
        finally:
            self.files.delete(fresh, False)

    def read(self, name: str) -> str | None:
        """A file's text; None if there is none."""
        target = self.path(name)
        try:
            stream = self.files.open(target)
        except Exception:
            if self.files.exists(target):
                raise
            return None
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, name: str) -> list[str]:
        target = self.path(name)
        return sorted(s.getPath().getName() for s in self.files.listStatus(target)) if self.files.exists(target) else []

    def move(self, name: str, to: str) -> bool:
        return bool(self.files.rename(self.path(name), self.path(to)))

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)


@contextlib.contextmanager
def lock(spark: SparkSession, folder: str, name: str, lease: float = 600.0) -> Iterator[str]:
    """Holds a named lock while the block runs; ``Taken`` if someone else holds it.

    A holder that has died loses the lock when its lease is over: whoever moves the old lock file away first, by its owner's
    name, may ask for a new one. On leaving, the lock is given up only if it is still the holder's.
    """
    files, owner = Files(spark, folder), uuid.uuid4().hex
    file = f"{name}.lock"
    held = files.read(file)
    if held is not None:
        old = json.loads(held)
        if old["until"] > time.time():
            raise Taken(f"{name} until {old['until']}")
        files.move(file, f"{name}.{old['owner']}.expired")
    files.create(file, json.dumps({"owner": owner, "until": time.time() + lease}))
    try:
        yield owner
    finally:
        now = files.read(file)
        if now is not None and json.loads(now)["owner"] == owner:
            files.delete(file)


def version(spark: SparkSession, path: str) -> int:
    """The highest committed version of a table, 0 if there is none."""
    return max((int(n) for n in Files(spark, path).names("_versions") if n.isdigit()), default=0)


def commit(df: DataFrame, path: str, expected: int, kind: str = "parquet", **options) -> int:
    """Writes ``df`` as the version after ``expected``; ``Taken`` if another writer has committed that already.

    The data are written first, to a folder of their own that goes again if the commit fails."""
    spark = df.sparkSession
    files, data = Files(spark, path), f"data-{uuid.uuid4().hex}"
    if version(spark, path) != expected:
        raise Taken(f"{path} is at another version than {expected}")
    df.write.format(kind).options(**options).save(f"{files.folder}/{data}")
    schema = df.schema.json()
    try:
        files.create(f"_versions/{expected + 1}", json.dumps({"data": data, "kind": kind, "options": options, "schema": schema}))
    except Taken:
        files.delete(data)
        raise
    return expected + 1


def current(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The table as of a version, the last one if none is named."""
    from pyspark.sql.types import StructType

    at = version(spark, path) if at is None else at
    text = Files(spark, path).read(f"_versions/{at}")
    if text is None:
        raise FileNotFoundError(f"{path} has no version {at}")
    pointer = json.loads(text)
    return spark.read.schema(StructType.fromJson(json.loads(pointer["schema"]))).format(pointer["kind"]).options(**pointer["options"]).load(f"{path.rstrip('/')}/{pointer['data']}")
