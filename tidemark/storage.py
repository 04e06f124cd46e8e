"""Shared folders and small driver-side file operations, through Hadoop's file system API.

Everything that several executors must see is kept under one folder. A cluster names it in
``spark.checkpoint.dir``; where that setting is absent (tests, notebooks) a local folder is made.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, else one made for a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_made: list[str] = []
#: Catalog entries of tables that are files of ours; they are made again when needed.
registered: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Delete what this session wrote to scratch paths, and its catalog entries. Results that were not yet read or saved are lost."""
    n = 0
    while registered:
        spark.sql(f"DROP TABLE IF EXISTS {registered.pop()}")
    while _made:
        Files(spark, _made.pop()).delete()
        n += 1
    return n


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` cut from its lineage: written to the shared folder as Parquet and read again."""
    path = scratch(df.sparkSession, name)
    out = df.write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Existence, exclusive creation, atomic rename, listing and deletion on any Hadoop URI."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def mkdirs(self, name: str = "") -> None:
        self.fs.mkdirs(self.path(name))

    def write(self, name: str, text: str, overwrite: bool = True) -> None:
        """Write a small text; with ``overwrite=False`` an existing file raises FileExistsError.

        Without overwriting the file appears whole or not at all, and of several writers one wins: the text
        is written aside and renamed, or on a local file system linked, to its name.
        """
        self.write_bytes(name, text.encode(), overwrite)

    def write_bytes(self, name: str, content: bytes, overwrite: bool = True) -> None:
        if overwrite:
            return self._put(name, content)
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        self._put(aside, content)
        try:
            if self.fs.getScheme() == "file":
                local = lambda n: self.path(n).toUri().getPath()
                os.link(local(aside), local(name))
            else:
                self._rename(aside, name, "NONE")
        except FileExistsError:
            raise FileExistsError(name) from None
        except Exception as e:  # the JVM's FileAlreadyExistsException
            if "AlreadyExists" in str(e):
                raise FileExistsError(name) from None
            raise
        finally:
            self.fs.delete(self.path(aside), False)

    def _put(self, name: str, content: bytes) -> None:
        out = self.fs.create(self.path(name), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def _rename(self, old: str, new: str, how: str) -> None:
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = _array(self.jvm, options, [getattr(options, how)])
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf).rename(self.path(old), self.path(new), array)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_bytes(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Replace ``name`` in one step: a temporary file renamed over it."""
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        self.write(temporary, text)
        self._rename(temporary, name, "OVERWRITE")

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"could not rename {old} to {new} below {self.root}")

    def list(self, name: str = "") -> list[tuple[str, int]]:
        """Names and lengths of the plain files directly below ``name``; empty when it is missing."""
        if not self.exists(name):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self.path(name)) if s.isFile())

    def folders(self, name: str = "") -> list[str]:
        """Names of the folders directly below ``name``; empty when it is missing."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)) if s.isDirectory())

    def walk(self, name: str = "") -> list[str]:
        """Paths below the root of all plain files below ``name``, at any depth; empty when it is missing."""
        if not self.exists(name):
            return []
        root = self.path("").toUri().getPath().rstrip("/") + "/"
        found, out = self.fs.listFiles(self.path(name), True), []
        while found.hasNext():
            out.append(found.next().getPath().toUri().getPath().removeprefix(root))
        return sorted(out)

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)


def _array(jvm, kind, items):
    out = jvm.java.lang.reflect.Array.newInstance(items[0].getClass(), len(items))
    for i, x in enumerate(items):
        jvm.java.lang.reflect.Array.set(out, i, x)
    return out
