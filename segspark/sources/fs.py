"""Small driver-side file operations on any file system that Hadoop knows. Data goes through Spark's readers and
writers; these are for names, pointers and deletes. Faults that may pass are tried again; a commit's own create isn't, as it
may have happened.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import TypeVar
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from segspark.errors import TransientError, UnsupportedError, WriteConflictError
from segspark.retry import RetryPolicy, with_retry

T = TypeVar("T")
#: Hadoop's names: a create that the store itself refuses if the name is taken, and lists of rights, which abfs has where
#: its renames are atomic.
CONDITIONAL, RIGHTS = "fs.option.create.conditional.overwrite", "fs.capability.paths.acls"
#: Java errors that trying again doesn't mend.
LASTING = ("FileNotFoundException", "FileAlreadyExistsException", "AccessControlException", "AccessDeniedException", "ParentNotDirectoryException", "PathIsNotEmptyDirectoryException", "UnsupportedOperationException")
FAULTS = RetryPolicy(attempts=4, base_s=0.1, cap_s=2.0)


def way_to_create(scheme: str, capable: Callable[[str], bool]) -> str:
    """How a file can be created whole and only once: "link" on local disks, "rename" where renames are atomic and
    keep what is there (HDFS; abfs with a hierarchical namespace), "conditional" where the store checks the name itself
    (s3a with conditional writes). UnsupportedError elsewhere: two writers could both succeed."""
    if scheme == "file":
        return "link"
    if scheme == "hdfs" or (scheme in ("abfs", "abfss") and capable(RIGHTS)):
        return "rename"
    if capable(CONDITIONAL):
        return "conditional"
    raise UnsupportedError(f"{scheme}: no way to create a file exclusively, which commits need")


def passing(e: BaseException) -> bool:
    """Whether a Java error is one of input and output that may pass."""
    if not isinstance(e, Py4JJavaError):
        return isinstance(e, (TransientError, ConnectionError, TimeoutError))
    kinds, c = [], e.java_exception.getClass()
    while c is not None:
        kinds.append(c.getSimpleName())
        c = c.getSuperclass()
    return "IOException" in kinds and not any(k in LASTING for k in kinds)


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self._conf)
        self.scheme = self._fs.getUri().getScheme()
        self._way: str | None = None

    @property
    def way(self) -> str:
        if self._way is None:
            self._way = way_to_create(self.scheme, lambda c: self._fs.hasPathCapability(self._path(self.root), c))
        return self._way

    def _try(self, run: Callable[[], T]) -> T:
        return with_retry(run, FAULTS, passing)

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self._try(lambda: self._fs.exists(self._path(p)))

    def entries(self, p: str) -> list[tuple[str, int]]:
        """Name and time of change (ms, the file system's clock) of what is in a folder, by name; none if it isn't there."""

        def once() -> list[tuple[str, int]]:
            path = self._path(p)
            if not self._fs.exists(path):
                return []
            return sorted((s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(path))

        return self._try(once)

    def names(self, p: str) -> list[str]:
        return [name for name, _ in self.entries(p)]

    def create(self, p: str, data: bytes) -> None:
        """Create p whole or raise WriteConflictError if it is there: the one atomic step commits rest on."""
        {"link": self._link, "rename": self._rename, "conditional": self._conditional}[self.way](p, data)

    def _link(self, p: str, data: bytes) -> None:
        """A finished file is hard-linked to its name, which fails if the name is taken."""
        target = urlparse(p).path if "://" in p or p.startswith("file:") else p
        os.makedirs(os.path.dirname(target), exist_ok=True)
        staged = f"{os.path.dirname(target)}/.{os.path.basename(target)}.{os.getpid()}.{os.urandom(6).hex()}"
        with open(staged, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(staged, target)
        except FileExistsError as e:
            raise WriteConflictError(p) from e
        finally:
            os.unlink(staged)

    def _rename(self, p: str, data: bytes) -> None:
        """A finished file is renamed to its name without leave to overwrite."""
        folder, name = p.rsplit("/", 1)
        staged, target = self._path(f"{folder}/.{name}.{os.urandom(12).hex()}"), self._path(p)
        try:
            out = self._fs.create(staged, True)
            out.write(bytearray(data))
            out.close()
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(staged, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception) or self.exists(p):
                raise WriteConflictError(p) from e
            raise
        finally:
            if self._fs.exists(staged):
                self._fs.delete(staged, False)

    def _conditional(self, p: str, data: bytes) -> None:
        """The store itself refuses the file if the name is taken, and shows it only when it is whole."""
        try:
            out = self._fs.createFile(self._path(p)).overwrite(True).must(CONDITIONAL, True).build()
            out.write(bytearray(data))
            out.close()
        except Py4JJavaError as e:
            if self.exists(p):
                raise WriteConflictError(p) from e
            raise

    def touch(self, p: str) -> None:
        """An empty file, whether it is there or not."""
        self._try(lambda: self._fs.create(self._path(p), True).close())

    def read(self, p: str) -> bytes:
        def once() -> bytes:
            stream = self._fs.open(self._path(p))
            try:
                return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()

        return self._try(once)

    def delete(self, p: str) -> bool:
        return self._try(lambda: self._fs.delete(self._path(p), True))

    def move(self, old: str, new: str) -> bool:
        """Rename a folder, making the folders above its new name."""
        self._fs.mkdirs(self._path(new.rsplit("/", 1)[0]))
        return self._fs.rename(self._path(old), self._path(new))
