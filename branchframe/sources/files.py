"""Small files on any file system Spark knows, by way of Hadoop's FileSystem; create is an atomic put-if-absent."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from branchframe.errors import InvalidError

#: File systems whose rename without overwrite is atomic.
_RENAMES = {"hdfs", "viewfs", "webhdfs", "abfs", "abfss"}


class Files:
    """Paths below one root. Only manifests and logs go through here, never rows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def create(self, name: str, data: dict) -> bool:
        """Write a new file; False if it is there already (another writer won). Readers see all of it or nothing.

        The bytes go to a hidden file first, which then gets the name if nothing has it: by a hard link on a
        local file system, by a rename without overwrite on HDFS and its like. Object stores must offer a
        conditional create; without that this raises InvalidError, as two writers could both win.
        """
        if self.exists(name):
            return False
        body = bytearray(json.dumps(data, sort_keys=True).encode())
        scheme = self._fs.getUri().getScheme()
        if scheme != "file" and scheme not in _RENAMES:
            return self._conditional(name, body)
        folder, _, last = name.rpartition("/")
        hidden = f"{folder}/.{last}-{uuid.uuid4().hex}" if folder else f".{last}-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(hidden), False)
        try:
            out.write(body)
        finally:
            out.close()
        try:
            if scheme == "file":
                paths = self._jvm.java.nio.file.Paths
                local = lambda n: paths.get(self._path(n).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
                self._jvm.java.nio.file.Files.createLink(local(name), local(hidden))
            else:
                options = self._jvm.org.apache.hadoop.fs.Options
                never = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
                never[0] = getattr(options, "Rename").NONE
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(self._path(hidden), self._path(name), never)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(self._path(hidden), False)
        return True

    def _conditional(self, name: str, body: bytearray) -> bool:
        try:
            out = self._fs.createFile(self._path(name)).overwrite(False).recursive().must("fs.option.create.conditional.overwrite", True).build()
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise InvalidError("this file system can't create a file only if none is there") from None
        try:
            out.write(body)
            out.close()
        except Py4JJavaError as error:
            if any(word in str(error.java_exception) for word in ("AlreadyExists", "PreconditionFailed", "412")):
                return False
            raise
        return True

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(n for n in (x.getPath().getName() for x in self._fs.listStatus(self._path(folder))) if not n.startswith("."))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
