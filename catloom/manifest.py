"""Versioned manifests: small JSON files in a shared folder; making the next one is the commit of a change."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from .session import read_bytes


class Conflict(Exception):
    """Another writer made this version first."""


class Manifest:
    """The state of a folder of files as ``v<number>.json``; the highest number counts.

    A version is written under a name of its own and then given its number by a step that fails where the
    number is taken: a hard link on a local disk, a rename without overwriting elsewhere. So readers see the
    old state or the new one, and of two writers one gets a ``Conflict``. A writer that dies leaves a file
    that no version names.
    """

    def __init__(self, spark: SparkSession, folder: str, *, keep: int = 16):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("")
        if not fs.exists(folder):
            return []
        names = (re.fullmatch(r"v(\d+)\.json", f.getPath().getName()) for f in fs.listStatus(folder))
        return sorted(int(m[1]) for m in names if m)

    def read(self) -> tuple[int, dict]:
        """The latest version and its content; 0 and nothing before the first."""
        versions = self.versions()
        if not versions:
            return 0, {}
        return versions[-1], json.loads(read_bytes(self.spark, f"{self.folder}/v{versions[-1]:012d}.json"))

    def commit(self, version: int, content: dict) -> None:
        """Makes ``version``; a ``Conflict`` if it is there."""
        if version <= max(self.versions(), default=0):
            raise Conflict(f"version {version} of {self.folder} is past")
        fs, jvm = self._fs(), self.spark.sparkContext._jvm
        own, final = self._path(f"_new-{uuid.uuid4().hex}"), self._path(f"v{version:012d}.json")
        out = fs.create(own, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        try:
            if fs.getUri().getScheme() == "file":
                local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, own)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                options = self.spark.sparkContext._gateway.new_array(kind, 1)
                options[0] = kind.NONE
                context.rename(own, final, options)
        except Py4JJavaError as problem:
            if "AlreadyExists" in problem.java_exception.getClass().getName():
                raise Conflict(f"version {version} of {self.folder} is there") from problem
            raise
        finally:
            fs.delete(own, False)
        for old in self.versions()[: -self.keep]:
            fs.delete(self._path(f"v{old:012d}.json"), False)

    def change(self, edit: Callable[[dict], dict]) -> dict:
        """Applies ``edit`` to the latest content, again if another writer was first; returns what was committed."""
        while True:
            version, content = self.read()
            changed = edit(content)
            try:
                self.commit(version + 1, changed)
            except Conflict:
                continue
            return changed
