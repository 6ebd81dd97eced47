"""Versioned collections in a directory of a Hadoop file system.

A database is a folder; its catalog is a series of JSON manifests, one per version, and the newest one
counts. A manifest is written under a name of its own and then moved to its place unless something is
there, so nobody reads half of one, a writer that dies leaves nothing in the way, and of two writers only one gets the
version; the other one reads again and retries. That takes a file system whose move is atomic and doesn't overwrite:
HDFS and those that behave like it, and the local one (by a hard link). Object stores don't.
Data files are never changed: a write adds a segment or replaces all of them, and readers go on with the
version they began with. vacuum() deletes what the newest version doesn't name any more.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from typing import Any

from pyspark.sql import SparkSession

from docloom.errors import QueryError


class Conflict(Exception):
    """Another writer made the version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def versions(self, database: str) -> list[int]:
        folder = self._path(f"{self.root}/{database}/_catalog")
        if not self.fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(folder))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, database: str) -> tuple[int, dict[str, Any]]:
        """The newest version and its manifest: collections by name."""
        known = self.versions(database)
        if not known:
            return 0, {"collections": {}}
        stream = self.fs.open(self._path(f"{self.root}/{database}/_catalog/v{known[-1]:010d}.json"))
        try:
            return known[-1], json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, database: str, version: int, manifest: dict[str, Any]) -> None:
        """Make the manifest version + 1, or raise Conflict if there is one."""
        path = self._path(f"{self.root}/{database}/_catalog/v{version + 1:010d}.json")
        draft = self._path(f"{self.root}/{database}/_catalog/draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        try:
            if not self._move(draft, path):
                raise Conflict
        finally:
            self.fs.delete(draft, False)

    def _move(self, source, target) -> bool:
        """Move a file unless the target exists."""
        if self.fs.getUri().getScheme() != "file":
            return self.fs.rename(source, target)
        try:
            os.link(source.toUri().getPath(), target.toUri().getPath())  # the local rename would overwrite
        except FileExistsError:
            return False
        return True

    def vacuum(self, database: str, older_than: float = 3600.0) -> list[str]:
        """Delete segments that the newest version doesn't name, and older manifests and drafts, if they are older than so many seconds (readers of an older version may need them). Returns the paths."""
        version, manifest = self.read(database)
        named = {self._path(s).getName() for c in manifest["collections"].values() for s in c["segments"]}
        before, gone = (time.time() - older_than) * 1000, []
        folder = self._path(f"{self.root}/{database}")
        for place in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
            for f in self.fs.listStatus(place.getPath()):
                name = f.getPath().getName()
                kept = name == f"v{version:010d}.json" if place.getPath().getName() == "_catalog" else name in named
                if not kept and f.getModificationTime() <= before:
                    self.fs.delete(f.getPath(), True)
                    gone.append(str(f.getPath()))
        return gone

    def drop_path(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def new_segment(self, database: str, collection_id: str) -> str:
        return f"{self.root}/{database}/{collection_id}/{uuid.uuid4().hex}"

    def drop_folder(self, database: str, name: str = "") -> None:
        self.fs.delete(self._path(f"{self.root}/{database}/{name}".rstrip("/")), True)

    def databases(self) -> list[str]:
        root = self._path(self.root)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(root) if s.isDirectory()) if self.fs.exists(root) else []


def check_name(name: str, what: str) -> str:
    if not isinstance(name, str) or not name or "\0" in name or "$" in name or "/" in name:
        raise QueryError(73, f"Invalid {what} name: {name!r}")
    return name
