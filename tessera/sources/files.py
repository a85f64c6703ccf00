"""A Spark data source that walks folders: one row for each file that the walk meets.

Unlike the built-in file sources it keeps names that start with an underscore, reports empty files, does not
follow symbolic links and keeps full modification times.  Each root is one partition, so a walk runs where the
folders are mounted.  ``content`` is read only if it is asked for.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root int, root_label string, path string, below_root string, project string, file_type string, size long, mtime double, uid long, content binary, reason string"


def printable(name: str) -> str:
    """A path as text; bytes that are no UTF-8 become escapes."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def _pruned(name: str, denied: set[str]) -> bool:
    return name.startswith(".") or name.casefold() in denied


def walk(root: str, max_depth: int, denied: set[str]):
    """(path, reason) below a root, folders and files in name order; reason is null for files.

    Depth 0 is no limit and 1 the root's own files.  A root can be one file; a linked or denied root has none.
    """
    top = Path(root)
    if top.is_symlink() or _pruned(top.name, denied):
        return
    if top.is_file():
        yield str(top), None
        return
    todo = [(str(top), 1)]
    while todo:
        folder, depth = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        deeper = []
        for e in entries:
            if e.is_dir(follow_symlinks=False) or (e.is_symlink() and e.is_dir()):
                if _pruned(e.name, denied) or e.is_symlink():
                    if not e.name.startswith("."):
                        yield e.path, f"denied path segment: {e.name}"
                elif not max_depth or depth < max_depth:
                    deeper.append((e.path, depth + 1))
            else:
                yield e.path, None
        todo.extend(reversed(deeper))


class FilesDataSource(DataSource):
    """format("tessera_files"): options roots and labels (newline-separated), max_depth, denied, content."""

    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


class FilesReader(DataSourceReader):
    def __init__(self, options):
        self.roots = options["roots"].split("\n")
        self.labels = options.get("labels", "").split("\n") if options.get("labels") else [Path(r).name for r in self.roots]
        self.depth = int(options.get("max_depth", 0))
        self.denied = {x.casefold() for x in options.get("denied", "").split("\n") if x}
        self.content = options.get("content", "false").lower() == "true"

    def partitions(self):
        return [InputPartition(i) for i in range(len(self.roots))]

    def read(self, partition):
        i = partition.value
        root, label = self.roots[i], self.labels[i]
        base = os.path.realpath(root)
        for path, reason in walk(root, self.depth, self.denied):
            name = printable(path)
            below = printable(os.path.relpath(path, root)) if not os.path.isfile(root) else printable(os.path.basename(path))
            parts = below.split("/")
            project = f"{label}/{parts[0]}" if len(parts) > 1 else label
            size = mtime = uid = data = None
            if reason is None and name != path:
                reason = "file name is not valid UTF-8"
            if reason is None and (os.path.islink(path) or os.path.realpath(path) != os.path.join(base, below) and not os.path.isfile(root)):
                reason = "symlink source"
            if reason is None:
                try:
                    s = os.stat(path)
                    size, mtime, uid = s.st_size, s.st_mtime, s.st_uid
                    if self.content:
                        with open(path, "rb") as f:
                            data = f.read()
                except OSError:
                    reason = "unreadable metadata" if size is None else None
            yield i, label, name, below, project, os.path.splitext(name)[1].lower(), size, mtime, uid, data, reason


def list_files(spark: SparkSession, roots: list[str], labels: list[str] | None = None, max_depth: int = 0, denied: list[str] | None = None, content: bool = False) -> DataFrame:
    spark.dataSource.register(FilesDataSource)
    reader = spark.read.format("tessera_files").option("roots", "\n".join(roots)).option("max_depth", max_depth).option("content", content)
    if labels:
        reader = reader.option("labels", "\n".join(labels))
    if denied:
        reader = reader.option("denied", "\n".join(denied))
    return reader.load()


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones are passed over."""
    return spark.read.json(path)


def read_manifests(spark: SparkSession, glob: str) -> DataFrame:
    """The union of JSON arrays of entries; paths listed twice are an error."""
    entries = spark.read.option("multiLine", True).json(glob)
    if not entries.groupBy("path").count().where("count > 1").isEmpty():
        raise ValueError("a path is listed twice")
    return entries.orderBy("path")


def missing_roots(roots: list[str]) -> list[str]:
    return [r for r in roots if not os.path.exists(r)]


def disk_state(spark: SparkSession, paths: DataFrame, hashed: bool = True) -> DataFrame:
    """(path, content_hash, byte_count, mtime, uid) of the given paths that exist, each read where its task runs.

    Without ``hashed`` files are only looked at, not read, and content_hash is null.
    """

    def run(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    s, h = os.stat(p), None
                    if hashed:
                        h = hashlib.sha256()
                        with open(p, "rb") as f:
                            while block := f.read(1 << 20):
                                h.update(block)
                    rows.append((p, h and h.hexdigest(), s.st_size, s.st_mtime, s.st_uid))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "content_hash", "byte_count", "mtime", "uid"])

    return paths.select("path").mapInPandas(run, "path string, content_hash string, byte_count long, mtime double, uid long")
