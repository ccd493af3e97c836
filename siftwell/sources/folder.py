"""A folder of files as a data source: each file a row, with an error instead of a content where it can't be read.

Names and sizes are listed once, sorted, when the read is planned, as Spark's own file index does: links are skipped, ignored folders aren't entered. The files are
then dealt to tasks by their bytes and opened there. It reads what every executor has mounted under one path; ``sources.files.read_folder`` reads stores
that only Spark reaches.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell.sources.config import ScanConfig

TASK_BYTES, TASK_FILES = 64 << 20, 10_000
SCHEMA = "file string, content binary, size long, error string"


@dataclass
class Files(InputPartition):
    """(name, path, size, error) of the files of a task."""

    files: list[tuple[str, str, int | None, str | None]]


def said(name: str, error: OSError) -> str:
    reason = {"EACCES": "Permission denied", "EPERM": "Permission denied", "ENOENT": "File not found"}
    import errno

    return f"Cannot read {name}: {reason.get(errno.errorcode.get(error.errno or 0, ''), error.strerror or str(error))}"


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.most = options["path"].removeprefix("file://"), int(options["max_file_size"])
        whole = lambda key: re.compile("|".join(f"(?:{p})" for p in json.loads(options[key]))) if json.loads(options[key]) else None
        self.ignored, self.kept = whole("ignored"), whole("kept")
        self.tracked = options.get("tracked")

    def ignores(self, name: str) -> bool:
        return bool(self.ignored and self.ignored.search(name)) and not (self.kept and self.kept.search(name))

    def listed(self) -> Iterator[tuple[str, str, int | None, str | None]]:
        """Depth first, each folder's entries by name."""
        if self.tracked is not None:
            with open(self.tracked.removeprefix("file://"), encoding="utf-8") as names:
                for name in sorted({os.path.normpath(x) for x in names.read().splitlines() if x}):
                    parts = name.split("/")
                    if not any(self.ignores("/".join(parts[: i + 1])) for i in range(len(parts))):
                        yield from self._one(name, os.path.join(self.root, name))
            return
        if not os.path.lexists(self.root):
            yield self.root, self.root, None, "File not found"
        elif not os.path.isdir(self.root):
            yield from self._one(os.path.basename(self.root), self.root)
        else:
            yield from self._walk("")

    def _one(self, name: str, path: str) -> Iterator[tuple[str, str, int | None, str | None]]:
        try:
            found = os.lstat(path)
        except OSError as e:
            yield name, path, None, "File not found" if e.errno == 2 else said(name, e)
            return
        if stat.S_ISDIR(found.st_mode):
            yield name, path, None, f"Cannot scan {name}: it is a directory"
        elif stat.S_ISREG(found.st_mode):
            yield name, path, found.st_size, None
        elif not stat.S_ISLNK(found.st_mode):
            yield name, path, None, f"Cannot read {name}: it is no regular file"

    def _walk(self, folder: str) -> Iterator[tuple[str, str, int | None, str | None]]:
        waiting = [folder]
        while waiting:
            at = waiting.pop()
            path = os.path.join(self.root, at) if at else self.root
            if at and not os.path.isdir(path) or os.path.islink(path) and at:
                yield from self._one(at, path)
                continue
            try:
                names = sorted(os.listdir(path))
            except OSError as e:
                yield at or self.root, path, None, said(at or self.root, e)
                continue
            inner = [f"{at}/{n}" if at else n for n in names]
            waiting += [n for n in reversed(inner) if not self.ignores(n)]

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for file in self.listed():
            own = min(file[2] or 0, self.most)
            if out[-1].files and (size + own > TASK_BYTES or len(out[-1].files) >= TASK_FILES):
                out.append(Files([]))
                size = 0
            out[-1].files.append(file)
            size += own
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for name, path, size, error in partition.files:
            content = None
            if error is None and size <= self.most:
                try:
                    with open(path, "rb", opener=lambda p, flags: os.open(p, flags | os.O_NOFOLLOW)) as file:
                        content = file.read(self.most + 1)
                        size = len(content)
                    if size > self.most:  # it has grown since it was listed
                        content, size = None, os.path.getsize(path)
                except OSError as e:
                    error = said(name, e)
            yield name, content, size, error


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siftwell_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FolderReader:
        return FolderReader(dict(self.options))


def read(spark: SparkSession, path: str, config: ScanConfig = ScanConfig(), tracked: str | None = None) -> DataFrame:
    """file (relative to ``path``), content, size, error. Larger files than the limit have no content and no error.

    ``tracked``: a file with a name a line; only these are read, and those that aren't there are rows with an error."""
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("siftwell_folder").option("path", path).option("max_file_size", str(config.max_file_size))
    reader = reader.option("ignored", json.dumps(config.ignore.files)).option("kept", json.dumps(config.ignore.negations))
    return (reader.option("tracked", tracked) if tracked else reader).load()
