"""A folder tree as a Spark data source: what stands where, told apart by kind, listed by partitions and without reading content.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("ready", "a,b").load("/mnt/inbox")

The driver lists the top level only; each of its folders is a partition (small ones are dealt together), listed by an executor,
so the tree must be on a file system that all machines mount. Links and special files (devices, pipes, sockets) are rows
of their own kind and are never followed or opened; a folder that vanishes or can't be read while it's listed is an error row.

Options: path; ready (names of top-level entries, comma-separated: only these are listed); hidden (`true` lists names that begin
with a dot at the top level, which an inbox ignores); tasks (partitions at most).
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, entry string, kind string, size long, mtime_ns long, target string"
TASKS = 200


def kind_of(mode: int) -> str:
    return "file" if stat.S_ISREG(mode) else "link" if stat.S_ISLNK(mode) else "folder" if stat.S_ISDIR(mode) else "special"


def listed(root: str, rel: str) -> Iterator[tuple]:
    """Rows of everything under (and with) an entry, depth first, in order of name."""
    waiting = [rel]
    while waiting:
        own = waiting.pop()
        full = os.path.join(root, own)
        entry = own.split("/", 1)[0]
        try:
            found = os.lstat(full)
            kind = kind_of(found.st_mode)
            target = os.readlink(full) if kind == "link" else None
            inside = sorted(os.listdir(full), reverse=True) if kind == "folder" else []
        except OSError as error:
            yield own, entry, "unreadable", None, None, type(error).__name__
            continue
        if kind == "folder":
            waiting += [f"{own}/{name}" for name in inside]
        else:
            yield own, entry, kind, found.st_size if kind == "file" else None, found.st_mtime_ns, target


class Entries(InputPartition):
    def __init__(self, names: list[str]) -> None:
        super().__init__(names)
        self.names = names


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        path = options.get("path")
        if not path:
            raise ValueError("a path is needed")
        self.root = path.removeprefix("file://")
        ready = options.get("ready")
        self.ready = None if ready is None else {x.strip() for x in ready.split(",") if x.strip()}
        self.hidden = str(options.get("hidden", "false")).lower() == "true"
        self.tasks = max(1, int(options.get("tasks", TASKS)))

    def partitions(self) -> list[Entries]:
        names = sorted(n for n in os.listdir(self.root) if (self.hidden or not n.startswith(".")) and (self.ready is None or n in self.ready))
        parts: list[list[str]] = [names[k :: self.tasks] for k in range(min(self.tasks, len(names)))]
        return [Entries(p) for p in parts] or [Entries([])]

    def read(self, partition: Entries) -> Iterator[tuple]:
        for name in partition.names:
            yield from listed(self.root, name)


class TreeSource(DataSource):
    """path (under the root), entry (its top-level name), kind (file, link, special, unreadable), size, mtime_ns, target (of a link, or
    the error)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))
