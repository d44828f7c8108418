"""Directory trees as a Spark data source: ``spark.read.format("library_files")``.

The driver lists only the uppermost levels, until there are about ``tasks`` subtrees; each input
partition walks its share of them. Excluded folders are pruned before they are opened. Rows
carry what a stat says; no file is opened.

Options: roots and suffixes (JSON lists; suffixes with or without their dot, all files if there are none), excluded (a JSON
list of component names, compared without case; with it go lock files and temporary suffixes),
follow_symlinks (false: linked files and folders don't count; true: they do, and a link to a
folder above itself isn't entered), tasks.

A root that is no folder is an error. A folder that can't be read has no rows.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stacklight.functions.paths import EXCLUDED_COMPONENTS, IMAGE_SUFFIXES, TEMPORARY_SUFFIXES

SCHEMA = "source_path string, size bigint, mtime_ns bigint, regular boolean, linked boolean"
#: Rows of a batch, and the levels that the driver lists at most.
ROWS, LEVELS = 8192, 4

#: (folder, whether what lies below belongs to it too, (device, inode) of the folders above and itself)
_Subtree = tuple[str, bool, frozenset]


@dataclass(frozen=True)
class Rules:
    suffixes: frozenset = frozenset()
    excluded: frozenset = frozenset()
    follow: bool = False

    def out(self, name: str) -> bool:
        """Whether an entry of this name is excluded."""
        name = name.casefold()
        return bool(self.excluded) and (name in self.excluded or name.startswith("~$") or name.endswith(TEMPORARY_SUFFIXES))

    def wanted(self, name: str) -> bool:
        head, dot, tail = name.rpartition(".")
        return not self.suffixes or bool(head and dot and tail) and f".{tail.casefold()}" in self.suffixes


def _identity(path: str) -> frozenset:
    info = os.stat(path)
    return frozenset([(info.st_dev, info.st_ino)])


def _entries(folder: str, scan: Callable) -> list[os.DirEntry]:
    try:
        with scan(folder) as found:
            return list(found)
    except OSError:
        return []


def _below(subtree: _Subtree, entries: Iterable[os.DirEntry], rules: Rules) -> list[_Subtree]:
    """The subtrees right below a folder that are to be walked."""
    out = []
    for e in entries:
        try:
            if rules.out(e.name) or e.is_symlink() and not rules.follow or not e.is_dir():
                continue
            own = _identity(e.path)
        except OSError:
            continue
        if not own <= subtree[2]:
            out.append((e.path, True, subtree[2] | own))
    return out


def planned(roots: Sequence[str], rules: Rules, tasks: int, scan: Callable = os.scandir) -> list[_Subtree]:
    """Folders and subtrees that cover the roots, each file in one of them: levels are opened until there are `tasks` subtrees."""
    level: list[_Subtree] = []
    for root in sorted({os.path.abspath(r) for r in roots}):
        if not os.path.isdir(root):
            raise NotADirectoryError(f"no folder to walk: {root}")
        if not any(rules.out(part) for part in root.split(os.sep) if part):
            level.append((root, True, _identity(root)))
    done: list[_Subtree] = []
    for _ in range(LEVELS):
        if not level or len(level) >= tasks:
            break
        done += [(folder, False, above) for folder, _, above in level]
        level = [sub for one in level for sub in _below(one, _entries(one[0], scan), rules)]
    return done + level


def walked(subtree: _Subtree, rules: Rules, scan: Callable = os.scandir) -> Iterator[tuple]:
    """The rows of a subtree, or of a folder alone."""
    todo = [subtree]
    while todo:
        one = todo.pop()
        entries = _entries(one[0], scan)
        for e in entries:
            if rules.out(e.name) or not rules.wanted(e.name):
                continue
            try:
                linked = e.is_symlink()
                if linked and not rules.follow or e.is_dir():
                    continue
                info = e.stat()
            except OSError:
                continue
            yield e.path, info.st_size, info.st_mtime_ns, stat.S_ISREG(info.st_mode), linked
        if one[1]:
            todo += _below(one, entries, rules)


class _Share(InputPartition):
    def __init__(self, subtrees: list[_Subtree]):
        super().__init__(len(subtrees))
        self.subtrees = subtrees


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        listed = lambda name: json.loads(options.get(name) or "[]")
        self.roots = listed("roots") or ([options["path"]] if options.get("path") else [])
        if not self.roots:
            raise ValueError("no roots to walk")
        suffixes = frozenset("." + s.casefold().lstrip(".") for s in listed("suffixes"))
        self.rules = Rules(suffixes, frozenset(x.casefold() for x in listed("excluded")), options.get("follow_symlinks", "false").lower() == "true")
        self.tasks = max(1, int(options.get("tasks") or 64))

    def partitions(self) -> list[_Share]:
        found = planned(self.roots, self.rules, self.tasks)
        shares = [found[k :: self.tasks] for k in range(min(self.tasks, len(found)))]
        return [_Share(s) for s in shares] or [_Share([])]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["source_path", "size", "mtime_ns", "regular", "linked"])

        for subtree in partition.subtrees:
            for row in walked(subtree, self.rules):
                rows.append(row)
                if len(rows) == ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


class LibraryFiles(DataSource):
    """Files below some folders, with their stats."""

    @classmethod
    def name(cls) -> str:
        return "library_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def library(spark: SparkSession, roots: str | Sequence[str], suffixes: Sequence[str] = IMAGE_SUFFIXES, excluded: Sequence[str] = (), follow_symlinks: bool = False, tasks: int = 64) -> DataFrame:
    """source_path, size, mtime_ns, regular, linked of the files below the roots."""
    spark.dataSource.register(LibraryFiles)
    roots = [roots] if isinstance(roots, str) else list(roots)
    options = {"roots": json.dumps(roots), "suffixes": json.dumps(list(suffixes)), "excluded": json.dumps(list(excluded)), "follow_symlinks": str(follow_symlinks).lower(), "tasks": str(tasks)}
    return spark.read.format("library_files").options(**options).load()


def inventory(spark: SparkSession, root: str, tasks: int = 64) -> DataFrame:
    """library() of the images below a root as the audit contract sees them: excluded folders aren't entered."""
    return library(spark, root, IMAGE_SUFFIXES, EXCLUDED_COMPONENTS, tasks=tasks)
