"""A Spark data source that lists an evidence folder, files and failures alike.

The driver opens folders only until there are enough subtrees to deal out; the
tasks walk those.  Following links needs one memory of the folders seen, so
that mode walks in a single task.
"""

from __future__ import annotations

import fnmatch
import json
import os
import stat
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import NOTE_CYCLE, NOTE_ERROR, SCAN

SUBTREES = 64


def times(st: os.stat_result, windows: bool) -> tuple[float | None, float | None]:
    """(birth, metadata change); on Windows the change time field holds the birth."""
    born = getattr(st, "st_birthtime", None)
    if windows:
        return float(st.st_ctime if born is None else born), None
    return (None if born is None else float(born)), float(st.st_ctime)


class Walker:
    """Walks subtrees; yields rows of the scan relation."""

    def __init__(self, root: str, follow: bool, globs: list[str], skipped_paths: list[str]):
        self.root, self.follow, self.globs = root, follow, globs
        self.skipped = set(skipped_paths)
        self.seen: set[tuple[int, int]] = set()

    def hidden(self, path: str) -> bool:
        name = os.path.basename(path)
        return os.path.abspath(path) in self.skipped or any(fnmatch.fnmatch(path, g) or fnmatch.fnmatch(name, g) for g in self.globs)

    def note(self, path: str, kind: str, reason: str) -> tuple:
        return (path, *[None] * 11, kind, reason)

    def folder(self, path: str) -> tuple[list[str], list[tuple]]:
        """The folders below ``path`` and the rows of everything else in it."""
        below, rows = [], []
        try:
            with os.scandir(path) as it:
                entries = sorted(it, key=lambda e: e.name)
        except OSError as e:
            return [], [self.note(path, NOTE_ERROR, f"folder not readable: {type(e).__name__}")]
        for entry in entries:
            if self.hidden(entry.path):
                continue
            try:
                link = entry.is_symlink()
                if entry.is_dir(follow_symlinks=self.follow) and not (link and not self.follow):
                    if self.entered(entry):
                        below.append(entry.path)
                    else:
                        rows.append(self.note(entry.path, NOTE_CYCLE, "folder was visited before"))
                elif link or entry.is_file(follow_symlinks=self.follow):
                    rows.append(self.row(entry.path, link))
            except OSError as e:
                rows.append(self.note(entry.path, NOTE_ERROR, f"entry not readable: {type(e).__name__}"))
        return below, rows

    def entered(self, entry: os.DirEntry) -> bool:
        if not self.follow:
            return True
        st = entry.stat(follow_symlinks=True)
        new = (st.st_dev, st.st_ino) not in self.seen
        self.seen.add((st.st_dev, st.st_ino))
        return new

    def row(self, path: str, link: bool) -> tuple:
        broken = link and not os.path.exists(path)
        try:
            st = os.lstat(path) if (link and not self.follow) or broken else os.stat(path)
        except OSError:
            return self.note(path, NOTE_ERROR, "metadata not readable")
        target = ""
        if link:
            try:
                target = os.readlink(path)
            except OSError:
                pass
        born, changed = times(st, sys.platform == "win32")
        rel = Path(path).relative_to(self.root).as_posix()
        return (path, rel, os.path.basename(path), os.path.dirname(path), st.st_size, st.st_mtime, st.st_atime, changed, born, link, target, broken, None, None)

    def walk(self, folders: list[str]) -> Iterator[tuple]:
        stack = list(folders)
        while stack:
            below, rows = self.folder(stack.pop())
            stack += below
            yield from rows


class Piece(InputPartition):
    def __init__(self, folders: list[str], rows: list[tuple]):
        self.folders, self.rows = folders, rows


class EvidenceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        self.follow = options.get("followSymlinks", "false").lower() == "true"
        self.globs = json.loads(options.get("exclude", "[]"))
        self.skipped = json.loads(options.get("excludePaths", "[]"))
        self.subtrees = int(options.get("subtrees", SUBTREES))

    def walker(self) -> Walker:
        return Walker(self.root, self.follow, self.globs, self.skipped)

    def partitions(self) -> list[Piece]:
        if self.follow:
            return [Piece([self.root], [])]
        walker, folders, rows = self.walker(), [self.root], []
        # widen by one level at a time until there is enough to deal out
        while folders and len(folders) < self.subtrees:
            level = [walker.folder(f) for f in folders]
            rows += [r for _, found in level for r in found]
            folders = [b for below, _ in level for b in below]
            if len(rows) > 100_000:
                break
        dealt = [folders[k :: self.subtrees] for k in range(min(len(folders), self.subtrees))]
        return [Piece(f, []) for f in dealt] + [Piece([], rows[k : k + 10_000]) for k in range(0, len(rows), 10_000)] or [Piece([], [])]

    def read(self, partition: Piece) -> Iterator[tuple]:
        walker = self.walker()
        if self.follow:
            st = os.stat(self.root)
            walker.seen.add((st.st_dev, st.st_ino))
        yield from partition.rows
        yield from walker.walk(partition.folders)


class EvidenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self):
        return SCAN

    def reader(self, schema) -> DataSourceReader:
        return EvidenceReader(self.options)


def scan(spark: SparkSession, root: str, follow_symlinks: bool = False, exclude: list[str] | None = None, exclude_paths: list[str] | None = None) -> DataFrame:
    """Files and notes below ``root``; see ``schemas.SCAN``."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    spark.dataSource.register(EvidenceSource)
    reader = spark.read.format("evidence").option("followSymlinks", str(follow_symlinks).lower())
    reader = reader.option("exclude", json.dumps(exclude or [])).option("excludePaths", json.dumps([os.path.abspath(p) for p in exclude_paths or []]))
    return reader.load(root)


def restat(path: str, follow: bool) -> os.stat_result | None:
    try:
        return os.stat(path) if follow else os.lstat(path)
    except OSError:
        return None


def is_regular(mode: int) -> bool:
    return stat.S_ISREG(mode)
