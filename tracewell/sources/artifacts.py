"""Databases, settings files and property lists as rows of keys and values.

Evidence is never opened in place: a database is copied first, with its
write-ahead log, so that what an app had not yet checkpointed is there too.
"""

from __future__ import annotations

import plistlib
import shutil
import sqlite3
import tempfile
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---- fixed values ----------------------------------------------------------------------------
SQLITE_HEAD = b"SQLite format 3\x00"
SETTINGS_BYTES = 16 * 1024 * 1024
HEAD_BYTES = 512
BLANK, XML_HEADS = b"\xef\xbb\xbf \t\r\n", (b"<?xml", b"<plist", b"<map", b"<!DOCTYPE plist")
ROW_NAMES = ("rowid", "_rowid_", "oid")
SQLITE, PREFS, PLIST, FILE = "sqlite", "shared_prefs", "plist", "file"
# ----------------------------------------------------------------------------------------------


def kind_of(path: str) -> str:
    """How a file can be compared, by its leading bytes."""
    try:
        with open(path, "rb") as f:
            head = f.read(HEAD_BYTES)
    except OSError:
        return FILE
    if head.startswith(SQLITE_HEAD):
        return SQLITE
    if head.startswith(b"bplist00"):
        return PLIST
    if head.lstrip(BLANK).startswith(XML_HEADS):
        if b"<plist" in head or b"PropertyList" in head:
            return PLIST
        return PREFS if b"<map" in head else FILE
    return FILE


def _limited(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(SETTINGS_BYTES + 1)
    if len(data) > SETTINGS_BYTES:
        raise ValueError("file is too large")
    return data


def preferences(path: str) -> dict[str, str]:
    """Settings by name, each as ``type:value``."""

    def value(node) -> str:
        if node.tag == "set":
            return "{" + ", ".join(sorted(c.text or "" for c in node)) + "}"
        return (node.text or "") if node.tag == "string" else node.get("value", "")

    return {node.get("name"): f"{node.tag}:{value(node)}" for node in ElementTree.fromstring(_limited(path)) if node.get("name") is not None}


def flat(value, path: str = "") -> Iterator[tuple[str, object]]:
    """Leaves of nested dictionaries and lists by path; empty ones are leaves."""
    if value and isinstance(value, (dict, list)):
        named = isinstance(value, dict)
        for key, item in value.items() if named else enumerate(value):
            yield from flat(item, (f"{path}.{key}" if path else str(key)) if named else f"{path}[{key}]")
    else:
        yield path, value


def property_list(path: str) -> dict[str, object]:
    return dict(flat(plistlib.loads(_limited(path))))


def typed(value) -> tuple[str, str | None]:
    """(kind, text) of a stored value; numbers that are equal have equal kinds and texts."""
    if value is None:
        return "null", None
    if isinstance(value, (bytes, bytearray)):
        return "blob", f"x'{bytes(value).hex()}'"
    if isinstance(value, bool):
        return "real", str(value)
    if isinstance(value, (int, float)):
        return "real", str(value)
    return "text", str(value)


def comparable(value) -> str:
    """Text that is equal for equal values."""
    if isinstance(value, (bool, int, float)):
        return f"n{value!r}" if not isinstance(value, bool) and isinstance(value, float) and not value.is_integer() else f"n{int(value)}" if value == value and abs(value) != float("inf") else f"n{value}"
    kind, text = typed(value)
    return kind[0] + (text or "")


def shown(value) -> str:
    """A value for people: NULL by name, blobs in hex, long ones cut with their length."""
    _, text = typed(value)
    if text is None:
        return "NULL"
    size = f"{len(value)} bytes" if isinstance(value, (bytes, bytearray)) else f"{len(text)} chars"
    return text if len(text) <= 300 else f"{text[:300]}…({size})"


# ---- databases -----------------------------------------------------------------------------------


class Database:
    """A private copy of a database file."""

    def __init__(self, path: str):
        self._folder = tempfile.TemporaryDirectory()
        try:
            copy = Path(self._folder.name) / Path(path).name
            shutil.copyfile(path, copy)
            log = Path(f"{path}-wal")
            if log.is_file():
                shutil.copyfile(log, f"{copy}-wal")
            self.connection = sqlite3.connect(copy)
            self.connection.text_factory = lambda b: b.decode("utf-8", "replace")
            self.tables = [r[0] for r in self.connection.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        except BaseException:
            self._folder.cleanup()
            raise

    def close(self) -> None:
        self.connection.close()
        self._folder.cleanup()

    def rows(self, table: str) -> Iterator[tuple[tuple, dict]]:
        """(key, columns) of each row: by row number, else primary key, else content and its count."""
        quoted = '"' + table.replace('"', '""') + '"'
        columns = self.connection.execute(f"PRAGMA table_info({quoted})").fetchall()
        names = {c[1].lower() for c in columns}
        for number in ROW_NAMES:
            if number in names:
                continue
            try:
                cursor = self.connection.execute(f"SELECT {number}, * FROM {quoted}")
            except sqlite3.OperationalError:
                break  # a table without row numbers
            fields = [d[0] for d in cursor.description[1:]]
            yield from ((("rowid", r[0]), dict(zip(fields, r[1:], strict=True))) for r in cursor)
            return
        cursor = self.connection.execute(f"SELECT * FROM {quoted}")
        fields = [d[0] for d in cursor.description]
        key = [c[1] for c in sorted(columns, key=lambda c: c[5]) if c[5]]
        counts: dict[tuple, int] = {}
        for r in cursor:
            row = dict(zip(fields, r, strict=True))
            if key:
                yield tuple(row[k] for k in key), row
            else:
                content = tuple(map(shown, r))
                counts[content] = counts.get(content, 0) + 1
                yield (*content, f"#{counts[content]}"), row


def key_text(key: tuple) -> str:
    return f"rowid={key[1]}" if len(key) == 2 and key[0] == "rowid" else ", ".join(map(shown, key))


def key_order(key: tuple) -> list[dict]:
    """Numbers before text and by value."""
    return [{"kind": 0, "number": float(k), "text": ""} if isinstance(k, (int, float)) else {"kind": 1, "number": 0.0, "text": str(k)} for k in key]


_VALUE = T.StructType([T.StructField("same", T.StringType()), T.StructField("shown", T.StringType())])
CELLS = T.StructType(
    [
        T.StructField("rel_path", T.StringType()),
        T.StructField("artifact", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("key_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("key_order", T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("number", T.DoubleType()), T.StructField("text", T.StringType())]))),
        T.StructField("row_text", T.StringType()),
        T.StructField("columns", T.MapType(T.StringType(), _VALUE)),
        T.StructField("error", T.StringType()),
    ]
)


def _database_records(rel: str, path: str) -> Iterator[tuple]:
    """A record for each row, one without a key for each table, and errors as records."""
    try:
        db = Database(path)
    except (sqlite3.Error, OSError) as e:
        yield rel, SQLITE, "", None, None, None, None, None, f"{type(e).__name__}: {e}"
        return
    try:
        for table in db.tables:
            try:
                held = list(db.rows(table))
            except sqlite3.Error as e:
                yield rel, SQLITE, table, None, None, None, None, None, f"{type(e).__name__}: {e}"
                continue
            yield rel, SQLITE, table, None, None, None, None, None, None
            for key, row in held:
                ident = "\x1f".join(map(comparable, key))
                cells = {c: {"same": comparable(v), "shown": shown(v)} for c, v in row.items()}
                yield rel, SQLITE, table, ident, key_text(key), key_order(key), "; ".join(f"{c}={shown(v)}" for c, v in row.items()), cells, None
    finally:
        db.close()


def _keyed_records(rel: str, path: str, kind: str) -> Iterator[tuple]:
    try:
        found = (preferences if kind == PREFS else property_list)(path)
    except Exception as e:  # damaged, too large or not what its head says
        yield rel, kind, "", None, None, None, None, None, f"{type(e).__name__}: {e}"
        return
    for key, value in found.items():
        yield rel, kind, "", key, key, key_order((key,)), shown(value), {"": {"same": comparable(value) if kind == PLIST else value, "shown": shown(value)}}, None


def records(files: DataFrame) -> DataFrame:
    """Records of the artifacts in ``files`` (rel_path, path, artifact); a task reads one file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[tuple] = []
            for row in batch.itertuples():
                make = _database_records(row.rel_path, row.path) if row.artifact == SQLITE else _keyed_records(row.rel_path, row.path, row.artifact)
                for record in make:
                    held.append(record)
                    if len(held) >= 5_000:
                        yield pd.DataFrame(held, columns=CELLS.names)
                        held = []
            if held:
                yield pd.DataFrame(held, columns=CELLS.names)

    return files.select("rel_path", "path", "artifact").mapInPandas(run, CELLS)
