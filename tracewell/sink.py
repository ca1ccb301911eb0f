"""Results as single files: CSV for spreadsheets and JSON records, replaced in one step."""

from __future__ import annotations

import csv
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values


def ensure_dir(folder: str | Path) -> Path:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def clean_label(label: str) -> str:
    """A label that is safe in file names."""
    return re.sub(r"[^0-9A-Za-z가-힣._-]", "_", label)


def out_path(tool: str, folder: str | Path, label: str = "", suffix: str = ".csv", now: datetime | None = None) -> Path:
    """A name that no file has yet."""
    parts = [tool, *([clean_label(label)] if label else []), f"{now or datetime.now():%Y%m%d_%H%M%S}"]
    stem = "_".join(parts)
    path, n = Path(folder) / f"{stem}{suffix}", 1
    while path.exists():
        path, n = Path(folder) / f"{stem}_{n}{suffix}", n + 1
    return path


def meta_path(csv_path: str | Path) -> Path:
    return Path(csv_path).with_suffix(".meta.json")


def side_path(csv_path: str | Path, what: str) -> Path:
    path = Path(csv_path)
    return path.with_name(f"{path.stem}_{what}.csv")


def _replace(path: Path, write: Callable) -> None:
    """Write beside ``path`` and rename, so that readers never see half a file."""
    ensure_dir(path.parent)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            write(f)
        os.chmod(name, 0o644)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def escape(value):
    """One cell of a CSV file; text that a spreadsheet would run gets a quote in front."""
    if not isinstance(value, str) or not value:
        return "" if value is None else value
    if value.startswith(values.FORMULA_MARK):
        return values.FORMULA_MARK + value
    if value.startswith(values.FORMULA_STARTS):
        try:
            float(value)
        except ValueError:
            return values.FORMULA_MARK + value
    return value


def unescape(value: str) -> str:
    return value[1:] if value.startswith(values.FORMULA_MARK) else value


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that spark.checkpoint.dir names (below the warehouse if unset) and read back.

    For tables that several parts of a plan read: they are computed once, and
    lost executors don't lose them.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_settled"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_csv(rows: DataFrame | Iterable[tuple], path: str | Path, columns: list[str] | None = None) -> int:
    """One CSV file with a byte order mark and always a header; rows stream through the driver."""
    if isinstance(rows, DataFrame):
        columns = columns or rows.columns
        rows = rows.select(*columns).toLocalIterator(prefetchPartitions=True)
    count = 0

    def write(f) -> None:
        nonlocal count
        f.write("﻿")
        out = csv.writer(f, lineterminator="\r\n")
        out.writerow(columns)
        for row in rows:
            out.writerow([escape(v) for v in row])
            count += 1

    _replace(Path(path), write)
    return count


def write_json(data, path: str | Path) -> None:
    _replace(Path(path), lambda f: json.dump(data, f, ensure_ascii=False, indent=2))


def read_meta(csv_path: str | Path) -> dict | None:
    """The scan record beside an inventory; None if there is none that can be read."""
    try:
        data = json.loads(meta_path(csv_path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return data if isinstance(data, dict) else None


def read_inventory(spark: SparkSession, path: str | Path) -> DataFrame:
    """An inventory CSV as text columns, with ``_order`` for the place of each row; ValueError for any other file."""
    try:
        with open(path, encoding="utf-8-sig", newline="") as f:
            header = next(csv.reader(f), [])
    except UnicodeDecodeError:
        raise ValueError(f"not a text file: {path}") from None
    if not ({"path", "rel_path"} & set(header)) or not {"size_bytes", "mtime_epoch"} <= set(header):
        raise ValueError(f"not an inventory: {path}")
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "enforceSchema": True}
    rows = spark.read.options(**options).schema(", ".join(f"`{c}` STRING" for c in header)).csv(Path(path).resolve().as_uri())
    cells = [values.unescape_formula(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in header]
    return rows.select(*cells, F.monotonically_increasing_id().alias("_order"))
