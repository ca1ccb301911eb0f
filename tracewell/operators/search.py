"""Keyword and pattern search, line by line, with the places of every match."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import encoding, values

#: Extensions that are searched, and the largest file.
EXTENSIONS = ("txt", "log", "csv", "json", "xml", "md", "ini", "conf", "reg")
MAX_BYTES = 10 * 1024 * 1024
#: About the bytes of one Arrow batch into Python and of the texts decoded together, and the most hits of one batch back.
BATCH_BYTES, BATCH_HITS = 4 << 20, 4096
#: A line, for the JVM's matcher: its end stays with it, and form feeds and the like end none.


def compile_all(keywords: Sequence[str], regex: bool = False, case_sensitive: bool = False) -> list[re.Pattern]:
    """The patterns, in order; re.error for a broken one."""
    flags = re.UNICODE if case_sensitive else re.UNICODE | re.IGNORECASE
    return [re.compile(k if regex else re.escape(k), flags) for k in keywords]


# ---- over bytes ----------------------------------------------------------------------------------


def _hits(data: bytes, patterns: list[re.Pattern], encodings: Sequence[str]) -> Iterator[tuple]:
    """The columns of a hit behind its path, and the number of its pattern, line by line."""
    for number, (line, name) in enumerate(encoding.decode_lines(data, encodings), 1):
        bare = line.rstrip("\r\n")
        for k, p in enumerate(patterns):
            for m in p.finditer(line):
                a, b = m.span()
                if a < b:
                    yield number, a, b, m.group(), p.pattern, name, _preview(bare, a, b), k


def _bounded(rows: DataFrame) -> DataFrame:
    """Bound the bytes of Arrow batches in the session of ``rows``."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows


def _pieces(batch: pa.RecordBatch, data_col: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by about ``BATCH_BYTES`` of their data; a longer one begins a piece."""
    sizes = pc.fill_null(pc.binary_length(batch.column(data_col)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        yield batch.slice(a, b - a)


def search_bytes(rows: DataFrame, data_col: str, patterns: list[re.Pattern], keep: Sequence[str] = (), encodings: Sequence[str] = encoding.ENCODINGS) -> DataFrame:
    """``keep`` and the hits in files that a binary column holds; null has none."""
    found = [*schemas.HITS.fields[1:], T.StructField("pattern_no", T.IntegerType())]
    schema = T.StructType([*(rows.schema[c] for c in keep), *found])
    kinds = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string() for f in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(data_col)
            hits = ((k, *hit) for k in range(len(data)) for hit in _hits(data[k].as_py() or b"", patterns, encodings))
            while some := list(islice(hits, BATCH_HITS)):
                at, *columns = zip(*some, strict=True)
                own = [batch.column(c).take(pa.array(at, pa.int64())) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=schema.names)

    return _bounded(rows).select(*keep, data_col).mapInArrow(run, schema)


# ---- over files ----------------------------------------------------------------------------------


def eligible(files: DataFrame, extensions: Sequence[str] = EXTENSIONS, max_bytes: int = MAX_BYTES, follow_symlinks: bool = False) -> DataFrame:
    """Files of the extensions, with ``skip_reason`` where one is not to be read."""
    wanted = [e.lower().lstrip(".") for e in extensions]
    suffix = F.regexp_extract(F.lower(F.col("name")), r"^\.*[^.].*\.([^.]+)$", 1)
    reason = F.when(F.col("size_bytes") > max_bytes, "too_large")
    if not follow_symlinks:
        reason = F.when(F.col("is_symlink"), "symlink").otherwise(reason)
    return files.where(suffix.isin(*wanted)).withColumn("skip_reason", reason)


def search_files(candidates: DataFrame, patterns: list[re.Pattern], encodings: Sequence[str] = encoding.ENCODINGS) -> DataFrame:
    """Hits, and a row with only ``path`` and ``skip_reason`` for a file that can't be read.

    Rows of ``candidates`` with a ``skip_reason`` must be filtered out before.
    """
    schema = T.StructType([*schemas.HITS.fields, T.StructField("pattern_no", T.IntegerType()), T.StructField("skip_reason", T.StringType())])

    def of_file(path: str) -> Iterator[tuple]:
        try:
            with open(path, "rb") as f:
                data = f.read()
        except OSError:
            yield (path, *[None] * 8, "read_error")
            return
        for hit in _hits(data, patterns, encodings):
            yield path, *hit, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[tuple] = []
            for path in batch["path"]:
                for hit in of_file(path):
                    held.append(hit)
                    if len(held) >= 10_000:
                        yield _frame(held)
                        held = []
            if held:
                yield _frame(held)

    def _frame(rows):
        frame = pd.DataFrame(rows, columns=schema.names)
        return frame.astype({c: "Int32" for c in ("line_no", "match_span_start", "match_span_end", "pattern_no")})

    return candidates.select("path").mapInPandas(run, schema)


def decoded_lines(files: DataFrame, encodings: Sequence[str] = encoding.ENCODINGS) -> DataFrame:
    """``path``, ``line_no``, ``line`` and ``encoding`` of every line; a file that can't be read is one row with only its path."""
    schema = schemas.schema("path:s line_no:i line:s encoding:s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with open(path, "rb") as f:
                        found = encoding.decode_lines(f.read(), encodings)
                except OSError:
                    yield pd.DataFrame([(path, None, None, None)], columns=schema.names).astype({"line_no": "Int32"})
                    continue
                for at in range(0, len(found), 10_000):
                    rows = [(path, at + k, line, name) for k, (line, name) in enumerate(found[at : at + 10_000], 1)]
                    yield pd.DataFrame(rows, columns=schema.names).astype({"line_no": "Int32"})

    return files.select("path").mapInPandas(run, schema)


def decoded_texts(rows: DataFrame, data_col: str, keep: Sequence[str] = (), encodings: Sequence[str] = encoding.ENCODINGS) -> DataFrame:
    """``keep``, ``lines`` (with their ends) and ``encoding`` (of all lines, in one name) of files that a binary column holds; null has neither."""
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("encoding", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole, data_col)):
            found = [None if data is None else encoding.decode_lines(data, encodings) for data in batch.column(data_col).to_pylist()]
            lines = pa.array([None if x is None else [line for line, _ in x] for x in found], pa.list_(pa.string()))
            names = pa.array([None if x is None else encoding.file_label([name for _, name in x]) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lines, names], names=schema.names)

    return _bounded(rows).select(*keep, data_col).mapInArrow(run, schema)


def _preview(line: str, a: int, b: int, width: int = values.PREVIEW_CHARS) -> str:
    if len(line) <= width:
        return line
    right = min(len(line), max(0, (a + b) // 2 - width // 2) + width)
    left = max(0, right - width)
    return ("…" if left else "") + line[left:right] + ("…" if right < len(line) else "")


def search(
    files: DataFrame,
    scan_notes: DataFrame,
    keywords: Sequence[str],
    *,
    regex: bool = False,
    case_sensitive: bool = False,
    extensions: Sequence[str] = EXTENSIONS,
    encodings: Sequence[str] = encoding.ENCODINGS,
    max_bytes: int = MAX_BYTES,
    follow_symlinks: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(hits, skipped) of a folder; hits in order of path, line, pattern and place."""
    candidates = eligible(files, extensions, max_bytes, follow_symlinks)
    found = search_files(candidates.where(F.col("skip_reason").isNull()), compile_all(keywords, regex, case_sensitive), encodings).cache()
    hits = found.where(F.col("skip_reason").isNull()).orderBy("path", "line_no", "pattern_no", "match_span_start").select(*schemas.HITS.names)
    sizes = files.select("path", "size_bytes")
    unread = found.where(F.col("skip_reason").isNotNull()).select("path", F.col("skip_reason").alias("reason")).join(sizes, "path")
    passed = candidates.where(F.col("skip_reason").isNotNull()).select("path", F.col("skip_reason").alias("reason"), "size_bytes")
    noted = scan_notes.select("path", F.when(F.col("kind") == schemas.NOTE_CYCLE, "symlink_cycle").otherwise("dir_read_error").alias("reason"), F.lit(None).cast("long").alias("size_bytes"))
    return hits, passed.unionByName(unread).unionByName(noted).orderBy("path")
