"""Columns that need a file's bytes: digests and formats.  One pass of Arrow batches over paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import formats, values
from ..sources.files import restat

CHUNK = 1 << 20


def digests(path: str, algorithms: list[str], chunk: int = CHUNK) -> dict[str, str] | None:
    """All digests of a file in one reading; None if it can't be read."""
    if chunk < 1:
        raise ValueError("the chunk size must be positive")
    states = {a: hashlib.new(a) for a in algorithms}
    try:
        with open(path, "rb") as f:
            while block := f.read(chunk):
                for s in states.values():
                    s.update(block)
    except OSError:
        return None
    return {a: s.hexdigest() for a, s in states.items()}


def usable_algorithms(names: list[str]) -> list[str]:
    """Lower-case, distinct digest names; ValueError for one that can't be used."""
    if not names:
        raise ValueError("no hash algorithm given")
    out = []
    for name in names:
        low = name.strip().lower()
        try:
            hashlib.new(low).hexdigest()
        except TypeError:
            raise ValueError(f"{name} needs an output length") from None
        except ValueError:
            raise ValueError(f"unknown hash algorithm: {name}") from None
        out.append(low)
    return list(dict.fromkeys(out))


def _unchanged(row, follow: bool) -> bool:
    st = restat(row.path, follow)
    return st is not None and st.st_size == row.size_bytes and abs(st.st_mtime - row.mtime_epoch) <= 1e-6


def with_hashes(files: DataFrame, algorithms: list[str], chunk: int = CHUNK, follow_symlinks: bool = False) -> DataFrame:
    """Append one column for each algorithm and ``hash_status``.

    ``files`` needs path, size_bytes, mtime_epoch and is_symlink.  Links are
    not read unless they are followed; what can't be read has empty digests.
    """
    algorithms = usable_algorithms(algorithms)
    if chunk < 1:
        raise ValueError("the chunk size must be positive")
    new = [*algorithms, "hash_status"]
    kept = T.StructType([f for f in files.schema.fields if f.name not in new])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                if row.is_symlink and not follow_symlinks:
                    rows.append({"hash_status": schemas.HASH_LINK})
                    continue
                found = digests(row.path, algorithms, chunk) if row.path else None
                if found is None:
                    rows.append({"hash_status": schemas.HASH_READ_ERROR})
                else:
                    rows.append(found | {"hash_status": schemas.HASH_OK if _unchanged(row, follow_symlinks) else schemas.HASH_CHANGED})
            added = pd.DataFrame(rows, columns=new, index=batch.index).fillna("")
            yield pd.concat([batch, added], axis=1)

    schema = T.StructType([*kept.fields, *(T.StructField(n, T.StringType()) for n in new)])
    return files.select(*kept.names).mapInPandas(run, schema)


_PROBED = schemas.schema("sig_mime:s sig_ext:s sig_desc:s sig_source:s sig_high_entropy:b hidden:b")


def types_of_bytes(rows: DataFrame, data_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``mime``, ``usual_ext`` and ``found_by`` of files that a binary column holds, by their first bytes."""
    added = ("mime", "usual_ext", "found_by")
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(c, T.StringType()) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [formats.by_head(x) if x else (formats.EMPTY_TYPES[0], "", "", "empty") for x in batch.column("_head").to_pylist()]
            columns = [pa.array([h[k] for h in heads], pa.string()) for k in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=schema.names)

    return rows.select(*keep, F.substring(data_col, 1, formats.SAMPLE).alias("_head")).mapInArrow(run, schema)


def with_signature(files: DataFrame, follow_symlinks: bool = False) -> DataFrame:
    """Append the columns of ``schemas.SIGNATURE``; the mismatch rule runs in the JVM."""
    kept = T.StructType([f for f in files.schema.fields if f.name not in {*schemas.SIGNATURE.names, "hidden"}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blank = {"sig_mime": "", "sig_ext": "", "sig_high_entropy": None, "hidden": False}
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                if row.is_symlink and not follow_symlinks:
                    rows.append(blank | {"sig_desc": "symbolic link, not followed", "sig_source": formats.LINK})
                    continue
                found = formats.probe(row.path) if row.path else None
                rows.append(found or blank | {"sig_desc": "file not readable", "sig_source": formats.FAILED})
            added = pd.DataFrame(rows, columns=_PROBED.names, index=batch.index).astype({"sig_high_entropy": object})
            yield pd.concat([batch, added], axis=1)

    out = files.select(*kept.names).mapInPandas(run, T.StructType([*kept.fields, *_PROBED.fields]))
    out = out.withColumn("ext_on_disk", values.disk_extension(F.col("path")))
    read = ~F.col("sig_source").isin(formats.LINK, formats.FAILED)
    wrong = formats.extension_mismatch(F.col("ext_on_disk"), F.col("sig_mime"), F.col("sig_ext"), F.col("hidden"))
    out = out.withColumn("ext_mismatch", F.coalesce(read & wrong, F.lit(False)))
    return out.select(*kept.names, *schemas.SIGNATURE.names)
