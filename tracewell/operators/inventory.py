"""A folder as a table: metadata, and on request digests and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources import files
from . import content


def inventory(scanned: DataFrame) -> DataFrame:
    """The files of a scan."""
    return scanned.where(F.col("note_kind").isNull()).select(*schemas.INVENTORY.names)


def notes(scanned: DataFrame) -> DataFrame:
    """What a scan could not read, and the folders that it would have met again."""
    return scanned.where(F.col("note_kind").isNotNull()).select("path", F.col("note_kind").alias("kind"), F.col("note_reason").alias("reason"))


def build(
    spark: SparkSession,
    root: str,
    *,
    follow_symlinks: bool = False,
    exclude: list[str] | None = None,
    exclude_paths: list[str] | None = None,
    algorithms: list[str] | None = None,
    chunk: int = content.CHUNK,
    signature: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(inventory, notes) of a folder; hash and signature columns exist only on request."""
    scanned = files.scan(spark, root, follow_symlinks, exclude, exclude_paths)
    out = inventory(scanned)
    if algorithms:
        out = content.with_hashes(out, algorithms, chunk, follow_symlinks)
    if signature:
        out = content.with_signature(out, follow_symlinks)
    return out, notes(scanned)
