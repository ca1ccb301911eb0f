"""Times of files as events in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import schemas
from ..functions import values

#: Time columns and the names of their events.
EVENTS = (("birthtime_epoch", "Created"), ("ctime_epoch", "MetadataChanged"), ("mtime_epoch", "Modified"), ("atime_epoch", "Accessed"))
KEPT = ("path", "rel_path", "name", "size_bytes", "is_symlink")


def timeline(files: DataFrame, now: float, offset_minutes: int = 0, events=EVENTS, kept=KEPT) -> DataFrame:
    """One row for each usable time, in no order; ``now`` (epoch seconds) is fixed by the caller.

    Times that are missing or not finite make no event.  Columns of ``kept``
    that ``files`` lacks are null.
    """
    if not -1440 < offset_minutes < 1440:
        raise ValueError("the offset must be less than a day")
    have = [(c, label) for c, label in events if c in files.columns]

    def number(c: str) -> Column:
        if isinstance(files.schema[c].dataType, NumericType):
            value = F.col(c).cast("double")
            return F.when(values.finite(value), value)
        return values.to_number(F.col(c).cast("string"))

    made = F.array(*(F.struct(number(c).alias("ts_epoch"), F.lit(label).alias("event")) for c, label in have))
    base = [F.col(k) if k in files.columns else F.lit(None).cast(schemas.TIMELINE[k].dataType).alias(k) for k in kept]
    rows = files.select(*base, F.explode(F.filter(made, lambda e: e["ts_epoch"].isNotNull())).alias("e")).select("e.*", *kept)
    rows = rows.withColumns({"ts_iso": values.iso_time(F.col("ts_epoch"), offset_minutes), "ts_suspicious": values.suspicious_time(F.col("ts_epoch"), now)})
    order = [c for c in schemas.TIMELINE.names if c in rows.columns] + [k for k in kept if k not in schemas.TIMELINE.names]
    return rows.select(*order)


def ordered(events: DataFrame) -> DataFrame:
    """Events in order of time, for results that are written as one file."""
    return events.orderBy("ts_epoch", "path", "event")
