"""Column contracts of every relation that the engine returns, in order."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType()}


def schema(spec: str) -> T.StructType:
    """A schema from ``name:kind`` words."""
    return T.StructType([T.StructField(n, _KINDS[k], True) for n, k in (w.split(":") for w in spec.split())])


INVENTORY = schema(
    "path:s rel_path:s name:s parent:s size_bytes:l mtime_epoch:d atime_epoch:d ctime_epoch:d birthtime_epoch:d is_symlink:b link_target:s link_broken:b"
)
#: A scan carries its failures as rows: ``note_kind`` is null for files.
SCAN = T.StructType([*INVENTORY.fields, *schema("note_kind:s note_reason:s").fields])
SIGNATURE = schema("sig_mime:s sig_ext:s sig_desc:s sig_source:s sig_high_entropy:b ext_on_disk:s ext_mismatch:b")
ERRORS = schema("path:s kind:s reason:s")
HITS = schema("path:s line_no:i match_span_start:i match_span_end:i matched:s pattern:s encoding:s line_preview:s")
SKIPPED = schema("path:s reason:s size_bytes:l")
TIMELINE = schema("ts_epoch:d ts_iso:s event:s ts_suspicious:b path:s rel_path:s name:s size_bytes:l is_symlink:b")
ISSUES = schema("severity:s code:s path:s field:s value:s detail:s")
APPS = schema(
    "path:s rel_path:s ext_on_disk:s app_type:s structure_ok:b structure_desc:s package:s app_name:s version_name:s version_code:s min_os:s target_sdk:s permissions:s signing:s status:s detail:s"
)
DIFF = schema("rel_path:s artifact:s change:s scope:s key:s column:s before:s after:s")

HASH_OK, HASH_READ_ERROR, HASH_LINK, HASH_CHANGED = "ok", "read_error", "symlink_skipped", "changed_during_hash"
NOTE_ERROR, NOTE_CYCLE = "error", "symlink_cycle"
