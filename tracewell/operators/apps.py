"""App packages among the files of an inventory, and their facts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import containers, formats

#: Extensions and types of apps.
EXTENSIONS = {".apk": "apk", ".ipa": "ipa"}
TYPES = {containers.KINDS[k][0]: k for k in ("apk", "ipa")}


def candidates(files: DataFrame) -> DataFrame:
    """Files that are apps, may be, or are named so, with ``kind`` and ``structure_ok``.

    kind is apk or ipa, unreadable, not_app, or check for a ZIP whose member
    names are still to be looked at.
    """
    named = F.col("ext_on_disk").isin(*EXTENSIONS)
    kind = F.when(F.col("sig_source") == formats.FAILED, F.when(named, "unreadable"))
    for mime, k in TYPES.items():
        kind = kind.when(F.col("sig_mime") == mime, k)
    kind = kind.when(F.col("sig_mime") == "application/zip", "check").when(named, "not_app")
    return files.withColumns({"kind": kind, "structure_ok": F.coalesce(F.col("sig_mime").isin(*TYPES), F.lit(False))}).where(F.col("kind").isNotNull())


def apps(files: DataFrame, algorithms: Sequence[str] = ()) -> DataFrame:
    """``schemas.APPS`` and the digests of every app; ``files`` has its signature columns."""
    known = candidates(files).withColumnRenamed("sig_desc", "structure_desc")
    given = ["path", "rel_path", "ext_on_disk", "kind", "structure_ok", "structure_desc", *algorithms]
    facts = [n for n in schemas.APPS.names if n not in (*given, "app_type")]
    schema = T.StructType([*(known.schema[c] for c in given), T.StructField("app_type", T.StringType()), *(schemas.APPS[n] for n in facts)])

    def read(path: str, kind: str, ext: str) -> dict[str, str] | None:
        if kind == "check":
            kind = containers.marker(path) or ("not_app" if ext in EXTENSIONS else "")
        if kind in ("apk", "ipa"):
            return {"app_type": kind.upper(), **(containers.android_facts if kind == "apk" else containers.ios_facts)(path)}
        if not kind:
            return None
        status = ("parse_error", "file not readable") if kind == "unreadable" else ("not_app", "named like an app, but no mark of one inside")
        return {"app_type": EXTENSIONS[ext].upper(), "status": status[0], "detail": status[1]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read(r.path, r.kind, r.ext_on_disk) for r in batch.itertuples()]
            there = [x is not None for x in found]
            added = pd.DataFrame([x for x in found if x], columns=["app_type", *facts]).fillna("")
            yield pd.concat([batch[there].reset_index(drop=True), added], axis=1)

    return known.select(*given).mapInPandas(run, schema).select(*schemas.APPS.names, *algorithms).orderBy("path")
