"""Merkle fixity audit of web archive records and their replicas.

Records are laid out in archive files by key; each has an offset and a length
there.  The hash of a record is a leaf.  ``FAN`` neighbouring leaves, which
cover one range of offsets, make a node, and so on up to the root of the file.
Replicas are compared from the roots down, and only below nodes that differ,
so a sound file costs one comparison and a damaged record costs ``FAN`` of them
on each level.  Everything is DataFrame operations; a group never has more than
``FAN`` rows.

Defined cases: null payloads and addresses are hashed as empty; an empty table
has no roots; records with equal keys keep their order by digest; a null key
sorts first; a replica may lack records, have more of them, or lack files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FAN = 16
#: Records of one archive file, by position of the key.
FILE_KEYS = 4096


def record_bytes(key: Column, address: Column, payload: Column) -> Column:
    """One response record as it stands in an archive file."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(address, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, key_col: str = "page_id", address_col: str = "url", payload_col: str = "html", file_keys: int = FILE_KEYS) -> DataFrame:
    """key, file, leaf number, offset, length and digest of every record."""
    key = F.col(key_col)
    record = record_bytes(key, F.col(address_col), F.col(payload_col))
    rows = pages.select(
        key.alias("key"),
        F.coalesce(F.floor(key / file_keys), F.lit(-1)).cast("long").alias("file"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record.cast("binary"), 256).alias("digest"),
    )
    order = Window.partitionBy("file").orderBy(F.col("key").asc_nulls_first(), "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"leaf": (F.row_number().over(order) - 1).cast("long"), "offset": F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")})


def _above(nodes: DataFrame) -> DataFrame:
    """The nodes one level up: node number, digest and range of offsets."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]), "")
    grouped = nodes.groupBy("file", F.floor(F.col("node") / FAN).cast("long").alias("up"))
    out = grouped.agg(F.sha2(joined.cast("binary"), 256).alias("digest"), F.min("offset").alias("offset"), F.sum("length").alias("length"))
    return out.withColumnRenamed("up", "node")


def tree(leaf_rows: DataFrame) -> list[DataFrame]:
    """Levels of the tree from the leaves to the roots, each (file, node, digest, offset, length)."""
    levels = [leaf_rows.select("file", F.col("leaf").alias("node"), "digest", "offset", "length")]
    most = leaf_rows.agg(F.max("leaf")).first()[0]
    while most is not None and most > 0:
        levels.append(cut(_above(levels[-1]), "merkle"))
        most //= FAN
    return levels


def mismatches(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(file, node) of the leaves that differ, found by descent from the roots."""
    height = max(len(ours), len(theirs))

    def level(levels: list[DataFrame], k: int) -> DataFrame:
        rows = levels[min(k, len(levels) - 1)]
        # a lower tree is compared as if single nodes stood above its root
        return rows.select("file", "node", "digest")

    suspects = None
    for k in range(height - 1, -1, -1):
        a, b = level(ours, k), level(theirs, k)
        if suspects is not None:
            below = suspects.select("file", F.col("node").alias("up")).distinct()
            a, b = (x.withColumn("up", F.floor(F.col("node") / FAN).cast("long")).join(below, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        both = a.join(b.withColumnRenamed("digest", "other"), ["file", "node"], "full_outer")
        suspects = cut(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("file", "node"), "suspects")
    return suspects


def audit(pages: DataFrame, replica: DataFrame, **columns) -> DataFrame:
    """One row per record of either side: place, digest and ``status``.

    ``status`` is ok, altered, missing (not in the replica) or added (only
    there).  Records are told apart by key within their file; the descent runs
    over leaf ranges, and only files with differing roots are descended.
    """
    mine, other = cut(leaves(pages, **columns), "leaves"), cut(leaves(replica, **columns), "leaves")
    # leaves of both sides stand at the place of their key, so a lost record does not shift those behind it
    places = mine.select("file", "key").unionByName(other.select("file", "key")).distinct()
    order = Window.partitionBy("file").orderBy(F.col("key").asc_nulls_first())
    places = cut(places.withColumn("leaf", (F.row_number().over(order) - 1).cast("long")), "places")

    def placed(rows: DataFrame) -> DataFrame:
        same = (rows["file"] == places["file"]) & rows["key"].eqNullSafe(places["key"])
        at = rows.drop("leaf").join(places.withColumnRenamed("leaf", "_leaf"), same).select(rows["file"], F.col("_leaf").alias("leaf"), "offset", "length", "digest")
        # records that share a key share a leaf
        digest = F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), "").cast("binary"), 256)
        return cut(at.groupBy("file", "leaf").agg(digest.alias("digest"), F.min("offset").alias("offset"), F.sum("length").alias("length")), "placed")

    bad = mismatches(tree(placed(mine)), tree(placed(other)))
    bad_keys = places.join(bad.withColumnRenamed("node", "leaf"), ["file", "leaf"]).select("file", F.col("key").alias("bad_key"), F.lit(True).alias("bad"))
    there = other.select(F.col("file").alias("f"), F.col("key").alias("k"), F.lit(True).alias("there")).distinct()
    rows = mine.drop("leaf").join(bad_keys, (mine["file"] == bad_keys["file"]) & mine["key"].eqNullSafe(bad_keys["bad_key"]), "left").drop(bad_keys["file"])
    rows = rows.join(there, (rows["file"] == there["f"]) & rows["key"].eqNullSafe(there["k"]), "left")
    status = F.when(F.col("bad").isNull(), "ok").when(F.col("there").isNull(), "missing").otherwise("altered")
    known = mine.select(F.col("file").alias("f"), F.col("key").alias("k")).distinct()
    added = other.join(known, (other["file"] == known["f"]) & other["key"].eqNullSafe(known["k"]), "left_anti").withColumn("status", F.lit("added"))
    columns = ["key", "file", "offset", "length", "digest", "status"]
    return rows.withColumn("status", status).select(columns).unionByName(added.select(columns))


def damaged(pages: DataFrame, key_col: str = "page_id", payload_col: str = "html", rate: int = 53) -> DataFrame:
    """A replica with simulated damage: of ``rate`` records about one has a byte changed and one is lost."""
    draw = F.pmod(F.coalesce(F.col(key_col), F.lit(0)) * 40503 + 7, F.lit(rate))
    broken = F.concat(F.lit("~"), F.substring(F.col(payload_col), 2, 1 << 30))
    return pages.where(draw != 1).withColumn(payload_col, F.when(draw == 0, broken).otherwise(F.col(payload_col)))
