"""Rules over an inventory, and its comparison with an earlier one."""

from __future__ import annotations

import random
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import values
from ..sink import settled
from ..sources.files import restat
from .content import CHUNK, digests

REQUIRED = ("path", "name", "size_bytes", "mtime_epoch", "atime_epoch")
TIMES = ("mtime_epoch", "atime_epoch", "ctime_epoch", "birthtime_epoch")
MTIME_TOLERANCE = 1e-3
#: Scan options that make two scans comparable.
OPTIONS = ("follow_symlinks", "exclude", "excluded_paths")

_ISSUE = schemas.ISSUES.names


def issue(severity: str, code: str, path: Column, field: str | Column = "", value: Column | None = None, detail: Column | None = None) -> Column:
    blank = F.lit("")
    parts = (F.lit(severity), F.lit(code), path, F.lit(field) if isinstance(field, str) else field, blank if value is None else value, blank if detail is None else detail)
    return F.struct(*(F.coalesce(p.cast("string"), blank).alias(n) for p, n in zip(parts, _ISSUE, strict=True)))


def exploded(rows: DataFrame, rules: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One issue for each rule (condition, issue) that holds for a row; rows are read once."""
    found = F.array(*(F.when(F.coalesce(test, F.lit(False)), what) for test, what in rules))
    return rows.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue")).select("issue.*")


def _empty(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def row_rules(files: DataFrame, now: float, hashed: bool = False) -> list[tuple[Column, Column]]:
    """The rules that look at one row; those over columns that ``files`` lacks are left out."""
    have, path = set(files.columns), F.col("path")
    rules = [((_empty(c) if c in have else F.lit(True)), issue("ERROR", "MISSING_FIELD", path, c, detail=F.lit("required value is missing"))) for c in REQUIRED]
    for c in (t for t in TIMES if t in have):
        raw = F.col(c).cast("string")
        number, there = values.to_number(raw), ~_empty(c)
        rules += [
            (there & number.isNull(), issue("WARN", "TS_BAD_TYPE", path, c, raw, F.lit("not a finite number"))),
            (there & (number <= 0), issue("WARN", "TS_SUSPICIOUS", path, c, raw, F.lit("time is not after 1970"))),
            (there & (number > now + values.DAY), issue("WARN", "TS_FUTURE", path, c, raw, F.lit("time is more than a day ahead"))),
        ]
    if "hash_status" in have:
        if hashed:
            rules.append((F.col("hash_status") == schemas.HASH_READ_ERROR, issue("WARN", "HASH_READ_FAIL", path, detail=F.lit("file not readable"))))
        rules.append((F.col("hash_status") == schemas.HASH_CHANGED, issue("WARN", "CHANGED_DURING_HASH", path, detail=F.lit("size or time changed since the scan"))))
    if "sig_source" in have:
        rules.append((F.col("sig_source") == "error", issue("WARN", "SIGNATURE_READ_FAIL", path, detail=F.lit("file not readable"))))
    if "ext_mismatch" in have:
        told = F.concat_ws(" ", F.col("ext_on_disk"), F.lit("holds"), F.col("sig_mime"), F.col("sig_desc"))
        rules.append((F.col("ext_mismatch").cast("string") == "true", issue("WARN", "EXT_MISMATCH", path, "ext_mismatch", F.lit("True"), told)))
    if "link_broken" in have:
        rules.append((F.col("link_broken").cast("string") == "true", issue("INFO", "LINK_BROKEN", path, detail=F.concat(F.lit("no such target: "), F.coalesce(F.col("link_target"), F.lit(""))))))
    if {"now_size", "now_found"} <= have:
        recorded = values.to_whole(F.col("size_bytes").cast("string"))
        differs = F.col("now_found") & ~F.coalesce(F.col("link_broken"), F.lit(False)) & (F.col("now_size") != recorded)
        rules += [
            ((path != "") & ~F.col("now_found"), issue("ERROR", "FILE_NOT_FOUND", path, detail=F.lit("file can't be reached"))),
            (differs, issue("WARN", "SIZE_MISMATCH", path, "size_bytes", recorded, F.concat(F.lit("size is now "), F.col("now_size").cast("string")))),
        ]
    return rules


def with_current_state(files: DataFrame, follow_symlinks: bool = False) -> DataFrame:
    """Append ``now_found`` and ``now_size`` by looking at each file again."""
    schema = T.StructType([*files.schema.fields, T.StructField("now_found", T.BooleanType()), T.StructField("now_size", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [restat(p, follow_symlinks) if p else None for p in batch["path"]]
            yield batch.assign(now_found=[s is not None for s in found], now_size=pd.array([s and s.st_size for s in found], "Int64"))

    return files.mapInPandas(run, schema)


def duplicate_paths(files: DataFrame) -> DataFrame:
    counts = files.where(F.coalesce("path", F.lit("")) != "").groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.select(issue("WARN", "DUP_PATH", F.col("path"), detail=F.concat(F.lit("recorded times: "), F.col("n").cast("string"))).alias("issue")).select("issue.*")


def check_rows(files: DataFrame, now: float, *, hashed: bool = False, look_again: bool = True, follow_symlinks: bool = False) -> DataFrame:
    """Issues of an inventory by itself."""
    rows = with_current_state(files, follow_symlinks) if look_again else files
    return exploded(rows, row_rules(rows, now, hashed)).unionByName(duplicate_paths(files))


def note_issues(notes: DataFrame) -> DataFrame:
    cycle = F.col("kind") == schemas.NOTE_CYCLE
    return notes.select(
        F.when(cycle, "INFO").otherwise("WARN").alias("severity"),
        F.when(cycle, "SYMLINK_CYCLE_SKIPPED").otherwise("SCAN_ERROR").alias("code"),
        "path",
        F.lit("").alias("field"),
        F.lit("").alias("value"),
        F.col("reason").alias("detail"),
    )


# ---- baseline ------------------------------------------------------------------------------------

def composed(key: Column) -> Column:
    """A key in composed form; only keys outside ASCII leave the JVM."""
    nfc = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x)), "string")
    return F.when(key.rlike(r"^[\x00-\x7f]*$"), key).otherwise(nfc(key))


def _keyed(rows: DataFrame, key: str, columns: Sequence[str], algorithms: Sequence[str], mark: str, order: str | None) -> DataFrame:
    """One row for each key: the last one by ``order`` (any one without an order), and which digests any of its rows has."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("") for c in columns}
    flat = rows.select(F.coalesce(composed(F.col(key).cast("string")), F.lit("")).alias("_key"), *(v.alias(c) for c, v in text.items()), (F.col(order) if order else F.lit(0)).alias("_order"))
    seen = [F.max(F.col(a) != "").alias(f"_{mark}_{a}") for a in algorithms]
    return flat.groupBy("_key").agg(F.max_by(F.struct(*columns), F.col("_order")).alias(mark), *seen)


def compare(
    current: DataFrame,
    baseline: DataFrame,
    algorithms: Sequence[str],
    *,
    key: str | None = None,
    tolerance: float = MTIME_TOLERANCE,
    current_order: str | None = None,
    baseline_order: str | None = None,
) -> DataFrame:
    """Issues between an earlier inventory and this one.

    Keys are relative paths if the baseline has that column.  Both sides meet in
    one full outer join, which is written once: which digests are shared, what
    moved and all other rules are read from that table.  Missing and new keys
    whose digest is unique on either side and equal are one file that moved.
    """
    key = key or ("rel_path" if "rel_path" in baseline.columns else "path")
    usable = [a for a in sorted(algorithms, key=lambda a: a != "sha256") if a in current.columns and a in baseline.columns]
    columns = list(dict.fromkeys(["path", "size_bytes", "mtime_epoch", "is_symlink", "link_target", *usable]))
    sides = _keyed(baseline, key, columns, usable, "b", baseline_order), _keyed(current, key, columns, usable, "c", current_order)
    both = settled(sides[0].join(sides[1], "_key", "full_outer"), "baseline")
    seen = both.agg(F.count(F.lit(1)), *(F.max(f"_{mark}_{a}").alias(f"{mark}_{a}") for mark in "bc" for a in usable)).first()
    shared = [a for a in usable if seen[f"b_{a}"] and seen[f"c_{a}"]]
    both = both.where("_key <> ''").withColumn("_shown", F.coalesce(F.nullif(F.coalesce("c.path", "b.path"), F.lit("")), "_key"))
    if shared:
        alone = F.col("b").isNull() | F.col("c").isNull()
        digest = F.when(alone, F.nullif(F.lower(F.coalesce(F.col(f"b.{shared[0]}"), F.col(f"c.{shared[0]}"))), F.lit("")))
        both = both.withColumn("_digest", digest)
        gone, size = F.col("c").isNull(), values.to_whole(F.col("b.size_bytes"))
        # unique on either side; the counts are partial sums, so a digest that very many files share costs no task
        found = both.where("_digest IS NOT NULL").groupBy("_digest")
        moves = found.agg(F.count_if(gone).alias("olds"), F.count_if(~gone).alias("news"), F.max(F.when(gone, size)).alias("size"), F.max(F.when(gone, F.col("_key"))).alias("_from"), F.max(F.when(~gone, F.col("_key"))).alias("_into"), F.max(F.when(~gone, F.col("_shown"))).alias("_at"))
        moves = moves.where("olds = 1 AND news = 1 AND size <> 0").select("_digest", "_from", "_into", "_at")
        both = both.join(moves, "_digest", "left")
        left, first = F.col("_from").isNull(), []
        rules = [(left & fails, found) for fails, found in _pair_rules(shared, tolerance)]
        rules.append((~left & gone, issue("WARN", "MOVED", F.col("_at"), detail=F.concat("_from", F.lit(" -> "), "_into"))))
    else:
        spark = current.sparkSession
        detail = "no digest has values on both sides, so contents were not compared"
        first = [spark.createDataFrame([("WARN", "BASELINE_NO_HASH", "", "", "", detail)], schemas.ISSUES)]
        rules = _pair_rules(shared, tolerance)
    out = exploded(both, rules)
    for more in first:
        out = more.unionByName(out)
    return out


def _pair_rules(shared: Sequence[str], tolerance: float) -> list[tuple[Column, Column]]:
    path, old, new = F.col("_shown"), F.col("b"), F.col("c")
    here = old.isNotNull() & new.isNotNull()
    rules = [
        (new.isNull(), issue("ERROR", "BASELINE_MISSING", path, detail=F.concat(F.lit("was in the baseline: "), "_key"))),
        (old.isNull(), issue("WARN", "BASELINE_NEW", path, detail=F.concat(F.lit("was not in the baseline: "), "_key"))),
    ]
    compared = F.lit(False)
    for a in shared:
        x, y = F.lower(F.col(f"b.{a}")), F.lower(F.col(f"c.{a}"))
        valued = (x != "") & (y != "")
        compared = compared | valued
        rules.append((here & valued & (x != y), issue("ERROR", "HASH_CHANGED", path, a, x, F.concat(F.lit(f"{a} "), F.left(x, F.lit(12)), F.lit(" -> "), F.left(y, F.lit(12))))))
    if shared:
        link = F.lower(F.col("c.is_symlink")) == "true"
        rules.append((here & ~compared & ~link, issue("WARN", "HASH_NOT_COMPARED", path, detail=F.lit("a digest is missing on one side"))))
    s0, s1 = values.to_whole(F.col("b.size_bytes")), values.to_whole(F.col("c.size_bytes"))
    m0, m1 = values.to_number(F.col("b.mtime_epoch")), values.to_number(F.col("c.mtime_epoch"))
    l0, l1 = F.col("b.link_target"), F.col("c.link_target")
    arrow = lambda x, y: F.concat_ws(" -> ", x.cast("string"), y.cast("string"))
    return [
        *rules,
        (here & (s0 != s1), issue("WARN", "SIZE_CHANGED", path, "size_bytes", s0, arrow(s0, s1))),
        (here & (F.abs(m0 - m1) > tolerance), issue("WARN", "MTIME_CHANGED", path, "mtime_epoch", F.col("b.mtime_epoch"), arrow(m0, m1))),
        (here & (l0 != l1), issue("WARN", "LINK_TARGET_CHANGED", path, "link_target", l0, arrow(l0, l1))),
    ]


def option_issues(baseline: dict | None, current: dict) -> list[tuple]:
    """Issues where the two scans' options differ; rows of ``schemas.ISSUES``."""
    if baseline is None:
        return [("INFO", "BASELINE_META_MISSING", "", "", "", "no scan record beside the baseline")]
    plain = lambda v: sorted(map(str, v)) if isinstance(v, list) else v
    pairs = ((k, plain(baseline.get(k)), plain(current.get(k))) for k in OPTIONS)
    return [("WARN", "BASELINE_OPTIONS_DIFFER", "", k, str(a), f"{k}: {a} -> {b}") for k, a, b in pairs if a != b]


# ---- sampled re-hashing ------------------------------------------------------------------------


def sample_ordinals(n: int, ratio: float = 0.05, least: int = 5, most: int = 200, seed: int = 0) -> list[int]:
    """Which of ``n`` rows in order are hashed again."""
    return random.Random(seed).sample(range(n), min(max(int(n * ratio), least), most, n))


def recheck(files: DataFrame, algorithms: Sequence[str], *, chunk: int = CHUNK, **sampling) -> DataFrame:
    """Issues of a sample of the hashed files, read and hashed once more."""
    hashed = F.lit(False)
    for a in algorithms:
        hashed = hashed | (F.coalesce(F.col(a), F.lit("")) != "")
    rows = files.where(hashed & (F.coalesce("path", F.lit("")) != "")).select("path", *algorithms)
    # numbered in order of path: the number of a row is the rows of smaller parts and those before it in its own
    dealt = rows.repartitionByRange("path").sortWithinPartitions("path", *algorithms).withColumn("_id", F.monotonically_increasing_id()).cache()
    part = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = {}, 0
    for p in sorted(sizes):
        starts[p], at = at, at + sizes[p]
    wanted = set()
    for k in sample_ordinals(at, **sampling):
        p = max(q for q in starts if starts[q] <= k and k < starts[q] + sizes[q])
        wanted.add((p << 33) + k - starts[p])
    chosen = dealt.where(F.col("_id").isin(*wanted)) if wanted else dealt.limit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                found = digests(row["path"], list(algorithms), chunk)
                if found is None:
                    out.append(("WARN", "HASH_VERIFY_READ_FAIL", row["path"], "", "", "file not readable"))
                for a, now in (found or {}).items():
                    old = (row[a] or "").lower()
                    if old and old != now:
                        out.append(("ERROR", "HASH_VERIFY_FAIL", row["path"], a, old, f"{a} is now {now[:12]}"))
            yield pd.DataFrame(out, columns=_ISSUE)

    return chosen.select("path", *algorithms).mapInPandas(run, schemas.ISSUES)


def summary(issues: DataFrame) -> DataFrame:
    """Counts by severity and by code, in one pass."""
    sets = issues.groupingSets([("severity",), ("code",)], "severity", "code").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.coalesce("severity", "code").alias("name"), "n").orderBy("name")
