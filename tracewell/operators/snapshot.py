"""Two snapshots of a folder compared: files, database rows and columns, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import values
from ..sources import artifacts
from . import content, inventory

MAX_CHANGES = 1000


def change(rel: Column, artifact: Column, code: Column, **parts: Column) -> list[Column]:
    """The columns of ``schemas.DIFF``; what isn't given is empty."""
    given = {"rel_path": rel, "artifact": artifact, "change": code, **parts}
    return [F.coalesce(given.get(n, F.lit("")), F.lit("")).alias(n) for n in schemas.DIFF.names]


# ---- generic: any keyed tables --------------------------------------------------------------


def row_changes(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys, ``change``, ``column``, ``before`` and ``after`` for rows that differ.

    One full outer join; added and deleted rows give one row each, changed rows
    one for each column that differs (nulls are equal to nulls).
    """
    text = lambda c: F.col(c).cast("string")
    packed = lambda df, name: df.select(*keys, F.struct(*(text(c).alias(c) for c in columns)).alias(name))
    both = packed(before, "b").join(packed(after, "a"), keys, "full_outer")

    def whole(side: str) -> Column:
        return F.concat_ws("; ", *(F.concat(F.lit(f"{c}="), values.value_text(F.col(f"{side}.{c}"))) for c in columns))

    cells = F.array(
        *(
            F.when(
                ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")),
                F.struct(F.lit("ROW_CHANGED").alias("change"), F.lit(c).alias("column"), values.value_text(F.col(f"b.{c}")).alias("before"), values.value_text(F.col(f"a.{c}")).alias("after")),
            )
            for c in columns
        )
    )
    single = lambda code, x, y: F.array(F.struct(F.lit(code).alias("change"), F.lit("").alias("column"), x.alias("before"), y.alias("after")))
    blank = F.lit("")
    found = F.when(F.col("b").isNull(), single("ROW_ADDED", blank, whole("a"))).when(F.col("a").isNull(), single("ROW_DELETED", whole("b"), blank)).otherwise(cells)
    return both.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def capped(changes: DataFrame, group: list[str], order: list[Column], most: int = MAX_CHANGES) -> tuple[DataFrame, DataFrame]:
    """(the first ``most`` changes of each group, group and ``omitted`` for the others)."""
    numbered = changes.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    counts = changes.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return numbered.where(F.col("_n") <= most).drop("_n"), counts.select(*group, (F.col("n") - most).alias("omitted"))


def keyed_changes(before: DataFrame, after: DataFrame, group: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """KEY_ADDED, KEY_DELETED and KEY_CHANGED between two tables of keys and values."""
    both = before.select(*group, key, F.col(value).alias("b"), F.lit(True).alias("in_b")).join(
        after.select(*group, key, F.col(value).alias("a"), F.lit(True).alias("in_a")), [*group, key], "full_outer"
    )
    code = F.when(F.col("in_b").isNull(), "KEY_ADDED").when(F.col("in_a").isNull(), "KEY_DELETED").when(~F.col("a").eqNullSafe(F.col("b")), "KEY_CHANGED")
    text = lambda c, there: F.when(F.col(there), values.value_text(F.col(c))).otherwise("")
    return both.select(*group, key, code.alias("change"), text("b", "in_b").alias("before"), text("a", "in_a").alias("after")).where(F.col("change").isNotNull())


def flat_json(rows: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """Top-level keys of JSON objects as rows of ``keep``, ``key`` and ``value``."""
    entries = F.from_json(F.col(json_col), T.MapType(T.StringType(), T.StringType()))
    return rows.select(*keep, F.explode(entries).alias("key", "value"))


# ---- folders --------------------------------------------------------------------------------------


def snapshot(spark: SparkSession, root: str, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files with digest and kind of artifact, notes) of a folder; links are left out."""
    files, notes = inventory.build(spark, root, exclude=exclude)
    files = content.with_hashes(files.where(~F.col("is_symlink")), ["sha256"])
    kind = F.pandas_udf(lambda paths: paths.map(artifacts.kind_of), "string")
    return files.select("rel_path", "path", "size_bytes", "sha256", "hash_status").withColumn("kind", kind("path")), notes


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both sides of every file that differs, with its ``change``.

    Files that could be read on neither side are not taken for equal: they are
    FILE_NOT_COMPARED.
    """
    b = before.select("rel_path", F.struct("path", "size_bytes", "sha256", "kind").alias("b"))
    a = after.select("rel_path", F.struct("path", "size_bytes", "sha256", "kind").alias("a"))
    both = b.join(a, "rel_path", "full_outer")
    digest = lambda s: F.coalesce(F.col(f"{s}.sha256"), F.lit(""))
    code = (
        F.when(F.col("b").isNull(), "FILE_ADDED")
        .when(F.col("a").isNull(), "FILE_DELETED")
        .when((digest("b") == "") & (digest("a") == ""), "FILE_NOT_COMPARED")
        .when(digest("b") != digest("a"), "FILE_MODIFIED")
    )
    return both.withColumn("change", code).where(F.col("change").isNotNull())


def _summary(side: str) -> Column:
    text = F.concat(F.lit("size="), F.col(f"{side}.size_bytes").cast("string"), F.lit(" sha256="), F.left(F.col(f"{side}.sha256"), F.lit(16)))
    return F.when(F.col(side).isNotNull(), text).otherwise("")


def _records(files: DataFrame, side: str) -> DataFrame:
    there = files.where(F.col(side).isNotNull()).select("rel_path", F.col(f"{side}.path").alias("path"), "artifact")
    return artifacts.records(there)


def compare(spark: SparkSession, before_root: str, after_root: str, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes in order, notes) between two folders; only files that differ are parsed."""
    before, notes_b = snapshot(spark, before_root, exclude)
    after, notes_a = snapshot(spark, after_root, exclude)
    before, after = before.cache(), after.cache()
    changed = file_changes(before, after).cache()
    kind = F.coalesce("a.kind", "b.kind")
    files = changed.select(*change(F.col("rel_path"), kind, F.col("change"), before=_summary("b"), after=_summary("a")), F.lit(0).alias("_phase"), F.array().cast("array<struct<kind:int,number:double,text:string>>").alias("_order"))

    # a changed log counts as a change of its database, if both sides of that are databases
    mains = changed.select(F.explode(F.array(F.when(kind == artifacts.SQLITE, F.col("rel_path")), values.sidecar_main(F.col("rel_path")))).alias("rel_path"))
    mains = mains.where(F.col("rel_path").isNotNull()).distinct()
    side = lambda df, s: df.select("rel_path", F.struct("path", "kind").alias(s))
    databases = mains.join(side(before, "b"), "rel_path", "left").join(side(after, "a"), "rel_path", "left")
    is_db = lambda s: F.coalesce(F.col(f"{s}.kind") == artifacts.SQLITE, F.col(s).isNull())
    databases = databases.where((F.col("a").isNotNull() | F.col("b").isNotNull()) & is_db("a") & is_db("b")).withColumn("artifact", F.lit(artifacts.SQLITE))
    same_kind = F.coalesce(F.col("a.kind") == F.col("b.kind"), F.lit(True))
    settings = changed.where(kind.isin(artifacts.PREFS, artifacts.PLIST) & same_kind).select("rel_path", F.struct("b.path").alias("_b"), "a", "b", kind.alias("artifact")).drop("_b")

    cells = []
    for s in ("b", "a"):
        cells.append(_records(databases, s).unionByName(_records(settings, s)).cache())
    out = files.unionByName(_record_changes(*cells))
    # files with their settings by path, then the rows of databases
    order = [F.col("_phase") == 2, "rel_path", "_phase", "scope", "_order", "key", "column"]
    return out.orderBy(*order).select(*schemas.DIFF.names), notes_b.unionByName(notes_a)


def _record_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two tables of artifact records."""
    group = ["rel_path", "artifact", "scope"]
    no_order = F.array().cast("array<struct<kind:int,number:double,text:string>>")

    errors = lambda df, name: df.where(F.col("error").isNotNull()).groupBy(*group).agg(F.min("error").alias(name))
    failed = errors(before, "b").join(errors(after, "a"), group, "full_outer")
    phase = F.when(F.col("artifact") == artifacts.SQLITE, 2).otherwise(1)
    told = failed.select(*change(F.col("rel_path"), F.col("artifact"), F.lit("PARSE_ERROR"), scope=F.col("scope"), before=F.col("b"), after=F.col("a")), phase.alias("_phase"), no_order.alias("_order"))
    # an artifact that could not be opened on one side is not compared at all; a table neither
    dead = failed.where(F.col("scope") == "").select("rel_path").distinct()
    usable = lambda df: df.where(F.col("error").isNull()).join(dead, "rel_path", "left_anti").join(failed.select(*group), group, "left_anti")
    before, after = usable(before), usable(after)

    sizes = lambda df, name: df.where(F.col("artifact") == artifacts.SQLITE).groupBy(*group).agg(F.count("key_id").alias(name))
    tables = sizes(before, "nb").join(sizes(after, "na"), group, "full_outer").where(F.col("nb").isNull() | F.col("na").isNull())
    rows_text = lambda n: F.concat(F.col(n).cast("string"), F.lit(" rows"))
    code = F.when(F.col("nb").isNull(), "TABLE_ADDED").otherwise("TABLE_DELETED")
    made = tables.select(*change(F.col("rel_path"), F.col("artifact"), code, scope=F.col("scope"), before=rows_text("nb"), after=rows_text("na")), F.lit(2).alias("_phase"), no_order.alias("_order"))

    pack = lambda df, name: df.where(F.col("key_id").isNotNull()).groupBy(*group, "key_id").agg(F.max_by(F.struct("key", "key_order", "row_text", "columns"), F.lit(0)).alias(name))
    both = pack(before, "b").join(pack(after, "a"), [*group, "key_id"], "full_outer").withColumns({"key": F.coalesce("a.key", "b.key"), "key_order": F.coalesce("a.key_order", "b.key_order")})
    prefix = F.when(F.col("artifact") == artifacts.SQLITE, "ROW_").otherwise("KEY_")
    names = F.array_sort(F.array_union(F.map_keys("b.columns"), F.map_keys("a.columns")))
    null_value = F.struct(F.lit("n").alias("same"), F.lit("NULL").alias("shown"))
    cell = lambda s, c: F.coalesce(F.try_element_at(F.col(f"{s}.columns"), c), null_value)
    item = lambda code, column, x, y: F.struct(code.alias("change"), column.alias("column"), x.alias("before"), y.alias("after"))
    differing = F.filter(names, lambda c: cell("b", c)["same"] != cell("a", c)["same"])
    changes = F.transform(differing, lambda c: item(F.concat(prefix, F.lit("CHANGED")), c, cell("b", c)["shown"], cell("a", c)["shown"]))
    blank = F.lit("")
    found = (
        F.when(F.col("b").isNull(), F.array(item(F.concat(prefix, F.lit("ADDED")), blank, blank, F.col("a.row_text"))))
        .when(F.col("a").isNull(), F.array(item(F.concat(prefix, F.lit("DELETED")), blank, F.col("b.row_text"), blank)))
        .otherwise(changes)
    )
    rows = both.select(*group, "key", "key_order", F.explode(found).alias("x")).select(*group, "key", "key_order", "x.*")
    keyed, tabled = rows.where(F.col("artifact") != artifacts.SQLITE), rows.where(F.col("artifact") == artifacts.SQLITE)
    kept, omitted = capped(tabled, group, [F.col("key_order"), F.col("key"), F.col("column")])
    shape = lambda df, n: df.select(*schemas.DIFF.names, F.lit(n).alias("_phase"), F.col("key_order").alias("_order"))
    last = F.array(F.struct(F.lit(9).alias("kind"), F.lit(0.0).alias("number"), F.lit("").alias("text")))
    text = F.concat(F.lit("further changes left out: "), F.col("omitted").cast("string"))
    cut = omitted.select(*change(F.col("rel_path"), F.col("artifact"), F.lit("TRUNCATED"), scope=F.col("scope"), after=text), F.lit(2).alias("_phase"), last.alias("_order"))
    return told.unionByName(made).unionByName(shape(keyed, 1)).unionByName(shape(kept, 2)).unionByName(cut)
