"""The registered queries over the shared tables, each with its SQL twin.

Every query runs an operator of the engine over whole tables; the tables stand
in for evidence (documents are files with contents, orders are database rows,
events are settings and times).  Second snapshots are made of the same tables
by rules on values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, values
from ..operators import content, search, snapshot, timeline, validate
from ..sources import artifacts

#: Moments that stand for now; fixed, so that results are the same every day.
NOW_EVENTS, NOW_ORDERS = 1_705_000_000.0, 900_000_000.0
KEYWORD, PATTERN, TOKEN = "tion", "tion|ing|é", "token"
GLOBS = ["*.example.com/*", "*page=?&*", "https://m.*", "[!h]*"]
MAX_FILE = 4000
#: Numbers of rows for which the SQL of the sample holds the drawn ordinals.
SAMPLED = (0, 200, 1000, 10_000, 51_282, 256_410)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path() -> Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))


# ---- files ---------------------------------------------------------------------------------------


def inventory_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", document_path())
    name = F.element_at(F.split("path", "/"), -1)
    return docs.select("path", name.alias("name"), F.col("source").alias("parent"), F.octet_length("text").cast("long").alias("size_bytes"), values.disk_extension(F.col("path")).alias("ext"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1")


def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.pandas_udf(lambda data: data.map(lambda b: formats.entropy_bits(b or b"")), "double")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), bits(F.col("text").cast("binary")).alias("e"))
    high = (F.col("n_bytes") >= 256) & (F.col("e") >= 7.0)
    return docs.select("doc_id", "n_bytes", F.round("e", 5).alias("entropy"), high.alias("high_entropy"))


# ---- baseline -------------------------------------------------------------------------------------


def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def listed(path: Column, text: Column) -> list[Column]:
        return [path.alias("path"), path.alias("rel_path"), F.octet_length(text).alias("size_bytes"), F.lit(1).alias("mtime_epoch"), F.sha2(text, 256).alias("sha256")]

    current = docs.where("source <> 'src5'").select(*listed(document_path(), F.col("text")))
    before_path = F.when(F.col("lang") == "es", F.concat(F.lit("archive/"), document_path())).otherwise(document_path())
    before_text = F.when(F.col("n_chars") < 300, F.concat(F.col("text"), F.lit("."))).otherwise(F.col("text"))
    baseline = docs.where("source <> 'src7'").select(*listed(before_path, before_text))
    return validate.compare(current, baseline, ["md5", "sha256"])


def _event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type"), F.floor(F.col("value")).cast("string")).alias("path"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("name"),
        F.when(F.col("value") >= 1, F.floor(F.col("value") * 100).cast("long")).alias("size_bytes"),
        F.when(F.col("event_type") == "error", 0 - seconds).otherwise(seconds).alias("mtime_epoch"),
        F.when(F.col("event_type") == "click", "never").otherwise(seconds.cast("string")).alias("atime_epoch"),
        F.when(F.col("event_type") == "signup", "read_error").otherwise("ok").alias("hash_status"),
    )


def issue_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check_rows(_event_files(spark, sf_dir), NOW_EVENTS, hashed=True, look_again=False)


def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(issue_rules(spark, sf_dir))


def rehash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = validate.sample_ordinals(docs.count())
    ordinals = spark.createDataFrame([(k,) for k in wanted], "ordinal long")
    # ids are the ordinals of the rows in order: unique and without gaps
    return docs.join(F.broadcast(ordinals), docs["doc_id"] == ordinals["ordinal"], "left_semi").select("doc_id", F.sha2("text", 256).alias("sha256"))


# ---- times ----------------------------------------------------------------------------------------


def order_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"),
        F.col("o_orderpriority").alias("rel_path"),
        F.col("l_returnflag").alias("name"),
        F.col("l_quantity").cast("long").alias("size_bytes"),
        F.lit(False).alias("is_symlink"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("double").alias("mtime_epoch"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("birthtime_epoch"),
        F.when(F.col("o_orderstatus") == "F", F.lit("nan")).when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(F.lit("-1")).alias("atime_epoch"),
    )
    return timeline.timeline(rows, NOW_ORDERS, 540)


# ---- search ---------------------------------------------------------------------------------------


def _document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))


def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.decoded_texts(_document_bytes(spark, sf_dir), "data", ["doc_id"])
    return rows.select("doc_id", F.posexplode("lines").alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_bytes(_document_bytes(spark, sf_dir), "data", search.compile_all([KEYWORD], case_sensitive=True), ["doc_id"])
    return found.select("doc_id", "line_no", "match_span_start", "match_span_end", "matched", "pattern")


def hit_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_bytes(_document_bytes(spark, sf_dir), "data", search.compile_all([TOKEN], case_sensitive=True), ["doc_id"])
    return found.select("doc_id", "line_no", "match_span_start", "line_preview")


def search_regex_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("data"))
    found = search.search_bytes(rows, "data", search.compile_all([PATTERN], regex=True), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "line_no", "match_span_start", "match_span_end", "matched")


def skip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("lang") == "en", "txt").when(F.col("lang") == "fr", "LOG").when(F.col("lang") == "de", "bin").otherwise("csv")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", F.col("doc_id").cast("string"), ext).alias("name"), (F.col("source") == "src3").alias("is_symlink"), F.octet_length("text").alias("size_bytes"))
    return search.eligible(files, max_bytes=MAX_FILE).select("doc_id", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"))


def glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *(values.excluded(F.col("url"), [g]).alias(f"g{k}") for k, g in enumerate(GLOBS)))


# ---- formats --------------------------------------------------------------------------------------

#: Heads in hex with their types; the last ones are of no known type.
HEADS = [(m.hex().upper() + "00FF", t) for m, t, _ in formats.SIGNATURES]
HEADS += [((b"RIFF\1\2\3\4" + f).hex().upper(), t) for f, (t, _) in formats.RIFF.items()]
HEADS += [((b"\0\0\0\x18ftyp" + b).hex().upper(), t) for b, (t, _) in formats.BRANDS.items()]
HEADS += [((b"\0\0\0\x18ftypzzzz").hex().upper(), "video/mp4"), ((b"RIFF\1\2\3\4zzzz").hex().upper(), None), ("", None), ("00", None)]

#: Marks of one type each, and none.
HEAD_MARKS = [(h, t) for h, t in HEADS if h not in ("", "00") and t] + [("", "text/plain")]

#: extension, type, usual extension, hidden data, and whether they contradict each other
MISMATCH = [
    (".jpg", "image/png", ".png", False, True),
    (".jpg", "image/jpeg", ".jpg", False, False),
    (".txt", "application/octet-stream", "", False, True),
    (".bin", "application/octet-stream", "", False, False),
    (".png", "application/octet-stream", "", False, True),
    (".hwp", "application/x-ole-storage", ".doc", False, False),
    (".jpg", "application/x-dosexec", ".exe", False, True),
    ("", "application/x-executable", "", False, False),
    ("", "image/png", ".png", False, True),
    ("", "text/plain", ".txt", False, False),
    (".cr2", "image/tiff", ".tiff", False, False),
    (".apk", "application/zip", ".zip", False, True),
    (".zip", "application/vnd.android.package-archive", ".apk", False, False),
    (".docx", "application/vnd.android.package-archive", ".apk", False, True),
    (".log", "text/plain", ".txt", True, True),
    (".log", "text/plain", ".txt", False, False),
    (".py", "text/x-python", "", False, False),
    (".xyz", "image/png", ".png", False, False),
    (".pdf", "inode/x-empty", "", False, False),
    (".mov", "video/mp4", ".mp4", False, False),
    (".jar", "application/x-no-such-type", "", False, False),
]


def signature_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the fixed heads and of every page and document by their leading bytes."""
    fixed = spark.createDataFrame([(h,) for h, _ in HEADS], "head string").select(F.concat(F.lit("head "), "head").alias("item"), "head")
    heads = lambda name, key, text: table(spark, sf_dir, name).select(F.concat(F.lit(f"{name} "), F.col(key).cast("string")).alias("item"), F.hex(F.substring(F.col(text).cast("binary"), 1, 16)).alias("head"))
    rows = fixed.unionByName(heads("pages", "page_id", "html")).unionByName(heads("documents", "doc_id", "text"))
    return rows.select("item", F.coalesce(formats.head_type(F.col("head")), F.lit("")).alias("mime"))


def artifact_kind(head: Column) -> Column:
    """How text could be compared, by its first characters."""
    start = F.regexp_replace(F.substring(head, 1, 512), "^[﻿ \t\r\n]+", "")
    markup = start.startswith("<?xml") | start.startswith("<plist") | start.startswith("<map") | start.startswith("<!DOCTYPE plist")
    plist = head.contains("<plist") | head.contains("PropertyList")
    return F.when(markup & plist, artifacts.PLIST).when(markup & head.contains("<map"), artifacts.PREFS).otherwise(artifacts.FILE)


def signature_text_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of pages as they are, and under an XML, a settings and a property list head."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    heads = F.array(*(F.struct(F.lit(n).alias("wrapped"), F.lit(h).alias("h")) for n, h in (("no", ""), ("xml", "<?xml version='1.0'?>"), ("prefs", " \n<map>"), ("plist", "<plist>"))))
    rows = pages.select("page_id", "html", F.explode(heads).alias("x")).select("page_id", "x.wrapped", F.substring(F.concat("x.h", "html"), 1, 512).alias("head"))
    return rows.select("page_id", "wrapped", artifact_kind(F.col("head")).alias("kind"))


def ext_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:4] for r in MISMATCH], "ext string, mime string, usual string, hidden boolean")
    return rows.withColumn("mismatch", formats.extension_mismatch(F.col("ext"), F.col("mime"), F.col("usual"), F.col("hidden")))


# ---- snapshots -------------------------------------------------------------------------------------


def _orders_twice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(14,2)").alias("o_totalprice"), "o_orderpriority")
    before = orders.where("o_totalprice >= 20000")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("string")).otherwise(F.col("o_orderstatus"))
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(14,2)")
    after = orders.where("o_totalprice < 480000").withColumns({"o_orderstatus": status, "o_totalprice": price})
    return before, after


def row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.row_changes(*_orders_twice(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_totalprice", "o_orderpriority"])


def row_diff_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first changes of each ship year and how many more there are; the cap is the feature."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.year("l_shipdate").alias("scope"), F.col("l_quantity").cast("int").alias("l_quantity"), "l_returnflag")
    keys = ["scope", "l_orderkey", "l_linenumber", "l_partkey"]
    after = items.withColumn("l_quantity", F.when(F.col("l_returnflag") == "A", F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    summed = lambda rows: rows.groupBy(*keys).agg(F.sum("l_quantity").alias("q"))
    changes = snapshot.row_changes(summed(items), summed(after), keys, ["q"])
    kept, omitted = snapshot.capped(changes, ["scope"], [F.col(k) for k in keys])
    shown = kept.select("scope", "l_orderkey", "l_linenumber", "l_partkey", "change", "before", "after")
    cut = omitted.select("scope", *(F.lit(None).cast(t).alias(c) for c, t in (("l_orderkey", "long"), ("l_linenumber", "int"), ("l_partkey", "long"))), F.lit("TRUNCATED").alias("change"), F.lit("").alias("before"), F.col("omitted").cast("string").alias("after"))
    return shown.unionByName(cut)


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.flat_json(table(spark, sf_dir, "events"), "props", ["event_id"])


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last setting of each kind of event by user."""
    flat = snapshot.flat_json(table(spark, sf_dir, "events"), "props", ["event_id", "user_id", "event_type"])
    name = F.concat_ws(".", "event_type", "key").alias("key")
    return flat.select("event_id", "user_id", name, "value")


def keyed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by user before and after: the first ones written against the last ones."""
    flat = _settings(spark, sf_dir)
    pick = lambda how, rows: rows.groupBy("user_id", "key").agg(how("value", "event_id").alias("value"))
    before = pick(F.min_by, flat.where("key <> 'error.k' OR user_id > 50"))
    after = pick(F.max_by, flat.where("key <> 'view.k' OR user_id < 100"))
    return snapshot.keyed_changes(before, after, ["user_id"])


def sidecar_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases among the pages' paths that have a changed side file."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"//([^/?#]+)", 1).alias("host"))
    ending = F.when(F.length("host") % 4 == 0, "-wal").when(F.length("host") % 4 == 1, "-shm").when(F.length("host") % 4 == 2, "-journal").otherwise("-log")
    sides = pages.select(values.sidecar_main(F.concat("host", F.lit(".db"), ending)).alias("main")).where("main IS NOT NULL").distinct()
    return pages.withColumn("main", F.concat("host", F.lit(".db"))).join(sides, "main", "left_semi").select("page_id", "main")


def formula_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of cells as they are written and read back: whole texts behind each mark, and numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"), F.col("n_chars").cast("string").alias("n"))
    marks = ["", "=", "+", "-", "@", "'", "\t", " ", "''", "=-"]
    cells = F.array(*(F.concat(F.lit(m), F.col(c)) for m in marks for c in ("t", "n")))
    rows = docs.select("doc_id", F.posexplode(cells).alias("cell", "value"))
    escaped = values.escape_formula(F.col("value"))
    return rows.select("doc_id", "cell", F.sha2(escaped, 256).alias("escaped"), F.sha2(values.unescape_formula(escaped), 256).alias("back"))


def text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in four encodings, decoded by the engine: encoding, lines and the text again."""
    form = F.pmod(F.col("doc_id"), F.lit(4))
    data = F.when(form == 0, F.col("text").cast("binary"))
    for number, mark, name in ((1, "EFBBBF", "UTF-8"), (2, "FFFE", "UTF-16LE"), (3, "FEFF", "UTF-16BE")):
        data = F.when(form == number, F.concat(F.unhex(F.lit(mark)), F.encode("text", name))).otherwise(data)
    rows = table(spark, sf_dir, "documents").select("doc_id", data.alias("data"))
    got = search.decoded_texts(rows, "data", ["doc_id"])
    return got.select("doc_id", "encoding", F.size("lines").cast("long").alias("n_lines"), F.sha2(F.array_join("lines", ""), 256).alias("text_sha256"))


def signature_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of documents behind one of the known marks each, or behind none."""
    marks = F.array(*(F.unhex(F.lit(h)) for h, _ in HEAD_MARKS))
    data = F.concat(F.get(marks, F.pmod(F.col("doc_id"), F.lit(len(HEAD_MARKS))).cast("int")), F.col("text").cast("binary"))
    rows = table(spark, sf_dir, "documents").select("doc_id", data.alias("data"))
    return content.types_of_bytes(rows, "data", ["doc_id"]).select("doc_id", "mime")


def permissions_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("permissions"))


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each repeated key: the last one."""
    events = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", "props")
    return events.groupBy("key").agg(F.max_by(F.struct("event_id", "props"), "event_id").alias("x")).select("key", "x.*")


def content_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of rows without one: their content and its running number."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    n = F.row_number().over(Window.partitionBy("event_type", "props").orderBy("event_id"))
    return events.select("event_id", F.concat_ws(", ", "event_type", "props", F.concat(F.lit("#"), n.cast("string"))).alias("key"))


QUERIES = {
    f.__name__: f
    for f in (
        baseline_diff,
        inventory_meta,
        content_hashes,
        duplicate_content,
        byte_entropy,
        issue_rules,
        issue_summary,
        rehash_sample,
        order_timeline,
        search_lines,
        search_hits,
        hit_preview,
        search_regex_ci,
        skip_split,
        glob_exclude,
        signature_magic,
        signature_text_kind,
        signature_bytes,
        text_decode,
        ext_mismatch,
        row_diff,
        row_diff_capped,
        json_flatten,
        keyed_diff,
        sidecar_semi,
        formula_escape,
        permissions_join,
        last_wins,
        content_sequence,
    )
}

# ---- SQL -----------------------------------------------------------------------------------------

_PATH = "source || '/' || doc_id || '.' || lang"


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _cut(column: str) -> str:
    """A stored value as the diffs show it."""
    return f"CASE WHEN {column} IS NULL THEN 'NULL' WHEN length({column}) <= 300 THEN {column} ELSE left({column}, 300) || '…(' || length({column}) || ' chars)' END"


_ISSUES_SQL = f"""
WITH f AS (SELECT user_id || '/' || event_type || '/' || CAST(floor(value) AS BIGINT) AS path,
  CASE WHEN event_type <> 'view' THEN event_type END AS name,
  CASE WHEN value >= 1 THEN CAST(floor(value * 100) AS BIGINT) END AS size_bytes,
  CASE WHEN event_type = 'error' THEN 0 - CAST(floor(epoch(ts)) AS BIGINT) ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS m,
  CASE WHEN event_type = 'click' THEN 'never' ELSE CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) END AS a,
  CASE WHEN event_type = 'signup' THEN 'read_error' ELSE 'ok' END AS hash_status FROM events),
times AS (SELECT path, 'mtime_epoch' AS field, CAST(m AS VARCHAR) AS v FROM f UNION ALL SELECT path, 'atime_epoch', a FROM f)
SELECT 'ERROR' AS severity, 'MISSING_FIELD' AS code, path, 'name' AS field, '' AS value, 'required value is missing' AS detail FROM f WHERE name IS NULL
UNION ALL SELECT 'ERROR', 'MISSING_FIELD', path, 'size_bytes', '', 'required value is missing' FROM f WHERE size_bytes IS NULL
UNION ALL SELECT 'WARN', 'TS_BAD_TYPE', path, field, v, 'not a finite number' FROM times WHERE try_cast(v AS DOUBLE) IS NULL
UNION ALL SELECT 'WARN', 'TS_SUSPICIOUS', path, field, v, 'time is not after 1970' FROM times WHERE try_cast(v AS DOUBLE) <= 0
UNION ALL SELECT 'WARN', 'TS_FUTURE', path, field, v, 'time is more than a day ahead' FROM times WHERE try_cast(v AS DOUBLE) > {NOW_EVENTS + 86400}
UNION ALL SELECT 'WARN', 'HASH_READ_FAIL', path, '', '', 'file not readable' FROM f WHERE hash_status = 'read_error'
UNION ALL SELECT 'WARN', 'DUP_PATH', path, '', '', 'recorded times: ' || count(*) FROM f GROUP BY path HAVING count(*) > 1"""

_LINES_SQL = """
SELECT doc_id, CAST(i AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
FROM (SELECT doc_id, regexp_extract_all(text, '[^\\r\\n]*(?:\r\n|\n|\r)|[^\\r\\n]+\\z') AS l FROM documents))"""


def _literal_sql(word: str) -> str:
    n = len(word)
    return f"""
WITH lines AS ({_LINES_SQL}),
p AS (SELECT doc_id, line_no, line, string_split(line, '{word}') AS p FROM lines WHERE contains(line, '{word}')),
k AS (SELECT *, unnest(range(1, len(p))) AS k FROM p),
hits AS (SELECT doc_id, line_no, regexp_replace(line, '[\\r\\n]+\\z', '') AS line, line AS raw,
  CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * {n} AS INTEGER) AS match_span_start FROM k)"""


_GLOB_SQL = [r"(?s).*\.example\.com/.*", r"(?s).*page=.&.*", r"(?s)https://m\..*", r"(?s)[^h].*"]

_ORDERS_SQL = """
WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(14,2)) AS p, o_orderpriority FROM orders),
b AS (SELECT o_orderkey, o_orderstatus, CAST(p AS VARCHAR) AS o_totalprice, o_orderpriority, 1 AS there FROM o WHERE p >= 20000),
a AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CAST(CAST(CASE WHEN o_orderstatus = 'P' THEN p + 1 ELSE p END AS DECIMAL(14,2)) AS VARCHAR) AS o_totalprice, o_orderpriority, 1 AS there FROM o WHERE p < 480000),
j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.there AS tb, a.there AS ta,
  b.o_orderstatus AS b1, a.o_orderstatus AS a1, b.o_totalprice AS b2, a.o_totalprice AS a2, b.o_orderpriority AS b3, a.o_orderpriority AS a3
  FROM b FULL JOIN a ON b.o_orderkey = a.o_orderkey)"""


def _row_text(side: str) -> str:
    return " || '; ' || ".join(f"'{c}=' || coalesce({side}{k}, 'NULL')" for k, c in enumerate(("o_orderstatus", "o_totalprice", "o_orderpriority"), 1))


_SETTINGS_SQL = "SELECT event_id, user_id, event_type || '.' || j.key AS key, json_extract_string(props, '$.' || j.key) AS value FROM events, (SELECT unnest(['k']) AS key) j WHERE json_extract_string(props, '$.' || j.key) IS NOT NULL"

ORACLE_SQL: dict[str, str] = {
    "inventory_meta": f"SELECT {_PATH} AS path, doc_id || '.' || lang AS name, source AS parent, CAST(strlen(text) AS BIGINT) AS size_bytes, '.' || lang AS ext FROM documents",
    "content_hashes": "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents",
    "duplicate_content": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "byte_entropy": """
WITH h AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents),
b AS (SELECT doc_id, n, substr(h, 2 * i + 1, 2) AS b FROM (SELECT doc_id, n, h, unnest(range(n)) AS i FROM h)),
c AS (SELECT doc_id, n, b, count(*) AS c FROM b GROUP BY ALL),
e AS (SELECT doc_id, n, greatest(0.0, -sum(c / n * log2(c / n))) AS e FROM c GROUP BY doc_id, n)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, round(coalesce(e, 0.0), 5) AS entropy, n >= 256 AND coalesce(e, 0.0) >= 7.0 AS high_entropy FROM h LEFT JOIN e USING (doc_id, n)""",
    "baseline_diff": f"""
WITH c AS (SELECT {_PATH} AS k, strlen(text) AS s, sha256(text) AS h FROM documents WHERE source <> 'src5'),
b AS (SELECT CASE WHEN lang = 'es' THEN 'archive/' || {_PATH} ELSE {_PATH} END AS k,
  strlen(CASE WHEN n_chars < 300 THEN text || '.' ELSE text END) AS s, sha256(CASE WHEN n_chars < 300 THEN text || '.' ELSE text END) AS h FROM documents WHERE source <> 'src7'),
j AS (SELECT coalesce(c.k, b.k) AS k, b.k AS bk, c.k AS ck, b.s AS bs, c.s AS cs, b.h AS bh, c.h AS ch FROM b FULL JOIN c ON b.k = c.k),
o AS (SELECT *, count(*) OVER (PARTITION BY bh) AS n FROM j WHERE ck IS NULL),
w AS (SELECT *, count(*) OVER (PARTITION BY ch) AS n FROM j WHERE bk IS NULL),
m AS (SELECT o.k AS f, w.k AS t FROM o JOIN w ON o.bh = w.ch WHERE o.n = 1 AND w.n = 1 AND o.bs <> 0),
r AS (SELECT * FROM j WHERE k NOT IN (SELECT f FROM m) AND k NOT IN (SELECT t FROM m))
SELECT 'WARN' AS severity, 'MOVED' AS code, t AS path, '' AS field, '' AS value, f || ' -> ' || t AS detail FROM m
UNION ALL SELECT 'ERROR', 'BASELINE_MISSING', k, '', '', 'was in the baseline: ' || k FROM r WHERE ck IS NULL
UNION ALL SELECT 'WARN', 'BASELINE_NEW', k, '', '', 'was not in the baseline: ' || k FROM r WHERE bk IS NULL
UNION ALL SELECT 'ERROR', 'HASH_CHANGED', k, 'sha256', bh, 'sha256 ' || left(bh, 12) || ' -> ' || left(ch, 12) FROM r WHERE bh <> ch
UNION ALL SELECT 'WARN', 'SIZE_CHANGED', k, 'size_bytes', CAST(bs AS VARCHAR), bs || ' -> ' || cs FROM r WHERE bs <> cs""",
    "issue_rules": _ISSUES_SQL,
    "issue_summary": f"SELECT coalesce(severity, code) AS name, count(*) AS n FROM ({_ISSUES_SQL}) GROUP BY GROUPING SETS ((severity), (code))",
    "rehash_sample": "SELECT doc_id, sha256(text) AS sha256 FROM documents, (SELECT count(*) AS n FROM documents) WHERE "
    + " OR ".join(f"(n = {n} AND doc_id IN ({', '.join(map(str, [-1, *validate.sample_ordinals(n)]))}))" for n in SAMPLED),
    "order_timeline": f"""
WITH f AS (SELECT l_orderkey || '/' || l_linenumber AS path, o_orderpriority AS rel_path, l_returnflag AS name, CAST(l_quantity AS BIGINT) AS size_bytes,
  CAST(epoch(l_shipdate) AS DOUBLE) AS m, CAST(epoch(o_orderdate) AS DOUBLE) AS b, o_orderstatus AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT m AS ts_epoch, 'Modified' AS event, path, rel_path, name, size_bytes FROM f UNION ALL SELECT b, 'Created', path, rel_path, name, size_bytes FROM f
  UNION ALL SELECT -1.0, 'Accessed', path, rel_path, name, size_bytes FROM f WHERE s NOT IN ('F', 'O'))
SELECT ts_epoch, strftime(make_timestamp(CAST((ts_epoch + 32400) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '+09:00' AS ts_iso, event,
  ts_epoch <= 0 OR ts_epoch > {NOW_ORDERS + 86400} AS ts_suspicious, path, rel_path, name, size_bytes, false AS is_symlink FROM e""",
    "search_lines": _LINES_SQL,
    "search_hits": f"{_literal_sql(KEYWORD)} SELECT doc_id, line_no, match_span_start, CAST(match_span_start + {len(KEYWORD)} AS INTEGER) AS match_span_end, substr(raw, match_span_start + 1, {len(KEYWORD)}) AS matched, '{KEYWORD}' AS pattern FROM hits",
    "hit_preview": f"""{_literal_sql(TOKEN)},
c AS (SELECT *, length(line) AS n, greatest(0, (match_span_start * 2 + {len(TOKEN)}) // 2 - 120) AS l0 FROM hits),
d AS (SELECT *, least(n, l0 + 240) AS r FROM c), w AS (SELECT *, greatest(0, r - 240) AS l FROM d)
SELECT doc_id, line_no, match_span_start, CASE WHEN n <= 240 THEN line ELSE
  (CASE WHEN l > 0 THEN '…' ELSE '' END) || substr(line, l + 1, 240) || (CASE WHEN r < n THEN '…' ELSE '' END) END AS line_preview FROM w""",
    "search_regex_ci": rf"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+') AS l FROM conversations),
n AS (SELECT conv_id, turn, l[i] AS text, i AS line_no FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM t)),
p AS (SELECT conv_id, turn, line_no, regexp_extract_all(text, '(?i){PATTERN}') AS m, regexp_split_to_array(text, '(?i){PATTERN}') AS p FROM n WHERE regexp_matches(text, '(?i){PATTERN}')),
k AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM p)
SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, CAST(s AS INTEGER) AS match_span_start, CAST(s + length(x) AS INTEGER) AS match_span_end, x AS matched FROM
(SELECT conv_id, turn, line_no, m[k] AS x, list_sum(list_transform(p[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda y: length(y))), 0) AS s FROM k)""",
    "skip_split": f"""
SELECT doc_id, CASE WHEN source = 'src3' THEN 'symlink' WHEN strlen(text) > {MAX_FILE} THEN 'too_large' ELSE '' END AS skip_reason FROM documents WHERE lang <> 'de'""",
    "glob_exclude": "SELECT page_id, "
    + ", ".join(f"regexp_full_match(url, {_text(g)}) OR regexp_full_match(string_split(url, '/')[-1], {_text(g)}) AS g{k}" for k, g in enumerate(_GLOB_SQL))
    + " FROM pages",
    "signature_magic": "WITH fixed AS (SELECT * FROM (VALUES "
    + ", ".join(f"({_text('head ' + h)}, {_text(t or '')})" for h, t in HEADS)
    + ") v(item, mime)) SELECT * FROM fixed UNION ALL SELECT 'pages ' || page_id, '' FROM pages UNION ALL SELECT 'documents ' || doc_id, '' FROM documents",
    "signature_bytes": "SELECT doc_id, [" + ", ".join(_text(t) for _, t in HEAD_MARKS) + f"][CAST(doc_id % {len(HEAD_MARKS)} AS INTEGER) + 1] AS mime FROM documents",
    "text_decode": r"""
SELECT doc_id, CASE WHEN text = '' THEN 'empty' ELSE ['utf-8', 'utf-8-sig', 'utf-16', 'utf-16'][CAST(doc_id % 4 AS INTEGER) + 1] END AS encoding,
       CAST(len(regexp_extract_all(text, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+')) AS BIGINT) AS n_lines, sha256(text) AS text_sha256 FROM documents""",
    "signature_text_kind": """
WITH h AS (SELECT page_id, wrapped, substr(h || coalesce(html, ''), 1, 512) AS t FROM pages, (VALUES ('no', ''), ('xml', '<?xml version=''1.0''?>'), ('prefs', ' ' || chr(10) || '<map>'), ('plist', '<plist>')) v(wrapped, h)),
s AS (SELECT *, ltrim(t, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM h),
k AS (SELECT *, starts_with(s, '<?xml') OR starts_with(s, '<plist') OR starts_with(s, '<map') OR starts_with(s, '<!DOCTYPE plist') AS markup FROM s)
SELECT page_id, wrapped, CASE WHEN markup AND (contains(t, '<plist') OR contains(t, 'PropertyList')) THEN 'plist' WHEN markup AND contains(t, '<map') THEN 'shared_prefs' ELSE 'file' END AS kind FROM k""",
    "ext_mismatch": "SELECT * FROM (VALUES " + ", ".join(f"({_text(e)}, {_text(m)}, {_text(u)}, {h}, {x})" for e, m, u, h, x in MISMATCH) + ") v(ext, mime, usual, hidden, mismatch)",
    "row_diff": f"""{_ORDERS_SQL}
SELECT o_orderkey, 'ROW_ADDED' AS change, '' AS "column", '' AS "before", {_row_text("a")} AS "after" FROM j WHERE tb IS NULL
UNION ALL SELECT o_orderkey, 'ROW_DELETED', '', {_row_text("b")}, '' FROM j WHERE ta IS NULL
"""
    + "".join(
        f"UNION ALL SELECT o_orderkey, 'ROW_CHANGED', '{c}', coalesce(b{k}, 'NULL'), coalesce(a{k}, 'NULL') FROM j WHERE ta = 1 AND tb = 1 AND b{k} IS DISTINCT FROM a{k} "
        for k, c in enumerate(("o_orderstatus", "o_totalprice", "o_orderpriority"), 1)
    ),
    "row_diff_capped": f"""
WITH i AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS scope, l_orderkey, l_linenumber, l_partkey, sum(CAST(l_quantity AS INTEGER)) AS q0,
  sum(CAST(l_quantity AS INTEGER) + CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS q1 FROM lineitem GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY l_orderkey, l_linenumber, l_partkey) AS n, count(*) OVER (PARTITION BY scope) AS t FROM i WHERE q0 <> q1)
SELECT scope, l_orderkey, l_linenumber, l_partkey, 'ROW_CHANGED' AS change, CAST(q0 AS VARCHAR) AS "before", CAST(q1 AS VARCHAR) AS "after" FROM c WHERE n <= {snapshot.MAX_CHANGES}
UNION ALL SELECT DISTINCT scope, CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS BIGINT), 'TRUNCATED', '', CAST(t - {snapshot.MAX_CHANGES} AS VARCHAR) FROM c WHERE t > {snapshot.MAX_CHANGES}""",
    "json_flatten": "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)",
    "keyed_diff": f"""
WITH f AS ({_SETTINGS_SQL}),
b AS (SELECT user_id, key, arg_min(value, event_id) AS v FROM f WHERE key <> 'error.k' OR user_id > 50 GROUP BY ALL),
a AS (SELECT user_id, key, arg_max(value, event_id) AS v FROM f WHERE key <> 'view.k' OR user_id < 100 GROUP BY ALL)
SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.key, a.key) AS key,
  CASE WHEN b.key IS NULL THEN 'KEY_ADDED' WHEN a.key IS NULL THEN 'KEY_DELETED' ELSE 'KEY_CHANGED' END AS change,
  CASE WHEN b.key IS NULL THEN '' ELSE {_cut("b.v")} END AS "before", CASE WHEN a.key IS NULL THEN '' ELSE {_cut("a.v")} END AS "after"
FROM b FULL JOIN a ON b.user_id = a.user_id AND b.key = a.key WHERE b.key IS NULL OR a.key IS NULL OR a.v <> b.v""",
    "sidecar_semi": """
WITH p AS (SELECT page_id, regexp_extract(url, '//([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, host || '.db' AS main FROM p WHERE length(host) % 4 <> 3""",
    "permissions_join": "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS permissions FROM events GROUP BY user_id",
    "last_wins": "SELECT user_id || '/' || event_type AS key, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY 1",
    "content_sequence": "SELECT event_id, event_type || ', ' || props || ', #' || row_number() OVER (PARTITION BY event_type, props ORDER BY event_id) AS key FROM events",
}

_CELLS = ", ".join(f"{_text(m)} || {c}" if m != "\t" else f"chr(9) || {c}" for m in ("", "=", "+", "-", "@", "'", "\t", " ", "''", "=-") for c in ("t", "n"))
ORACLE_SQL["formula_escape"] = f"""
WITH d AS (SELECT doc_id, text AS t, CAST(n_chars AS VARCHAR) AS n FROM documents),
c AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS cell, l[i] AS v FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, [{_CELLS}] AS l FROM d)))
SELECT doc_id, cell, sha256(CASE WHEN left(v, 1) = '''' OR (left(v, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) AND try_cast(trim(v, chr(9) || ' ') AS DOUBLE) IS NULL) THEN '''' || v ELSE v END) AS escaped, sha256(v) AS back FROM c"""
