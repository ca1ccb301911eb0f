"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, language, perplexity, repeats, rules, secrets, toxicity, warc
from .common import documents


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), drop=("text",))
    return coded.select(
        "doc_id",
        F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = warc.audit(pages, warc.damaged(pages))
    return found.select(F.col("key").alias("page_id"), F.col("file").alias("warc_file"), "offset", "length", "digest", "status")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["hi"] - s["lo"]))
    return cleaned.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, items, drop=("text",))
    listed = F.array_join(F.array_sort("hit_items"), ",")
    return found.withColumn("n_hit", decontaminate.hit_words()).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs), drop=("text",))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_listed("base_spans").cast("binary"), 256).alias("base_sha256"),
        _listed("all_spans").alias("spans"),
    )


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that are labelled as good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    files = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    measured = rules.measure(docs, *files, public_tokenizers.PATTERN, drop=("text",))
    measured = measured.join(trusted_ids(spark, sf_dir).withColumn("trusted", F.lit(True)), "doc_id", "left")
    counts = [f.name for f in rules.FIELDS]
    return rules.verdict(measured, F.col("trusted"), F.col("lang")).select("doc_id", *counts, "base_failed", "kept")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_classes(documents(spark, sf_dir, "doc_id", "text"))


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = perplexity.chunk_of(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", place.alias("chunk"))
    good = trusted_ids(spark, sf_dir)
    model = perplexity.KneserNey(perplexity.trusted_texts(docs, good.where(~perplexity.held_out())))
    scored = perplexity.perplexities(docs, model, ["doc_id", "lang"])
    scored = scored.join(good.where(perplexity.held_out()).withColumn("judged", F.lit(True)), "doc_id", "left")
    judged = perplexity.verdict(scored, F.col("judged"), F.col("lang"))
    return judged.select("doc_id", "n_bytes", F.round("perplexity", 6).alias("perplexity"), F.round("limit", 6).alias("limit"), "kept")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    model = language.train_on_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = language.identify(docs, model, declared=F.col("lang"), host=F.col("source"), drop=("text",))
    return found.select("doc_id", "lang_id", F.round("lang_posterior", 6).alias("posterior"), F.col("lang_kept").alias("kept"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, drop=("text",))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_warc_fixity, op3_suffix_dedup, op4_decontamination, op5_secrets, op6_quality_rules, op7_jaccard_join, op8_perplexity, op9_language_id, op10_toxicity)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of a text as op4 takes them.
_OP4_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

#: A record of op2.
_OP2_RECORD = """'WARC/1.0' || crlf || 'WARC-Type: response' || crlf || 'WARC-Record-ID: <urn:record:' || page_id || '>' || crlf
|| 'WARC-Target-URI: ' || coalesce(url, '') || crlf || 'Content-Type: text/html' || crlf || 'Content-Length: ' || strlen(coalesce(html, ''))
|| crlf || crlf || coalesce(html, '') || crlf || crlf"""

ORACLE_SQL: dict[str, str] = {
    "op7_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM met JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 90 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.z = e.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)""",
    "op2_warc_fixity": f"""
WITH p AS (SELECT page_id, url, html, page_id // 4096 AS warc_file, (page_id * 40503 + 7) % 53 AS draw, chr(13) || chr(10) AS crlf FROM pages),
r AS (SELECT page_id, warc_file, draw, html, {_OP2_RECORD} AS record FROM p)
SELECT page_id, CAST(warc_file AS BIGINT) AS warc_file,
       CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY warc_file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest,
       CASE WHEN draw = 1 THEN 'missing' WHEN draw = 0 AND '~' || substr(html, 2) <> html THEN 'altered' ELSE 'ok' END AS status
FROM r""",
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
twice AS (SELECT m FROM g GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g SEMI JOIN twice USING (m)),
numbered AS (SELECT doc_id, i, count(*) FILTER (p IS NULL OR i > p + 200) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
run AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY doc_id, r),
piece AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS z FROM run),
cuts AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS z, string_agg(substr(h, 2 * z + 1, 2 * (lo - z)), '' ORDER BY lo) AS kept FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cuts USING (doc_id)""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_OP4_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_OP4_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
