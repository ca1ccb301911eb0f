"""A training-text pipeline: each stage reads the Parquet that the one before wrote.

Language ID drops documents of no known language, the Jaccard join keeps one
document of each group of near-duplicates, decontamination cuts benchmark
passages out (and drops texts that are hardly more than those), the secret scan
replaces secrets by marks, and BPE encodes what is left.

Defined cases: a null text is kept as null where the stage has nothing to cut
from it; documents without words are linked with nothing, so each stays; rows
that share doc_id and text are repeats, of which one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, jaccard, language, secrets
from tracewell.llm.common import cut, prepare

#: Words per shingle and least similarity of near-duplicates.
SHINGLE, SIMILAR = 5, (8, 10)
#: A document is dropped when more than this share of its words is benchmark text.
MAX_COVERAGE = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = language.train_on_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = language.identify(docs, model, declared=F.col("lang"), host=F.col("source"))
    return found.where("lang_kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id stays; a row without one has a negative id made of its text."""
    prepare(spark)
    own = F.coalesce(F.col("doc_id"), -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 62)))
    rows = docs.withColumn("_row_id", own)
    classes = jaccard.link_classes(rows, id_col="_row_id", shingle=SHINGLE, num=SIMILAR[0], den=SIMILAR[1])
    leave = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_row_id")).distinct()
    # both steps deal rows out by the id, so texts are shuffled once
    return rows.join(leave, "_row_id", "left_anti").dropDuplicates(["_row_id", "text"]).select(docs.columns)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, items, clean=True)
    share = decontaminate.hit_words() / F.greatest("n_words", F.lit(1))
    found = found.where(share <= MAX_COVERAGE)
    hit = F.size("hit_spans") > 0
    n_chars = F.when(hit, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": F.col("clean_text"), "n_chars": n_chars}).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = secrets.scan(docs, secrets.train(docs), redact=True)
    hit = F.size("all_spans") > 0
    n_chars = F.when(hit, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": F.col("redacted"), "n_chars": n_chars}).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), drop=("text",))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmarks),
    ("secret_scan", redact_secrets),
    ("bpe", encode),
]

#: The suffix automaton's cuts, the CRF and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, f"stage-{name}")
    return docs
