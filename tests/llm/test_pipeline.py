"""The pipeline's stages on planted cases and against brute force."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_operators import ODD, brute_classes, docs_of, near_copies

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def stage(name):
    return dict(P.STAGES)[name]


def test_all_but_the_last_return_the_columns_of_documents(spark, documents):
    docs = documents
    for name, f in P.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.schema == documents.schema, name
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "bpe"]


def test_near_duplicates_leave_one_of_each_group(spark):
    import random

    texts = near_copies(random.Random(11)) + ODD
    docs = docs_of(spark, texts)
    got = {r.doc_id for r in stage("near_duplicates")(spark, docs, SF).collect()}
    assert got == {k for k, (n, c) in enumerate(brute_classes(texts, 5, 8, 10)) if c == k}
    again = docs.unionByName(docs)
    assert stage("near_duplicates")(spark, again, SF).count() == len(got)


def test_benchmark_passages_go_and_clean_texts_stay(spark, documents):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    texts = ["before " * 30 + item + " after" * 30, "clean text " * 20, item, None, ""]
    got = {r.doc_id: r for r in stage("decontamination")(spark, docs_of(spark, texts), SF).collect()}
    assert set(got) == {0, 1, 3, 4}
    assert item not in got[0].text and got[0].text.startswith("before") and got[0].text.endswith("after")
    assert got[0].n_chars == len(got[0].text) and [got[k].text for k in (1, 3, 4)] == [texts[k] for k in (1, 3, 4)]


def test_secrets_are_replaced(spark):
    h = "0123456789abcdef" * 2
    got = {r.doc_id: r for r in stage("secret_scan")(spark, docs_of(spark, [f"a token={h} b", "nothing", None]), SF).collect()}
    assert got[0].text == "a [assign] b" and got[0].n_chars == 12 and got[1].text == "nothing" and got[2].text is None


def test_run_is_the_stages_one_after_another(spark, documents):
    docs = documents
    for _, f in P.STAGES:
        docs = f(spark, docs, SF)
    want = sorted(map(tuple, docs.collect()))
    got = sorted(map(tuple, P.run(spark, SF).collect()))
    assert got == want and 0 < len(got) < documents.count()
    assert all(re.fullmatch("[0-9a-f]{64}", r[4]) for r in got)


def test_languages_are_kept(spark, documents):
    kept = stage("language_id")(spark, documents, SF)
    assert kept.count() >= 0.99 * documents.count()
    assert kept.where(F.col("text").isNull()).count() == 0
