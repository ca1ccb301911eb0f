"""Language identification by Bayesian fusion of four kinds of evidence.

For each language: the likelihood of the text (byte trigrams), of the language
that the markup declares, of the address suffix, and a prior of the host.  The
trigram model knows every language that occurs among the labels and is fit on a
bounded sample of each; how far declarations and suffixes can be trusted, and
the host priors, are counts over all rows by the language that the text alone
suggests, made by grouped aggregation.  A host's prior leans on its parent
domain's and that on the whole collection's.  So a declaration is evidence only
as far as texts bear it out, and the registered query learns from web pages
alone: the languages that documents declare are never labels of their texts.

Defined cases: null and empty text has no likelihood and is judged by the rest;
null declarations, addresses and hosts are no evidence; a row without any
evidence, with a posterior below ``LEAST`` or with a text unlike every known
language is rejected (``lang_id`` is ``und``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_ASCII, annotate, cut, field, unused

#: Labelled rows of the training sample for each language, about, and characters of each.
TRAIN_ROWS, TRAIN_CHARS = 1000, 20_000
CELLS = 1 << 16
#: Trigrams that count in full; longer texts are averaged to this many, as trigrams overlap.
FULL = 200
LEAST = 0.5
#: Weights of a parent's distribution, in rows.
HOST_PRIOR, DOMAIN_PRIOR, EVIDENCE_PRIOR = 20.0, 50.0, 2.0

_LETTERS = bytes(LOWER_ASCII[b] if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
MARKUP = r"""(?i)<(?:html|body)[^>]{0,300}?\blang\s*=\s*["']?([A-Za-z]{2,3})"""
_MARKUP = re.compile(MARKUP.encode())


def cells(text: bytes) -> np.ndarray:
    """Cells of the byte trigrams; every stretch without letters is one space."""
    words = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    b = np.frombuffer(words, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # CELLS x languages, log probabilities
    floor: float  # mean log likelihood below which a text is of no known language

    def likelihood(self, text: bytes) -> tuple[np.ndarray, int, float]:
        at = cells(text) if text else np.empty(0, np.uint32)
        if not len(at):
            return np.zeros(len(self.languages)), 0, 0.0
        mean = self.table[at].mean(0, dtype=np.float64)
        return mean * min(len(at), FULL), len(at), float(mean.max())


def fit(rows: list[tuple[bytes, str]]) -> TextModel:
    languages = sorted({lang for _, lang in rows})
    counts = np.full((CELLS, max(1, len(languages))), 0.05)
    coded = [(cells(t), languages.index(lang)) for t, lang in rows if t]
    for at, k in coded:
        counts[:, k] += np.bincount(at, minlength=CELLS)
    table = np.log(counts / counts.sum(0)).astype(np.float32)
    means = [float(table[at, k].mean()) for at, k in coded if len(at) >= 50]
    spread = (np.median(means) - np.quantile(means, 0.01)) if means else 0.0
    floor = float(np.median(means) - max(3.0, 4 * spread)) if means else -1e9
    return TextModel(languages or ["und"], table, floor)


def train(docs: DataFrame, label: Column, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_ROWS) -> TextModel:
    """Fit the trigram model on about ``bound`` rows of each label, drawn by a hash of the id.

    Which languages there are is counted over all rows; each is then drawn from
    at a rate of its own, so that rare ones are known too.
    """
    labelled = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(21)).alias("draw"), F.col(text_col).alias("t"), label.alias("l")).where("l IS NOT NULL")
    counts = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    levels = F.lit(0)
    for lang, n in counts.items():
        levels = F.when(F.col("l") == lang, int(min(1.0, bound / n) * (1 << 20))).otherwise(levels)
    drawn = labelled.where(F.pmod("draw", F.lit(1 << 20)) < levels).orderBy("draw").limit(2 * bound * max(1, len(counts)))
    rows = drawn.select(F.left(F.coalesce("t", F.lit("")), F.lit(TRAIN_CHARS)).alias("t"), "l").collect()
    return fit([(r.t.encode("utf-8", "replace"), r.l) for r in rows])


def train_on_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> TextModel:
    """Fit on the words of web pages, by the language that their markup declares."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    words = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-z#0-9]+;", " ")
    return train(pages.select(id_col, words.alias("text"), markup_language(F.col(html_col)).alias("label")), F.col("label"), id_col)


def markup_language(html: Column) -> Column:
    """The language that the root of a page declares, as two letters; null without one."""
    return F.nullif(F.lower(F.left(F.regexp_extract(html, MARKUP, 1), F.lit(2))), F.lit(""))


def suffix_of(address: Column) -> Column:
    """Last label of the host of an address, with the first language-like part of its path."""
    host = F.regexp_extract(address, r"^(?:[a-z]+://)?([^/?#:]+)", 1)
    part = F.regexp_extract(address, r"^(?:[a-z]+://)?[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    return F.when(address.isNotNull(), F.concat_ws("/", F.regexp_extract(host, r"([^.]+)$", 1), part))


def host_of(address: Column) -> Column:
    return F.regexp_extract(address, r"^(?:[a-z]+://)?([^/?#:]+)", 1)


def _evidence(docs: DataFrame, model: TextModel, text_col: str, own: str, drop: Sequence[str]) -> DataFrame:
    """Append the text's likelihoods and the language that its markup declares."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"likelihood": T.ArrayType(T.DoubleType()), "trigrams": T.LongType(), "fit": T.DoubleType(), "markup": T.StringType()}

    def make():
        def kernel(texts):
            found = [shared.value.likelihood(t or b"") for t in texts]
            marks = [m.group(1).decode().lower() if t and b"<" in t and (m := _MARKUP.search(t)) else None for t in texts]
            return [
                pa.array([x[0].tolist() for x in found], pa.list_(pa.float64())),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], pa.float64()),
                pa.array(marks, pa.string()),
            ]

        return kernel

    return annotate(docs, text_col, make, [field(own + c, kind) for c, kind in kinds.items()], drop)


def _log_shares(size: int, priors: list[Column], weight: float) -> Column:
    """Logarithms of each language's share among the counts n0, n1, ..., leaning on ``priors`` as on ``weight`` rows."""
    total = sum((F.col(f"n{k}") for k in range(1, size)), F.col("n0"))
    return F.array(*(F.log((F.col(f"n{k}") + weight * priors[k]) / (total + weight)) for k in range(size)))


RESULTS = ("lang_id", "lang_posterior", "lang_kept")


def identify(
    docs: DataFrame,
    model: TextModel,
    text_col: str = "text",
    declared: Column | None = None,
    address: Column | None = None,
    host: Column | None = None,
    least: float = LEAST,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Append ``lang_id``, ``lang_posterior`` and ``lang_kept`` to every row of ``docs`` (columns of these names are replaced).

    Texts are scored once: their likelihoods are written beside the columns that
    are kept, and counts and posteriors are read from there.
    """
    own = unused(docs.columns, "_lid_")
    none = F.lit(None).cast("string")
    langs = model.languages
    size = len(langs)
    host = host if host is not None else host_of(address) if address is not None else none
    given = {"host": host, "given": declared if declared is not None else none, "suffix": suffix_of(address) if address is not None else none}
    rows = docs.drop(*(c for c in RESULTS if c in docs.columns)).withColumns({own + c: v for c, v in given.items()})
    names = [c for c in docs.columns if c not in RESULTS and c not in drop]
    c = {k: F.col(own + k) for k in ("host", "given", "suffix", "likelihood", "trigrams", "fit", "markup", "guess", "declared", "domain")}
    seen = _evidence(rows, model, text_col, own, drop)
    guess = F.when(c["trigrams"] > 0, F.array_position(c["likelihood"], F.array_max(c["likelihood"])).cast("int") - 1)
    told = F.lower(F.left(F.coalesce(c["markup"], c["given"]), F.lit(2)))
    seen = seen.withColumns({f"{own}guess": guess, f"{own}declared": told, f"{own}domain": F.regexp_extract(c["host"], r"([^.]+(?:\.[^.]+)?)$", 1)})
    seen = cut(seen, "language-evidence")

    # counts over all rows, pre-aggregated in every task
    per_language = [F.count_if(c["guess"] == k).cast("double").alias(f"n{k}") for k in range(size)]
    keys = [c[k].alias(k) for k in ("host", "domain", "declared", "suffix")]
    counts = cut(seen.where(c["guess"].isNotNull()).groupBy(*keys).agg(*per_language), "language-counts")
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(size)]

    whole = counts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0.0)) for k in range(size)]).first()
    general = [(n + 1.0) / (sum(whole) + size) for n in whole]
    domains = counts.where("domain <> ''").groupBy("domain").agg(*sums)
    domains = domains.select("domain", _log_shares(size, [F.lit(p) for p in general], DOMAIN_PRIOR).alias("parent"))
    hosts = counts.where("host IS NOT NULL").groupBy("host", "domain").agg(*sums).join(domains, "domain", "left")
    leaning = [F.coalesce(F.exp(F.get("parent", F.lit(k))), F.lit(general[k])) for k in range(size)]
    tables = {"host": hosts.select("host", _log_shares(size, leaning, HOST_PRIOR).alias("log"))}
    for kind in ("declared", "suffix"):
        # how likely a declaration or suffix is under each language, less its share overall
        table = counts.where(F.col(kind).isNotNull()).groupBy(kind).agg(*sums)
        shares = _log_shares(size, [F.lit(p) for p in general], EVIDENCE_PRIOR)
        tables[kind] = table.select(kind, F.zip_with(shares, F.array(*(F.lit(float(np.log(p))) for p in general)), lambda x, y: x - y).alias("log"))

    out = seen
    for kind, table in tables.items():
        out = out.join(table.select(F.col(kind).alias(own + kind), F.col("log").alias(f"{own}log_{kind}")), own + kind, "left")
    score = F.coalesce(F.col(f"{own}log_host"), F.array(*(F.lit(float(np.log(p))) for p in general)))
    for part in ("likelihood", "log_declared", "log_suffix"):
        score = F.zip_with(score, F.coalesce(F.col(own + part), F.array_repeat(F.lit(0.0), size)), lambda a, b: a + b)
    out = out.withColumn(f"{own}score", score)
    best = F.array_max(f"{own}score")
    posterior = 1 / F.aggregate(f"{own}score", F.lit(0.0), lambda a, s: a + F.exp(s - best))
    some = (c["trigrams"] > 0) | F.col(f"{own}log_declared").isNotNull()
    known = (c["trigrams"] < 50) | (c["fit"] >= model.floor)
    name = F.element_at(F.array(*map(F.lit, langs)), F.array_position(f"{own}score", best).cast("int"))
    out = out.withColumns({"lang_posterior": posterior, "lang_kept": some & known & (posterior >= least)})
    return out.withColumn("lang_id", F.when(F.col("lang_kept"), name).otherwise("und")).select(*names, *RESULTS)
