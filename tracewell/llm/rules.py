"""Quality rules: fixed text statistics, then what public tokenizers make of a text.

Vocabularies trained on ordinary text spend few tokens on ordinary text.  Per
document: characters per token of two vocabularies, and of the first one the
share of byte-fallback tokens and the entropy of the token distribution.  Each
figure has a band per language and size class (powers of two of the tokens, as
entropy grows with them): from a low to a high quantile over trusted texts,
widened by ``MARGIN`` of its distance from the median.  A text outside a band is
rejected.  Bands are grouped aggregates over all trusted rows.

Defined cases: null and empty text has no words, so it fails the base rule; a
language and size with fewer than ``LEAST_TRUSTED`` trusted texts takes the
bands of its language over all sizes, and a language with fewer than that is
judged by the base rule alone; a null language is a language of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, WordHashes, annotate, cut, field, unused, window_hashes

#: Least and largest size class, as powers of two of the number of tokens.
SIZES = (5, 9)
#: Quantile on either side, and how far bands go beyond it, as a share of its distance from the median.
QUANTILE, MARGIN = 0.005, 0.5
#: Trusted texts that a language and size, or a language, needs for bands of its own.
LEAST_TRUSTED = 50
#: Share of byte-fallback tokens that is never too large.
SOME_BYTES = 0.02
JUDGED = ("chars_per_token", "chars_per_token_2", "byte_share", "token_entropy")

_SPACE = bytes(range(9, 14)) + b" "
_SYMBOLS = b"#*$%&|<>"
#: 1 white space, 2 a counted symbol, 3 a UTF-8 continuation byte, 0 anything else
_CLASS = np.array([1 if b in _SPACE else 2 if b in _SYMBOLS else 3 if b & 0xC0 == 0x80 else 0 for b in range(256)], np.uint8)


def base_counts(text: bytes | None, hashes: WordHashes) -> tuple[list[bytes], int, int, int, int]:
    """Words, and their code points, symbols, repeated lines and words of repeated windows."""
    if not text:
        return [], 0, 0, 0, 0
    words = text.split()
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=4)
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = window_hashes(hashes.of(words), 5)
    repeated = 0
    if len(windows) > 1:
        order = np.argsort(windows)
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, np.flatnonzero(twice), 1)
            np.add.at(cover, np.flatnonzero(twice) + 5, -1)
            repeated = int((np.cumsum(cover) > 0).sum())
    return words, int(kinds[0] + kinds[2]), int(kinds[2]), len(lines) - len(set(lines)), repeated


def second_vocabulary(path: str, pattern: str):
    """Number of tokens of a word behind a space, by a file of ranks."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda word: len(encode(f" {word}"))


class Fertility:
    """Token figures of a text, word by word, for a sentencepiece vocabulary and a second one."""

    def __init__(self, path: str, second):
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self._second = second
        self._size = self._sp.get_piece_size()
        self._byte = np.array([self._sp.is_byte(k) for k in range(self._size)])
        self._known: dict[bytes, bytes] = {}
        self._count: dict[bytes, int] = {}

    def _learn(self, words: list[bytes]) -> None:
        new = list({w for w in words if w not in self._known})
        if len(self._known) + len(new) > CACHE_WORDS:
            self._known.clear()
            self._count.clear()
            new = list(set(words))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            texts = [w.decode("utf-8", "replace") for w in part]
            for word, text, ids in zip(part, texts, self._sp.encode(texts, num_threads=1), strict=True):
                self._known[word] = np.array(ids, np.int32).tobytes()
                self._count[word] = self._second(text)

    def of(self, words: list[bytes], chars: int) -> tuple:
        """Tokens, characters per token of either vocabulary, share of byte tokens, entropy in bits."""
        nothing = (0, None, None, None, None)
        if not words:
            return nothing
        self._learn(words)
        ids = np.frombuffer(b"".join(map(self._known.__getitem__, words)), np.int32)
        other = sum(map(self._count.__getitem__, words))
        if not len(ids) or not other:
            return nothing
        counts = np.bincount(ids, minlength=self._size)
        p = counts[counts > 0] / len(ids)
        return len(ids), chars / len(ids), chars / other, float(counts[self._byte].sum() / len(ids)), float(-(p * np.log2(p)).sum())


FIELDS = [
    field("n_words", T.LongType()),
    field("word_chars", T.LongType()),
    field("n_symbols", T.LongType()),
    field("n_dup_lines", T.LongType()),
    field("n_repeat_words", T.LongType()),
    field("n_tokens", T.LongType()),
    field("chars_per_token", T.DoubleType()),
    field("chars_per_token_2", T.DoubleType()),
    field("byte_share", T.DoubleType()),
    field("token_entropy", T.DoubleType()),
]


def measure(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Append the base counts and the token figures of every whole text.

    ``vocabulary`` is a sentencepiece file, ``ranks`` a file of byte-level tokens
    by rank and ``pattern`` its split pattern; both lie on every executor.
    """

    def make():
        hashes, fertility = WordHashes(), Fertility(vocabulary, second_vocabulary(ranks, pattern))

        def kernel(texts):
            rows = []
            for text in texts:
                words, chars, symbols, lines, repeated = base_counts(text, hashes)
                rows.append((len(words), chars, symbols, lines, repeated, *fertility.of(words, chars)))
            columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            return [pa.array(c, pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64()) for c, f in zip(columns, FIELDS, strict=True)]

        return kernel

    return annotate(docs, text_col, make, FIELDS, drop)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _bands(trusted: DataFrame, by: list[Column], mark: str) -> DataFrame:
    """Low and high end of each figure's band, by ``by``, for groups of enough rows."""
    thirds = [F.percentile_approx(c, [QUANTILE, 0.5, 1 - QUANTILE], 10_000).alias(f"{mark}{c}") for c in JUDGED]
    found = trusted.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{mark}n"), *thirds).where(F.col(f"{mark}n") >= LEAST_TRUSTED)
    ends = {}
    for c in JUDGED:
        low, middle, high = (F.get(f"{mark}{c}", F.lit(k)) for k in range(3))
        ends[f"{mark}{c}"] = F.struct((low - MARGIN * (middle - low)).alias("lo"), (high + MARGIN * (high - middle)).alias("hi"))
    return found.withColumns(ends).drop(f"{mark}n")


def verdict(measured: DataFrame, trusted: Column, lang: Column) -> DataFrame:
    """Append ``base_failed`` and ``kept`` from the figures of ``measure``; ``trusted`` marks the rows that give the bands."""
    own = unused(measured.columns, "_fert_")
    size = F.least(F.greatest(F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))), F.lit(SIZES[0])), F.lit(SIZES[1]))
    named = {"base_failed": base_failed(), f"{own}lang": lang, f"{own}size": size, f"{own}trusted": F.coalesce(trusted, F.lit(False))}
    rows = cut(measured.withColumns(named), "measured")
    good = rows.where(F.col(f"{own}trusted") & ~F.col("base_failed"))
    out = rows
    for mark, keys in ((f"{own}a", ("lang", "size")), (f"{own}b", ("lang",))):
        bands = _bands(good, [F.col(f"{own}{k}").alias(f"{mark}_{k}") for k in keys], f"{mark}_of_")
        same = F.col(f"{own}lang").eqNullSafe(F.col(f"{mark}_lang"))
        if "size" in keys:
            same = same & (F.col(f"{own}size") == F.col(f"{mark}_size"))
        out = out.join(bands, same, "left")
    kept = ~F.col("base_failed")
    for c in JUDGED:
        band = F.coalesce(F.col(f"{own}a_of_{c}"), F.col(f"{own}b_of_{c}"))
        high = F.greatest(band["hi"], F.lit(SOME_BYTES)) if c == "byte_share" else band["hi"]
        kept = kept & (band.isNull() | F.coalesce(F.col(c).between(band["lo"], high), F.lit(False)))
    return out.withColumn("kept", kept).select(*measured.columns, "base_failed", "kept")
