"""Toxicity scores: gradient-boosted trees over dense features, made probabilities by isotonic regression.

Features of a text: how densely it uses words, and beginnings of words, of a
lexicon learnt from the training labels; how near they stand to second-person
words; capitals, punctuation, symbols and obfuscated spellings.  Trees are
grown on histograms; scores of rows that a model has not seen (two folds) fit
the isotonic map.

Defined cases: null and empty text has all-zero features and so gets the score
of a text without any sign; equal texts get equal scores; without labels, or
with one class only, every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field as dc_field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, annotate, field

#: Labelled rows that training takes at most, about; drawn by a hash of the id.
TRAIN_ROWS = 6_000
#: Entries of the learnt lexicon, and labelled texts an entry must occur in.
LEXICON, LEAST = 400, 8
PREFIXES = (5, 6, 7, 8)
#: Characters of a training text; with TRAIN_ROWS this bounds what the driver holds.  Scores are of whole texts.
TRAIN_CHARS = 50_000
#: Share of the uncalibrated score.
TRACE = 1e-4

#: Second-person words of the languages at hand, and letters that digits and signs stand for.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ti tus su vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile(r"[^\W_]+(?:[^\w\s][^\W_]+)*")
_SPACED = re.compile(r"\b(?:[^\W\d_][.\-_* ]){3,}[^\W\d_]\b")
_STRETCHED = re.compile(r"(\w)\1{2,}")
_STRETCHED_WORD = re.compile(r"\w*?(\w)\1{2,}\w*")
_MIXED = re.compile(r"[a-zA-Z]+[013457@$!]+[a-zA-Z]+")
_SIGN_INSIDE = re.compile(r"[013457@$!](?<=[a-zA-Z].)[013457@$!]*[a-zA-Z]")
_NEAR = 6
N_FEATURES = 18


def entries(word: str) -> list[str]:
    """Lexicon entries that a word may hit: itself and its longer beginnings."""
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def learn_lexicon(texts: list[str], labels: np.ndarray) -> dict[str, float]:
    """Entries that tell toxic texts best, with their log odds."""
    seen = [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        seen[int(label)].update({e for w in set(tokens(text)) for e in entries(w)})
    n1, n0 = float(labels.sum()) + 1, float((1 - labels).sum()) + 1
    scored = []
    for entry, a in seen[1].items():
        b = seen[0].get(entry, 0)
        p, q = (a + 0.5) / n1, (b + 0.5) / n0
        # an entry must be more frequent by several standard errors, else long texts bring in chance words
        z = (a / n1 - b / n0) / np.sqrt((a + b) / (n0 + n1) * (1 / n0 + 1 / n1) + 1e-12)
        if a >= LEAST and z > 4:
            scored.append((z, float(np.log(p / q)), entry))
    return {e: w for _, w, e in sorted(scored, reverse=True)[:LEXICON]}


#: 1 a letter's first byte, 2 a capital of ASCII, 3 one of the counted symbols
_KIND = np.array([2 if 65 <= b <= 90 else 1 if 97 <= b <= 122 or b >= 0xC2 else 3 if b in b"#*$%&|<>@" else 0 for b in range(256)], np.uint8)


def _near(hits: np.ndarray, you: np.ndarray) -> int:
    """How many of the sorted places ``hits`` have one of the sorted places ``you`` within reach."""
    after = np.searchsorted(you, hits)
    behind = np.abs(hits - you[np.maximum(after - 1, 0)])
    ahead = np.abs(you[np.minimum(after, len(you) - 1)] - hits)
    return int((np.minimum(behind, ahead) <= _NEAR).sum())


def features(text: str, lexicon: dict[str, float], cache: dict | None = None) -> list[float]:
    """The dense features of one text; ``cache`` remembers words of earlier ones."""
    if not text:
        return [0.0] * N_FEATURES
    cache = {} if cache is None else cache
    if len(cache) > CACHE_WORDS:
        cache.clear()
    words = tokens(text)
    n = max(1, len(words))
    you = [k for k, w in enumerate(words) if w in SECOND_PERSON]
    hits, weight, best, strong = [], 0.0, 0.0, 0
    heads = {f"{e[: PREFIXES[0]]}~" for e in lexicon} if not cache else cache["\0heads"]
    cache["\0heads"] = heads
    for k, w in enumerate(words):
        v = cache.get(w)
        if v is None:
            v = cache[w] = max(map(lexicon.get, entries(w), repeat(0.0))) if w in lexicon or f"{w[: PREFIXES[0]]}~" in heads else 0.0
        if v > 0:
            hits.append(k)
            weight += v
            best = max(best, v)
            strong += v > 3
    near = _near(np.array(hits), np.array(you)) if you and hits else 0
    plain = lexicon.keys()
    hidden = 0
    for m in _MIXED.finditer(text) if _SIGN_INSIDE.search(text) else ():
        hidden += m.group().lower().translate(LEET) in plain
    for m in _SPACED.finditer(text):
        hidden += re.sub(r"[.\-_* ]", "", m.group().lower()) in plain
    for m in _STRETCHED_WORD.finditer(text) if _STRETCHED.search(text) else ():
        hidden += _STRETCHED.sub(r"\1", m.group().lower()) in plain
    chars = len(text)
    kinds = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=4).tolist()
    upper, letters = kinds[2], kinds[1] + kinds[2]
    shouted = sum(w.isupper() and len(w) > 2 for w in text.split())
    return [
        len(hits) / n,
        float(len(hits)),
        weight / n,
        weight,
        best,
        float(strong),
        strong / n,
        near / n,
        float(near),
        len(you) / n,
        upper / max(1, letters),
        shouted / n,
        text.count("!") / chars,
        text.count("?") / chars,
        kinds[3] / chars,
        float(hidden),
        hidden / n,
        float(np.log1p(n)),
    ]


@dataclass
class Trees:
    """Boosted regression trees for log odds; each tree is arrays of a full binary tree."""

    depth: int = 4
    rounds: int = 60
    rate: float = 0.15
    bins: int = 32
    base: float = 0.0
    edges: list = dc_field(default_factory=list)
    trees: list = dc_field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        if len(y) < 20 or len(np.unique(y)) < 2:
            return self
        self.edges = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, self.bins - 1))) for c in x.T]
        self.edges = [np.unique(np.concatenate([[1e-12], e])) for e in self.edges]
        coded = self._code(x)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(coded, y - p, p * (1 - p))
            score += self.rate * tree[2][leaf]
            self.trees.append(tree)
        return self

    def _code(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def _grow(self, coded: np.ndarray, g: np.ndarray, h: np.ndarray):
        nodes = 2**self.depth
        split_on, split_at = np.zeros(nodes, np.int64), np.full(nodes, 1 << 30)
        at = np.ones(len(g), np.int64)
        width = self.bins + 2
        for level in range(self.depth):
            first = 2**level
            local = at - first
            best = np.zeros(first)
            for f in range(coded.shape[1]):
                cell = local * width + coded[:, f]
                gs = np.bincount(cell, g, first * width).reshape(first, width).cumsum(1)
                hs = np.bincount(cell, h, first * width).reshape(first, width).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(first), k]
                better = top > best + 1e-9
                best[better] = top[better]
                split_on[first:][:first][better] = f
                split_at[first:][:first][better] = k[better]
            at = 2 * at + (coded[np.arange(len(at)), split_on[at]] > split_at[at])
        leaf = at - nodes
        value = np.bincount(leaf, g, nodes) / (np.bincount(leaf, h, nodes) + 1)
        return (split_on, split_at, value), leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.trees:
            return out
        coded = self._code(x)
        rows = np.arange(len(x))
        for split_on, split_at, value in self.trees:
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + (coded[rows, split_on[at]] > split_at[at])
            out += self.rate * value[at - len(split_on)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing map from score to probability (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, label in zip(score[order], y[order], strict=True):
        if pools and pools[-1][3] == s:
            pools[-1][0] += label
            pools[-1][1] += 1
        else:
            pools.append([float(label), 1.0, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, count, _, hi = pools.pop()
            pools[-1][0] += total
            pools[-1][1] += count
            pools[-1][3] = hi
    xs = [v for p in pools for v in (p[2], p[3])]
    ys = [p[0] / p[1] for p in pools for _ in (0, 1)]
    return np.array(xs), np.array(ys)


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees
    xs: np.ndarray
    ys: np.ndarray

    def scores(self, texts: list[str], cache: dict | None = None) -> np.ndarray:
        if not texts:
            return np.empty(0)
        cache = {} if cache is None else cache
        x = np.array([features(t, self.lexicon, cache) for t in texts])
        raw = self.trees.score(x)
        plain = 1 / (1 + np.exp(-raw))
        # a trace of the raw score keeps the order inside a flat step
        mapped = (1 - TRACE) * np.interp(raw, self.xs, self.ys) + TRACE * plain if len(self.xs) else plain
        return np.clip(mapped, 0.0, 1.0)


def fit(texts: list[str], labels: np.ndarray) -> ToxicityModel:
    labels = np.asarray(labels, float)
    fold = np.arange(len(texts)) % 2
    raw = np.zeros(len(texts))
    if len(texts) >= 40 and len(np.unique(labels)) == 2:
        for k in (0, 1):  # the lexicon too comes from the other half
            own = [t for t, f in zip(texts, fold, strict=True) if f != k]
            lexicon = learn_lexicon(own, labels[fold != k])
            known: dict[str, float] = {}
            x = np.array([features(t, lexicon, known) for t in texts])
            raw[fold == k] = Trees().fit(x[fold != k], labels[fold != k]).score(x[fold == k])
        xs, ys = isotonic(raw, labels)
        lexicon = learn_lexicon(texts, labels)
        known = {}
        x = np.array([features(t, lexicon, known) for t in texts])
        return ToxicityModel(lexicon, Trees().fit(x, labels), xs, ys)
    return ToxicityModel({}, Trees().fit(np.zeros((len(texts), N_FEATURES)), labels), np.empty(0), np.empty(0))


def held_out(id_col: str = "doc_id"):
    """Rows whose label is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on about ``bound`` labelled rows outside the held-out part, drawn by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    level = int(min(1.0, bound / max(1, total)) * (1 << 20))
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 20)) < level
    texts = docs.select("doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(TRAIN_CHARS)).alias("text")).where(pick & ~held_out())
    rows = texts.join(known.where(pick), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(12))).select("text", "toxic").limit(2 * bound).collect()
    return fit([r.text for r in rows], np.array([r.toxic for r in rows], float))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Append ``score``, the calibrated probability of a toxic label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        cache: dict = {}
        return lambda texts: [pa.array(shared.value.scores([t.decode("utf-8", "replace") if t else "" for t in texts], cache), pa.float64())]

    return annotate(docs, text_col, make, [field("score", T.DoubleType())], drop)
