"""Secret scans: fixed patterns, and a linear-chain CRF that tags what they miss.

The patterns give the base spans.  The CRF looks at every run of at least
``LEAST`` word characters that holds a letter or digit (everything else is
outside by definition, which makes the chain fall apart into short ones that
are decoded exactly): the whole run is cut into tokens, two words on either
side join the chain, and Viterbi finds the best begin/inside/outside path over
shape, neighbour and file features.  The CRF learns from a bounded sample of documents in which the
base spans are the labels; of letter runs without a keyword or sign before them
only a share is in the sample, and runs of many tokens are learnt in pieces.

Defined cases: null text is taken as empty and has no spans; offsets are code
points; equal texts get equal spans; a corpus without any secret gives a CRF
that tags everything outside.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, field

#: The patterns and least lengths of the base kinds, in their order.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

#: Documents in the training sample, about; the sample is by a hash of the id.
TRAIN_DOCS = 4000
#: Characters of a training text; with TRAIN_DOCS this bounds what the driver holds.  Scans are of whole texts.
TRAIN_CHARS = 50_000

#: What the training variants are put together from.
NAMES = ("key", "auth key", "access_key", "credential", "bearer", "password", "client_secret", "auth", "pwd")
SIGNS = (" = ", "=", ": ", ":", ' = "', " ")
PREFIXES = ("", "", "", "sk_", "ghp_", "pk-", "xoxb-")
ALPHABETS = (
    ("abcdefghijklmnopqrstuvwxyz0123456789", 20, 44),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 20, 44),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 24, 64),
    ("0123456789abcdef", 32, 48),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20, 44),
    ("abcdefghijklmnopqrstuvwxyz", 16, 32),
)

#: Variants of one secret from each alphabet.
DRAWS = 2
#: What stands before a value in one run: a sign or part again and again, up to so many characters.
LEADS = ("=", "-", "=", "-", "_", "ab/", "some.name.", "x-y=")
MOST_LEAD = 160

#: Least characters of a run.
LEAST = 8
#: Tokens of a piece that the CRF learns from; decoding takes whole runs.
PIECE = 64
#: One of so many letter runs of prose is learnt from.
PROSE_SHARE = 16
#: AdaGrad's squares at the start: small beside the gradient of a feature that few of many tokens have.
START_SQUARES = 1e-6
#: Parts of runs that a task remembers, of each kind.
REMEMBERED = 50_000

_RUNS = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_KEYWORD = re.compile(r"(?i)pass|pwd|secret|token|key|auth|cred|bearer")
FEATURES = 1 << 13
_AROUND = 48


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in order of start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


_KINDS = bytes(b"9"[0] if chr(b).isdigit() else b"A"[0] if chr(b).isupper() else b"a"[0] if chr(b).islower() else b for b in range(128)) + bytes(range(128, 256))
_AGAIN = re.compile(r"(.)\1+", re.S)


def _shape(token: str) -> str:
    """Kinds of the first characters, each run of one kind as one."""
    head = token[:24]
    if head.isascii():
        if head.isalpha() and head.islower():
            return "a"
        kinds = head.encode().translate(_KINDS).decode()
    else:
        kinds = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in head)
    return _AGAIN.sub(r"\1", kinds)[:8]


def _bucket(n: int) -> int:
    return min(12, n if n < 4 else 2 + int(2 * math.log2(n) / 2))


class Chain:
    """Tokens of one stretch: (start, end) in the text and feature numbers."""

    __slots__ = ("features", "inner", "spans")

    def __init__(self, spans, inner, features):
        self.spans, self.inner, self.features = spans, inner, features


def _ids(names: list[str]) -> list[int]:
    return [zlib.crc32(f.encode()) % FEATURES for f in names]


def _file_features(text: str) -> list[str]:
    return [f"file:lines{_bucket(text.count(chr(10)))}", f"file:equals{_bucket(text.count('='))}", f"file:size{_bucket(len(text))}"]


def _run_features(run: str) -> list[str]:
    size = len(run)
    entropy = math.log2(size) - sum(n * math.log2(n) for n in map(run.count, set(run)) if n > 1) / size
    digits = 0 if run.isalpha() else sum(map(run.count, "0123456789"))
    return [
        f"run:len{_bucket(size)}",
        f"run:entropy{int(entropy * 2 + 1e-9)}",
        f"run:digits{5 * digits // size}",
        f"run:hex{not run.strip('0123456789abcdefABCDEF')}",
        f"run:mixed{(run != run.lower()) + 2 * (run != run.upper())}",
    ]


def _token_features(token: str, first: bool) -> list[str]:
    return [f"tok:shape{_shape(token)}", f"tok:len{_bucket(len(token))}", f"tok:first{first}", f"tok:sign{token if not token.isalnum() else ''}"]


def _alone_features(run: str) -> list[str]:
    return [*_run_features(run), *_token_features(run, True)]


def _key_features(key: bool, sign: bool) -> list[str]:
    return [f"left:key{key}", f"left:sign{sign}"]


def _telling(word: str) -> bool:
    """Whether a word before a run is a feature by itself, and not by its shape alone."""
    return bool(len(word) < 16 and not word.isalpha() or _KEYWORD.search(word))


def _left_features(k: int, word: str) -> list[str]:
    return [f"left:shape{k}:{_shape(word)}", *([f"left:word{k}:{word}"] if _telling(word) else [])]


def _right_features(k: int, word: str) -> list[str]:
    return [f"right:shape{k}:{_shape(word)}"]


def _around(text: str, a: int, b: int) -> tuple[bool, bool, list[str], list[str]]:
    """Whether a keyword and whether a sign stand before, the words before (nearest first) and those behind."""
    before = text[max(0, a - _AROUND) : a]
    left = [x.lower() for x in reversed(_WORD.findall(before)[-2:])]
    right = [x.lower() for x in _WORD.findall(text[b : b + _AROUND])[:2]]
    return bool(_KEYWORD.search(before[-24:])), before.rstrip(" \"'")[-1:] in ("=", ":"), left, right


def _chain(text: str, a: int, b: int, whole: list[str]) -> Chain:
    """All tokens of the run from ``a`` to ``b``; equal tokens share their list of features."""
    run = text[a:b]
    key, sign, left, right = _around(text, a, b)
    common = [*whole, *_run_features(run), *_key_features(key, sign)]
    for k, w in enumerate(left):
        common += _left_features(k, w)
    for k, w in enumerate(right):
        common += _right_features(k, w)
    shared = _ids(common)
    known: dict[tuple[str, bool], list[int]] = {}
    spans, features = [], []
    for t in _TOKEN.finditer(run):
        own = (t.group(), t.start() == 0)
        if own not in known:
            known[own] = _ids(_token_features(*own)) + shared
        spans.append((a + t.start(), a + t.end()))
        features.append(known[own])
    return Chain(spans, (a, b), features)


def chains(text: str, prose_share: int = 1, whole: list[str] | None = None) -> list[Chain]:
    """The runs of ``text``, with two words around; of letter runs of prose one in ``prose_share``."""
    out: list[Chain] = []
    for m in _RUNS.finditer(text):
        a, b = m.span()
        run = m.group()
        if prose_share > 1 and run.isalpha() and zlib.crc32(f"{a}:{run}".encode()) % prose_share:
            before = text[max(0, a - _AROUND) : a]
            if not _KEYWORD.search(before[-24:]) and before.rstrip(" \"'")[-1:] not in ("=", ":"):
                continue
        if any(map(str.isalnum, run)):
            whole = whole or _file_features(text)
            out.append(_chain(text, a, b, whole))
    return out


#: Characters that str.split and str.lower take otherwise than the patterns.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u017f\u0130]")
_KEYWORDS = _KEYWORD.pattern.removeprefix("(?i)").split("|")


class Scorer:
    """Best labels of runs from sums of weights that are remembered by part, so that words of prose cost little.

    A sum is the weights of outside, begin and inside, and by how much begin is
    above outside; a run of letters is one token, for which the last decides.
    """

    def __init__(self, crf: Crf):
        self._weights = crf.weights.tolist()
        self._start, self._moves = crf.start.tolist(), crf.moves.T.tolist()
        self._bar = self._start[0] - self._start[1]
        self._marks = {(k, s): self._sum(_key_features(k, s)) for k in (False, True) for s in (False, True)}
        self._runs: dict = {}
        self._alone: dict = {}
        self._tokens: dict = {}
        self._words: dict = {}
        self._shapes: dict = {}

    def _sum(self, names: list[str]) -> tuple[float, ...]:
        out = begin = inside = 0.0
        for f in _ids(names):
            x, y, z = self._weights[f]
            out, begin, inside = out + x, begin + y, inside + z
        return out, begin, inside, begin - out

    def _part(self, held: dict, word, make) -> tuple[float, ...]:
        value = held.get(word)
        if value is None:
            if len(held) >= REMEMBERED:
                held.clear()
            value = held[word] = self._sum(make(word))
        return value

    def _seen(self, word: str) -> tuple[tuple, tuple]:
        """Sums of a word before a run, nearest and next, and of one behind it; most words share theirs by shape."""
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= REMEMBERED:
                self._words.clear()
            low = word.lower()
            kind = low if _telling(low) else (_shape(low),)
            found = self._shapes.get(kind)
            if found is None:
                if len(self._shapes) >= REMEMBERED:
                    self._shapes.clear()
                sides = (_left_features, _right_features)
                found = self._shapes[kind] = tuple(tuple(self._sum(side(k, low)) for k in (0, 1)) for side in sides)
            self._words[word] = found
        return found

    def spans(self, text: str) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        whole = None
        alone, words, seen = self._alone, self._words, self._seen
        for m in _RUNS.finditer(text):
            run = m.group()
            letters = run.isalpha()
            if not letters and not any(map(str.isalnum, run)):
                continue
            a, b = m.span()
            if whole is None:
                whole = self._sum(_file_features(text))
                odd = bool(_ODD.search(text))
                low = text.lower()
                some = odd or any(k in low for k in _KEYWORDS)
            if odd:
                key, sign, left, right = _around(text, a, b)
            else:
                before = text[max(0, a - _AROUND) : a]
                left, right = before.split()[:-3:-1], text[b : b + _AROUND].split(None, 2)[:2]
                key = some and bool(_KEYWORD.search(before[-24:]))
                sign = before.rstrip(" \"'")[-1:] in ("=", ":")
            if letters:
                ahead = whole[3] + self._marks[key, sign][3] + (alone.get(run) or self._part(alone, run, _alone_features))[3]
                for k, w in enumerate(left):
                    ahead += (words.get(w) or seen(w))[0][k][3]
                for k, w in enumerate(right):
                    ahead += (words.get(w) or seen(w))[1][k][3]
                if ahead > self._bar:
                    found.append((a, b))
                continue
            parts = [whole, self._marks[key, sign], self._part(self._runs, run, _run_features)]
            parts += [seen(w)[0][k] for k, w in enumerate(left)] + [seen(w)[1][k] for k, w in enumerate(right)]
            shared = tuple(map(sum, zip(*parts, strict=True)))
            tokens = list(_TOKEN.finditer(run))
            own = (self._part(self._tokens, (t.group(), not t.start()), lambda t: _token_features(*t)) for t in tokens)
            for t, label in zip(tokens, best_path(((x + p, y + q, z + r) for (x, y, z, _), (p, q, r, _) in zip(own, repeat(shared), strict=False)), self._start, self._moves), strict=True):
                if label == 1:
                    found.append((a + t.start(), a + t.end()))
                elif label == 2 and found:
                    found[-1] = (found[-1][0], a + t.end())
        return found


def best_path(emits: Iterable[tuple[float, ...]], start: list[float], moves: list[list[float]]) -> list[int]:
    """Viterbi's labels; ``moves`` holds the weights into each label, by the label before."""
    score: list[float] | None = None
    back = bytearray()
    for emit in emits:
        if score is None:
            score = [e + s for e, s in zip(emit, start, strict=True)]
            continue
        after = []
        for e, (m0, m1, m2) in zip(emit, moves, strict=True):
            x, y, z = score[0] + m0, score[1] + m1, score[2] + m2
            k = 0 if x >= y and x >= z else 1 if y >= z else 2
            back.append(k)
            after.append((x, y, z)[k] + e)
        score = after
    path = [score.index(max(score))]
    for t in range(len(back) // 3 - 1, -1, -1):
        path.append(back[3 * t + path[-1]])
    return path[::-1]


class Crf:
    """Linear-chain conditional random field with labels 0 outside, 1 begin, 2 inside."""

    def __init__(self):
        self.weights = np.zeros((FEATURES, 3))
        self.moves = np.zeros((3, 3))
        self.moves[0, 2] = -1e4  # inside never follows outside
        self.start = np.array([0.0, 0.0, -1e4])

    def fit(self, data: list[tuple[Chain, list[int]]], rounds: int = 120, rate: float = 0.5, l2: float = 10.0) -> Crf:
        """AdaGrad on the conditional log-likelihood, all chains of one length at a time.

        ``l2`` is held against the sum over tokens, so that more tokens of prose
        don't take away the weights of features that only secrets have.
        """
        by_length: dict[int, list] = {}
        for chain, labels in data:
            by_length.setdefault(len(labels), []).append((chain.features, labels))
        groups = []
        for length, rows in sorted(by_length.items()):
            width = max(len(f) for feats, _ in rows for f in feats)
            x = np.full((len(rows), length, width), FEATURES, np.int64)
            for i, (feats, _) in enumerate(rows):
                for t, f in enumerate(feats):
                    x[i, t, : len(f)] = f
            groups.append((x, np.array([y for _, y in rows])))
        if not groups:
            self.start[0] = 1e3
            return self
        total = sum(len(y) for _, y in groups)
        sums = [np.full((FEATURES, 3), START_SQUARES), np.full((3, 3), START_SQUARES)]
        for _ in range(rounds):
            gw, gm = -l2 / total * self.weights, np.zeros((3, 3))
            for x, y in groups:
                padded = np.vstack([self.weights, np.zeros((1, 3))])
                emit = padded[x].sum(2)
                node, edge = self._marginals(emit)
                want = np.eye(3)[y] - node
                for k in range(3):
                    gw[:, k] += np.bincount(x.ravel(), np.repeat(want[:, :, k].ravel(), x.shape[2]), FEATURES + 1)[:FEATURES] / total
                if y.shape[1] > 1:
                    np.add.at(gm, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0 / total)
                    gm -= edge / total
            for value, grad, seen in ((self.weights, gw, sums[0]), (self.moves, gm, sums[1])):
                seen += grad**2
                value += rate * grad / np.sqrt(seen)
            self.moves[0, 2] = -1e4
        return self

    def _marginals(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length, _ = emit.shape
        fwd, bwd = np.empty_like(emit), np.zeros_like(emit)
        fwd[:, 0] = emit[:, 0] + self.start
        for t in range(1, length):
            fwd[:, t] = np.logaddexp.reduce(fwd[:, t - 1, :, None] + self.moves, axis=1) + emit[:, t]
        for t in range(length - 2, -1, -1):
            bwd[:, t] = np.logaddexp.reduce(self.moves + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        node = np.exp(fwd + bwd - z[:, None, None])
        edge = np.zeros((3, 3))
        for t in range(1, length):
            edge += np.exp(fwd[:, t - 1, :, None] + self.moves + (emit[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]).sum(0)
        return node, edge

    def viterbi(self, features: list[list[int]]) -> list[int]:
        return best_path((self.weights[f].sum(0).tolist() for f in features), self.start.tolist(), self.moves.T.tolist())

    def spans(self, text: str) -> list[tuple[int, int]]:
        return Scorer(self).spans(text)


def secret_values(text: str) -> list[tuple[int, int]]:
    """Where the secrets of the base spans lie, without the name that is assigned to."""
    return [(ASSIGN.match(text, a).start(2) if kind == "assign" else a, b) for a, b, kind in base_spans(text)]


def variants(text: str, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """The neighbourhood of each assigned secret with another name and another kind of value.

    The base patterns know one form of secret; with these the chain also
    learns the shapes and neighbours of others.
    """
    rng = np.random.default_rng(seed)
    out = []
    for a, b, kind in base_spans(text):
        if kind != "assign":
            continue
        for letters, least, most in ALPHABETS * DRAWS:
            # behind a mere space letters are prose
            signs = SIGNS if "0" in letters else SIGNS[:-1]
            value = "".join(rng.choice(list(letters), int(rng.integers(least, most))))
            value = str(rng.choice(PREFIXES)) + value
            head = text[max(0, a - _AROUND) : a] + str(rng.choice(NAMES)) + str(rng.choice(signs))
            tail = " " + text[b : b + _AROUND].lstrip("\"'")
            lead = str(rng.choice(LEADS))
            lead *= 1 + int(rng.integers(4, MOST_LEAD)) // len(lead)
            for start in (head, head + lead):
                out.append((start + value + tail, [(len(start), len(start) + len(value))]))
    return out


def labelled(text: str, inside: list[tuple[int, int]] | None = None, whole: list[str] | None = None) -> list[tuple[Chain, list[int]]]:
    """Chains with the labels that the secrets, by default those of the base spans, give them."""
    inside = secret_values(text) if inside is None else inside
    out = []
    for chain in chains(text, PROSE_SHARE, whole):
        labels = []
        for a, b in chain.spans:
            hit = any(lo <= a and b <= hi for lo, hi in inside)
            labels.append(0 if not hit else 2 if labels and labels[-1] else 1)
        for k in range(0, len(labels), PIECE):
            if labels[k] != 2:  # a piece can't begin inside
                out.append((Chain(chain.spans[k : k + PIECE], chain.inner, chain.features[k : k + PIECE]), labels[k : k + PIECE]))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_DOCS) -> Crf:
    """Fit on about ``bound`` documents, drawn by a hash of the id."""
    total = docs.count()
    share = 1.0 if total <= bound else bound / total
    level = int(share * (1 << 20))
    pick = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(5)), F.lit(1 << 20)) < level
    rows = docs.where(pick).select(F.left(F.col(text_col), F.lit(TRAIN_CHARS))).limit(2 * bound).collect()
    texts = sorted(r[0] for r in rows if r[0])
    data = [x for t in texts for x in labelled(t)]
    # a variant stands for its document, so it has the file features of that
    data += [x for k, t in enumerate(texts) for v, where in variants(t, k) for x in labelled(v, where, _file_features(t))]
    return Crf().fit(data)


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, model: Crf, text_col: str = "text", redact: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """Append ``base_spans`` and ``all_spans`` (kind, start, end in code points).

    The CRF's spans that overlap a base span are left out.  With ``redact``
    the column ``redacted`` holds the text with every span replaced by its kind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [field("base_spans", _SPANS), field("all_spans", _SPANS)]
    if redact:
        fields.append(field("redacted", T.StringType()))

    def make():
        scorer = Scorer(shared.value)

        def kernel(texts):
            base_out, all_out, clean = [], [], []
            for raw in texts:
                text = raw.decode("utf-8", "replace") if raw else ""
                base = base_spans(text)
                more = [(a, b, "crf") for a, b in scorer.spans(text) if all(b <= lo or hi <= a for lo, hi, _ in base)]
                both = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
                base_out.append([{"kind": k, "start": a, "end": b} for a, b, k in base])
                all_out.append([{"kind": k, "start": a, "end": b} for a, b, k in both])
                if redact:
                    clean.append(redacted(text, both) if raw is not None else None)
            arrays = [pa.array(base_out, _ARROW), pa.array(all_out, _ARROW)]
            return arrays + ([pa.array(clean, pa.string())] if redact else [])

        return kernel

    return annotate(docs, text_col, make, fields, drop)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each maximal run of overlapping spans becomes one mark."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, kind in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])
