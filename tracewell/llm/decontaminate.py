"""Benchmark decontamination with a generalised suffix automaton over words.

The items' normalised words build one automaton; each text streams through it
and the length of the longest match that ends at each word is tracked.  Where
it reaches a window (``window`` words, or a whole shorter item) the words of
that window are hit.  Only stretches whose neighbouring words are pairs of some
item are streamed, since no window can reach across any other pair.

Defined cases: null text and null items have no words; an item without words
has no window; rows of one item_id are one item; a null item_id is an item of
its own, listed as an empty string; equal texts are treated alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_ASCII, annotate, column_bytes, cut, field, unused

#: Bytes of words: digits, letters and everything outside ASCII; all else becomes a space.
WORD_BYTES = bytes(LOWER_ASCII[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: Words of items that one automaton may hold (about 1 KB each); more items go through in blocks of that size.
BLOCK_WORDS = 250_000

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_PAIRS = 1 << 22


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(key, [self.ids.setdefault(w, len(self.ids)) for w in words]) for key, words in items if words]
        self.pairs = np.zeros(_PAIRS, bool)
        for _, seq in coded:
            last = 0
            for word in seq:
                last = self._extend(last, word)
            if len(seq) > 1:
                ids = np.array(seq, np.int64)
                self.pairs[self._pair(ids[:-1], ids[1:])] = True
        self.least = min([window, *(len(s) for _, s in coded)], default=window)
        #: state -> [(window length, keys of items)]
        self.ends: dict[int, dict[int, set]] = {}
        for key, seq in coded:
            size = min(window, len(seq))
            state, matched = 0, 0
            for word in seq:
                state, matched = self.step(state, matched, word)
                if matched >= size:
                    at = self._holding(state, size)
                    self.ends.setdefault(at, {}).setdefault(size, set()).add(key)
        #: state -> the nearest state on its suffix path, itself included, where a window ends
        self.near = [-1] * len(self.len)
        for s in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.near[s] = s if s in self.ends else self.near[self.link[s]] if s else -1

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919) & (_PAIRS - 1)

    def _new(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(arcs)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, word: int) -> int:
        """The state for the longest string of ``p`` plus ``word``, cloned out of its target if need be."""
        q = self.next[p][word]
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._new(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.len[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, matched + 1)

    def _holding(self, state: int, length: int) -> int:
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal hit spans of word positions, and the keys of items with a window there."""
        n = len(words)
        if n < self.least or not self.ids:
            return [], set()
        ids = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, n)
        known = ids >= 0
        if not known.any():
            return [], set()
        joined = np.zeros(n + 1, bool)  # whether word k continues the stretch of word k - 1
        joined[1:n] = known[:-1] & known[1:] & self.pairs[self._pair(ids[:-1], ids[1:])]
        starts = np.flatnonzero(known & ~joined[:n])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        long = ends - starts >= self.least
        spans: list[tuple[int, int]] = []
        found: set = set()
        for lo, hi in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state, matched = 0, 0
            for k, word in enumerate(ids[lo:hi].tolist(), lo + 1):
                state, matched = self.step(state, matched, word)
                at, most = self.near[state], 0
                while at >= 0:
                    for size, keys in self.ends[at].items():
                        if size <= matched:
                            most = max(most, size)
                            found |= keys
                    at = self.near[self.link[at]] if at else -1
                if most:
                    start = k - most
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, k))
        return spans, found


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words in spans that neither overlap nor touch, as ``scan`` gives them."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cleaned(text: bytes | None, spans: list[tuple[int, int]], least: int) -> str | None:
    long = [s for s in spans if s[1] - s[0] >= least]
    return cut_words(text, long).decode("utf-8") if long else text and text.decode("utf-8")


def _span_array(rows: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"start": a, "end": b} for a, b in spans] for spans in rows], kind)


def _span_lists(spans: pa.Array) -> list[list[tuple[int, int]]]:
    return [[(s["start"], s["end"]) for s in row] for row in spans.to_pylist()]


@F.arrow_udf(_SPANS)
def _merge(spans: pa.Array) -> pa.Array:
    return _span_array([merged(row) for row in _span_lists(spans)])


def _cut_with(least: int):
    @F.arrow_udf(T.StringType())
    def clean(text: pa.Array, spans: pa.Array) -> pa.Array:
        texts = column_bytes(pa.RecordBatch.from_arrays([text], names=["text"]), "text")
        return pa.array([_cleaned(t, row, least) for t, row in zip(texts, _span_lists(spans), strict=True)], pa.string())

    return clean


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int):
    """Items of at most ``block_words`` words together; rows reach the driver one by one."""
    block: list = []
    size = 0
    rows = items.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"))
    for row in rows.toLocalIterator():
        words = words_of(row.t.encode("utf-8", "surrogatepass") if row.t else None)
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row.k, words))
        size += len(words)
    yield block


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    clean: bool = False,
    min_span_words: int = 0,
    drop: tuple[str, ...] = (),
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Append ``n_words``, ``hit_spans`` (word positions, end exclusive) and ``hit_items``.

    With ``clean`` the column ``clean_text`` holds the text without its hit
    spans of at least ``min_span_words`` words.  Items beyond ``block_words``
    words go through block by block, each over all of ``docs``: a block's pass is
    written before the next automaton is built, so never more than one of them
    is held or broadcast.  Every block is held against the whole text; the spans
    are merged and cut once after the last one, so results don't depend on the
    blocks.
    """
    blocks = _blocks(items, item_id_col, item_text_col, window, block_words)
    block, following = next(blocks), next(blocks, None)
    several = following is not None
    if not several:
        out, _ = _scanned(docs, text_col, SuffixAutomaton(block, window), min_span_words if clean else None)
        return out.drop(*drop)
    own = unused(docs.columns, "_hit_")
    out = kept = None
    while block is not None:
        before = docs if out is None else out.withColumnsRenamed({"hit_spans": f"{own}spans", "hit_items": f"{own}items"})
        seen, shared = _scanned(before, text_col, SuffixAutomaton(block, window), None)
        if out is not None:
            both = {"hit_spans": F.concat(f"{own}spans", "hit_spans"), "hit_items": F.array_union(f"{own}items", "hit_items")}
            seen = seen.withColumns(both).drop(f"{own}spans", f"{own}items")
        out = kept = cut(seen, "block", kept)
        shared.destroy()
        block, following = following, next(blocks, None)
    out = out.withColumn("hit_spans", _merge("hit_spans"))
    if clean:
        out = out.withColumn("clean_text", _cut_with(min_span_words)(text_col, "hit_spans"))
    return out.drop(*drop)


def _scanned(docs: DataFrame, text_col: str, automaton: SuffixAutomaton, least: int | None) -> tuple[DataFrame, Broadcast]:
    """``docs`` with what one automaton finds, and with ``least`` the texts without it; and the broadcast of the automaton."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    fields = [field("n_words", T.LongType()), field("hit_spans", _SPANS), field("hit_items", T.ArrayType(T.StringType()))]
    if least is not None:
        fields.append(field("clean_text", T.StringType()))

    def make():
        scan = shared.value.scan

        def kernel(texts):
            sizes, spans, keys, cleaned = [], [], [], []
            for text in texts:
                words = words_of(text)
                sizes.append(len(words))
                got, items_hit = scan(words)
                spans.append(got)
                keys.append(sorted(("" if k is None else k) for k in items_hit))
                if least is not None:
                    cleaned.append(_cleaned(text, got, least))
            arrays = [pa.array(sizes, pa.int64()), _span_array(spans), pa.array(keys, pa.list_(pa.string()))]
            return arrays + ([pa.array(cleaned, pa.string())] if least is not None else [])

        return kernel

    return annotate(docs, text_col, make, fields), shared


def hit_words() -> Column:
    """Number of distinct hit words; the spans of several blocks may overlap."""
    sizes = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    places = F.array_distinct(F.flatten(F.transform("hit_spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    apart = F.size("hit_spans") == F.size(F.array_distinct(F.transform("hit_spans", lambda s: s["start"])))
    sorted_spans = F.array_sort("hit_spans")
    disjoint = apart & F.forall(
        F.sequence(F.lit(1), F.greatest(F.size("hit_spans") - 1, F.lit(1))),
        lambda k: (F.size("hit_spans") < 2) | (F.get(sorted_spans, k - 1)["end"] <= F.get(sorted_spans, k)["start"]),
    )
    return F.when(disjoint, sizes).otherwise(F.size(places).cast("long"))
