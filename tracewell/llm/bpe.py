"""BPE as a deterministic automaton over tokens.

``MergeAutomaton`` starts from the automaton with one state that accepts every
sequence of symbols and applies a *gadget* for each merge ``(a, b) -> c`` in
order of rank.  The gadget adds arcs labelled ``c`` around every path ``a b``
and gives the arcs labelled ``a`` a target of their own from which ``b`` is
dead.  What is left accepts just the token sequences that BPE produces, one for
each word, so a word is encoded by following live arcs and decoded by emitting
the labels of the arcs it took.

A state is kept as the label that was read last.  Its row, the dead arcs, is
shared with the state it was split from: an arc ``u`` is dead when a gadget
killed it, or killed a leftmost part of it before that part had grown into
``u``.  Rows are looked up arc by arc and remembered.

Defined cases: null and empty text give no ids; text of white space only gives
none; equal rows are encoded alike; no text length limit.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import CACHE_WORDS, annotate, field

END = "</w>"

#: Runs without white space remembered by one task, beside the words that they are made of.
CACHE_CHUNKS = CACHE_WORDS // 2

#: The split pattern that the vocabulary file states, for ASCII text in lower case.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")
ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in table]
    table.update({b: chr(256 + k) for k, b in enumerate(hidden)})
    return [table[b] for b in range(256)]


class MergeAutomaton:
    """The token automaton of one merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values()) + 1
        self.labels = [""] * size
        for text, label in vocab.items():
            self.labels[label] = text
        self.left = [-1] * size
        self.right = [-1] * size
        self.born = [-1] * size
        #: (a, b) -> rank of the gadget that killed arc b after label a.
        self.killed: dict[int, int] = {}
        self._rows: dict[int, bool] = {}
        for rank, (a, b) in enumerate(merges):
            self._gadget(vocab[a], vocab[b], vocab[a + b], rank)
        self._rows.clear()
        self._trie: dict = {}
        for text, label in vocab.items():
            self._insert(text, label)

    def _gadget(self, a: int, b: int, c: int, rank: int) -> None:
        if not self._live(a, b, rank):
            return  # no path a b is left, so this merge never happens
        self.killed[a << 20 | b] = rank
        if self.born[c] < 0 and self.left[c] < 0:
            self.left[c], self.right[c], self.born[c] = a, b, rank

    def _dead_since(self, state: int, arc: int, before: int) -> int:
        """Rank at which ``arc`` died in the row of ``state``, or -1."""
        while state >= 0:
            rank = self.killed.get(state << 20 | arc, -1)
            if 0 <= rank < before:
                return rank
            # the row was split from that of the state's last part, when the state was born
            before = min(before, self.born[state]) if self.born[state] >= 0 else before
            state = self.right[state]
        return -1

    def _live(self, state: int, arc: int, before: int) -> bool:
        child_born = -1
        while arc >= 0:
            since = self._dead_since(state, arc, before)
            if since >= 0 and (child_born < 0 or child_born >= since):
                return False
            child_born, arc = self.born[arc], self.left[arc]
        return True

    def live(self, state: int, arc: int) -> bool:
        """Whether the arc ``arc`` leaves ``state``; the start has every arc."""
        key = state << 20 | arc
        known = self._rows.get(key)
        if known is None:
            if len(self._rows) >= CACHE_WORDS:
                self._rows.clear()
            known = self._rows[key] = self._live(state, arc, 1 << 30)
        return known

    def _insert(self, text: str, label: int) -> None:
        end = text.endswith(END) and len(text) > len(END)
        node = self._trie
        for ch in text[: -len(END)] if end else text:
            node = node.setdefault(ch, {})
        node[1 if end else 0] = label

    def encode_word(self, word: str) -> list[int]:
        """Labels of the one accepting path for a word of byte symbols."""
        n = len(word)
        if not n:
            return []
        state = [-2] * (n + 1)
        came = [0] * (n + 1)
        state[0] = -1
        for i in range(n):
            q = state[i]
            if q == -2:
                continue
            node = self._trie
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                arc = node.get(1 if j == n - 1 else 0)
                if arc is not None and (q < 0 or self.live(q, arc)):
                    state[j + 1], came[j + 1] = arc, i
        if state[n] == -2:
            raise ValueError("the vocabulary lacks a symbol of this word")
        path, j = [], n
        while j:
            path.append(state[j])
            j = came[j]
        return path[::-1]


class WordBpe:
    """Encoder and decoder for a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        # the library only normalizes and splits, so it gets no tokens to hold
        model |= {"vocab": {}, "merges": []}
        tokenizer = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None}))
        self._normalize = tokenizer.normalizer.normalize_str
        self._split = tokenizer.pre_tokenizer.pre_tokenize_str
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_re = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) or r"(?!)")
        self.labels = list(self.automaton.labels)
        for text, label in self._special.items():
            self.labels += [""] * (label + 1 - len(self.labels))
            self.labels[label] = text
        self._symbols = byte_symbols()
        #: Ids of ASCII words, of other words by their symbols, and of chunks that are no ASCII word themselves.
        self._words: dict[str, bytes] = {}
        self._others: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}

    def _word(self, held: dict[str, bytes], key: str, symbols: str) -> bytes:
        if len(self._words) + len(self._others) >= CACHE_WORDS:
            self._words.clear()
            self._others.clear()
        ids = held[key] = np.array(self.automaton.encode_word(symbols), "<u4").tobytes()
        return ids

    def _plain(self, text: str) -> bytes:
        out = []
        if text.isascii():
            for word in ASCII_WORDS.findall(text.lower()):
                ids = self._words.get(word)
                if ids is None:
                    symbols = word if word.isprintable() else "".join(self._symbols[b] for b in word.encode())
                    ids = self._word(self._words, word, symbols)
                out.append(ids)
        else:
            for word, _ in self._split(self._normalize(text)):
                ids = self._others.get(word)
                out.append(self._word(self._others, word, word) if ids is None else ids)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without ASCII white space; no word and no special token crosses such space."""
        out = []
        at = 0
        if "<|" in chunk:
            for m in self._special_re.finditer(chunk):
                out += [self._plain(chunk[at : m.start()]), self._special[m.group()].to_bytes(4, "little")]
                at = m.end()
        out.append(self._plain(chunk[at:] if at else chunk))
        ids = b"".join(out)
        if chunk not in self._words:
            if len(self._chunks) >= CACHE_CHUNKS:
                self._chunks.clear()
            self._chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        word, known, chunk = self._words.get, self._chunks.get, self._chunk
        out = []
        for c in ASCII_SPACE.split(text):
            if c:
                got = word(c)
                if got is None:
                    got = known(c)
                out.append(chunk(c) if got is None else got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, joined as the library joins tokens without a decoder."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(df: DataFrame, vocabulary: str, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Append ``ids`` (binary, little-endian 32-bit) and ``decoded`` (string).

    ``vocabulary`` is the path of a word-end BPE file on every executor.
    Null text is taken as empty: no ids, an empty decoded text.
    """

    def make():
        bpe = WordBpe(vocabulary)

        def kernel(texts):
            ids = [bpe.encode(t.decode("utf-8", "replace")) if t else b"" for t in texts]
            return [pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())]

        return kernel

    return annotate(df, text_col, make, [field("ids", T.BinaryType()), field("decoded", T.StringType())], drop)
