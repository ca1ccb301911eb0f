"""Removal of long repeated byte strings with suffix arrays of two-stage sorting.

A byte goes when a string of ``length`` bytes that covers it starts anywhere
else too.  Sorting the suffixes of the whole collection in one array is not
possible on a cluster, so equal strings are first brought together:

1. Every string of ``length`` bytes has an anchor, the 64-byte gram with the
   least hash in it.  Equal strings have equal anchors, so only grams that
   occur twice matter; the others, nearly all, are dropped after a count.
2. The *context* of an anchor is the stretch that the strings with that anchor
   fill.  Equal contexts are counted; those that occur twice or more are
   repeated as a whole, and one of each kind stands for them all.
3. Differing contexts of one gram go to one block.  A block's suffix array is
   made by two-stage sorting: the suffixes smaller than their successors are
   sorted directly, the others are induced from them by bucket scans.
   Neighbours whose common prefix reaches ``length`` are repeated strings.
   A gram with more contexts than a block may hold has the strings of its
   contexts counted by fingerprint instead, pre-aggregated in each task.

Defined cases: null text is taken as empty; texts shorter than ``length`` keep
all their bytes; matches never cross documents; equal rows are repeats of one
another; null and repeated doc_ids are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_bytes, cut, field, mix64, prepare

GRAM = 64
#: Bytes of one block, and the number of differing contexts up to which a gram is put in blocks.
BLOCK_BYTES = 1 << 21
BLOCK_CONTEXTS = 16_384

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


class Fingerprints:
    """Hashes of any stretch of one text."""

    def __init__(self, text: bytes, powers: Powers):
        data = np.frombuffer(text, np.uint8)
        up, self._down = powers.upto(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[:-1], out=self._sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self._sums[hi] - self._sums[lo]) * self._down[lo])

    def all(self, size: int) -> np.ndarray:
        n = len(self._sums) - size
        return mix64((self._sums[size:] - self._sums[:n]) * self._down[:n])


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``size`` values."""
    out, have = values, 1
    while 2 * have <= size:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = size - have
    return pick(out[:-rest], out[rest:]) if rest else out


def anchors(text: bytes, length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Gram hash, context hash, start of the gram, start and end of the context."""
    n = len(text)
    prints = Fingerprints(text, powers)
    grams = prints.all(GRAM)
    width = length - GRAM + 1
    least = _sliding(grams, width, np.minimum)
    # a gram that is the least of any string; each string belongs to the leftmost of its own
    top = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    found = _sliding(top, width, np.maximum) == grams
    at = np.flatnonzero(found)
    owner = (np.cumsum(found) - found)[: len(least)]
    wrong = np.flatnonzero(grams[at[owner]] != least)
    while len(wrong):
        owner[wrong] += 1
        wrong = wrong[grams[at[owner[wrong]]] != least[wrong]]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    at, lo = at[owner[first]], first
    hi = np.append(first[1:], len(least)) - 1 + length
    context = mix64(prints.of(lo, hi) + mix64(((at - lo) * 65536 + (hi - at)).astype(np.uint64)))
    return grams[at], context, at, lo, hi


def two_stage(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text`` (uint8), ordered by the first ``depth`` bytes at least."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    values = text.astype(np.int16)
    # smaller than its successor: the next differing byte is larger (the end counts as smallest)
    change = np.flatnonzero(values[:-1] != values[1:])
    ends = np.append(change, n - 1)  # last places of the runs of one byte
    after = np.append(values[change + 1], -1)
    small = np.repeat(values[ends] < after, np.diff(ends, prepend=-1))

    direct = _sorted_suffixes(text, np.flatnonzero(small).astype(np.int32), depth)
    counts = np.bincount(text, minlength=256)
    begin = np.concatenate([[0], np.cumsum(counts)])
    array = np.full(n, -1, np.int32)
    head = begin[:-1].copy()
    firsts = text[direct]
    tail = begin[1:] - np.bincount(firsts, minlength=256)
    array[np.arange(len(direct)) - np.searchsorted(firsts, np.arange(256))[firsts] + tail[firsts]] = direct

    def put(found: np.ndarray, bucket: np.ndarray) -> None:
        order = np.argsort(bucket, kind="stable")
        found, bucket = found[order], bucket[order]
        start = np.searchsorted(bucket, np.arange(256))
        array[head[bucket] + np.arange(len(found)) - start[bucket]] = found
        head[:] += np.bincount(bucket, minlength=256)

    put(np.array([n - 1]), text[n - 1 :])  # the last suffix is larger than the empty one
    for c in np.flatnonzero(counts):
        done = begin[c]
        while done < head[c]:  # runs of one byte induce within their own bucket, in order
            new = array[done : head[c]]
            done = head[c]
            new = new[new > 0] - 1
            new = new[(values[new] == c) & ~small[new]]
            if len(new):
                put(new, text[new])
        new = array[begin[c] : begin[c + 1]]
        new = new[new > 0] - 1
        new = new[values[new] > c]
        if len(new):
            put(new, text[new])
    return array


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers that sort like them."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(text)].astype(np.uint64)
    return out


def _sorted_suffixes(text: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """``which`` ordered by the suffixes that start there, by ``depth`` bytes; the end sorts first."""
    n = len(text)
    keys = _words(text)
    order = which[np.argsort(keys[which])]
    tied = np.arange(len(order))
    group = np.zeros(len(order), np.int64)
    now, done = keys[order], 8
    while True:
        new = np.empty(len(tied), bool)
        new[:1] = True
        np.logical_or(now[1:] != now[:-1], group[1:] != group[:-1], out=new[1:])
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        group = np.cumsum(new[~alone]) - 1
        if not len(tied) or done >= depth:
            break
        # as many further bytes as fit into one number below the group's
        step = (64 - int(group[-1]).bit_length()) // 8
        at = order[tied] + done
        word = keys[np.minimum(at, n - 1)] >> np.uint64(64 - 8 * step)
        word[at >= n] = 0
        now = group.astype(np.uint64) << np.uint64(8 * step) | word if step < 8 else word
        moved = np.argsort(now)
        order[tied] = order[tied][moved]
        now, done = now[moved], done + step
        group = np.zeros(len(tied), np.int8)
    late = np.isin(group, group[order[tied] >= n - depth - 8]) if len(tied) else np.zeros(0, bool)
    if late.any():  # the end of the text was read as zeros; of equal suffixes the shorter one is smaller
        places, own = tied[late], group[late]
        order[places] = order[places][np.lexsort((-np.where(order[places] >= n - depth - 8, order[places], -1), own))]
    return order


def common_prefixes(text: np.ndarray, array: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares its first ``depth`` bytes with the one before it in ``array``."""
    same = np.zeros(len(array), bool)
    if len(array) < 2:
        return same
    pairs = np.arange(1, len(array))
    keys = _words(text)
    for at in range(0, depth, 8):
        step = min(at, depth - 8)
        pairs = pairs[keys[array[pairs] + step] == keys[array[pairs - 1] + step]]
    same[pairs] = True
    return same


def repeated_in_block(contexts: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(document, start, end) of the repeated stretches among contexts (document, start, bytes)."""
    segments: list[list] = []
    for key, lo, data in sorted(contexts):
        last = segments[-1] if segments else None
        if last and last[0] == key and lo <= last[1] + len(last[2]):
            more = lo + len(data) - last[1] - len(last[2])
            if more > 0:
                last[2] += data[-more:]
        else:
            segments.append([key, lo, bytearray(data)])
    text = np.frombuffer(b"\0".join(bytes(s[2]) for s in segments) + b"\0", np.uint8)
    sizes = np.array([len(s[2]) for s in segments])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    valid = np.zeros(len(text), bool)
    for a, size in zip(starts, sizes, strict=True):
        valid[a : a + max(0, size - length + 1)] = True
    array = two_stage(text, length + 8)
    array = array[valid[array]]
    same = common_prefixes(text, array, length)
    twice = np.zeros(len(text), bool)
    twice[array[same]] = True
    twice[array[np.flatnonzero(same) - 1]] = True
    out = []
    places = np.flatnonzero(twice)
    if len(places):
        owner = np.searchsorted(starts, places, "right") - 1
        gap = np.flatnonzero((np.diff(places) > length) | (np.diff(owner) > 0)) + 1
        for run in np.split(np.arange(len(places)), gap):
            a, b = places[run[0]], places[run[-1]] + length
            key, lo, _ = segments[owner[run[0]]]
            shift = lo - starts[owner[run[0]]]
            out.append((key, int(a + shift), int(b + shift)))
    return out


_SPAN_SCHEMA = T.StructType([field("key", T.LongType()), field("lo", T.IntegerType()), field("hi", T.IntegerType())])


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    schema = T.StructType([field("gram", T.LongType()), field("context", T.LongType()), *_SPAN_SCHEMA.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            found = []
            for key, text in zip(batch.column("key").to_pylist(), column_bytes(batch, "text"), strict=True):
                if text and len(text) >= length:
                    gram, context, _, lo, hi = anchors(text, length, powers)
                    found.append((gram.view(np.int64), context.view(np.int64), np.full(len(lo), key), lo.astype(np.int32), hi.astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _block_rows(contexts: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Spans repeated among the contexts of each gram; partitions are sorted by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list = []
        size, last = 0, None

        def flush():
            spans = repeated_in_block(block, length)
            columns = list(zip(*spans, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=_SPAN_SCHEMA.names)

        for batch in batches:
            for gram, key, lo, data in zip(batch.column("gram").to_pylist(), batch.column("key").to_pylist(), batch.column("lo").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if gram != last and size >= block_bytes:
                    yield flush()
                    block, size = [], 0
                last = gram
                block.append((key, lo, data))
                size += len(data)
        if block:
            yield flush()

    return contexts.select("gram", "key", "lo", "data").mapInArrow(run, _SPAN_SCHEMA)


def _string_rows(contexts: DataFrame, length: int) -> DataFrame:
    """print, key, lo of every string of the contexts."""
    schema = T.StructType([field("print", T.LongType()), field("key", T.LongType()), field("lo", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            found = []
            for key, lo, data in zip(batch.column("key").to_pylist(), batch.column("lo").to_pylist(), batch.column("data").to_pylist(), strict=True):
                prints = Fingerprints(data, powers).all(length).view(np.int64)
                found.append((prints, np.full(len(prints), key), (lo + np.arange(len(prints))).astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=schema.names)

    return contexts.select("key", "lo", "data").mapInArrow(run, schema)


def repeated_spans(rows: DataFrame, length: int = 200, block_bytes: int = BLOCK_BYTES, block_contexts: int = BLOCK_CONTEXTS) -> DataFrame:
    """(key, lo, hi): stretches of bytes to remove, possibly overlapping, for rows (key, text)."""
    spark = prepare(rows.sparkSession)
    found = cut(_anchor_rows(rows, length), "anchors")
    # counts are written before they are joined: only then can a join split a gram that a third of all texts hold
    twice = cut(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "twice")
    found = cut(found.join(twice, "gram"), "candidates")

    kinds = cut(found.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "lo", "hi")).alias("first")), "kinds")
    whole = found.join(kinds.where("n > 1").select("gram", "context"), ["gram", "context"]).select("key", "lo", "hi")

    varied = cut(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "varied")
    wanted = kinds.join(varied, "gram").select("gram", "kinds", "first.*")
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "kinds", "lo", "hi")).alias("wanted"))
    data = F.expr("substring(CAST(text AS BINARY), w.lo + 1, w.hi - w.lo)")
    contexts = rows.join(per_text, "key").select("key", "text", F.explode("wanted").alias("w"))
    contexts = cut(contexts.select("w.gram", "w.kinds", "key", "w.lo", data.alias("data")), "contexts")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = contexts.where(F.col("kinds") <= block_contexts).repartition(parts, "gram").sortWithinPartitions("gram")
    strings = _string_rows(contexts.where(F.col("kinds") > block_contexts), length).distinct()
    strings = cut(strings, "strings")
    again = cut(strings.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "again")
    common = strings.join(again, "print").select("key", "lo", (F.col("lo") + length).alias("hi"))
    return whole.unionByName(_block_rows(blocks, length, block_bytes)).unionByName(common)


def merged(spans: list, n: int) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, min(b, n)) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``removed`` (byte spans) and ``kept`` (binary) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows.select("key", "text"), length).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    joined = rows.join(cut(spans, "spans"), "key", "left").drop("key")
    span_type = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    schema = T.StructType(
        [
            field("doc_id", docs.schema[id_col].dataType),
            field("n_bytes", T.LongType()),
            field("removed", T.ArrayType(T.StructType([field("lo", T.IntegerType()), field("hi", T.IntegerType())]))),
            field("kept", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, spans in zip(column_bytes(batch, "text"), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                cuts = merged(spans or [], len(text))
                out, at = [], 0
                for lo, hi in cuts:
                    out.append(text[at:lo])
                    at = hi
                sizes.append(len(text))
                removed.append([{"lo": a, "hi": b} for a, b in cuts])
                kept.append(b"".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, span_type), pa.array(kept, pa.binary())], names=schema.names)

    return joined.mapInArrow(run, schema)
