"""Exact Jaccard join of shingle sets by PartEnum signatures.

Two sets of sizes a <= b whose similarity reaches num / den differ in at most
k = 2b (den - num) / (den + num) features.  Sizes are cut into bands, and each
set signs for its own band and for those in which a larger partner can lie.  In
a band the feature domain (64-bit hashes) is cut into so many ranges that, by
the pigeonhole principle, linked sets differ by ``spare`` features at most in
some range.  Each range is cut into parts, and every subset of all but
``spare`` parts makes a signature: the one without the parts that differ is
shared.

Signatures of few features are shared by chance far too often.  Linked sets
agree, but for ``spare`` features, in n1 - k / (spare + 1) ranges at least.  So
a set may leave out all signatures of less than t features if fewer of its
ranges than that have one: some range is left in which all are strong, and the
one that is shared there is made by the other set too, if that one's t is not
larger; if it is, the same holds the other way round.  Each set takes the
largest t it can.

Nodes are documents; equal sets are one node, that with the smallest key.
Candidates are verified in rounds, each only for pairs that the rounds before
left in different components: every node with the hub (first node) of the
buckets that it shares most often, then with its other hubs and the nodes
before it in its buckets.  Of buckets that still hold several components those
of at most ``CROWD`` nodes give their remaining pairs.  The nodes of larger ones
are signed anew with ``FINE`` parts, whose signatures hold more features, and go
through the same rounds; buckets that are large even then give the pairs of
``HUBS`` nodes with the others round by round, beginning with the smallest
components, until one component is left in each.  So no round makes more than
``CROWD`` pairs for a row of a bucket.  Candidates are held against sizes and
parity sketches first, which rule out nearly all that are not linked; texts are
fetched for the others only.

Defined cases: null, empty and word-less texts have an empty set and are
linked with nothing; a text of fewer words than a shingle is one shingle;
repeated rows are equal sets; rows with one id are one document, for whose
links the largest of its sets speaks; null ids take part in links but are
never a component_id.
"""

from __future__ import annotations

from itertools import combinations
from math import floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_ASCII, WordHashes, annotate, cut, field, mix64, window_hashes
from .graph import components


#: Nodes of a bucket up to which all pairs of different components are candidates.
CROWD = 32
#: Nodes of a larger bucket that one round holds against its others.
HUBS = 64
#: Spare parts and parts of a range, for all sets and for those of crowded buckets.
COARSE, FINE = (1, 3), (3, 6)


class PartEnum:
    """Signatures for a Jaccard threshold given as a fraction ``num / den``.

    Bands are powers of two of the difference, or with ``narrow`` steps of
    den / num of the size: a set then signs for two or three of them, but has no
    more ranges than its size needs.
    """

    def __init__(self, num: int = 9, den: int = 10, parts: tuple[int, int] = COARSE, narrow: bool = False):
        self.num, self.den, self.narrow = num, den, narrow
        self.spare, self.parts = parts
        self.subsets = list(combinations(range(self.parts), self.parts - self.spare))

    def difference(self, size: int) -> int:
        """Most features in which a set differs from a linked one that is not larger."""
        return 2 * size * (self.den - self.num) // (self.den + self.num)

    def band(self, size: int) -> int:
        """The band of pairs whose larger set has this size."""
        if self.narrow:
            return floor(log(size) / log(self.den / self.num) + 1e-9)
        return self.difference(size).bit_length()

    def bands(self, size: int) -> range:
        """The bands in which a set of this size can meet a linked one."""
        return range(self.band(size), self.band(max(size, size * self.den // self.num)) + 1)

    def most(self, band: int) -> int:
        """Most features in which linked sets of a band differ."""
        if self.narrow:
            return self.difference(int((self.den / self.num) ** (band + 1)) + 1)
        return (1 << band) - 1

    def sign(self, features: np.ndarray) -> np.ndarray:
        """40-bit signatures of sorted, distinct 64-bit features."""
        size = len(features)
        mixed = np.zeros(size + 1, np.uint64)
        np.cumsum(mix64(features), out=mixed[1:])
        own = self.difference(max(size, size * self.den // self.num))
        out = []
        for band in self.bands(size):
            if not own or not self.most(band):
                continue  # only equal sets can be linked, and those are one node
            ranges = self.most(band) // (self.spare + 1) + 1
            spoilt = min(self.most(band), own) // (self.spare + 1)
            parts = (features >> np.uint64(32)) * np.uint64(self.parts * ranges) >> np.uint64(32)
            bounds = np.searchsorted(parts, np.arange(self.parts * ranges + 1, dtype=np.uint64))
            sums = (mixed[bounds[1:]] - mixed[bounds[:-1]]).reshape(ranges, self.parts)
            sizes = np.diff(bounds).reshape(ranges, self.parts)
            # as many ranges as there may be without a strong signature lie below this one
            weakest = np.sort(np.sort(sizes, axis=1)[:, : self.parts - self.spare].sum(1))
            strong = weakest[ranges - spoilt - 1]
            place = mix64(np.arange(ranges, dtype=np.uint64) * np.uint64(64) + np.uint64(band))
            for number, subset in enumerate(self.subsets):
                held = sizes[:, subset].sum(1) >= strong
                sign = place[held] + np.uint64(number)
                for part in subset:
                    sign = mix64(sign + sums[held, part])
                out.append(sign)
        return np.concatenate(out) >> np.uint64(24) if out else np.empty(0, np.uint64)


def shingle_set(text: bytes | None, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words, or of the whole shorter sequence."""
    words = text.translate(LOWER_ASCII).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    coded = hashes.of(words)
    if len(words) < n:
        return mix64(window_hashes(coded, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(coded, n))


def _key(id_col: str, text_col: str) -> Column:
    """The id, or for rows without one a negative number made of the text."""
    return F.coalesce(F.col(id_col), -1 - F.pmod(F.xxhash64(text_col), F.lit(1 << 62)))


SKETCH = 16


def sketch(features: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """64 * ``words`` parity bits; sets that differ by d features differ by d bits at most."""
    counts = np.bincount((features & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch(features: np.ndarray) -> np.ndarray:
    """A sketch of about two bits for each feature; a longer one folds into a shorter one."""
    return sketch(features, max(SKETCH, 1 << (len(features) // 32).bit_length()))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` without its text, with n_shingles, a 128-bit hash of the set in two halves, and its sketches."""
    fields = [field("n_shingles", T.LongType()), field("set_hi", T.LongType()), field("set_lo", T.LongType()), field("wide", T.ArrayType(T.LongType()))]
    fields += [field(f"s{k}", T.LongType()) for k in range(SKETCH)]

    def make():
        hashes = WordHashes()

        def kernel(texts):
            sets = [shingle_set(t, hashes, n) for t in texts]
            marks = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(len(sets), 2).view(np.int64)
            bits = np.array([sketch(s) for s in sets], np.int64).reshape(len(sets), SKETCH)
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                *(pa.array(np.ascontiguousarray(marks[:, k])) for k in (0, 1)),
                pa.array([wide_sketch(s) for s in sets], pa.list_(pa.int64())),
                *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH)),
            ]

        return kernel

    return annotate(docs, "text", make, fields, drop=("text",))


def _signatures(docs: DataFrame, n: int, enum: PartEnum) -> DataFrame:
    """key and signatures; a task signs a set that it meets again only once."""

    def make():
        hashes, seen = WordHashes(), set()

        def kernel(texts):
            signs = []
            for t in texts:
                s = shingle_set(t, hashes, n)
                mark = xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and mark not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(mark)
                    signs.append(enum.sign(s).view(np.int64))
                else:
                    signs.append(np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in signs])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(signs) if signs else np.empty(0, np.int64)))]

        return kernel

    return annotate(docs, "text", make, [field("signs", T.ArrayType(T.LongType()))], drop=("text",))


def _features(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` without its text, with its features."""

    def make():
        hashes = WordHashes()

        def kernel(texts):
            sets = [shingle_set(t, hashes, n) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]

        return kernel

    return annotate(docs, "text", make, [field("features", T.ArrayType(T.LongType()))], drop=("text",))


def _sketches(features: DataFrame, node: str, mark: str) -> DataFrame:
    return features.select(F.col("node").alias(node), F.col("size").alias(f"{mark}size"), *(F.col(f"s{k}").alias(f"{mark}{k}") for k in range(SKETCH)))


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """False only for pairs whose sizes or sketches rule out the similarity."""
    x, y = F.col(f"{a}size"), F.col(f"{b}size")
    bits = sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))
    return (F.least(x, y) * den >= F.greatest(x, y) * num) & (bits * (den + num) <= (x + y) * (den - num))


def _folded(wide: Column, words: Column) -> Column:
    """A wide sketch of at most twice ``words`` words folded to that length."""
    half = F.zip_with(F.slice(wide, F.lit(1), words), F.slice(wide, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(wide) > words, half).otherwise(wide)


def _linked(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (u, v) whose similarity reaches num / den."""
    likely = pairs.join(_sketches(nodes, "u", "a"), "u").join(_sketches(nodes, "v", "b"), "v").where(_may_link("a", "b", num, den)).select("u", "v")
    # large sets fill the short sketches, so those are held against wide ones
    for node, mark in (("u", "a"), ("v", "b")):
        likely = likely.join(nodes.select(F.col("node").alias(node), F.col("size").alias(f"{mark}size"), F.col("wide").alias(f"{mark}wide")), node)
    words = F.least(F.size("awide"), F.size("bwide"))
    bits = F.aggregate(F.zip_with(_folded(F.col("awide"), words), _folded(F.col("bwide"), words), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, n: t + n)
    fits = bits * (den + num) <= (F.col("asize") + F.col("bsize")) * (den - num)
    likely = cut(likely.where((words == SKETCH) | fits).select("u", "v"), "likely")

    wanted = likely.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = rows.select(F.col("key").alias("node"), "text").join(wanted, "node")
    features = _features(texts, shingle).groupBy("node").agg(F.max_by("features", F.struct(F.size("features"), "features")).alias("features"))
    features = cut(features, "features")
    for node, name in (("u", "fu"), ("v", "fv")):
        likely = likely.join(features.select(F.col("node").alias(node), F.col("features").alias(name)), node)
    a, b = F.size("fu"), F.size("fv")
    same = F.size(F.array_intersect("fu", "fv"))
    return cut(likely.where(same * den >= (a + b - same) * num).select("u", "v"), "linked")


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, num: int = 9, den: int = 10, crowd: int = CROWD, hubs: int = HUBS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", _key("doc_id", "text"))
    sets = cut(_sets(rows, shingle), "sets")
    # aggregates are written before they are joined: only then can a join split a hot set
    same = cut(sets.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("key").alias("node")), "same")
    named = sets.join(same, ["set_hi", "set_lo"], "left").withColumn("node", F.coalesce("node", "key"))
    base = cut(named.select("doc_id", "key", "n_shingles", "node"), "nodes")
    bits = [f"s{k}" for k in range(SKETCH)]
    # rows that share a key have several sets; the largest stands for them
    nodes = sets.groupBy("key").agg(F.max_by(F.struct(F.col("n_shingles").alias("size"), "wide", *bits), F.struct("n_shingles", "set_hi", "set_lo")).alias("x"))
    nodes = cut(nodes.select(F.col("key").alias("node"), "x.*"), "sketches")

    links = _Links(nodes, rows, shingle, num, den)
    signed = rows.select("key", "text")
    for enum in (PartEnum(num, den), PartEnum(num, den, FINE, narrow=True)):
        met = _met(_signatures(signed, shingle, enum).select("key", F.explode("signs").alias("sign")))
        buckets = cut(_as_nodes(met, base), "buckets")
        _with_hubs(links, buckets)
        mixed = _mixed(buckets, links.parts)
        links.verify(_pairs(mixed.where(F.col("size") <= crowd), links))
        crowded = mixed.where(F.col("size") > crowd)
        again = cut(crowded.select("node").distinct(), "crowded")
        if again.isEmpty():
            break
        signed = rows.select("key", "text").join(again.withColumnRenamed("node", "key"), "key")
    else:
        _one_by_one(links, buckets, crowd, hubs)

    labelled = base.join(links.parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    labelled = cut(labelled.select("doc_id", "n_shingles", "part"), "labelled")
    least = cut(labelled.where("n_shingles > 0").groupBy("part").agg(F.min("doc_id").alias("least")), "least")
    return labelled.join(least, "part", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


class _Links:
    """Verified links and the components that they make."""

    def __init__(self, nodes: DataFrame, rows: DataFrame, shingle: int, num: int, den: int):
        self.nodes, self.rows, self.shingle, self.num, self.den = nodes, rows, shingle, num, den
        self.parts = nodes.select("node", F.col("node").alias("component")).limit(0)

    def verify(self, pairs: DataFrame) -> None:
        """Add those of the pairs (u, v) that are links, and join their components."""
        found = _linked(pairs, self.nodes, self.rows, self.shingle, self.num, self.den)
        if not found.isEmpty():
            held = self.parts.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
            self.parts = cut(components(held.unionByName(found)), "parts")


def _met(signed: DataFrame) -> DataFrame:
    """Bucket rows (sign, key, hub, prev) but the first one's, which all of a bucket's rows name as hub."""
    order = Window.partitionBy("sign").orderBy("key")
    first = F.first("key").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut(signed.withColumn("hub", first).withColumn("prev", F.lag("key").over(order)).where("key <> prev"), "met")


def _with_hubs(links: _Links, buckets: DataFrame) -> None:
    """Verify every node with the hub that it meets most often, then with its other hubs and the nodes before it."""
    # how often a node meets a hub says how alike they are
    hubs = buckets.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    links.verify(hubs.groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("v")).select(F.col("node").alias("u"), "v"))
    apart = []
    for other in ("hub", "prev"):
        known = _with_parts(buckets.select("node", other).where(f"node <> {other}").distinct(), links.parts, other)
        apart.append(known.where(f"node_part <> {other}_part").select(F.greatest("node", other).alias("u"), F.least("node", other).alias("v")))
    links.verify(apart[0].unionByName(apart[1]).distinct())


def _as_nodes(met: DataFrame, base: DataFrame) -> DataFrame:
    """Bucket rows with nodes for keys; rows that then join a node with itself are dropped."""
    nodes = base.where("key <> node").select("key", "node").distinct().withColumnRenamed("node", "_node")
    for name in ("key", "hub", "prev"):
        met = met.join(nodes.withColumnRenamed("key", name), name, "left").withColumn(name, F.coalesce("_node", name)).drop("_node")
    return met.select("sign", F.col("key").alias("node"), "hub", "prev").where("node <> hub OR node <> prev").distinct()


def _with_parts(buckets: DataFrame, parts: DataFrame, other: str) -> DataFrame:
    """``buckets`` with the components so far of ``node`` and of the column ``other``."""
    for name in ("node", other):
        part = parts.select(F.col("node").alias(name), F.col("component").alias("part"))
        buckets = buckets.join(part, name, "left").withColumn(f"{name}_part", F.coalesce("part", name)).drop("part")
    return buckets


def _mixed(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(sign, node, part, size) of the buckets that hold several components; size counts a bucket's nodes."""
    members = buckets.select("sign", "node").unionByName(buckets.select("sign", F.col("hub").alias("node"))).distinct()
    return _of_several(cut(_with_part(members, parts), "members"))


def _with_part(members: DataFrame, parts: DataFrame) -> DataFrame:
    return members.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node")).select("sign", "node", "part")


def _of_several(members: DataFrame) -> DataFrame:
    # written before it is joined, so that a hot bucket can be split
    several = members.groupBy("sign").agg(F.count(F.lit(1)).alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    return cut(members.join(cut(several.select("sign", "size"), "several"), "sign"), "mixed")


def _pairs(mixed: DataFrame, links: _Links, first: DataFrame | None = None) -> DataFrame:
    """Pairs of ``first`` (by default all) with the nodes of their bucket that are in other components, if sizes and sketches allow."""
    x = (mixed if first is None else first).select(F.col("sign").alias("x_sign"), F.col("node").alias("x"), F.col("part").alias("x_part"))
    y = mixed.select("sign", F.col("node").alias("y"), F.col("part").alias("y_part"))
    x, y = x.join(_sketches(links.nodes, "x", "a"), "x"), y.join(_sketches(links.nodes, "y", "b"), "y")
    may = (F.col("x_part") != F.col("y_part")) & _may_link("a", "b", links.num, links.den)
    if first is None:
        may = may & (F.col("x") < F.col("y"))
    pairs = x.join(y, (F.col("x_sign") == F.col("sign")) & may)
    return pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def _one_by_one(links: _Links, buckets: DataFrame, crowd: int, hubs: int) -> None:
    """Hold ``hubs`` nodes of each crowded bucket against its others and take them out, until no bucket has two components."""
    mixed = _mixed(buckets, links.parts).where(F.col("size") > crowd)
    while not mixed.isEmpty():
        # both windows are over buckets, so rows are dealt out once
        share = F.count(F.lit(1)).over(Window.partitionBy("sign", "part"))
        order = Window.partitionBy("sign").orderBy("share", "part", "node")
        ranked = cut(mixed.repartition("sign").withColumn("share", share).withColumn("turn", F.row_number().over(order)), "ranked")
        links.verify(_pairs(mixed, links, ranked.where(F.col("turn") <= hubs)))
        rest = ranked.where(F.col("turn") > hubs).select("sign", "node")
        mixed = _of_several(cut(_with_part(rest, links.parts), "members"))
