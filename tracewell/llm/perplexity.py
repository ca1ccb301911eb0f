"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over UTF-8 bytes, so it needs no vocabulary and knows every text.
Trusted texts give the counts of ``ORDER``-grams; lower orders count distinct
left neighbours; three discounts per order come from counts of counts.  Tables
of probabilities and of back-off weights are made level by level with joins on
the gram, so each is sharded by its key.

To score, the distinct grams of every chunk of documents are looked up in those
tables, again by joins, and come back to the chunk, whose documents are then
scored with what they need and no more.  A document is kept up to its language's
quantile over trusted texts that the model has not seen.  Nothing of the model is broadcast and
no document's grams are shuffled one by one.

Defined cases: null and empty text has no perplexity and is not kept; repeated
rows are scored alike and count as often as they occur; without trusted text
every byte has probability 1/256; a language with few
held-out texts takes the quantile over all of them, and without any no text is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_bytes, cut, field, prepare, unused

ORDER = 5
#: Rows of one chunk, at most; chunks are cut out of one file in row order.
CHUNK_ROWS = 8192
#: Texts up to this quantile of held-out trusted texts are kept.
QUANTILE = 0.99
#: One of so many trusted texts is held out of the model for the quantiles.
HOLD_OUT = 8
#: Held-out texts from which on a language has a quantile of its own.
LEAST_HELD = 50
#: A text of this many bytes is allowed twice the limit, as a mean over few bytes varies more;
#: quantiles are of perplexities without that allowance.
SHORT_BYTES = 16
#: Ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 2_000_000
#: Distinct grams that a task gathers before it hands them on.
GATHER = 1 << 20


def grams(text: bytes, order: int = ORDER) -> np.ndarray:
    """The ``order`` bytes that end at each byte of the text, as one number; the text is preceded by zero bytes."""
    data = np.frombuffer(b"\0" * (order - 1) + text, np.uint8).astype(np.int64)
    out = np.zeros(len(text), np.int64)
    for k in range(order):
        out = out << 8 | data[k : k + len(text)]
    return out


def _gram_counts(texts: DataFrame, order: int) -> DataFrame:
    schema = T.StructType([field("gram", T.LongType()), field("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def merge():
            code, inverse = np.unique(np.concatenate(held), return_inverse=True)
            return code, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            found = [grams(t, order) for t in column_bytes(batch, "text") if t]
            if not found:
                continue
            code, n = np.unique(np.concatenate(found), return_counts=True)
            held.append(code)
            counts.append(n)
            if sum(map(len, held)) >= GATHER:
                code, n = merge()
                if len(code) >= GATHER // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=schema.names)
                    held, counts = [], []
                else:
                    held, counts = [code], [n]
        if held:
            code, n = merge()
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=schema.names)

    return texts.select("text").mapInArrow(run, schema).groupBy("gram").agg(F.sum("n").alias("n"))


def _chunk_grams(docs: DataFrame, order: int) -> DataFrame:
    """The distinct grams of each chunk, made distinct within the task."""
    schema = T.StructType([field("chunk", T.LongType()), field("gram", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out():
            for chunk, code in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), chunk)), pa.array(code)], names=schema.names)

        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for chunk, text in zip(batch.column("chunk").to_pylist(), column_bytes(batch, "text"), strict=True):
                if text:
                    by.setdefault(chunk, []).append(grams(text, order))
            for chunk, parts in by.items():
                code = np.unique(np.concatenate(parts))
                held[chunk] = np.union1d(held[chunk], code) if chunk in held else code
            if sum(map(len, held.values())) >= GATHER:
                yield from out()
                held = {}
        yield from out()

    return docs.select("chunk", "text").mapInArrow(run, schema)


def _discounts(table: DataFrame) -> list[float]:
    """The three discounts, from the numbers of grams that occur one to four times."""
    n = [float(x) for x in table.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()]
    if not all(n[:3]):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    rest = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), rest, strict=True)]


class KneserNey:
    """Tables of one model: ``levels[k]`` has gram and p, ``backoffs[k]`` has context and weight, for order k + 1."""

    def __init__(self, texts: DataFrame, order: int = ORDER):
        self.order = order
        self.levels: list[DataFrame] = [None] * order
        self.backoffs: list[DataFrame] = [None] * order
        counts = [None] * order
        counts[order - 1] = cut(_gram_counts(texts, order), "grams")
        for k in range(order - 2, -1, -1):
            mask = F.lit((1 << 8 * (k + 1)) - 1)
            counts[k] = cut(counts[k + 1].groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
        lower = None
        for k in range(order):
            d1, d2, d3 = _discounts(counts[k])
            less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            context = F.shiftright("gram", 8).alias("context")
            sums = counts[k].groupBy(context).agg(F.sum("n").alias("total"), F.sum(less).alias("mass"))
            backoff = cut(sums.select("context", "total", (F.col("mass") / F.col("total")).alias("weight")), "backoff")
            rows = counts[k].withColumns({"context": context, "less": less}).join(backoff, "context")
            if lower is None:
                rows = rows.withColumn("below", F.lit(1 / 256))
            else:
                suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("suffix")
                rows = rows.withColumn("suffix", suffix).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
            p = F.greatest(F.col("n") - F.col("less"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("below")
            lower = self.levels[k] = cut(rows.select("gram", p.alias("p")), "level")
            self.backoffs[k] = backoff.select("context", "weight")

    def look_up(self, asked: DataFrame) -> DataFrame:
        """(gram, logp) for a table of distinct grams of the full order."""
        out = asked.select("gram").withColumn("p", F.lit(1 / 256))
        for k in range(self.order):
            own = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)) if k + 1 < self.order else F.col("gram")
            out = out.withColumns({"_own": own, "_context": F.shiftright(own, 8)})
            out = out.join(self.levels[k].select(F.col("gram").alias("_own"), F.col("p").alias("_p")), "_own", "left")
            out = out.join(self.backoffs[k].select(F.col("context").alias("_context"), "weight"), "_context", "left")
            out = out.select("gram", F.coalesce("_p", F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p"))
        return out.select("gram", F.log("p").alias("logp"))


def _packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one Arrow batch and chunk as one compressed row."""
    schema = T.StructType([field("chunk", T.LongType()), field("rows", T.BinaryType())])
    press = zstandard.ZstdCompressor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = press(level=5)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            chunks, blobs = [], []
            for chunk in table.column("chunk").unique().to_pylist():
                part = table.filter(pa.compute.equal(table.column("chunk"), chunk)).select(columns).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_table(part)
                chunks.append(chunk)
                blobs.append(packer.compress(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], names=schema.names)

    import pyarrow.compute  # noqa: F401  (binds pa.compute for the closure)

    return docs.select("chunk", *columns).mapInArrow(run, schema)


def perplexities(docs: DataFrame, model: KneserNey, keep: list[str]) -> DataFrame:
    """``keep``, ``n_bytes`` and ``perplexity`` per row of ``docs``, which has ``chunk`` and ``text`` too."""
    prepare(docs.sparkSession)
    order = model.order
    asked = cut(_chunk_grams(docs, order), "asked")
    known = model.look_up(asked.select("gram").distinct())
    answers = asked.join(known, "gram").select("chunk", "gram", F.col("logp").cast("float").alias("logp"))
    schema = T.StructType([*(docs.schema[c] for c in keep), field("n_bytes", T.LongType()), field("perplexity", T.DoubleType())])

    def score(rows: pa.Table, table: pa.Table) -> pa.Table:
        code = table.column("gram").to_numpy()
        ranked = np.argsort(code)
        code, logp = code[ranked], table.column("logp").to_numpy()[ranked].astype(np.float64)
        opener = zstandard.ZstdDecompressor()
        parts = []
        for blob in rows.column("rows").to_pylist():
            part = pa.ipc.open_stream(opener.decompress(blob)).read_all()
            sizes, values = [], []
            texts = part.column("text").combine_chunks()
            for text in texts.cast(pa.binary()).to_pylist():
                sizes.append(len(text) if text else 0)
                values.append(float(np.exp(-logp[np.searchsorted(code, grams(text, order))].mean())) if text else None)
            columns = [part.column(c).combine_chunks() for c in keep]
            parts.append(pa.Table.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(values, pa.float64())], names=schema.names))
        if not parts:
            return schema_table(schema)
        return pa.concat_tables(parts)

    packed = _packed(docs, [*keep, "text"])
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def trusted_texts(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", bound: int = BROADCAST_IDS) -> DataFrame:
    """Texts of the documents with an id in ``ids``; up to ``bound`` ids the texts are not shuffled for it."""
    few = ids.limit(bound + 1).count() <= bound
    return docs.select(id_col, "text").join(F.broadcast(ids) if few else ids, id_col, "left_semi").select("text")


def schema_table(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def chunk_of(path: Column, row: Column, rows: int = CHUNK_ROWS) -> Column:
    """The chunk of a row: ``rows`` rows in sequence of one file."""
    return F.xxhash64(path, F.floor(row / rows))


def held_out(id_col: str = "doc_id") -> Column:
    """Trusted texts that give quantiles and not counts."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(31)), F.lit(HOLD_OUT)) == 0


def verdict(scored: DataFrame, judged: Column, lang: Column, quantile: float = QUANTILE) -> DataFrame:
    """Append ``limit`` and ``kept``: the perplexity must not pass its language's quantile over the rows ``judged``."""
    own = unused(scored.columns, "_kn_")
    # written once: thresholds and verdicts both read it
    rows = cut(scored.withColumns({f"{own}judged": F.coalesce(judged, F.lit(False)), f"{own}lang": lang}), "scored")
    good = rows.where(F.col(f"{own}judged") & F.col("perplexity").isNotNull())
    longer = 1 + SHORT_BYTES / F.greatest("n_bytes", F.lit(1))
    every = F.percentile_approx(F.col("perplexity") / longer, quantile, 10_000)
    limits = good.groupBy(F.col(f"{own}lang").alias(f"{own}l")).agg(every.alias(f"{own}limit"), F.count(F.lit(1)).alias(f"{own}n")).where(F.col(f"{own}n") >= LEAST_HELD)
    general = good.agg(every).first()[0]
    rows = rows.join(limits, F.col(f"{own}lang").eqNullSafe(F.col(f"{own}l")), "left")
    limit = F.coalesce(F.col(f"{own}limit"), F.lit(float("inf") if general is None else float(general))) * longer
    out = rows.withColumn("limit", limit).withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(False)))
    return out.drop(*(f"{own}{c}" for c in ("judged", "lang", "l", "limit", "n")))
