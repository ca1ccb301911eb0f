"""What the text operators share: Arrow row kernels, word hashing, cut lineage.

Every row operator is a *kernel*: a function from a list of texts (bytes or
None) to one Arrow array per output column.  ``annotate`` runs a kernel over
Arrow batches beside the columns that are already there, so a row operator
never shuffles, never groups and can be re-run on any executor.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Kernel = Callable[[list], Sequence[pa.Array]]

#: Rows of one Arrow batch.  Texts can be long, so this is far below Spark's default.
BATCH_ROWS = 512

#: Words remembered by one task; beyond it the memory is emptied and filled anew.
CACHE_WORDS = 250_000

#: A-Z to a-z and every other byte to itself.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

MASK64 = (1 << 64) - 1


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the size of Arrow batches in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def annotate(
    df: DataFrame,
    text_col: str,
    make_kernel: Callable[[], Kernel],
    fields: Sequence[T.StructField],
    drop: Sequence[str] = (),
) -> DataFrame:
    """Append ``fields``, computed from ``text_col`` by a kernel built once a task.

    A column of ``df`` that has the name of an output is replaced.  Columns in
    ``drop`` are not returned, and so are not sent back from Python.
    """
    prepare(df.sparkSession)
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in drop]
    df = df.select(*[f"`{f.name}`" for f in df.schema.fields if f in kept or f.name == text_col])
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            columns = [batch.column(n) for n in kept_names]
            columns += kernel(column_bytes(batch, text_col))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept_names, *(f.name for f in fields)])
        del kernel
        give_back()

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def give_back() -> None:
    """Return free memory to the system: the same worker process runs the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent from some C libraries
        if trim:
            trim(0)


def column_bytes(batch: pa.RecordBatch, name: str) -> list:
    """A string column as UTF-8 bytes; null stays None."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


class WordHashes(dict):
    """64-bit hashes of words, remembered in bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` consecutive words, in order."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mix64(out + hashes[k : k + len(out)] + np.uint64(k + 1))
    return out


def unused(columns: Sequence[str], prefix: str) -> str:
    """``prefix``, with as many underscores before it as it takes that no column begins so."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors don't lose it.

    ``instead_of`` is a table that an earlier cut returned and that nothing else
    reads; it is deleted once the new one is there.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    if instead_of is not None:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in instead_of.inputFiles()}:
            old = jvm.org.apache.hadoop.fs.Path(folder)
            old.getFileSystem(conf).delete(old, True)
    # The driver's collector is what lets Spark delete the shuffle files that this table replaces.
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
