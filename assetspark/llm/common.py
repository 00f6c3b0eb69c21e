"""What the corpus operators share: tables, durable intermediate results, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Only a local session that names none gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, its lineage cut: a lost executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: The folders of tables that stored() returned.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table of the shared folder and read again: columnar and compressed, for larger results.

    The table is removed by dropped(), or when the driver ends.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path, files = _path(spark, where)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    _FOLDERS[out] = where
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables of stored(). Whatever is still to be computed must read none of them: store or settle it before."""
    for table in tables:
        path, files = _path(table.sparkSession, _FOLDERS.pop(table))
        files.delete(path, True)


#: Bytes of an Arrow batch, where the session sets no bound of its own.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at BATCH_BYTES: texts in batches of 64 MB take several times that in an executor and its workers."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(bound, spark.conf.get(bound, BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: What operators keep in a Python worker from one task to the next.
KEPT: list = []


def forget() -> None:
    """Drops what another operator keeps in this worker: workers outlive the stages of a job."""
    for kept in KEPT:
        kept.clear()


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Views of a few rows each, so that what Python makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes, nulls as empty ones."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# --- words of many texts at once, on bytes -------------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that end a word: the six ASCII white-space characters.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that end a word where punctuation does: all of ASCII but letters and digits.
NOT_WORD = np.zeros(256, dtype=bool)
NOT_WORD[:128] = True
NOT_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = _ODD
    return np.multiply.accumulate(out)


_UNDO = np.uint64(pow(int(_ODD), -1, 2**64))


class WordHasher:
    """64-bit hashes of the words of many texts in a few passes over their bytes, without an object per word.

    A word's hash is the sum of a random value for each byte times a power of an odd number, all modulo
    2**64, taken from running sums and shifted back to the word's start, then scrambled.
    """

    def __init__(self, ends: np.ndarray):
        self.ends = ends
        self.up = _powers(1)
        self.down = _powers(1)

    def __call__(self, texts: list[bytes], prefix: int = 0):
        """(hashes, number of words of each text, hashes of the words' first bytes or None)."""
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        stops = np.cumsum(lengths + 1)
        n = len(data)
        if len(self.up) < n + 1:
            self.up = _powers(2 * n)
            low = np.full(2 * n, _UNDO, dtype=np.uint64)
            low[0] = 1
            self.down = np.multiply.accumulate(low)
        blank = self.ends[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * self.up[:n], out=sums[1:])
        at = (sums[ends] - sums[starts]) * self.down[starts]
        words = scramble(at + (ends - starts).astype(np.uint64) * _MIX)
        counts = np.diff(np.searchsorted(starts, np.concatenate(([0], stops))))
        first = None
        if prefix:
            cut = np.minimum(starts + prefix, ends)
            first = scramble((sums[cut] - sums[starts]) * self.down[starts] + np.uint64(77))
        return words, counts, first
