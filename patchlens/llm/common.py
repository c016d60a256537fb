"""Shared helpers: hand-off tables in the cluster's shared folder and vectorised
text primitives over Arrow string batches.

Hand-off tables are written as Parquet under ``spark.checkpoint.dir``, so every
executor can read them and a lost executor costs one task, not the result.
"""
from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.terms import coded, runs
from patchlens.session import shared_dir

#: Bytes of text that one vectorised step works on; numpy needs about 60 bytes for each.
STEP_BYTES = 1 << 20


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about 16 MB for this session's Python steps, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


class Handoff:
    """Tables written once and read many times; ``drop`` deletes those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._handoff_path = path  # noqa: SLF001 - own marker on our own frame
        # The shuffle files of the finished job go when the JVM collects its garbage.
        self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._handoff_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_key(text="text"):
    """Identity of a text: the first 128 bits of its SHA-256 (null counts as empty)."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 1, 16)


# ---------------------------------------------------------------- Arrow side

def string_parts(col: pa.Array, step: int = STEP_BYTES):
    """Yield (first row, byte buffer, row offsets) for runs of rows of about ``step`` bytes.

    Nulls count as empty texts. A longer row is a part of its own.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(col)
    while i < n:
        j = int(np.searchsorted(off, off[i] + step, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, buf[off[i]:off[j]], (off[i:j + 1] - off[i])
        i = j


#: The byte set that separates words: blank and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int):
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(1 << 12, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, base, np.uint64)]))
            inv = pow(base, -1, 1 << 64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, inv, np.uint64)]))
        have = up, down
        if m <= 1 << 23:
            _POWERS[base] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def gram_hash(values: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hash of every run of k consecutive values.

    A polynomial modulo 2**64, so long runs of two values in certain orders can meet: of bytes it is for candidates that are compared
    themselves, of hashed words for windows of far fewer than 1,024 words.
    """
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values) + 1, base)
    with np.errstate(over="ignore"):
        g = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * down[:len(values)], out=g[1:])
        return mix64((g[k:] - g[:n]) * up[:n])


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over every w consecutive entries, by doubling."""
    s = 1
    while s < w:
        d = min(s, w - s)
        x = op(x[:-d], x[d:])
        s += d
    return x


def word_lanes(buf: np.ndarray, off: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+``: two 64-bit hashes of each (the halves of its XXH3-128), the number of words before each row, starts and ends.

    Only the distinct words are hashed, as they are: no arithmetic on bytes in which two words of one pattern might meet.
    """
    inside = ~SPACE[buf]
    start, stop, rows = runs(inside, off)
    codes, names = coded(buf, inside, start, stop)
    lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names.to_pylist())), ">u8").reshape(-1, 2).astype(np.uint64)
    return lanes[codes, 0], lanes[codes, 1], rows, start, stop


def word_hashes(buf: np.ndarray, off: np.ndarray):
    """64-bit hash of every word, the number of words before each row, starts and ends."""
    one, _, rows, start, stop = word_lanes(buf, off)
    return one, rows, start, stop


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
