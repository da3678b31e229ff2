"""What the operators of this subpackage share: reading tables, the shared folder, and word splitting on bytes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, only the named columns (others may have any name)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset (single machine)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spectrel-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; whoever writes there creates it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def octets(name: str = "text"):
    """A text column as UTF-8 bytes, null as none."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


def parts(batches, at: int, size: int = 1_000_000):
    """Arrow batches cut into runs of rows whose texts (column `at`) have about `size` bytes together, or one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
            yield batch.slice(a, b - a)
            a = b


def table_of(separator) -> bytes:
    """A translation table: A-Z to a-z, separators to a blank."""
    return bytes(32 if separator(c) else c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z. Bytes of longer code points are all above 0x7F.
ALNUM = table_of(lambda c: not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128))
#: Words [^\x20\x09-\x0D]+ after lower-casing A-Z.
BLANKS = table_of(lambda c: c == 32 or 9 <= c <= 13)


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def blank_words(text: bytes) -> list[bytes]:
    return text.translate(BLANKS).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Kinds of bytes: each of kind SINGLE is a word; between a byte of kind STICKY and another no word ends.
SINGLE, STICKY = 2, 4
_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, dtype=np.uint64))


def byte_words(texts: list[bytes], translation: bytes, kinds=None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined translated texts, and of all words in order their starts there, sizes and 64-bit hashes; the number of words of each text.

    A word's hash is mixed from a polynomial over its bytes and its length, taken in one pass over the joined texts. kinds(bytes)
    gives each byte a kind: words also end where the kind changes between bytes of kinds below STICKY, and between two of kind SINGLE.
    """
    joined = (b" ".join(texts) + b" ").translate(translation)
    b = np.frombuffer(joined, dtype=np.uint8)
    inside = b != 32
    edge = inside[1:] != inside[:-1]
    if kinds is not None:
        kind = kinds(b)
        edge |= ((kind[1:] != kind[:-1]) | (kind[1:] == SINGLE)) & (np.maximum(kind[1:], kind[:-1]) < STICKY)
    starts = np.flatnonzero(inside & np.concatenate([[True], edge]))
    ends = np.flatnonzero(inside & np.concatenate([edge, [True]])) + 1
    lengths = np.array([len(t) for t in texts], dtype=np.int64) + 1
    bounds = np.cumsum(lengths)
    counts = np.diff(np.searchsorted(starts, bounds, side="left"), prepend=0)
    size = ends - starts
    if not len(starts):
        return joined, starts, size, np.zeros(0, dtype=np.uint64), counts
    # position within the word, from its start: equal words give equal sums
    at = np.arange(len(b), dtype=np.int64)[inside] - np.repeat(starts, size)
    value = (b[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[at & 0xFFFF]
    if size.max() > 0xFFFF:  # beyond the table, a block's number enters too
        far = at > 0xFFFF
        value[far] = mix(value[far] + (at[far] >> 16).astype(np.uint64))
    first = np.cumsum(size) - size
    sums = np.add.reduceat(value, first)
    return joined, starts, size, mix(mix(sums) + size.astype(np.uint64)), counts


def byte_word_hashes(texts: list[bytes], translation: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words of each text."""
    return byte_words(texts, translation)[3:]
