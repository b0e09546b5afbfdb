"""Helpers shared by the training-data operators: shared storage and Arrow text access."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What separates words: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: Text bytes that a vectorised step handles at once; bounds the memory of a Python worker.
STEP_BYTES = 1 << 19


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured and Spark runs in this process alone, one is
    made and set; on a cluster that is an error."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if given:
        return given
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="quadrille-")
    context.setCheckpointDir(made)
    return made


#: How internal tables are made: shuffle files go with the query that made them, and Arrow batches stay small.
WHILE_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


#: No file marks a finished table: only the query that wrote it reads it.
NO_MARK = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


@contextmanager
def set_for(spark: SparkSession, settings: dict[str, str]):
    """The settings hold within the block."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors. ``options`` are those of
    Spark's Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with set_for(spark, WHILE_STORED):
        df.write.options(**{"compression": "zstd", **NO_MARK, **(options or {})}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(df: DataFrame) -> list:
    """The few rows of ``df``, made like a stored table."""
    with set_for(df.sparkSession, WHILE_STORED):
        return df.collect()


def emptied(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more: each is written anew without rows."""
    for df in tables:
        if files := df.inputFiles():
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").options(**NO_MARK).parquet(files[0].rpartition("/")[0])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column as one array, with n + 1 offsets; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Ranges (first, end) of documents of about ``limit`` bytes together; one longer document stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end
        first = end


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (xor-shift and multiply, twice)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and n + 1 offsets of the documents' words. Words end with their document."""
    gap = is_space(raw)
    word = ~gap
    begins, ends = word.copy(), word.copy()
    begins[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] |= word[inner]
    ends[inner - 1] |= word[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        m = _MULTIPLIERS[which]
        size = max(n, STEP_BYTES + 1)
        up = np.full(size, m, np.uint64)
        down = np.full(size, pow(m, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if n > STEP_BYTES + 1:
            del _POWERS[which]
    return have


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, wherever it stands. ``which`` 0 or 1: two independent functions."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(which, len(raw))
    table = np.random.default_rng(20 + which).integers(1, 1 << 63, 256, dtype=np.uint64)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(table[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """The hash of each run of ``n`` word hashes; grams that leave a document are the caller's to drop."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    m = np.uint64((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[which])
    out = words[:count].copy()
    for i in range(1, n):
        out *= m
        out += words[i : i + count]
    return mixed(out)
