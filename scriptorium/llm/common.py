"""What the corpus operators share: reading inputs, cutting lineage, splitting by hash."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: lineage ends there and lost executors don't repeat the work before it."""
    return written(df, name, compression="zstd")


@contextlib.contextmanager
def rows_a_batch(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for what runs meanwhile: where rows hold whole texts or all shingles of one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


PIECE = 1 << 18


@functools.cache
def _powers_of_a_piece() -> tuple[np.ndarray, np.ndarray]:
    return _powers(PIECE + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE, np.uint64)
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of UTF-8 texts, all at once: their 64-bit hashes, the text each is in, their
    first byte and the one after their last in the joined texts, and the joined texts as bytes (each followed by a space)."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(joined):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), joined
    word = ~_SPACE[joined]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # words of a piece at a time, or one longer word
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        first, size = starts[at], ends[stop - 1] - starts[at]
        up, down = _powers_of_a_piece() if size <= PIECE else _powers(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[joined[first : first + size]] * up[:size], dtype=np.uint64, out=sums[1:])
        s, e = starts[at:stop] - first, ends[at:stop] - first
        hashes[at:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    sizes = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(sizes, starts, side="right"), starts, ends, joined


def slices(texts: list, most: int = 500_000) -> Iterator[slice]:
    """Stretches of texts of about `most` characters in all, for work on many at once in bounded memory."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(first, i)
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield slice(first, len(texts))
