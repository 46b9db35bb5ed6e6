"""Packing along a space-filling curve.

Each document becomes token ids and a hashed count vector of them, which a fixed random matrix projects to three
dimensions. The Hilbert index of that point orders the corpus, and the ordered token stream is cut into sequences of a
fixed length, so that documents packed together lie near each other. The position of every document in the stream comes
from sums per range of the curve, so no task ever holds more than a stream of rows.

Padding: only the rest at the end of the whole stream is not full; it is cut into powers of two, which need no padding.
Null or empty texts are documents of one token (the end id). Repeated rows are packed once each, in any order.
An empty table gives an empty result. Columns other than the two named are ignored.
"""

from __future__ import annotations

import functools
import gc
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, read_table, shuffle_partitions

DIMS, BITS, TIE_BITS = 3, 10, 24
HASHED = 256
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE vocabularies use for each byte: itself where printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


class WordIds(dict):
    """Token ids, as bytes, of each piece of text between ASCII white space, where this vocabulary's pre-tokenizer always
    splits. Most pieces are a word of Latin letters and marks after it: those go to the BPE model itself, other pieces
    through the whole tokenizer. Bounded: it is emptied when full."""

    SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, tokenizer_file: str, dtype: str, most: int = 300_000, most_runs: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.dtype, self.most, self.most_runs = dtype, most, most_runs
        self.letters = byte_letters()
        self.runs: dict[str, bytes] = {"": b""}
        self[""] = b""

    def run(self, run: str) -> bytes:
        """Ids of one lower-case piece that the pre-tokenizer keeps together."""
        out = self.runs.get(run)
        if out is None:
            text = run if run.isascii() else run.encode().decode("latin1").translate(self.letters)
            out = np.array([x.id for x in self.model.tokenize(text)], self.dtype).tobytes()
            if len(self.runs) >= self.most_runs:
                self.runs.clear()
                self.runs[""] = b""
            if len(run) <= 64:
                self.runs[run] = out
        return out

    def __missing__(self, word: str) -> bytes:
        if found := self.SIMPLE.fullmatch(word):
            out = self.run(found[1].lower()) + self.run(found[2])
        else:
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self) >= self.most:
            self.clear()
            self[""] = b""
        if len(word) <= 64:
            self[word] = out
        return out

    def of(self, text: str) -> bytes:
        for space in "\n\t\r\x0b\x0c":
            if space in text:
                text = text.replace(space, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


@functools.cache
def word_ids(tokenizer_file: str, dtype: str) -> WordIds:
    """One for each Python worker, kept from task to task. Its millions of strings hold no cycles: leave them out of collections."""
    gc.freeze()
    gc.set_threshold(200_000, 50, 1000)
    return WordIds(tokenizer_file, dtype)


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, d), by J. Skilling's transpose method (2004)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def projection(vocabulary: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of each token id, and the matrix from buckets to the curve's dimensions."""
    rng = np.random.default_rng(20260101)
    return rng.integers(0, HASHED, vocabulary), rng.normal(size=(HASHED, DIMS))


def curve_key(counts: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed count vectors (n, HASHED), by their direction alone."""
    unit = np.sqrt(counts)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    unit -= 1 / np.sqrt(HASHED)
    point = unit @ matrix
    cell = ((np.tanh(point) + 1) * (1 << (BITS - 1))).astype(np.int64).clip(0, (1 << BITS) - 1)
    return hilbert_index(cell, BITS)


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int, dtype: str = "<u2") -> DataFrame:
    """(doc_id, n, ids, pos_key) of docs (doc_id, text). Equal keys of copies are spread by a hash of doc_id below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_file, dtype)
        bucket, matrix = projection()
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            ids = [words.of(t or "") + end for t in batch.column(1).to_pylist()]
            counts = np.zeros((len(ids), HASHED))
            lengths = np.zeros(len(ids), np.int64)
            for i, x in enumerate(ids):
                own = np.frombuffer(x, dtype)
                lengths[i] = len(own)
                counts[i] = np.bincount(bucket[own & 0xFFFF], minlength=HASHED)
            key = curve_key(counts, matrix)
            own = np.array([0 if v is None else v for v in batch.column(0).to_pylist()], np.int64)
            with np.errstate(over="ignore"):
                tie = (mix(own.view(np.uint64)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(lengths), pa.array(ids, pa.binary()), pa.array((key << TIE_BITS) | tie)],
                ["doc_id", "n", "ids", "pos_key"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary, pos_key long")


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 1, length: int = 2048, dtype: str = "<u2", with_ids: bool = False) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences of `length` tokens; with_ids adds each piece's ids (binary of dtype)."""
    spark = docs.sparkSession
    tokens = cut(tokenise(docs, tokenizer_file, end_id, dtype), "tokens")
    n = shuffle_partitions(spark)
    ranges = 8 * n
    cuts = tokens.agg(F.percentile_approx("pos_key", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left").astype(np.int32))

    placed = tokens.withColumn("part", range_of("pos_key"))
    # one row for each range of the curve, however many documents there are
    sums = dict(placed.groupBy("part").agg(F.sum("n")).collect())
    first, total = {}, 0
    for part in sorted(sums):
        first[part] = total
        total += sums[part]
    full, rest = divmod(total, length)
    tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    tail_starts = full * length + np.concatenate([[0], np.cumsum(tail)]).astype(np.int64)
    step = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, size, ids, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if own != part:
                    part, at = own, first[own]
                start = 0
                while start < size:
                    if at < full * length:
                        seq, offset = divmod(at, length)
                        take = min(size - start, length - offset)
                    else:
                        i = int(np.searchsorted(tail_starts, at, side="right")) - 1
                        seq, offset = full + i, at - int(tail_starts[i])
                        take = min(size - start, int(tail_starts[i + 1]) - at)
                    piece = ids[start * step : (start + take) * step]
                    crc = zlib.crc32(np.frombuffer(piece, dtype).astype("<u4").tobytes())
                    for column, value in zip(out, (doc, start, take, crc, size, seq, offset, piece), strict=True):
                        column.append(value)
                    start += take
                    at += take
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(x, pa.int64()) for x in out[:7]]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(out[7], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    dealt = placed.repartition(n, "part").sortWithinPartitions("part", "pos_key", "doc_id", "n")
    return dealt.select("doc_id", "n", "ids", "part").mapInArrow(run, PIECE_SCHEMA + ", ids binary" * with_ids)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
