"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), the last sum in time linear in the
features. Features: the words (hashed, each with weight 1/words), buckets of statistics of the text's structure (how many
words repeat the one before, marks after words, capitals, repeated lines, ...), and metadata of the text itself (its
length in characters, words and lines). Nothing else of a row is an input.

Fitted on the driver on at most `most_labels` pairs of a document and a label, taken in the order of a hash of doc_id; rows
whose crc32(doc_id) mod 5 is 0 are never among them. Scoring covers every whole text.

Null and empty texts have the features of a text of no words and get a score like any other. Labels that are null are left
out; a document labelled twice counts twice. With no labels, or labels of one kind only, scores are that share (0.5
without any). Repeated rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read_table, slices

WORDS = 1 << 13
BUCKETS = 24
STATS = ("chars", "words", "lines", "word_length", "capitals", "digits", "marks", "high", "repeats", "distinct", "line_repeats", "bars", "after_marks", "short")
RANK = 8
SIZE = WORDS + BUCKETS * len(STATS)
MOST_LABELS = 8000

#: The class of each byte: 0 other, 1 capital, 2 digit, 3 mark, 4 not ASCII, 5 bar.
_CLASS = np.zeros(256, np.int8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[]^_{}~"]] = 3
_CLASS[128:] = 4
_CLASS[ord("|")] = 5


class Hashed(dict):
    """The hash of each word, and below it whether it ends in marks and is short. Bounded: it is emptied when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        bare = word.rstrip("!#$%&*.,;:?|")
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & 0x3FFFFFFFFFFF
        out = h << 2 | (len(word) - len(bare) >= 2) << 1 | (len(bare) <= 2)
        if len(self) > 150_000:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


@functools.cache
def _hashed() -> Hashed:
    return Hashed()


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of rows."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts (their features, one after the other), how many each text has, and the statistics' features (n, STATS)."""
    table = _hashed()
    split = [t.split() for t in texts]
    n = np.array([len(x) for x in split], np.int64)
    packed = np.concatenate([np.fromiter(map(table.__getitem__, x), np.int64, len(x)) for x in split]) if len(split) else np.zeros(0, np.int64)
    words = packed >> 2
    same = np.zeros(len(words), np.int64)
    same[1:] = words[1:] == words[:-1]
    starts = (np.cumsum(n) - n)[n > 0]
    same[starts] = 0
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    kinds = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    of = lambda k: _sums((kinds == k).astype(np.int8), size)
    lines = [[y for y in t.split("\n") if y] for t in texts]
    count = np.maximum(n, 1)
    width = np.maximum(size, 1)
    n_lines = np.array([len(x) for x in lines])
    distinct = np.array([len(set(x)) for x in split])
    log = lambda x: np.log2(1 + x)
    share = lambda x, of=count: np.ceil((BUCKETS - 1) * np.sqrt(x / of))
    columns = [
        log(np.array([len(t) for t in texts])),
        log(n),
        2 * log(n_lines),
        (size - n) / count,
        share(of(1), width),
        share(of(2), width),
        share(of(3), width),
        share(of(4), width),
        share(_sums(same, n)),
        (BUCKETS - 1) * distinct / count,
        share(n_lines - np.array([len(set(x)) for x in lines]), np.maximum(n_lines, 1)),
        share(of(5), width),
        share(_sums(packed >> 1 & 1, n)),
        share(_sums(packed & 1, n)),
    ]
    stats = np.stack([np.clip(c, 0, BUCKETS - 1).astype(np.int64) for c in columns], axis=1) if texts else np.zeros((0, len(STATS)), np.int64)
    return words % WORDS, n, WORDS + stats + BUCKETS * np.arange(len(STATS))


def machine(w0: float, w: np.ndarray, v: np.ndarray, words: np.ndarray, n: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The factorisation machine's sums (before the sigmoid) and sum v x. Words weigh 1/words of their text, statistics 1."""
    x = (1 / np.maximum(n, 1))[:, None]
    linear = w0 + _sums(w[words], n) * x[:, 0] + w[stats].sum(1)
    vs = v[stats]
    s = _sums(v[words], n) * x + vs.sum(1)
    squares = _sums((v * v).sum(1)[words], n) * x[:, 0] ** 2 + (vs * vs).sum((1, 2))
    return linear + 0.5 * ((s * s).sum(1) - squares), s


def fit(words: np.ndarray, n: np.ndarray, stats: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss by AdaGrad."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE), rng.normal(scale=0.02, size=(SIZE, RANK))
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0, 1) or not len(labels):
        return float(np.log((share + 1e-3) / (1 - share + 1e-3))), w, np.zeros_like(v)
    w0 = float(np.log(share / (1 - share)))
    gw, gv, g0 = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3), 1e-3
    ends = np.cumsum(n)
    for epoch in range(epochs):
        rate = 0.15 / (1 + 0.3 * epoch)
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            own_n = n[rows]
            own = np.concatenate([words[ends[r] - n[r] : ends[r]] for r in rows])
            own_stats = stats[rows]
            z, s = machine(w0, w, v, own, own_n, own_stats)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            at_row = np.repeat(np.arange(len(rows)), own_n)
            x = 1 / np.maximum(own_n, 1)
            ids = np.concatenate([own, own_stats.ravel()])
            owner = np.concatenate([at_row, np.repeat(np.arange(len(rows)), len(STATS))])
            value = np.concatenate([x[at_row], np.ones(own_stats.size)])
            used, place = np.unique(ids, return_inverse=True)
            step = d[owner] * value
            grad_w = np.bincount(place, step, len(used)) + 1e-5 * w[used]
            grad_v = np.stack([np.bincount(place, step * (s[owner, f] - value * v[ids, f]), len(used)) for f in range(RANK)], axis=1) + 1e-4 * v[used]
            gw[used] += grad_w**2
            gv[used] += grad_v**2
            w[used] -= rate * grad_w / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * grad_v / np.sqrt(gv[used])
            g0 += d.sum() ** 2
            w0 -= rate * d.sum() / np.sqrt(g0)
    return w0, w, v


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit on labelled rows (doc_id, quality) that are not held out; at most most_labels of them, texts as hashed features only."""
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(most_labels)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for span in slices(texts):
                part = batch.iloc[span]
                words, n, stats = features(texts[span])
                ends = np.cumsum(n)
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"], "quality": part["quality"], "words": [words[e - k : e].astype(np.int16).tobytes() for e, k in zip(ends, n, strict=True)], "stats": [x.astype(np.int16).tobytes() for x in stats]}
                )

    # ids has most_labels rows at most: 12 bytes each to broadcast; ids that many documents share are cut after the join
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    found = sample.mapInPandas(run, "doc_id long, quality int, words binary, stats binary")
    rows = sorted(found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "words", "stats").limit(most_labels).collect())
    words = [np.frombuffer(r.words, np.int16).astype(np.int64) for r in rows]
    stats = np.stack([np.frombuffer(r.stats, np.int16) for r in rows]).astype(np.int64) if rows else np.zeros((0, len(STATS)), np.int64)
    n = np.array([len(x) for x in words], np.int64)
    return fit(np.concatenate(words) if rows else np.zeros(0, np.int64), n, stats, np.array([r.quality for r in rows], float))


def quality_score(text: Column, model: tuple[float, np.ndarray, np.ndarray]) -> Column:
    w0, w, v = model[0], model[1].astype(np.float32), model[2].astype(np.float32)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        texts = [t or "" for t in texts]
        for part in slices(texts, 1_000_000):
            z, _ = machine(w0, w, v, *features(texts[part]))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return pd.Series(np.concatenate(out))

    return score(text)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
