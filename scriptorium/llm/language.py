"""Language identification by bit-sliced Bloom filters of n-grams.

Learned from labelled texts: how often each n-gram (3 to 5 bytes of lower-case UTF-8 words with a space around them) occurs
in each language, counted over all of them. An n-gram belongs to a language if its rate there is at least `least_rate` and
at least `least_share` of its rate in any other; rates add up to 1, so a language has at most 1 / least_rate n-grams for
each length, which bounds what the driver holds. The filters of all languages share one table: slot i holds a mask of
languages (64 a word), so the AND of an n-gram's slots is the set of all languages that hold it.

A text's n-grams are looked up; for each language the hits are counted, corrected for the hits that its filter's false
positives give ((hits - n f) / (1 - f), f = fill^hashes); the most decide, ties going to the language with more training
text, then by name. The score is the share of the decided language in all corrected hits.

Texts that are null or have no letter give "und" and 0. Texts with letters of which no n-gram is known give the language
with most training text and 0. Rows without lang are not learned from; without any, every prediction is "und". Repeated
rows count and are predicted once each. More than MOST_LANGUAGES languages are an error, since the filters' size grows with
them. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, mix, read_table, slices, word_hashes

LENGTHS = (3, 4, 5)
LEAST_RATE, LEAST_SHARE = 2e-5, 0.1
HASHES, SLOTS_EACH = 3, 12
MOST_LANGUAGES = 1024


def word_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case texts: the text each word is in and the distinct word it is; and of all n-grams of the distinct words,
    the word each is in and its key (bytes and length)."""
    hashes, owner, starts, ends, joined = word_hashes(texts)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    padded = np.concatenate([[np.uint8(32)], joined, np.full(8, 32, np.uint8)])
    begin, size = starts[first], ends[first] - starts[first] + 2  # in padded, with the space before and after
    words, keys = [], []
    for n in LENGTHS:
        count = np.maximum(size - n + 1, 0)
        word = np.repeat(np.arange(len(first)), count)
        at = np.repeat(begin, count) + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        key = np.full(len(word), n, np.uint64)
        offset = at - begin[word]
        for i in range(n):
            byte = padded[at + i].astype(np.uint64)
            byte[(offset + i == 0) | (offset + i == size[word] - 1)] = 32
            key = key << np.uint64(8) | byte
        words.append(word)
        keys.append(key)
    return owner, which, np.concatenate(words), np.concatenate(keys)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over docs (lang, text), added up in each task before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def added(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(which, np.concatenate([p[1] for p in parts]), len(keys))

        def out(lang: str, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 50_000):
                k = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n[i : i + 50_000].astype(np.int64))], ["lang", "key", "n"])

        for batch in batches:
            frame = batch.to_pandas()
            for lang, own in frame.groupby("lang"):
                texts = [t.lower().encode("utf-8", "surrogatepass") for t in own["text"] if t]
                for part in slices(texts):
                    _, which, word, key = word_grams(texts[part])
                    times = np.bincount(which, minlength=int(which.max(initial=-1)) + 1)
                    held.setdefault(lang, []).append(added([(key, times[word])]))
                if sum(len(p[0]) for p in held.get(lang, [])) > 2_000_000:
                    held[lang] = [added(held[lang])]
                    if len(held[lang][0][0]) > 1_000_000:
                        yield from out(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield from out(lang, *added(parts))

    seen = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, key long, n long")
    return seen.groupBy("lang", "key").agg(F.sum("n").alias("n"))


@dataclass
class Filters:
    langs: list[str]
    table: np.ndarray  # (slots, words of 64 languages)
    false_rates: np.ndarray
    order: np.ndarray  # languages, most training text first

    def slots(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        bits = np.uint64(64 - (len(self.table).bit_length() - 1))
        for i in range(HASHES):
            yield (mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) >> bits).astype(np.int64)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        out = None
        for s in self.slots(keys):
            out = self.table[s] if out is None else out & self.table[s]
        return out

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text: the n-grams looked up, and those in each language's filter."""
        owner, which, word, key = word_grams(texts)
        n_words = int(which.max(initial=-1)) + 1
        masks = self.masks(key)
        grams = np.bincount(word, minlength=n_words)
        total = np.bincount(owner, grams[which], len(texts))
        found = np.zeros((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            own = np.bincount(word, (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), n_words)
            found[:, i] = np.bincount(owner, own[which], len(texts))
        return total, found

    def decide(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        total, found = self.hits(texts)
        fixed = np.clip((found - total[:, None] * self.false_rates) / np.maximum(1 - self.false_rates, 1e-9), 0, None)
        best = self.order[np.argmax(np.round(fixed[:, self.order], 6), axis=1)]
        all_hits = fixed.sum(1)
        score = np.where(all_hits > 0, fixed[np.arange(len(texts)), best] / np.maximum(all_hits, 1e-9), 0.0)
        return [self.langs[i] for i in best], np.clip(score, 0, 1)


def build(rows: pd.DataFrame, totals: dict[str, float], least_share: float = LEAST_SHARE) -> Filters:
    """Filters of rows (lang, key, n), totals being all n-grams of each language."""
    langs = sorted(totals)
    order = np.array(sorted(range(len(langs)), key=lambda i: (-totals[langs[i]], langs[i])), np.int64)
    number = {x: i for i, x in enumerate(langs)}
    lang = rows["lang"].map(number).to_numpy(np.int64)
    rate = rows["n"].to_numpy(float) / np.array([totals[x] for x in rows["lang"]])
    key = rows["key"].to_numpy(np.int64)
    keys, which = np.unique(key, return_inverse=True)
    top = np.zeros(len(keys))
    np.maximum.at(top, which, rate)
    keep = rate >= least_share * top[which]
    lang, key = lang[keep], key[keep].view(np.uint64)
    most = np.bincount(lang, minlength=1).max(initial=1)
    slots = 1 << max(10, int(SLOTS_EACH * most).bit_length())
    out = Filters(langs, np.zeros((slots, max(1, -(-len(langs) // 64))), np.uint64), np.zeros(len(langs)), order)
    for i in range(len(langs)):
        for s in out.slots(key[lang == i]):
            out.table[s, i // 64] |= np.uint64(1 << i % 64)
        fill = ((out.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
        out.false_rates[i] = fill**HASHES
    return out


def train(docs: DataFrame, least_rate: float = LEAST_RATE) -> Filters | None:
    """Filters learned from docs (lang, text); None without any labelled n-gram."""
    counts = cut(gram_counts(docs.where("lang is not null and text is not null")), "grams")
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = {r.lang: float(r.total) for r in sums.limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: lang holds something else")
    if not totals:
        return None
    # at most 1 / least_rate rows a language
    kept = counts.join(sums, "lang").where(F.col("n") >= F.greatest(F.lit(2.0), least_rate * F.col("total")))
    return build(kept.select("lang", "key", "n").toPandas(), totals)


def language_of(text: Column, filters: Filters | None) -> Column:
    """struct<lang, score> of a text."""

    @F.pandas_udf("lang string, score double")
    def decide(texts: pd.Series) -> pd.DataFrame:
        raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        langs, scores = [], [np.zeros(0)]
        for part in slices(raw):
            own, score = filters.decide(raw[part])
            langs += own
            scores.append(score)
        return pd.DataFrame({"lang": langs, "score": np.concatenate(scores)})

    unknown = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if filters is None:
        return unknown
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), decide(text)).otherwise(unknown)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    filters = train(docs.where(~held_out).select("lang", "text"))
    found = docs.select("doc_id", held_out.alias("held_out"), language_of(F.col("text"), filters).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
