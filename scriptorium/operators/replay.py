"""Query logs: making them from frequent n-grams, and replaying them against a searcher."""

from __future__ import annotations

import random
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Analyzer, valid_term
from ..storage import shuffle_tasks
from .index import ROWS_OUT, pieces
from .search import Searcher, SearchRequest


def frequent_ngrams(docs: DataFrame, text_column: str, n: int = 3, least: int = 10) -> DataFrame:
    """(ngram, count) of the n-grams of unstemmed words of letters that occur `least` times or more.

    They are counted by stretch of documents as numbers, then by text. Most occur once, so nothing is added up before they are
    dealt out, to tasks whose number grows with the input's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, words, doc, _ in pieces(batches):
            last = len(codes) - n + 1
            if last < 1:
                continue
            key, most = codes[:last], len(words)
            for i in range(1, n):
                if most > (1 << 62) // len(words):
                    key = np.unique(key, return_inverse=True)[1]
                    most = len(codes)
                key, most = key * len(words) + codes[i : i + last], most * len(words)
            whole = np.flatnonzero(doc[:last] == doc[n - 1 :])
            _, first, count = np.unique(key[whole], return_index=True, return_counts=True)
            first = whole[first]
            for i in range(0, len(first), ROWS_OUT):
                at = first[i : i + ROWS_OUT]
                grams = pc.binary_join_element_wise(*[words.take(pa.array(codes[at + j])) for j in range(n)], " ")
                yield pa.RecordBatch.from_arrays([grams, pa.array(count[i : i + ROWS_OUT].astype(np.int64))], ["ngram", "n"])

    words = F.filter(Analyzer().terms(F.col(text_column)), valid_term)
    counted = docs.select(F.lit(0).alias("doc_id"), words.alias("words")).mapInArrow(run, "ngram string, n long")
    return counted.repartition(shuffle_tasks(docs), "ngram").groupBy("ngram").agg(F.sum("n").alias("count")).where(F.col("count") >= least)


def make_queries(grams: list[str], number: int = 1000, seed: int = 13) -> list[str]:
    """Queries of every kind over the words of the given n-grams, by a seeded choice."""
    rng = random.Random(seed)
    kinds = {
        "term": lambda w: w[0],
        "and": lambda w: " AND ".join(w),
        "or": lambda w: " OR ".join(w),
        "not": lambda w: f"NOT {w[0]}",
        "phrase": lambda w: f'"{" ".join(w)}"',
        "near": lambda w: f"#{rng.randint(1, 5)}({w[0]}, {w[-1]})",
        "natural": lambda w: " ".join(w),
    }
    return [kinds[rng.choice(sorted(kinds))](rng.choice(grams).split()) for _ in range(number)] if grams else []


def replay(searcher: Searcher, queries: list[tuple[str, int | None]], **request) -> DataFrame:
    """(query, hits, expected_hits, agrees, seconds) of each query, run one after the other as a client would."""
    rows = []
    for query, expected in queries:
        began = time.time()
        found = searcher.search(SearchRequest(query, **request))
        found.hits.collect()
        rows.append((query, found.total_hits, expected, expected is None or expected == found.total_hits, time.time() - began))
    return searcher.index.docs.sparkSession.createDataFrame(rows, "query string, hits long, expected_hits long, agrees boolean, seconds double")
