"""Exact nearest neighbours by cosine or Euclidean distance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, at least 0; null for a vector of zeros."""
    return F.greatest(F.lit(0.0), 1 - _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


METRICS = {"cosine": cosine_distance, "l2": l2_distance}


def vector_literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(vectors: DataFrame, query: Sequence[float], k: int, id_column: str = "doc_id", vector_column: str = "vector", metric: str = "cosine", max_distance: float | None = None, among: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(id, distance) of the k nearest rows: a narrow scan with the query in the plan, then a top-k that each partition
    starts. Rows of another length take no part; ties go to the smaller id. `among` keeps the ids of another frame only."""
    if metric not in METRICS:
        raise QueryError(f"unknown metric {metric}")
    rows = vectors.where(F.size(vector_column) == len(query))
    if among is not None:
        rows = rows.join(among.select(id_column), id_column, "left_semi")
    distance = METRICS[metric](F.col(vector_column), vector_literal(query))
    rows = rows.select(id_column, (F.round(distance, digits) if digits is not None else distance).alias("distance")).where("distance is not null")
    if max_distance is not None:
        rows = rows.where(F.col("distance") <= max_distance)
    return rows.orderBy("distance", id_column).limit(k)


def rerank(top: DataFrame, vectors: DataFrame, query: Sequence[float], id_column: str = "doc_id", vector_column: str = "vector") -> DataFrame:
    """Scores of a top list (id, score) with cosine similarity added to each, the highest text score first having been
    divided out: cosine + score / max(score)."""
    similarity = 1 - cosine_distance(F.col(vector_column), vector_literal(query))
    best = top.agg(F.max("score").alias("best"))
    joined = top.join(vectors.select(id_column, vector_column), id_column).crossJoin(best)  # one row
    return joined.select(id_column, (similarity + F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0)).alias("score"))


def embed(rows: DataFrame, text_column: str, embedder: Callable[[list[str]], list[list[float]]], chunk_words: int | None = None, vector_column: str = "vector") -> DataFrame:
    """rows with vectors made by a function over batches of texts; with chunk_words a text is the mean of its chunks' vectors."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts.fillna(""):
            words = text.split()
            chunks = [" ".join(words[i : i + chunk_words]) for i in range(0, max(1, len(words)), chunk_words)] if chunk_words else [text]
            found = embedder(chunks)
            out.append([sum(x) / len(found) for x in zip(*found, strict=True)])
        return pd.Series(out)

    return rows.withColumn(vector_column, run(F.col(text_column)))
