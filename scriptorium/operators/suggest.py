"""Prefix suggestions from the term dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SuggestError
from ..functions.text import highlight, valid_term


def suggester(terms: DataFrame) -> DataFrame:
    """(term, cf, first_occurrence) of the terms of letters only, one row each however often it is built."""
    return terms.where(valid_term(F.col("term"))).groupBy("term").agg(F.sum("cf").alias("cf"), F.min_by("first_occurrence", F.struct("first_doc", "first_pos")).alias("first_occurrence"))


def suggest(words: DataFrame, query: str, max_results: int | None = 10) -> DataFrame:
    """(suggestion, highlighted, cf): the query with its last word completed, most frequent terms first, ties by term.

    Without max_results there are as many as the last word has letters, at least three."""
    pieces = query.lower().split()
    if not pieces:
        raise SuggestError("an empty query")
    before, prefix = pieces[:-1], pieces[-1]
    limit = max_results if max_results is not None else max(3, len(prefix))
    top = words.where(F.col("term").startswith(prefix)).orderBy(F.desc("cf"), "term").limit(limit)
    head = " ".join([*before, ""])
    text = F.concat(F.lit(head), F.lower("first_occurrence"))
    return top.select(text.alias("suggestion"), highlight(text, head + prefix).alias("highlighted"), "term", "cf")
