"""Search over an index: boolean and natural queries, filters, facets, pages."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.text import NON_WORD
from ..plans.compile import Compiler
from ..plans.syntax import Node, is_natural, parse
from ..storage import drop, written
from .vectors import nearest


@dataclass(frozen=True)
class Facet:
    field: str
    num_values: int = 10


@dataclass(frozen=True)
class Filter:
    field: str
    value: str


@dataclass(frozen=True)
class SearchRequest:
    query: str
    max_results: int = 10
    max_distance: float = 0.8
    use_vectors: bool = True
    offset: int = 0
    score: bool = True
    fields: Sequence[str] = ()
    facets: Sequence[Facet] = ()
    filters: Sequence[Filter] = ()
    score_filters: bool = True
    max_vector_results: int = 10_000

    def __post_init__(self) -> None:
        if not isinstance(self.query, str):
            raise QueryError("query must be text")
        for name in ("max_results", "offset", "max_vector_results"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 0:
                raise QueryError(f"{name} must be a whole number of at least 0")
        if isinstance(self.max_distance, bool) or not isinstance(self.max_distance, (int, float)) or not self.max_distance >= 0:
            raise QueryError("max_distance must be a number of at least 0")
        for name in ("use_vectors", "score", "score_filters"):
            if not isinstance(getattr(self, name), bool):
                raise QueryError(f"{name} must be true or false")
        if isinstance(self.fields, str) or not all(isinstance(f, str) for f in self.fields):
            raise QueryError("fields must be a list of names")
        if not all(isinstance(f, Facet) and isinstance(f.field, str) and isinstance(f.num_values, int) and f.num_values >= 0 for f in self.facets):
            raise QueryError("facets must have a field and a num_values of at least 0")
        if not all(isinstance(f, Filter) and isinstance(f.field, str) and isinstance(f.value, str) for f in self.filters):
            raise QueryError("filters must have a field and a value")


@dataclass
class SearchResult:
    hits: DataFrame
    total_hits: int
    facets: DataFrame | None
    time_elapsed: float
    request_id: str = field(default_factory=lambda: uuid.uuid4().hex)


def facet_counts(matches: DataFrame, docs: DataFrame, facets: Sequence[Facet]) -> DataFrame | None:
    """(field, value, count) over all matches, each occurrence in a document counting; ties by value. Unknown fields are left out."""
    rows = None
    for facet in facets:
        if facet.field not in docs.columns:
            continue
        values = docs.join(matches.select("doc_id"), "doc_id", "left_semi").select(F.explode(facet.field).alias("value"))
        counted = values.groupBy("value").agg(F.count("*").alias("count"))
        top = counted.orderBy(F.desc("count"), "value").limit(facet.num_values)
        own = top.select(F.lit(facet.field).alias("field"), "value", "count")
        rows = own if rows is None else rows.unionByName(own)
    return rows


def filtered(docs: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """doc_id of the documents whose fields hold the values, compared as words joined by "_"."""
    for f in filters:
        if f.field not in docs.columns:
            raise QueryError(f"unknown field {f.field}")
        wanted = F.regexp_replace(F.lit(f.value), NON_WORD, "_")
        docs = docs.where(F.exists(f.field, lambda v: F.regexp_replace(v, NON_WORD, "_") == wanted))
    return docs.select("doc_id")


def page(rows: DataFrame, max_results: int, offset: int = 0, scored: bool = True) -> DataFrame:
    """Best first, or in the order of ids; ties by id."""
    order = [F.desc("score"), "doc_id"] if scored else ["doc_id"]
    return rows.orderBy(*order).offset(offset).limit(max_results)


def facet_term(name: str, value: str) -> str:
    """The term of a field's value, as the index has it."""
    return f"{name}:{re.sub(r'\W+', '_', value)}"


class Searcher:
    """Queries over an index (anything with snapshot(), which has docs, postings, number_of_docs(), frequencies() and analyzer).
    All that one query reads is of one snapshot."""

    def __init__(self, index, embedder: Callable[[str], Sequence[float]] | None = None):
        self.index, self.embedder = index, embedder

    def _compiler(self, x, scored: bool) -> Compiler:
        return Compiler(x.postings, x.docs.select("doc_id"), x.number_of_docs(), x.frequencies, x.analyzer, scored)

    def matches(self, request: SearchRequest, index=None) -> tuple[DataFrame, bool]:
        """(doc_id, score) of all matches, and whether the order is by score."""
        index = index or self.index.snapshot()
        tree: Node = parse(request.query)
        if self.embedder and request.use_vectors and is_natural(tree):
            among = filtered(index.docs, request.filters) if request.filters else None
            found = nearest(index.docs, self.embedder(request.query), request.max_vector_results, max_distance=request.max_distance, among=among)
            return found.select("doc_id", (1 - F.col("distance")).alias("score")), True
        rows = self._compiler(index, request.score).compile(tree)
        if request.filters:
            rows = rows.join(filtered(index.docs, request.filters), "doc_id", "left_semi")
            if request.score and request.score_filters:
                rows = self._with_filter_scores(rows, request.filters, index)
        return rows, request.score

    def _with_filter_scores(self, rows: DataFrame, filters: Sequence[Filter], index) -> DataFrame:
        """Each filter is a leaf of an AND: its term's score is added."""
        words = [facet_term(f.field, f.value) for f in filters]
        df, n = index.frequencies(words), index.number_of_docs()
        idf = F.lit(0.0)
        for w in words:
            idf = F.when(F.col("term") == w, F.log10(F.lit(n) / F.lit(df.get(w, n)))).otherwise(idf)
        more = index.postings.where(F.col("term").isin(*words)).groupBy("doc_id").agg(F.sum((1 + F.log10("tf")) * idf).alias("more"))
        return rows.join(more, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))

    def search(self, request: SearchRequest) -> SearchResult:
        began = time.time()
        index = self.index.snapshot()
        docs = index.docs
        rows, by_score = self.matches(request, index)
        # found once; the count, the facets and the page are of that table, and what is kept of it is what was asked for
        rows = written(rows, "matches")
        total = rows.count()
        local = docs.sparkSession.createDataFrame
        facets = facet_counts(rows, docs, request.facets) if request.facets else None
        if facets is not None:
            facets = local(facets.collect(), facets.schema)
        top = local(page(rows, request.max_results, request.offset, by_score).collect(), rows.schema)
        drop(rows)
        wanted = [f for f in (request.fields or [c for c in docs.columns if c not in ("doc_id", "ext_id", "vector")]) if f in docs.columns]
        # at most max_results ids meet the documents
        hits = top.join(docs.select("doc_id", F.col("ext_id").alias("id"), *wanted), "doc_id").orderBy(*([F.desc("score")] if by_score else []), "doc_id")
        return SearchResult(hits.select("id", "score", *wanted), total, facets, time.time() - began)
