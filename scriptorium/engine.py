"""One object with what the service offered: search, suggest, expand, add, bulk_add, flush, optimize, builds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .errors import ExpansionError, SuggestError
from .functions.text import Analyzer
from .operators.expand import expand, expansions
from .operators.index import Index
from .operators.search import Searcher, SearchRequest, SearchResult
from .operators.suggest import suggest, suggester
from .sources.files import DOCUMENT, read_documents, read_vectors, with_vectors


class Engine:
    def __init__(self, spark: SparkSession, root: str, analyzer: Analyzer | None = None, embedder: Callable[[str], Sequence[float]] | None = None, dimension: int | None = None):
        self.spark, self.index = spark, Index(spark, root, analyzer=analyzer, dimension=dimension)
        self.searcher = Searcher(self.index, embedder)
        self._words: DataFrame | None = None
        self._expansions: tuple[DataFrame, DataFrame] | None = None

    def search(self, request: SearchRequest) -> SearchResult:
        return self.searcher.search(request)

    def add(self, document: dict) -> dict:
        """Appends one document; returns its ids, the internal one None if it was refused."""
        row = {f: document.get(f) for f in DOCUMENT.names}
        if not all(row[f] for f in ("id", "title", "abstract")):
            return {"doc_id": row["id"], "internal_id": None}
        self.index.add(self.spark.createDataFrame([row], DOCUMENT))
        found = self.index.get(row["id"]).select("doc_id").collect()
        return {"doc_id": row["id"], "internal_id": found[0].doc_id if found else None}

    def bulk_add(self, path: str, vectors: str | None = None, max_docs: int = -1) -> tuple[int, DataFrame, DataFrame]:
        """Appends a file of documents, with the vectors of another if given, max_docs of them if that is not negative: how many
        were new, documents refused (ext_id, reason), lines that are none (line, reason)."""
        good, bad = read_documents(self.spark, path)
        if vectors:
            good = with_vectors(good, read_vectors(self.spark, vectors))
        n, refused = self.index.add(good.limit(max_docs) if max_docs >= 0 else good)
        return n, refused, bad

    def flush(self) -> int:
        """Every append is on disk when it returns; the number of batches."""
        return len(self.index.batches())

    def optimize(self, target: int = 1) -> tuple[int, int]:
        return self.index.compact(target)

    def build_suggest(self) -> None:
        self._words = suggester(self.index.terms).cache()

    def build_expansions(self) -> None:
        self._expansions = tuple(x.cache() for x in expansions(self.index.postings, self.index.number_of_docs()))

    def suggest(self, query: str, max_results: int | None = 10) -> DataFrame:
        if self._words is None:
            raise SuggestError("build_suggest() comes first")
        return suggest(self._words, query, max_results)

    def expand(self, query: str, max_results: int = 10) -> DataFrame:
        if self._expansions is None:
            raise ExpansionError("build_expansions() comes first")
        terms = [t for t in map(self.index.analyzer.term, query.split()) if t]
        return expand(*self._expansions, terms, max_results)
