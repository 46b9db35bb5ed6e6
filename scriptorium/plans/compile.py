"""Query trees as DataFrames of (doc_id, score).

Stop words vanish when the plan is made. Terms of one AND or OR are one scan of the postings and one aggregate, whatever
their number; a NOT inside an AND is an anti join. Document frequencies of the query's terms are literals in the plan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Analyzer
from .syntax import And, Near, Node, Not, Or, Phrase, Term


class Compiler:
    """tables: postings (term, doc_id, tf, positions), docs (doc_id). frequencies gives the document frequency of terms."""

    def __init__(self, postings: DataFrame, docs: DataFrame, n_docs: int, frequencies: Callable[[list[str]], dict[str, int]], analyzer: Analyzer, scored: bool = True):
        self.postings, self.docs, self.n_docs, self.analyzer, self.scored = postings, docs, n_docs, analyzer, scored
        self.frequencies, self.df = frequencies, {}

    def analysed(self, node: Node) -> Node | None:
        """The tree over terms; None where only stop words are. Words with ":" are terms as they are."""
        if isinstance(node, Term):
            term = node.word if ":" in node.word else self.analyzer.term(node.word)
            return None if term is None else Term(term)
        if isinstance(node, Phrase):
            words = [w for w in map(self.analyzer.term, node.words) if w is not None]
            return None if not words else Term(words[0]) if len(words) == 1 else Phrase(tuple(words))
        if isinstance(node, Near):
            left, right = self.analyzer.term(node.left), self.analyzer.term(node.right)
            if left is None or right is None:
                return Term(left or right) if left or right else None
            return Near(node.distance, left, right)
        if isinstance(node, Not):
            return Not(self.analysed(node.part))
        parts = tuple(p for p in map(self.analysed, node.parts) if p is not None)
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else And(parts) if isinstance(node, And) else Or(parts, node.natural)

    def _words(self, node: Node | None) -> set[str]:
        if node is None:
            return set()
        if isinstance(node, Term):
            return {node.word}
        if isinstance(node, Phrase):
            return set(node.words)
        if isinstance(node, Near):
            return {node.left, node.right}
        return self._words(node.part) if isinstance(node, Not) else set().union(*map(self._words, node.parts))

    def compile(self, node: Node) -> DataFrame:
        tree = self.analysed(node)
        self.df = self.frequencies(sorted(self._words(tree)))
        return self._rows(tree) if tree is not None else self._none()

    def _none(self) -> DataFrame:
        return self.docs.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))

    def _score(self, words: Counter) -> Column:
        """(1 + log10 tf) log10(N / df), times how often the query names the term."""
        weight = F.lit(None).cast("double")
        for word, times in words.items():
            df = self.df.get(word, 0)
            idf = float(times) * F.log10(F.lit(self.n_docs) / F.lit(df)) if df else F.lit(0.0)
            weight = F.when(F.col("term") == word, idf).otherwise(weight)
        return (1 + F.log10("tf")) * weight if self.scored else F.lit(0.0)

    def _scan(self, words: Counter) -> DataFrame:
        """(doc_id, term, score, positions) of the terms' postings."""
        return self.postings.where(F.col("term").isin(*words)).select("doc_id", "term", self._score(words).alias("score"), "positions")

    def _terms(self, words: Counter, every: bool) -> DataFrame:
        rows = self._scan(words)
        if len(words) == 1:
            return rows.select("doc_id", "score")
        rows = rows.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
        return (rows.where(F.col("n") == len(words)) if every else rows).select("doc_id", "score")

    def _rows(self, node: Node | None) -> DataFrame:
        if node is None:
            return self._none()
        if isinstance(node, Term):
            return self._terms(Counter([node.word]), True)
        if isinstance(node, Phrase):
            return self._phrase(node)
        if isinstance(node, Near):
            return self._near(node)
        if isinstance(node, Not):
            rest = self.docs if node.part is None else self.docs.join(self._rows(node.part), "doc_id", "left_anti")
            return rest.select("doc_id", F.lit(1.0 if self.scored else 0.0).alias("score"))
        terms = Counter(p.word for p in node.parts if isinstance(p, Term))
        others = [p for p in node.parts if not isinstance(p, (Term, Not))]
        nots = [p for p in node.parts if isinstance(p, Not)]
        if isinstance(node, Or):
            rows = ([self._terms(terms, False)] if terms else []) + [self._rows(p) for p in (*others, *nots)]
            if len(rows) == 1:
                return rows[0]
            return reduce(DataFrame.unionByName, rows).groupBy("doc_id").agg(F.sum("score").alias("score"))
        rows = ([self._terms(terms, True)] if terms else []) + [self._rows(p) for p in others]
        out = rows[0] if rows else self.docs.select("doc_id", F.lit(0.0).alias("score"))
        for more in rows[1:]:
            out = out.join(more.withColumnRenamed("score", "more"), "doc_id").select("doc_id", (F.col("score") + F.col("more")).alias("score"))
        for p in nots:
            if p.part is not None:
                out = out.join(self._rows(p.part), "doc_id", "left_anti")
        return out.select("doc_id", (F.col("score") + F.lit(float(len(nots)) if self.scored else 0.0)).alias("score"))

    def _together(self, words: Counter) -> DataFrame:
        """(doc_id, score, p0, p1, ...) of the documents with all words: their positions in one row, in the order of words."""
        rows = self._scan(words)
        places = [F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, w in enumerate(words)]
        rows = rows.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("n"), *places)
        return rows.where(F.col("n") == len(words)).drop("n")

    def _phrase(self, node: Phrase) -> DataFrame:
        """Documents with the words at consecutive positions: the starts that each word allows, met within the document's row."""
        words = Counter(node.words)
        number = {w: i for i, w in enumerate(words)}
        starts = [F.expr(f"transform(p{number[w]}, p -> p - {i})") for i, w in enumerate(node.words)]
        return self._together(words).where(F.size(reduce(F.array_intersect, starts)) > 0).select("doc_id", "score")

    def _near(self, node: Near) -> DataFrame:
        """Documents with both words at most `distance` positions apart: the nearest places of two words stand next to one
        another when all are put in order."""
        words = Counter([node.left, node.right])
        if node.left == node.right:  # a word is near itself wherever it is
            return self._terms(words, True)
        side = lambda name, of: F.transform(name, lambda p: F.struct(p.alias("at"), F.lit(of).alias("of")))
        rows = self._together(words).withColumn("all", F.array_sort(F.concat(side("p0", 0), side("p1", 1))))
        beside = F.zip_with("all", F.slice("all", F.lit(2), F.size("all")), lambda a, b: (a["of"] != b["of"]) & (b["at"] - a["at"] <= node.distance))
        return rows.where(F.exists(beside, lambda x: F.coalesce(x, F.lit(False)))).select("doc_id", "score")
