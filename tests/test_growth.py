"""What keeps the work of a query in step with its input, on tables small enough for a test."""

import math
import random
from collections import Counter, defaultdict

import pytest

from scriptorium import queries
from scriptorium.functions.text import Analyzer
from scriptorium.operators import expand
from scriptorium.operators.index import postings_of, terms_of
from scriptorium.operators.replay import frequent_ngrams
from scriptorium.sources.files import dealt
from tests.conftest import SF

ROWS = [(3, "The cat the Cat"), (1, "cat"), (3, "a THE the"), (None, "cat a"), (None, "Cat"), (2, None), (4, ""), (5, "dog-The_x dog"), (-7, "Dog cat")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shared_ids(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def brute():
    found = defaultdict(list)
    for doc, text in ROWS:
        for pos, token in enumerate(t for t in (text or "").replace("-", " ").split()):
            found[token.lower(), doc].append((pos, token))
    return found


def test_rows_that_share_an_id_are_one_document(shared_ids):
    rows = postings_of(shared_ids, "text", Analyzer()).collect()
    want = {(*k, len(x), *sorted(p for p, _ in x)) for k, x in brute().items()}
    assert len(rows) == len(want)
    assert {(r.term, r.doc_id, r.tf, *r.positions) for r in rows} == want
    some = shared_ids.where("doc_id is not null")
    found = {r.term: (r.df, r.cf, r.first_doc, r.first_pos) for r in terms_of(some, "text", Analyzer()).collect()}
    docs = defaultdict(dict)
    for (term, doc), x in brute().items():
        if doc is not None:
            docs[term][doc] = x
    assert found == {t: (len(x), sum(map(len, x.values())), min(x), min(x[min(x)])[0]) for t, x in docs.items()}
    assert {r.term: r.first_occurrence for r in terms_of(some, "text", Analyzer()).collect()}["dog"] == "Dog"


def test_stems_and_stop_words_in_runs(spark):
    docs = spark.createDataFrame([(1, "Running the runs"), (2, "a run")], "doc_id long, text string")
    rows = postings_of(docs, "text", Analyzer(frozenset({"the"}), stem=True)).collect()
    assert [(r.term, r.doc_id, r.positions) for r in rows if r.term == "run"] == [("run", 1, [0, 1]), ("run", 2, [1])]
    words = {r.term: r for r in terms_of(docs, "text", Analyzer(stem=True)).collect()}
    assert (words["run"].df, words["run"].cf, words["run"].first_occurrence) == (2, 3, "Running")


def test_no_token_is_shuffled(spark):
    """A document's postings are made where its text is; of the dictionary, counts of stretches meet and not tokens."""
    docs = queries.table(spark, SF, "documents")
    assert "Exchange" not in plan(queries.QUERIES["postings"](spark, SF))
    assert "Exchange" not in plan(postings_of(docs, "text", Analyzer(stem=True)))
    assert "doc_id" not in "".join(x for x in plan(terms_of(docs, "text", Analyzer())).splitlines() if "Exchange" in x)


def test_runs_are_sorted(spark):
    rows = [(r.term.encode(), r.doc_id) for r in postings_of(queries.table(spark, SF, "documents").coalesce(1), "text", Analyzer()).collect()]
    assert rows == sorted(rows)


@pytest.mark.parametrize("query", ["phrase2", "phrase_stopword_gap", "bool_and", "stopword_and", "natural_and_precedence"])
def test_a_query_does_not_build_the_dictionary(spark, query, monkeypatch):
    monkeypatch.setattr(queries, "_held", {})
    assert queries.QUERIES[query](spark, SF).count() >= 0
    (held,) = queries._held.values()
    assert "postings" in vars(held) and "terms" not in vars(held)


def test_suggestions_do_not_build_postings(spark, monkeypatch):
    monkeypatch.setattr(queries, "_held", {})
    assert queries.QUERIES["suggest_highlight"](spark, SF).count() > 0
    (held,) = queries._held.values()
    assert "terms" in vars(held) and "postings" not in vars(held)


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_top_terms_sort_no_postings_by_document(spark, monkeypatch, sent):
    rows = [("a", 1, 2), ("b", 1, 1), ("a", 2, 5), ("7", 1, 9), ("c", 2, 1), ("b", None, 4)]
    postings = spark.createDataFrame(rows, "term string, doc_id long, tf long")
    ids = spark.createDataFrame([(1,), (1,), (None,), (9,)], "doc_id long")
    monkeypatch.setattr(expand, "MOST_IDS_SENT", sent)
    found = expand.top_terms(postings, ids, 4, 10)
    assert [(r.term, r.score) for r in found.collect()] == [("a", round(2 * math.log10(4 / 2), 6)), ("b", round(math.log10(4 / 2), 6))]
    assert "SortMergeJoin" not in plan(found)


def test_ngrams_are_added_up_once(spark):
    docs = queries.table(spark, SF, "documents")
    assert "Aggregate" not in plan(queries.QUERIES["trigrams"](spark, SF)).rpartition("Exchange")[2]
    # so many different words that the numbers of five don't fit into 64 bits, some n-grams in several documents
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", k=3) + ["".join(rng.choices("klmnopqrst", k=6)) for _ in range(40)] + "a b c d e f".split() * (i % 3)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "a 1 b"])], "doc_id long, text string")
    want = Counter(tuple(w[i : i + 5]) for w in map(str.split, texts) for i in range(len(w) - 4))
    found = frequent_ngrams(docs, "text", 5, 2).collect()
    assert {r.ngram: r["count"] for r in found} == {" ".join(g): c for g, c in want.items() if c >= 2}
    assert len(found) > 5


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_expansions_order_only_ties(spark, most):
    rng = random.Random(7)
    rows = {(rng.choice("abcdefghijkl") * rng.choice((1, 1, 2)), rng.randint(1, 25)): rng.randint(1, 3) for _ in range(250)}
    postings = spark.createDataFrame([(*k, tf) for k, tf in rows.items()] + [("only", 1, 9), ("x1", 1, 1), ("x1", 2, 1)], "term string, doc_id long, tf long")
    term_docs, doc_terms = expand.expansions(postings, 25, most, 2)
    by_term = defaultdict(list)
    for (term, doc), tf in rows.items():
        by_term[term].append((-tf, doc))
    want = {(t, d) for t, x in by_term.items() if len(x) > 1 for _, d in sorted(x)[:most]}
    found = [tuple(r) for r in term_docs.collect()]
    assert len(found) == len(want) and set(found) == want
    scores = {(r.doc_id, r.term): r.mi for r in doc_terms.collect()}
    assert set(Counter(d for d, _ in scores).items()) == {(d, min(2, n)) for d, n in Counter(d for _, d in want).items()}
    assert all((t, d) in want for d, t in scores)
    # no window puts a term's postings in order of tf
    assert not any("tf#" in x and "doc_id" in x.rpartition("[")[2] for x in plan(doc_terms).splitlines() if "Window" in x)
    assert "SortMergeJoin" not in plan(term_docs)
    # rows are dealt out by term to tasks that are not put together again
    assert "REPARTITION_BY_NUM" in plan(term_docs)


@pytest.mark.parametrize("query", ["page_metadata", "html_metadata"])
def test_pages_of_a_small_file_are_parsed_by_all_cores(spark, query):
    rows = queries.QUERIES[query](spark, SF)
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert dealt(rows) is rows
