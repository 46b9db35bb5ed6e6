import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.engine import Engine
from scriptorium.errors import ExpansionError, IndexStateError, QueryError, SuggestError
from scriptorium.functions.text import Analyzer
from scriptorium.operators.index import Index
from scriptorium.operators.replay import frequent_ngrams, make_queries, replay
from scriptorium.operators.search import Facet, Filter, Searcher, SearchRequest
from scriptorium.operators.vectors import embed, nearest

WORDS = "alpha beta gamma delta epsilon".split()
SCHEMA = "id string, title string, authors array<string>, abstract string, subject array<string>, body string, vector array<float>"


def documents():
    rng = random.Random(3)
    rows = []
    for i in range(40):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 25)))
        rows.append((f"d{i}", rng.choice(WORDS), ["Ann Lee", "Bo"] if i % 2 else ["Ann Lee"], text, ["Machine-Learning"] if i % 3 else ["Über Alles", "Über Alles"], None if i % 4 else "omega", [float(i), 1.0]))
    return rows


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    x = Index(spark, str(tmp_path_factory.mktemp("index")))
    rows = spark.createDataFrame(documents(), SCHEMA)
    assert x.add(rows.where("cast(substr(id, 2) as int) < 20"))[0] == 20
    assert x.add(rows)[0] == 20
    return x


def tokens(row):
    text = " ".join([row[1], " ".join(row[2]), row[3], " ".join(row[4]), row[5] or ""])
    return [t.lower() for t in re.split(r"\W+", text) if t]


def brute(test):
    return {r[0] for r in documents() if test(tokens(r))}


def ids(index, query, **more):
    rows, _ = Searcher(index).matches(SearchRequest(query, **more))
    return {r.ext_id for r in rows.join(index.docs, "doc_id").select("ext_id").collect()}


def follows(t, *words):
    return any(t[i : i + len(words)] == list(words) for i in range(len(t)))


def near(t, n, a, b):
    return any(abs(i - j) <= n for i, x in enumerate(t) for j, y in enumerate(t) if x == a and y == b)


@pytest.mark.parametrize(
    ("query", "test"),
    [
        ("alpha", lambda t: "alpha" in t),
        ("ALPHA AND Beta", lambda t: "alpha" in t and "beta" in t),
        ("alpha OR omega", lambda t: "alpha" in t or "omega" in t),
        ("NOT alpha", lambda t: "alpha" not in t),
        ("alpha AND NOT beta", lambda t: "alpha" in t and "beta" not in t),
        ("NOT alpha AND NOT beta", lambda t: "alpha" not in t and "beta" not in t),
        ("NOT (alpha AND beta)", lambda t: not ("alpha" in t and "beta" in t)),
        ("omega OR NOT gamma", lambda t: "omega" in t or "gamma" not in t),
        ('"alpha beta"', lambda t: follows(t, "alpha", "beta")),
        ('"alpha beta gamma"', lambda t: follows(t, "alpha", "beta", "gamma")),
        ('"alpha alpha"', lambda t: follows(t, "alpha", "alpha")),
        ("#2(alpha, omega)", lambda t: near(t, 2, "alpha", "omega")),
        ("#1(beta, gamma) AND alpha", lambda t: near(t, 1, "beta", "gamma") and "alpha" in t),
        ("#0(alpha, alpha)", lambda t: "alpha" in t),
        ("nothing", lambda t: False),
        ("omega alpha", lambda t: "alpha" in t or "omega" in t),
    ],
)
def test_against_brute_force(index, query, test):
    assert ids(index, query) == brute(test)
    assert ids(index, query, score=False) == brute(test)


def test_laws(index):
    every = {r[0] for r in documents()}
    for a, b in itertools.combinations(WORDS[:3], 2):
        both, phrase, close = ids(index, f"{a} AND {b}"), ids(index, f'"{a} {b}"'), ids(index, f"#1({a},{b})")
        assert phrase <= close <= both <= ids(index, a)
        assert close == ids(index, f"#1({b},{a})")
        assert ids(index, f"NOT ({a} OR {b})") == ids(index, f"NOT {a} AND NOT {b}")
    assert ids(index, "alpha") | ids(index, "NOT alpha") == every


def test_scores(index):
    rows, _ = Searcher(index).matches(SearchRequest("alpha AND NOT omega"))
    found = {r.ext_id: r.score for r in rows.join(index.docs, "doc_id").collect()}
    docs = {r[0]: tokens(r) for r in documents()}
    df = sum("alpha" in t for t in docs.values())
    for key, score in found.items():
        assert score == pytest.approx((1 + math.log10(docs[key].count("alpha"))) * math.log10(40 / df) + 1)


def test_pages_filters_facets(index):
    searcher = Searcher(index)
    pages = [searcher.search(SearchRequest("alpha OR beta", max_results=7, offset=o, fields=["title", "nothing"])) for o in (0, 7, 14)]
    whole = searcher.search(SearchRequest("alpha OR beta", max_results=21))
    assert [r.id for p in pages for r in p.hits.collect()] == [r.id for r in whole.hits.collect()]
    assert pages[0].hits.columns == ["id", "score", "title"]
    assert whole.total_hits == len(brute(lambda t: "alpha" in t or "beta" in t))
    plain = searcher.search(SearchRequest("NOT nothing", score=False, offset=10, max_results=10))
    assert len(plain.hits.collect()) == 10
    # values agree as words; the filter holds for the whole query
    some = ids(index, "alpha OR beta", filters=[Filter("subject", "Machine Learning")])
    assert some == {r[0] for r in documents() if r[4] == ["Machine-Learning"]} & brute(lambda t: "alpha" in t or "beta" in t)
    assert ids(index, "subject:Über_Alles") == {r[0] for r in documents() if "Über Alles" in r[4]}
    facets = searcher.search(SearchRequest("NOT nothing", facets=[Facet("authors", 1), Facet("subject"), Facet("none")])).facets.collect()
    assert [(r.field, r.value, r["count"]) for r in facets] == [("authors", "Ann Lee", 40), ("subject", "Über Alles", 28), ("subject", "Machine-Learning", 26)]


def test_stop_words_and_stems(spark, tmp_path):
    x = Index(spark, str(tmp_path), analyzer=Analyzer(frozenset({"the", "of"}), stem=True))
    x.add(spark.createDataFrame([("1", "runs of the river", "the"), ("2", "a running dog", "of")], "id string, title string, abstract string"))
    assert ids(x, "running") == {"1", "2"}
    assert ids(x, "the AND running") == {"1", "2"}
    assert ids(x, '"run the river"') == {"1"}
    assert ids(x, "the AND of") == set()
    assert ids(x, "NOT the") == {"1", "2"}
    assert ids(x, "river AND (the AND of)") == {"1"}


def test_append_dedup_compact(spark, tmp_path):
    x = Index(spark, str(tmp_path), dimension=2)
    with pytest.raises(IndexStateError):
        x.docs.count()
    rows = [("a", "t", [1.0, 2.0]), ("a", "t", [1.0, 2.0]), ("b", "t", [1.0]), (None, "t", None), ("c", "t", None)]
    n, failures = x.add(spark.createDataFrame(rows, "id string, title string, vector array<float>"))
    assert n == 2
    assert sorted((r.ext_id or "", r.reason) for r in failures.collect()) == [("", "no id"), ("a", "repeated in this batch"), ("b", "vector of wrong length")]
    assert x.add(spark.createDataFrame([("c", "again", None), ("d", "t", None)], "id string, title string, vector array<float>"))[0] == 1
    assert x.add(spark.createDataFrame([("d", "again", None)], "id string, title string, vector array<float>"))[0] == 0
    assert sorted(r.doc_id for r in x.docs.select("doc_id").collect()) == [1, 2, 3]
    before = {tuple(r) for r in x.terms.collect()}
    assert x.compact() == (3, 1)
    assert {tuple(r) for r in x.terms.collect()} == before
    assert x.number_of_docs() == 3
    assert [r.title for r in x.get("c", ["title", "missing"]).collect()] == ["t"]


def test_vectors(spark, index):
    rows = nearest(index.docs, [3.0, 1.0], 3, metric="l2").join(index.docs, "doc_id").orderBy("distance").collect()
    assert [r.ext_id for r in rows][0] == "d3"
    searcher = Searcher(index, embedder=lambda q: [0.0, 1.0])
    found = searcher.search(SearchRequest("alpha beta", max_distance=0.5))
    assert found.total_hits == 2  # cosine distance to (i, 1): 0 and 1 - 1/sqrt(2)
    only = searcher.search(SearchRequest("alpha beta", max_distance=2.0, filters=[Filter("authors", "Bo")]))
    assert only.total_hits == 20
    assert searcher.search(SearchRequest("alpha beta", use_vectors=False)).total_hits == len(brute(lambda t: "alpha" in t or "beta" in t))
    with pytest.raises(QueryError):
        nearest(index.docs, [1.0], 1, metric="none")
    made = embed(spark.createDataFrame([("a b c",), (None,)], "x string"), "x", lambda texts: [[float(len(t))] for t in texts], chunk_words=2)
    assert [r.vector for r in made.collect()] == [[2.0], [0.0]]


def test_engine(spark, tmp_path):
    lines = [
        '{"id": "1", "title": "One thing", "abstract": "theory of things and theories"}',
        '{"id": "2", "title": "Two", "abstract": "the theory", "body": null, "extra": 5}',
        "not json",
        '{"id": "3", "abstract": "no title"}',
        '{"id": "1", "title": "Again", "abstract": "x"}',
    ]
    (tmp_path / "in.json").write_text("\n".join(lines))
    engine = Engine(spark, str(tmp_path / "index"))
    with pytest.raises(SuggestError):
        engine.suggest("t")
    with pytest.raises(ExpansionError):
        engine.expand("t")
    n, refused, bad = engine.bulk_add(str(tmp_path / "in.json"))
    assert n == 2
    assert [r.reason for r in refused.collect()] == ["repeated in this batch"]
    assert sorted(r.reason for r in bad.collect()) == ["no title", "not a JSON object of documents"]
    assert engine.add({"id": "9", "title": "Nine", "abstract": "theory"})["internal_id"] == 3
    assert engine.add({"id": "10", "title": "Ten"})["internal_id"] is None
    assert engine.flush() == 2
    assert engine.optimize() == (2, 1)
    engine.build_suggest()
    engine.build_suggest()
    found = engine.suggest("of theo").collect()
    assert [(r.suggestion, r.highlighted, r.cf) for r in found] == [("of theory", "of theo<b>ry</b>", 3), ("of theories", "of theo<b>ries</b>", 1)]
    engine.build_expansions()
    assert "theory" in {r.term for r in engine.expand("theory").collect()}
    with pytest.raises(QueryError):
        SearchRequest("x", offset=-1)


def test_first_occurrence_and_term_counts(index):
    row = index.terms.where(F.col("term") == "alpha").first()
    assert row.df == len(brute(lambda t: "alpha" in t))
    assert row.cf == sum(tokens(r).count("alpha") for r in documents())


def test_replay(spark, index):
    grams = [r.ngram for r in frequent_ngrams(index.docs, "abstract", 2, 3).orderBy("ngram").collect()]
    log = make_queries(grams, 12)
    assert log == make_queries(grams, 12)
    rows = replay(Searcher(index), [("alpha", len(brute(lambda t: "alpha" in t))), ("NOT alpha", 0), *((q, None) for q in log)]).collect()
    assert [r.agrees for r in rows] == [True, False] + [True] * 12
    assert len(rows) == 14 and all(r.seconds > 0 for r in rows)


def test_one_snapshot_a_search(spark, tmp_path):
    x = Index(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame(documents(), SCHEMA)
    x.add(rows.where("cast(substr(id, 2) as int) < 10"))
    before = x.snapshot()
    x.add(rows)
    x.compact(1)
    assert (before.number_of_docs(), before.docs.count(), x.number_of_docs()) == (10, 10, 40)
    words = {r.term: r.df for r in before.terms.collect() if ":" not in r.term}
    assert before.frequencies(sorted(words)) == words
    assert max(words.values()) <= 10
    assert Searcher(before).search(SearchRequest("alpha OR beta")).total_hits <= 10
    gone = x.vacuum()
    assert len(gone) == 2
    assert not any((tmp_path / "index" / "postings" / b).exists() for b in gone)
    assert not (tmp_path / "index" / "staging").exists()
    assert x.docs.count() == 40


def test_rows_without_ids_are_refused(spark, tmp_path):
    x = Index(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame([(None, "t", "a")] * 3 + [("1", "t", "a")], "id string, title string, abstract string")
    n, refused = x.add(rows)
    assert n == 1
    assert [(r.ext_id, r.reason) for r in refused.collect()] == [(None, "no id")] * 3


@pytest.mark.parametrize(
    "wrong",
    [{"max_distance": -1}, {"max_distance": "far"}, {"fields": "title"}, {"fields": [1]}, {"facets": ["authors"]}, {"facets": [Facet("authors", -1)]}, {"filters": [Filter("subject", None)]}, {"filters": [("a", "b")]}, {"score": "yes"}, {"max_results": 1.5}],
)
def test_requests_are_checked(wrong):
    with pytest.raises(QueryError):
        SearchRequest("alpha", **wrong)


def test_natural_queries_by_vectors(spark, index):
    found = Searcher(index, lambda query: [1.0, 1.0]).search(SearchRequest("alpha beta", max_results=3, facets=[Facet("authors")], fields=["title"]))
    cosine = lambda i: (i + 1) / math.sqrt(2 * (i * i + 1))
    best = sorted(range(40), key=lambda i: -cosine(i))[:3]
    assert [r.id for r in found.hits.collect()] == [f"d{i}" for i in best]
    assert found.total_hits == 40
    assert {r.value: r["count"] for r in found.facets.collect()} == {"Ann Lee": 40, "Bo": 20}
    assert ids(index, "alpha beta", use_vectors=False) == brute(lambda t: "alpha" in t or "beta" in t)


def test_no_positions_are_shuffled_apart(index):
    """Phrases and proximity meet within a document's row: one exchange, no join and no explode."""
    for query in ('"alpha beta gamma"', "#3(alpha, beta)"):
        plan = Searcher(index).matches(SearchRequest(query))[0]._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan
        assert "Join" not in plan


def test_one_writer_at_a_time(spark, tmp_path):
    root = str(tmp_path / "index")
    x, y = (Index(spark, root, wait_seconds=0.5) for _ in range(2))
    rows = spark.createDataFrame([("1", "t", "a")], "id string, title string, abstract string")
    with x._writing(), pytest.raises(IndexStateError):
        y.add(rows)
    assert y.add(rows)[0] == 1
    (tmp_path / "index" / "writer").touch()
    y.stale_seconds = -1
    assert y.add(rows)[0] == 0
