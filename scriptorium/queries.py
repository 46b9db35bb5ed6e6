"""The engine's operators as queries over the fixture tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import stats, text
from .functions.text import Analyzer
from .operators import expand as expansion
from .operators import vectors as knn
from .operators.index import Index, postings_of, terms_of, value_postings
from .operators.replay import frequent_ngrams, replay
from .operators.search import Facet, Filter, Searcher, SearchRequest, facet_counts, page
from .operators.suggest import suggest, suggester
from .plans.compile import Compiler
from .plans.syntax import parse
from .sources.crawl import CrawlSource
from .sources.files import dealt, html_fields, html_title, read_documents, read_json_array, read_numbered_vectors, read_queries, read_vectors, with_vectors, write_lines
from .storage import new_table, shared_dir, written

FACETS = ("lang", "source")


@dataclass
class Corpus:
    """The documents table as an index, its postings and its dictionary each written once a session, when first asked for."""

    docs: DataFrame
    analyzer: Analyzer
    n_docs: int

    @functools.cached_property
    def postings(self) -> DataFrame:
        # in runs sorted by term: a query's scan reads the pages that hold its terms
        rows = postings_of(self.docs, "text", self.analyzer).unionByName(value_postings(self.docs, FACETS).sortWithinPartitions("term", "doc_id"))
        return written(rows, "postings")

    @functools.cached_property
    def terms(self) -> DataFrame:
        return written(terms_of(self.docs, "text", self.analyzer).sortWithinPartitions("term"), "terms")

    def snapshot(self) -> Corpus:
        return self

    def number_of_docs(self) -> int:
        return self.n_docs

    def frequencies(self, words: list[str]) -> dict[str, int]:
        if not words:
            return {}
        return {r.term: r.df for r in self.postings.where(F.col("term").isin(*words)).groupBy("term").agg(F.count("*").alias("df")).collect()}

    def rows(self, query: str, scored: bool = True) -> DataFrame:
        compiler = Compiler(self.postings, self.docs.select("doc_id"), self.number_of_docs(), self.frequencies, self.analyzer, scored)
        return compiler.compile(parse(query)).select("doc_id", F.round("score", 6).alias("score"))


_held: dict[tuple, Corpus] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stop_words(spark: SparkSession) -> frozenset[str]:
    return frozenset(StopWordsRemover.loadDefaultStopWords("english"))


def corpus(spark: SparkSession, sf_dir: str, stop: bool = False, stem: bool = False) -> Corpus:
    key = (spark.sparkContext.applicationId, sf_dir, stop, stem)
    if key not in _held:
        docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("ext_id"), "text", *[F.array(f).alias(f) for f in FACETS])
        _held[key] = Corpus(docs, Analyzer(stop_words(spark) if stop else frozenset(), stem), docs.count())
    return _held[key]


def _query(words: str, stop: bool = False, stem: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: corpus(spark, sf_dir, stop, stem).rows(words)


# SQL: the analysis (fixed pattern of words), postings, frequencies

P = r"[^\p{L}\p{N}_]+"


def _prelude(stops: str = "") -> str:
    keep = f" and x not in ({stops})" if stops else ""
    return f"""with d as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '{P}'), lambda x: lower(x)), lambda x: x <> '' and length(x) <= 25{keep}) as t from documents),
tk as (select doc_id, unnest(t) as term, generate_subscripts(t, 1) - 1 as pos from d),
po as (select term, doc_id, count(*) as tf from tk group by term, doc_id),
n as (select count(*) as n from documents),
s as (select term, doc_id, (1 + log10(tf)) * log10((select n from n) / count(*) over (partition by term)) as score from po)
"""


def _all_of(words: list[str]) -> str:
    names = ", ".join(f"'{w}'" for w in words)
    return f"select doc_id, sum(score) as score from s where term in ({names}) group by doc_id having count(*) = {len(words)}"


def _any_of(words: list[str]) -> str:
    names = ", ".join(f"'{w}'" for w in words)
    return f"select doc_id, sum(score) as score from s where term in ({names}) group by doc_id"


def _phrase(words: list[str]) -> str:
    joins = " ".join(f"join tk t{i} on t{i}.doc_id = t0.doc_id and t{i}.pos = t0.pos + {i} and t{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return f"select * from ({_all_of(sorted(set(words)))}) where doc_id in (select t0.doc_id from tk t0 {joins} where t0.term = '{words[0]}')"


def _out(body: str, stops: str = "") -> str:
    return _prelude(stops) + f"select doc_id, round(score, 6) as score from ({body}) q"


def _stops() -> str:
    """Spark's English stop words as a list in SQL."""
    words = sorted(stop_words(SparkSession.builder.getOrCreate()))
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | Callable[[], str] | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql if callable(sql) else lambda: sql


# analysis

_add(
    "tokenize_docs",
    lambda s, d: table(s, d, "documents").select("doc_id", F.size(text.tokenize(F.col("text"))).cast("long").alias("pieces"), F.md5(F.array_join(text.tokenize(F.col("text")), " ")).alias("tokens_md5")),
    f"select doc_id, cast(len(regexp_split_to_array(text, '{P}')) as bigint) as pieces, md5(array_to_string(regexp_split_to_array(text, '{P}'), ' ')) as tokens_md5 from documents",
)
_add(
    "analyze_terms",
    lambda s, d: table(s, d, "documents").select("doc_id", Analyzer().terms(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5")),
    _prelude() + "select doc_id, cast(len(t) as bigint) as n_terms, md5(array_to_string(t, ' ')) as terms_md5 from d",
)
_add(
    "analyze_stop_words",
    lambda s, d: table(s, d, "documents").select("doc_id", Analyzer(stop_words(s)).terms(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_terms")),
    lambda: _prelude(_stops()) + "select doc_id, cast(len(t) as bigint) as n_terms from d",
)
_add(
    "postings",
    lambda s, d: postings_of(table(s, d, "documents"), "text", Analyzer()).select("term", "doc_id", "tf", F.element_at("positions", 1).cast("long").alias("first_pos"), F.element_at("positions", -1).cast("long").alias("last_pos")),
    _prelude() + "select term, doc_id, cast(count(*) as bigint) as tf, cast(min(pos) as bigint) as first_pos, cast(max(pos) as bigint) as last_pos from tk group by term, doc_id",
)
_add(
    "term_dictionary",
    lambda s, d: terms_of(table(s, d, "documents"), "text", Analyzer()).select("term", "df", "cf", "first_occurrence"),
    f"""with d as (select doc_id, list_filter(regexp_split_to_array(text, '{P}'), lambda x: x <> '' and length(x) <= 25) as t from documents),
tk as (select doc_id, unnest(t) as token, generate_subscripts(t, 1) - 1 as pos from d)
select lower(token) as term, cast(count(distinct doc_id) as bigint) as df, cast(count(*) as bigint) as cf, arg_min(token, row(doc_id, pos)) as first_occurrence from tk group by 1""",
)

# query language

_add("term_tfidf", _query("erst"), _out("select doc_id, score from s where term = 'erst'"))
_add("bool_and", _query("the AND and"), _out(_all_of(["the", "and"])))
_add("bool_and3", _query("the AND of AND erst"), _out(_all_of(["the", "of", "erst"])))
_add("bool_or", _query("erst OR der"), _out(_any_of(["erst", "der"])))
_add("bool_not", _query("NOT the"), _out("select doc_id, 1.0 as score from documents where doc_id not in (select doc_id from tk where term = 'the')"))
_add("bool_and_not", _query("of AND NOT erst"), _out("select doc_id, score + 1 as score from s where term = 'of' and doc_id not in (select doc_id from tk where term = 'erst')"))
_add(
    "bool_nested_parens",
    _query("(erst OR der) AND (NOT of OR in)"),
    _out(f"select a.doc_id, a.score + b.score as score from ({_any_of(['erst', 'der'])}) a join (select doc_id, sum(score) as score from (select doc_id, score from s where term = 'in' union all select doc_id, 1.0 from documents where doc_id not in (select doc_id from tk where term = 'of')) group by doc_id) b on a.doc_id = b.doc_id"),
)
_add("natural_or", _query("erst haed"), _out(_any_of(["erst", "haed"])))
_add("natural_and_precedence", _query("haed erst AND re"), _out(f"select doc_id, sum(score) as score from (select doc_id, score from s where term = 'haed' union all select * from ({_all_of(['erst', 're'])})) group by doc_id"))
_add("stopword_and", _query("the AND erst", stop=True), lambda: _out("select doc_id, score from s where term = 'erst'", _stops()))
_add("phrase2", _query('"of the"'), _out(_phrase(["of", "the"])))
_add("phrase3", _query('"of the and"'), _out(_phrase(["of", "the", "and"])))
_add("phrase_repeated_word", _query('"the of the"'), _out("select doc_id, sum(score * case when term = 'the' then 2 else 1 end) as score from s where term in ('the', 'of') and doc_id in (select a.doc_id from tk a join tk b on a.doc_id = b.doc_id and b.pos = a.pos + 1 and b.term = 'of' join tk c on a.doc_id = c.doc_id and c.pos = a.pos + 2 and c.term = 'the' where a.term = 'the') group by doc_id"))
_add("phrase_stopword_gap", _query('"er the th"', stop=True), lambda: _out(_phrase(["er", "th"]), _stops()))
_add("proximity", _query("#3(of, to)"), _out(f"select * from ({_all_of(['of', 'to'])}) where doc_id in (select a.doc_id from tk a join tk b on a.doc_id = b.doc_id and abs(a.pos - b.pos) <= 3 where a.term = 'of' and b.term = 'to')"))
_add("proximity_and", _query("#2(of, erst) AND the"), _out(f"select * from ({_all_of(['of', 'erst', 'the'])}) where doc_id in (select a.doc_id from tk a join tk b on a.doc_id = b.doc_id and abs(a.pos - b.pos) <= 2 where a.term = 'of' and b.term = 'erst')"))
_add("protected_term", _query("source:src7"), "select doc_id, round(log10((select count(*) from documents) / count(*) over ()), 6) as score from documents where source = 'src7'")


# search


def _facet_filter(s: SparkSession, d: str) -> DataFrame:
    rows, _ = Searcher(corpus(s, d)).matches(SearchRequest("erst OR der", filters=[Filter("lang", "en")], score_filters=False))
    return rows.select("doc_id", F.round("score", 6).alias("score"))


def _scored_filter(s: SparkSession, d: str) -> DataFrame:
    rows, _ = Searcher(corpus(s, d)).matches(SearchRequest("erst OR der", filters=[Filter("source", "src7")]))
    return rows.select("doc_id", F.round("score", 6).alias("score"))


def _facets(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d)
    return facet_counts(c.rows("of", False), c.docs, [Facet("lang", 3), Facet("source", 5), Facet("nothing")])


def _hits(s: SparkSession, d: str) -> DataFrame:
    found = Searcher(corpus(s, d)).search(SearchRequest("erst AND the", max_results=5, fields=["lang", "source"]))
    return found.hits.select(F.col("id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), F.element_at("lang", 1).alias("lang"), F.element_at("source", 1).alias("source"))


_add("facet_filter", _facet_filter, _out(f"select q0.* from ({_any_of(['erst', 'der'])}) q0 join documents x on x.doc_id = q0.doc_id and x.lang = 'en'"))
_add("facet_filter_scored", _scored_filter, _out(f"select q0.doc_id, q0.score + (select log10((select n from n) / count(*)) from documents where source = 'src7') as score from ({_any_of(['erst', 'der'])}) q0 join documents x on x.doc_id = q0.doc_id and x.source = 'src7'"))
_add(
    "facet_counts",
    _facets,
    _prelude() + "select field, value, cast(count as bigint) as count from (select field, value, count(*) as count, row_number() over (partition by field order by count(*) desc, value) as r from (select doc_id, 'lang' as field, lang as value from documents union all select doc_id, 'source', source from documents) x where doc_id in (select doc_id from tk where term = 'of') group by field, value) where r <= case field when 'lang' then 3 else 5 end",
)
_add("total_hits", lambda s, d: corpus(s, d).rows("erst OR der", False).agg(F.count("*").alias("total_hits")), _prelude() + "select cast(count(distinct doc_id) as bigint) as total_hits from tk where term in ('erst', 'der')")
_add("topk_scored", lambda s, d: page(corpus(s, d).rows("the AND and"), 10), _out(_all_of(["the", "and"])) + " order by score desc, doc_id limit 10")
_add("page2_scored", lambda s, d: page(corpus(s, d).rows("the AND and"), 10, 10), _out(_all_of(["the", "and"])) + " order by score desc, doc_id limit 10 offset 10")
_add("topk_unscored", lambda s, d: page(corpus(s, d).rows("erst", False), 10, 5, False).select("doc_id"), _prelude() + "select doc_id from po where term = 'erst' order by doc_id limit 10 offset 5")
_add("field_projection", _hits, _prelude() + f"select q.doc_id, round(q.score, 6) as score, x.lang, x.source from ({_all_of(['erst', 'the'])}) q join documents x on x.doc_id = q.doc_id order by round(q.score, 6) desc, q.doc_id limit 5")

# vectors


def _vector(s: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(table(s, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


def _knn(metric: str, k: int = 10, among: bool = False, most: float | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        only = table(s, d, "embeddings").where("label = 3") if among else None
        return knn.nearest(table(s, d, "embeddings"), _vector(s, d), k, "vec_id", "embedding", metric, most, only, digits=6)

    return run


def _distance(metric: str) -> str:
    return "round(greatest(0.0, list_cosine_distance(cast(e.embedding as double[]), cast(q.embedding as double[]))), 6)" if metric == "cosine" else "round(list_distance(cast(e.embedding as double[]), cast(q.embedding as double[])), 6)"


def _knn_sql(metric: str, where: str = "true", limit: int = 10) -> str:
    return f"select * from (select e.vec_id, {_distance(metric)} as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q where {where}) order by distance, vec_id limit {limit}"


def _rerank(s: SparkSession, d: str) -> DataFrame:
    top = page(corpus(s, d).rows("the AND and"), 20)
    vectors = table(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return knn.rerank(top, vectors, _vector(s, d), "doc_id", "embedding").select("doc_id", F.round("score", 5).alias("score"))


def _mean(s: SparkSession, d: str) -> DataFrame:
    means = stats.mean_vector(table(s, d, "embeddings").select("label", "embedding"), "label", "embedding")
    return means.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


_add("knn_cosine", _knn("cosine"), _knn_sql("cosine"))
_add("knn_l2", _knn("l2", 4), _knn_sql("l2", limit=4))
_add("knn_max_distance", _knn("cosine", 10_000, most=0.8), f"select * from ({_knn_sql('cosine', limit=10_000)}) where distance <= 0.8")
_add("knn_filtered", _knn("cosine", 10, among=True), _knn_sql("cosine", "e.label = 3"))
_add("mean_embedding", _mean, "select label, cast(i - 1 as bigint) as i, round(avg(cast(x as double)), 6) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i")
_add("rerank_vector", _rerank, _prelude() + f", t as (select doc_id, round(score, 6) as score from ({_all_of(['the', 'and'])}) order by 2 desc, 1 limit 20) select t.doc_id, round(1 - greatest(0.0, list_cosine_distance(cast(e.embedding as double[]), cast(q.embedding as double[]))) + t.score / (select max(score) from t), 5) as score from t join embeddings e on e.vec_id = t.doc_id, (select embedding from embeddings where vec_id = 0) q")

# suggestions, expansion, statistics


def _suggest(query: str, most: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: suggest(suggester(corpus(s, d).terms), query, most).select("suggestion", "highlighted", "cf")


_FIRST = f"""with d as (select doc_id, list_filter(regexp_split_to_array(text, '{P}'), lambda x: x <> '' and length(x) <= 25) as t from documents),
tk as (select doc_id, unnest(t) as token, generate_subscripts(t, 1) - 1 as pos from d),
w as (select lower(token) as term, cast(count(*) as bigint) as cf, lower(arg_min(token, row(doc_id, pos))) as first from tk where regexp_full_match(lower(token), '\\p{{L}}+') group by 1)
"""


def _expand(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d)
    return expansion.expand(*expansion.expansions(c.postings, c.number_of_docs()), ["haed"], 10)


def _chi(s: SparkSession, d: str) -> DataFrame:
    """How lang = en and each frequent term go together."""
    c = corpus(s, d)
    en = c.docs.where(F.element_at("lang", 1) == "en").select("doc_id", F.lit(1).alias("en"))
    rows = c.postings.where(~F.col("term").contains(":")).select("term", "doc_id").join(en, "doc_id", "left").groupBy("term").agg(F.count("en").alias("n11"), F.count("*").alias("df")).where("df >= 100")
    total, n_en = c.number_of_docs(), en.count()
    n11 = F.col("n11").cast("double")
    n10, n01 = F.col("df") - n11, F.lit(float(n_en)) - n11
    return rows.select("term", F.round(stats.chi_square(n11, n10, n01, F.lit(float(total)) - F.col("df") - n01), 4).alias("chi2"))


def _trigrams(s: SparkSession, d: str) -> DataFrame:
    return frequent_ngrams(table(s, d, "documents"), "text")


def _replay(s: SparkSession, d: str) -> DataFrame:
    log = ["erst", "the AND of", "NOT the", '"of the"', "#3(of, to)", "erst haed"]
    return replay(Searcher(corpus(s, d)), [(q, None) for q in log], max_results=3, fields=["lang"]).select("query", "hits")


def _latency(s: SparkSession, d: str) -> DataFrame:
    rows = stats.latency_stats(table(s, d, "events").where("value > 0"), "value")
    return rows.select(*[F.round(c, 6).alias(c) if c != "n" else F.col(c) for c in rows.columns])


_add("suggest_prefix", _suggest("th", 5), _FIRST + "select first as suggestion, substr(first, 1, 2) || '<b>' || substr(first, 3) || '</b>' as highlighted, cf from w where starts_with(term, 'th') order by cf desc, term limit 5")
_add("suggest_highlight", _suggest("the onl", 8), _FIRST + "select 'the ' || first as suggestion, substr('the ' || first, 1, 7) || '<b>' || substr('the ' || first, 8) || '</b>' as highlighted, cf from w where starts_with(term, 'onl') order by cf desc, term limit 8")
_MI = "round(case when n11 > 0 then n11 / n * log2(n * n11 / ((n11 + n10) * n11)) else 0.0 end + case when n10 > 0 then n10 / n * log2(n * n10 / ((n11 + n10) * (n10 + n00))) else 0.0 end + case when n00 > 0 then n00 / n * log2(n * n00 / (n00 * (n10 + n00))) else 0.0 end, 6)"
_add(
    "expand_mi",
    _expand,
    _prelude() + f""", p as (select term, doc_id, tf from po where regexp_full_match(term, '\\p{{L}}+')),
f as (select term, cast(count(*) as double) as df from p group by term having count(*) > 1),
c as (select term, least(df, 1000.0) as n11, df - least(df, 1000.0) as n10, (select n from n) - df as n00, cast((select n from n) as double) as n from f),
m as (select term, {_MI} as mi from c),
top as (select p.term, doc_id, row_number() over (partition by p.term order by tf desc, doc_id) as r from p join f on f.term = p.term),
td as (select t.term, t.doc_id, m.mi from top t join m on m.term = t.term where r <= 1000),
best as (select doc_id, term, mi, row_number() over (partition by doc_id order by mi desc, term) as r from td)
select distinct term, mi from best where r <= 5 and doc_id in (select doc_id from td where term = 'haed') order by mi desc, term limit 10""",
)
_add(
    "chi_square",
    _chi,
    _prelude() + """, c as (select term, cast(count(*) filter (x.lang = 'en') as double) as n11, cast(count(*) as double) as df from po join documents x on x.doc_id = po.doc_id group by term having count(*) >= 100),
e as (select *, df - n11 as n10, (select count(*) from documents where lang = 'en') - n11 as n01 from c),
g as (select *, (select n from n) - df - n01 as n00 from e)
select term, round(case when (n11+n01)*(n11+n10)*(n10+n00)*(n01+n00) <> 0 then (n11+n10+n01+n00)*(n11*n00-n10*n01)*(n11*n00-n10*n01)/((n11+n01)*(n11+n10)*(n10+n00)*(n01+n00)) end, 4) as chi2 from g""",
)
_add(
    "top_terms",
    lambda s, d: expansion.top_terms(corpus(s, d).postings.where(~F.col("term").contains(":")), table(s, d, "documents").where("lang = 'de'"), corpus(s, d).number_of_docs(), 10, ("der",)),
    _prelude() + "select term, round(sum(tf) * log10((select n from n) / (select count(*) from po p2 where p2.term = po.term)), 6) as score from po where doc_id in (select doc_id from documents where lang = 'de') and not regexp_full_match(term, '\\p{N}+') and term <> 'der' group by term order by score desc, term limit 10",
)
_add(
    "trigrams",
    _trigrams,
    _prelude() + ", v as (select list_filter(t, lambda x: regexp_full_match(x, '\\p{L}+')) as t from d), i as (select t, unnest(range(1, len(t) - 1)) as i from v where len(t) >= 3) select t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] as ngram, cast(count(*) as bigint) as count from i group by 1 having count(*) >= 10",
)
_add(
    "latency_stats",
    _latency,
    "select round(max(value), 6) as max, round(min(value), 6) as min, round(quantile_cont(value, 0.5), 6) as median, round(avg(value), 6) as mean, round(count(value) / sum(1 / value), 6) as harmonic_mean, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(stddev_samp(value), 6) as stdev, cast(count(value) as bigint) as n from events where value > 0",
)
_add("slowest_n", lambda s, d: stats.slowest(table(s, d, "events").select("event_id", "value"), "value", "event_id", 10), "select event_id, value from events order by value desc, event_id limit 10")
_add(
    "query_log_replay",
    _replay,
    _prelude() + "select query, cast(hits as bigint) as hits from (select 'erst' as query, count(*) as hits from po where term = 'erst' "
    "union all select 'the AND of', count(*) from po a join po b on a.doc_id = b.doc_id and b.term = 'of' where a.term = 'the' "
    "union all select 'NOT the', count(*) from documents where doc_id not in (select doc_id from po where term = 'the') "
    "union all select '\"of the\"', count(distinct a.doc_id) from tk a join tk b on a.doc_id = b.doc_id and b.pos = a.pos + 1 and b.term = 'the' where a.term = 'of' "
    "union all select '#3(of, to)', count(distinct a.doc_id) from tk a join tk b on a.doc_id = b.doc_id and abs(a.pos - b.pos) <= 3 and b.term = 'to' where a.term = 'of' "
    "union all select 'erst haed', count(distinct doc_id) from po where term in ('erst', 'haed'))",
)
_add("mean_by_kind", lambda s, d: stats.mean_by(table(s, d, "events"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean")), "select event_type, round(avg(value), 6) as mean from events group by event_type")
_add("failure_counts", lambda s, d: stats.outcomes(table(s, d, "events"), F.col("value") > 50), "select cast(count(*) filter (value > 50) as bigint) as failed, cast(count(*) filter (value > 50 is not true) as bigint) as done from events")

# cleaning

_CLEAN = "regexp_replace(array_to_string(list_transform(list_filter(list_transform(list_transform(regexp_split_to_array(text, '[\\s\\p{Z}\\x1c-\\x1f\\x85]+'), lambda w: regexp_replace(w, '[^\\x00-\\x7F]', '', 'g')), lambda w: case when contains(w, 'http') or contains(w, '@') then replace(w, 'mailto:', '') when length(regexp_replace(w, '[!|\"£$%^&*()_+=}{\\[\\]~:;><.,/''0-9]', '', 'g')) > 2 then regexp_replace(w, '[!|\"£$%^&*()_+=}{\\[\\]~:;><.,/''0-9]', '', 'g') else '' end), lambda w: w <> ''), lambda w: ' ' || w), ''), '- | -', '', 'g')"
_add("body_clean", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(text.clean_body(F.col("text"))).alias("clean_md5")), f"select doc_id, md5({_CLEAN}) as clean_md5 from documents")
_add(
    "sentence_split",
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence")).select("conv_id", "turn", F.col("i").cast("long").alias("i"), "sentence"),
    "select conv_id, turn, cast(generate_subscripts(x, 1) - 1 as bigint) as i, unnest(x) as sentence from (select conv_id, turn, list_filter(string_split(text, '.'), lambda s: s <> '') as x from conversations)",
)


def _names(s: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.col("s_name"), F.lit(" (Dept. (x) of y), "), F.lpad(F.col("s_nationkey").cast("string"), 3, " "), F.lit("  and Zed (z),"))
    return table(s, d, "supplier").select("s_suppkey", F.array_join(text.authors(made), "|").alias("authors"))


_add("authors_split", _names, "select s_suppkey, s_name || '|' || trim(cast(s_nationkey as varchar)) || '|Zed' as authors from supplier")


def _codes(s: SparkSession, d: str) -> DataFrame:
    lookup = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    rows = table(s, d, "customer").select("c_custkey", F.concat_ws(" ", F.col("c_nationkey").cast("string"), ((F.col("c_nationkey") + 1) % 25).cast("string"), F.col("c_nationkey").cast("string")).alias("codes"))
    return text.map_codes(rows, "c_custkey", text.split_codes(F.col("codes")), lookup).select("c_custkey", F.array_join("names", "|").alias("names"))


def _codes_in_parentheses(s: SparkSession, d: str) -> DataFrame:
    lookup = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    rows = table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("A ("), F.col("s_nationkey").cast("string"), F.lit("); B ("), F.col("s_nationkey").cast("string"), F.lit(")")).alias("codes"))
    return text.map_codes(rows, "s_suppkey", text.codes_in_parentheses(F.col("codes")), lookup, distinct=False).select("s_suppkey", F.array_join("names", "|").alias("names"))


_add("subjects_map", _codes, "select c_custkey, least(a.n_name, b.n_name) || '|' || greatest(a.n_name, b.n_name) as names from customer join nation a on a.n_nationkey = c_nationkey join nation b on b.n_nationkey = (c_nationkey + 1) % 25")
_add("subjects_in_parentheses", _codes_in_parentheses, "select s_suppkey, n_name || '|' || n_name as names from supplier join nation on n_nationkey = s_nationkey")
_add("subjects_distinct", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(text.distinct_values(F.split("p_name", " ")), " ").alias("words")), "select p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') as words from part")
_add("metadata_prefix", lambda s, d: table(s, d, "part").select("p_partkey", text.metadata_value(F.concat(F.lit("Title:\n"), F.col("p_name"), F.lit("\n")), "Title:").alias("title")), "select p_partkey, p_name as title from part")


def _ids(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select("o_orderkey", text.paper_id(F.col("o_orderdate"), F.col("o_orderkey") * 37).alias("paper"))
    year, month = text.id_year_month(F.col("paper"))
    return rows.select("o_orderkey", "paper", text.age_in_years(F.when(year > 50, year - 100).otherwise(year), month, 2024, 6).alias("age"))


_add(
    "id_date_age",
    _ids,
    "select o_orderkey, strftime(o_orderdate, '%y%m') || '.' || lpad(cast(o_orderkey * 37 as varchar), cast(greatest(5, length(cast(o_orderkey * 37 as varchar))) as int), '0') as paper, cast(floor((12 * 2024 + 6 - (12 * year(o_orderdate) + month(o_orderdate))) / 12.0 + 0.5) as bigint) as age from orders",
)
_add("paging_math", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total")).select("o_custkey", text.total_pages(F.col("total"), 10).alias("pages"), text.page_offset(text.total_pages(F.col("total"), 10), 10).alias("last_offset")), "select o_custkey, cast(ceil(count(*) / 10.0) as bigint) as pages, cast((ceil(count(*) / 10.0) - 1) * 10 as bigint) as last_offset from orders group by o_custkey")
_add("value_counts", lambda s, d: text.value_counts(table(s, d, "part"), lambda: F.split("p_name", " ")), "select value, cast(count(*) as bigint) as count from (select unnest(string_split(p_name, ' ')) as value from part) group by value")
_add("param_to_bool", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(text.is_true(F.when(F.col("l_linestatus") == "O", "T").otherwise("no"))).alias("yes")), "select l_returnflag, cast(count(*) filter (l_linestatus = 'O') as bigint) as yes from lineitem group by l_returnflag")
_add(
    "html_title",
    lambda s, d: table(s, d, "pages").select("page_id", html_title(F.col("html")).alias("title")),
    "select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) as title from pages",
)
_add("html_metadata", lambda s, d: dealt(table(s, d, "pages").select("page_id", "html")).select("page_id", html_fields(F.col("html"), ("ad",)).alias("f")).select("page_id", F.col("f.ad").alias("ad")), "select page_id, trim(replace(regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1), chr(10), ' ')) as ad from pages")

# appending


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("title"), F.array("role").alias("subject"), F.col("text").alias("abstract"))


def _fresh(s: SparkSession, d: str, batches: int) -> Index:
    import uuid

    index = Index(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}")
    rows = _documents(s, d)
    for i in range(batches):
        index.add(rows.where(F.pmod(F.crc32("id"), F.lit(batches)) <= i))
    return index


def _dedup(s: SparkSession, d: str) -> DataFrame:
    return _fresh(s, d, 2).docs.select("ext_id", "title")


def _numbered(s: SparkSession, d: str) -> DataFrame:
    docs = _fresh(s, d, 2).docs
    return docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count_distinct("doc_id").alias("ids"))


def _merged(s: SparkSession, d: str) -> DataFrame:
    index = _fresh(s, d, 3)
    index.compact(1)
    compiler = Compiler(index.postings, index.docs.select("doc_id"), index.number_of_docs(), index.frequencies, index.analyzer)
    rows = compiler.compile(parse("the AND of"))
    return rows.join(index.docs.select("doc_id", "ext_id"), "doc_id").select("ext_id", F.round("score", 6).alias("score"))


def _stream(s: SparkSession, d: str) -> DataFrame:
    import uuid

    from .streaming.ingest import ingest, read_stream

    here = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    _documents(s, d).repartition(4).write.json(f"{here}/in")
    index = Index(s, f"{here}/index")
    ingest(index, read_stream(s, f"{here}/in", 2), f"{here}/checkpoint").awaitTermination()
    return index.docs.select("ext_id", "title")


_FIRST_OF = "select ext_id, role as title from (select cast(conv_id as varchar) || '-' || cast(turn as varchar) as ext_id, role from conversations) group by ext_id, role"
_add("dedup_append", _dedup, _FIRST_OF)
_add("append_numbering", _numbered, "select cast(n as bigint) as n, cast(1 as bigint) as least, cast(n as bigint) as most, cast(n as bigint) as ids from (select count(*) as n from (" + _FIRST_OF + "))")
_add(
    "segment_merge_invariance",
    _merged,
    f"""with c as (select cast(conv_id as varchar) || '-' || cast(turn as varchar) as ext_id, role || ' ' || text || ' ' || role as text from conversations),
d as (select ext_id, list_filter(list_transform(regexp_split_to_array(text, '{P}'), lambda x: lower(x)), lambda x: x <> '' and length(x) <= 25) as t from c),
po as (select ext_id, term, count(*) as tf from (select ext_id, unnest(t) as term from d) group by ext_id, term),
s as (select ext_id, term, (1 + log10(tf)) * log10((select count(*) from c) / count(*) over (partition by term)) as score from po)
select ext_id, round(sum(score), 6) as score from s where term in ('the', 'of') group by ext_id having count(*) = 2""",
)
_add("stream_ingest", _stream, _FIRST_OF)


#: Words that the stemmer takes to "der" and "erst", by the rules for their endings.
_STEMS = {"der": ("der", "ders", "derred", "derring", "derness", "derful"), "erst": ("erst", "ersts", "erste", "erstes", "ersted", "ersting", "erstings", "erstness", "erstful")}
_STEM = " ".join(f"when term in ({', '.join(repr(w) for w in words)}) then '{stem}'" for stem, words in _STEMS.items())
_add(
    "stemmed_search",
    lambda s, d: corpus(s, d, stem=True).rows("derring OR ersts"),
    _prelude() + f""", st as (select doc_id, case {_STEM} end as stem from tk), sp as (select stem, doc_id, count(*) as tf from st where stem is not null group by stem, doc_id),
ss as (select doc_id, (1 + log10(tf)) * log10((select n from n) / count(*) over (partition by stem)) as score from sp)
select doc_id, round(sum(score), 6) as score from ss group by doc_id""",
)

# sources: files made of the fixtures, read as the library reads them


def _folder(s: SparkSession, name: str) -> str:
    return new_table(s, name)


def _lines(rows: DataFrame, name: str, *more: str, compression: str | None = None) -> str:
    """rows as JSON lines in a folder, with some other lines."""
    path = _folder(rows.sparkSession, name)
    write_lines(rows, path, compression)
    if more:
        rows.sparkSession.createDataFrame([(m,) for m in more], "value string").write.mode("append").text(path, compression=compression)
    return path


def _papers(s: SparkSession, d: str) -> DataFrame:
    columns = [F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"), F.array("source").alias("authors"), F.col("text").alias("abstract"), F.array("lang", "source").alias("subject")]
    return table(s, d, "documents").select(*columns)


def _vector_lines(s: SparkSession, d: str) -> str:
    path = _folder(s, "vectors")
    table(s, d, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(","), F.to_json("embedding"))).write.text(path)
    return path


def _read_back(compression: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        path = _lines(_papers(s, d), "lines", "{not json", '{"id": "x1", "title": "no abstract"}', '{"title": "t", "abstract": "a"}', "", compression=compression)
        good, bad = read_documents(s, path)
        good = good.select("id", "title", F.array_join("subject", "|").alias("rest"), F.md5("abstract").alias("text_md5"))
        return good.unionByName(bad.select(F.lit("").alias("id"), F.lit("bad").alias("title"), F.col("reason").alias("rest"), F.md5("line").alias("text_md5")))

    return run


_READ_BACK = """select cast(doc_id as varchar) as id, lang as title, lang || '|' || source as rest, md5(text) as text_md5 from documents
union all select '', 'bad', 'not a JSON object of documents', md5('{not json')
union all select '', 'bad', 'no abstract', md5('{"id": "x1", "title": "no abstract"}')
union all select '', 'bad', 'no id', md5('{"title": "t", "abstract": "a"}')"""
_add("source_json_lines", _read_back(None), _READ_BACK)
_add("source_gzip_lines", _read_back("gzip"), _READ_BACK)


def _sums(rows: DataFrame, key: str) -> DataFrame:
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select(F.col(key).cast("long").alias("id"), F.size("vector").cast("long").alias("dim"), F.round(total, 4).alias("total"))


_SUMS = "cast(len(embedding) as bigint) as dim, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total"
_add("source_vectors", lambda s, d: _sums(read_vectors(s, _vector_lines(s, d)), "id"), f"select vec_id as id, {_SUMS} from embeddings")


def _numbered_vectors(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "vectors")
    rows = table(s, d, "embeddings").orderBy("vec_id").coalesce(1).select(F.concat(F.lit("any,"), F.to_json("embedding")))
    rows.write.text(path)
    return _sums(read_numbered_vectors(s, path), "id")


_add("source_numbered_vectors", _numbered_vectors, f"select row_number() over (order by vec_id) - 1 as id, {_SUMS} from embeddings")


def _json_array(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "array")
    rows = table(s, d, "nation").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))))))
    rows.write.text(path)
    return read_json_array(s, path, "code long, name string")


_add("source_json_array", _json_array, "select cast(n_nationkey as bigint) as code, n_name as name from nation")
_add(
    "vector_align",
    lambda s, d: _sums(with_vectors(_papers(s, d), read_vectors(s, _vector_lines(s, d)).join(_papers(s, d).select("id"), "id", "left_semi")), "id"),
    f"select doc_id as id, {_SUMS} from documents join embeddings on vec_id = doc_id",
)


def _bulk(s: SparkSession, d: str, **more) -> Engine:
    engine = Engine(s, _folder(s, "engine"), dimension=64, **more)
    ids = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"))
    lines = _papers(s, d).join(ids, "id", "left_semi").select("id", "title", "authors", "abstract", "subject")
    engine.bulk_add(_lines(lines, "lines", "{not json", compression="gzip"), _vector_lines_of(s, d))
    return engine


def _vector_lines_of(s: SparkSession, d: str) -> str:
    """Vectors of the documents that there are."""
    path = _folder(s, "vectors")
    found = table(s, d, "embeddings").join(table(s, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    found.select(F.concat(F.col("vec_id").cast("string"), F.lit(","), F.to_json("embedding"))).write.text(path)
    return path


_BOTH = "documents join embeddings on vec_id = doc_id"
_add("bulk_add", lambda s, d: _bulk(s, d).index.docs.select(F.col("ext_id").alias("id"), "title", F.size("vector").cast("long").alias("dim")), f"select cast(doc_id as varchar) as id, lang as title, cast(len(embedding) as bigint) as dim from {_BOTH}")


def _natural(s: SparkSession, d: str) -> DataFrame:
    vector = _vector(s, d)
    found = _bulk(s, d, embedder=lambda query: vector).search(SearchRequest("two words", max_results=5, max_distance=0.9, fields=["title"]))
    return found.hits.select(F.col("id").cast("long").alias("id"), F.round("score", 5).alias("score"), "title")


_add(
    "natural_vector_search",
    _natural,
    f"select doc_id as id, round(1 - distance, 5) as score, lang as title from (select *, greatest(0.0, list_cosine_distance(cast(embedding as double[]), cast((select embedding from embeddings where vec_id = 0) as double[]))) as distance from {_BOTH}) where distance <= 0.9 order by distance, doc_id limit 5",
)


def _vector_guard(s: SparkSession, d: str) -> DataFrame:
    """Vectors of another length than the index has are refused, one by one."""
    index = Index(s, _folder(s, "index"), dimension=64)
    rows = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("a").alias("abstract"), F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"))
    _, refused = index.add(rows)
    return index.docs.select("ext_id", F.lit("kept").alias("what")).unionByName(refused.select("ext_id", F.col("reason").alias("what")))


_add("vector_guard", _vector_guard, "select cast(vec_id as varchar) as ext_id, case when label = 3 then 'vector of wrong length' else 'kept' end as what from embeddings")


def _query_log(s: SparkSession, d: str) -> DataFrame:
    """A log of the words' frequencies, read back and replayed: its first queries by name."""
    path = _folder(s, "log")
    counts = corpus(s, d).terms.where("df >= 100").select("term", "df")
    counts.select(F.concat("term", F.lit(","), F.col("df").cast("string"))).write.text(path)
    return read_queries(s, path)


_add("source_query_log", _query_log, _prelude() + "select term as query, cast(count(*) as bigint) as expected_hits from po group by term having count(*) >= 100")
_add(
    "query_log_agrees",
    lambda s, d: replay(Searcher(corpus(s, d)), [(r.query, r.expected_hits) for r in _query_log(s, d).orderBy(F.desc("expected_hits"), "query").limit(5).collect()], max_results=1).select("query", "hits", "agrees"),
    _prelude() + "select term as query, cast(count(*) as bigint) as hits, true as agrees from po group by term order by count(*) desc, term limit 5",
)


def _page_fields(s: SparkSession, d: str) -> DataFrame:
    part = lambda name, label, value: F.concat(F.lit(f'<div class="x {name}"><span>{label}</span>\n'), value, F.lit("</div>"))
    html = F.concat(F.lit('<html><body><div class="dateline">[19 Nov]</div>'), part("title", "Title:", F.col("p_name")), part("authors", "Authors:", F.concat(F.lit("<a>"), F.col("p_brand"), F.lit("</a>, Zed"))), part("abstract", "Abstract:", F.col("p_type")), F.lit("<table><tr><td class=subjects>cs.IR</td></tr></table></body></html>"))
    return dealt(table(s, d, "part").select("p_partkey", html.alias("html"))).select("p_partkey", html_fields(F.col("html")).alias("f")).select("p_partkey", "f.*")


_add("page_metadata", _page_fields, "select p_partkey, '[19 Nov]' as date, p_name as title, p_brand || ', Zed' as authors, p_type as abstract, 'cs.IR' as subject from part")


def crawled_page(paper: str) -> str | None:
    """A page for every id but those of a number that three divides."""
    return None if int(paper[5:]) % 3 == 0 else f'<div class="dateline">[{paper[:4]}]</div><h1 class="title"><span>Title:</span> Paper {paper}</h1><div class="authors">Authors: A, B</div>'


def _crawl(s: SparkSession, d: str) -> DataFrame:
    s.dataSource.register(CrawlSource)
    found = s.read.format("crawl").options(fetch="scriptorium.queries:crawled_page", month="2403", first=1, last=1000, ids_a_task=300).load()
    return found.join(table(s, d, "supplier").select(F.concat(F.lit("2403."), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("id")), "id", "left_semi")


_add("crawl_source", _crawl, "select '2403.' || lpad(cast(s_suppkey as varchar), 5, '0') as id, '[2403]' as date, 'Paper 2403.' || lpad(cast(s_suppkey as varchar), 5, '0') as title, 'A, B' as authors, cast(null as varchar) as abstract, cast(null as varchar) as subject from supplier where s_suppkey between 1 and 1000 and s_suppkey % 3 <> 0")
_add(
    "sentence_texts",
    lambda s, d: table(s, d, "documents").select("doc_id", text.sentence_texts(F.col("text")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", "|")).alias("text_md5")),
    "select doc_id, cast(len(x) as bigint) as n, md5(array_to_string(x, '|')) as text_md5 from (select doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') as x from documents)",
)


def _nested(s: SparkSession, d: str) -> DataFrame:
    deep = F.concat(F.lit("A"), F.repeat(F.lit("("), F.col("s_suppkey").cast("int") % 30), F.lit("x"), F.repeat(F.lit(")"), F.col("s_suppkey").cast("int") % 30), F.lit(" B, C) D (E"))
    return table(s, d, "supplier").select("s_suppkey", text.without_parentheses(deep).alias("rest"))


_add("nested_parentheses", _nested, "select s_suppkey, 'A' || case when s_suppkey % 30 = 0 then 'x' else '' end || ' B, C) D (E' as rest from supplier")


def _no_codes(s: SparkSession, d: str) -> DataFrame:
    lookup = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    rows = table(s, d, "customer").select((F.col("c_custkey") % 100).alias("id"), F.when(F.col("c_nationkey") < 5, F.lit("")).otherwise(F.col("c_nationkey").cast("string")).alias("codes"))
    return text.map_codes(rows, "id", text.split_codes(F.col("codes")), lookup).select("id", F.array_join("names", "|").alias("names"))


_add("subjects_of_every_row", _no_codes, "select c_custkey % 100 as id, case when c_nationkey < 5 then '' else n_name end as names from customer join nation on n_nationkey = c_nationkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for two words, by TF-IDF."""
    return QUERIES["topk_scored"](spark, sf_dir)
