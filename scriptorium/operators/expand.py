"""Query expansion by mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import mutual_information
from ..functions.text import valid_term
from ..storage import shuffle_tasks

#: Ids of documents that each executor is given as a table; more are joined by a shuffle.
MOST_IDS_SENT = 1_000_000


def expansions(postings: DataFrame, n_docs: int, max_docs_per_term: int = 1000, max_terms_per_doc: int = 5) -> tuple[DataFrame, DataFrame]:
    """(term, doc_id): each term's documents where it is most frequent; (doc_id, term, mi): each document's best terms.

    Terms of letters only that occur in two documents or more. A term's score is one value, computed once a term: with its
    top documents as the set, n11 = their number, n10 = the other documents of the term, n01 = 0, n00 = the rest."""
    rows = postings.where(valid_term(F.col("term"))).select("term", "doc_id", "tf")
    # how often each tf occurs says which is the least among a term's top documents, and how many of those that have it are: so
    # only these are put in order, and only where some of them stay out
    down = Window.partitionBy("term").orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy("term", "tf").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(down)).withColumn("df", F.sum("n").over(Window.partitionBy("term")))
    top = F.least(F.col("df"), F.lit(max_docs_per_term))
    least = counts.where((F.col("df") > 1) & (F.col("upto") >= top) & (F.col("upto") - F.col("n") < top))
    n11 = top.cast("double")
    mi = mutual_information(n11, F.col("df") - n11, F.lit(0.0), F.lit(float(n_docs)) - F.col("df"))
    marks = least.select("term", F.col("tf").alias("least"), (top - (F.col("upto") - F.col("n"))).alias("wanted"), (F.col("upto") == top).alias("all"), F.round(mi, 6).alias("mi"))
    found = rows.repartition(shuffle_tasks(rows), "term").join(marks.hint("shuffle_hash"), "term").where(F.col("tf") >= F.col("least"))
    sure = found.where((F.col("tf") > F.col("least")) | F.col("all"))
    # not "==": that would be one more key of the join, and deal the rows out again
    equal = found.where((F.col("tf") <= F.col("least")) & ~F.col("all")).withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).where((F.col("n") <= max_docs_per_term) & (F.col("n") <= F.col("wanted")))
    scored = sure.select("term", "doc_id", "mi").unionByName(equal.select("term", "doc_id", "mi"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("mi"), "term")
    return scored.select("term", "doc_id"), scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max_terms_per_doc).select("doc_id", "term", "mi")


def expand(term_docs: DataFrame, doc_terms: DataFrame, terms: list[str], max_results: int = 10) -> DataFrame:
    """(term, mi): the best terms of the query terms' top documents, the query's own among them."""
    docs = term_docs.where(F.col("term").isin(*terms)).select("doc_id").distinct()  # so many a query term at most
    return doc_terms.join(F.broadcast(docs), "doc_id", "left_semi").select("term", "mi").distinct().orderBy(F.desc("mi"), "term").limit(max_results)


def top_terms(postings: DataFrame, doc_ids: DataFrame, n_docs: int, n: int = 10, without: tuple[str, ...] = ()) -> DataFrame:
    """(term, score): tf log10(N / df) added up over the given documents; no numbers, no terms of `without`."""
    ids = doc_ids.select("doc_id").distinct()
    few = ids.limit(MOST_IDS_SENT + 1).count() <= MOST_IDS_SENT
    ids = ids.withColumn("__among", F.lit(True)).hint("broadcast" if few else "shuffle_hash")
    # one scan and one aggregate; the postings are never sorted by document
    rows = postings.join(ids, "doc_id", "left").groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("__among"), F.col("tf"))).alias("tf")).where("tf is not null")
    rows = rows.where(~F.col("term").rlike(r"^\p{N}+$"))
    if without:
        rows = rows.where(~F.col("term").isin(*without))
    score = F.round(F.col("tf") * F.log10(F.lit(n_docs) / F.col("df")), 6)
    return rows.select("term", score.alias("score")).orderBy(F.desc("score"), "term").limit(n)
