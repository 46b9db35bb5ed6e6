"""The inverted index as Parquet tables.

A root folder holds, for each batch of appended documents, one folder a table:

    docs(doc_id, ext_id, fields..., vector)      postings(term, doc_id, tf, positions)
    terms(term, df, cf, first_doc, first_pos, first_occurrence)

and `commits`, one small record a batch, written last. A reader takes the batches of the commits it sees, so it never sees
half a batch, and compaction writes a new batch whose record names those it replaces. Postings are written where their
documents are read, in runs sorted by (term, doc_id), so a term's scan reads the pages of each run that hold it, and a term of
all documents is many files. Compaction range-partitions them by (term, doc_id) and sorts them.
"""

from __future__ import annotations

import contextlib
import functools
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import IndexStateError, MergeError
from ..functions.porter import stem
from ..functions.text import Analyzer, document_text, value_term

COMMIT = T.StructType([T.StructField("batch", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("first_id", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("replaces", T.ArrayType(T.StringType()))])
ID_BUCKETS = 256
#: Words taken together (or those of one longer document), and rows given to Spark at once.
PIECE, ROWS_OUT = 2_000_000, 100_000


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Of batches (doc_id, words), a stretch of documents at a time: the documents' ids in order, the words' codes in the order
    of the documents, what the codes stand for, and each word's document and position. Null texts have no words."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            stop = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + PIECE, side="right")))
            part = batch.slice(first, stop - first)
            part = part.take(pc.sort_indices(part.column(0)))
            own = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = part.column(1).flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(own)), own)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
            if len(doc):
                yield part.column(0), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, doc, pos
            first = stop


def _by_term(codes: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words in the order of their terms, by bytes, and of their places: the place of each, its term's number, and the terms.
    Several codes can stand for one term."""
    own = terms.dictionary_encode()
    order = pc.sort_indices(own.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    key = np.sort(rank[own.indices.to_numpy(zero_copy_only=False)][codes] * len(codes) + np.arange(len(codes)))
    term, place = np.divmod(key, len(codes))
    return place, term, own.dictionary.take(order)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _sharing(docs: DataFrame) -> DataFrame | None:
    """(doc_id) of ids that several rows have; None if there are none."""
    ids = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id"))
    return ids if ids.limit(1).collect() else None


@functools.lru_cache(1 << 18)
def _stem(term: str) -> str:
    return stem(term)


def postings_of(docs: DataFrame, text_column: str, analyzer: Analyzer, ids_differ: bool = False) -> DataFrame:
    """(term, doc_id, tf, positions), in runs that are sorted by term and id; positions count the terms that are kept, from 0.

    A document's postings are made where its text is read, and no token is shuffled. Rows that share an id, where ids_differ
    doesn't say that there are none, are one document: only theirs meet."""
    stems = analyzer.stem
    plain = replace(analyzer, stem=False)
    schema = T.StructType([T.StructField("term", T.StringType()), docs.schema["doc_id"], T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes, terms, doc, pos in pieces(batches):
            place, term, names = _by_term(codes, pa.array([_stem(t) for t in terms.to_pylist()], pa.string()) if stems else terms)
            own = doc[place]
            starts = _starts(term, own)
            ends = np.append(starts[1:], len(place))
            positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)).astype(np.int32)), pa.array(pos[place].astype(np.int32)))
            out = pa.RecordBatch.from_arrays([names.take(pa.array(term[starts])), ids.take(pa.array(own[starts])), pa.array(ends - starts), positions], ["term", "doc_id", "tf", "positions"])
            yield from (out.slice(i, ROWS_OUT) for i in range(0, len(out), ROWS_OUT))

    def rows(some: DataFrame) -> DataFrame:
        return some.select("doc_id", plain.terms(F.col(text_column)).alias("words")).mapInArrow(run, schema)

    if ids_differ or (sharing := _sharing(docs)) is None:
        return rows(docs)
    same = docs["doc_id"].eqNullSafe(sharing["__id"])
    met = rows(docs.join(sharing, same, "left_semi")).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return rows(docs.join(sharing, same, "left_anti")).unionByName(met)


def terms_of(docs: DataFrame, text_column: str, analyzer: Analyzer, ids_differ: bool = False) -> DataFrame:
    """(term, df, cf, first_doc, first_pos, first_occurrence): counts by stretch of documents first, so a hot term is small."""
    stems = analyzer.stem
    found = replace(analyzer, stem=False).terms_with_tokens(F.col(text_column))
    # one text for both: no token holds a zero
    words = F.transform(found, lambda p: F.when(p["term"] == p["token"], p["term"]).otherwise(F.concat_ws("\0", p["term"], p["token"])))
    doc_id = docs.schema["doc_id"].dataType
    fields = [("term", T.StringType()), ("df", T.LongType()), ("cf", T.LongType()), ("first_doc", doc_id), ("first_pos", T.IntegerType()), ("first_occurrence", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch], by_doc: bool) -> Iterator[pa.RecordBatch]:
        for ids, codes, both, doc, pos in pieces(batches):
            pairs = [w.split("\0") for w in both.to_pylist()]
            tokens = pa.array([p[-1] for p in pairs], pa.string())
            place, term, names = _by_term(codes, pa.array([_stem(p[0]) if stems else p[0] for p in pairs], pa.string()))
            own = doc[place]
            of_doc = _starts(term, own)
            starts = of_doc if by_doc else _starts(term)
            df = np.diff(np.append(np.searchsorted(of_doc, starts), len(of_doc)))
            at = place[starts]
            out = [names.take(pa.array(term[starts])), pa.array(df), pa.array(np.diff(np.append(starts, len(place)))), ids.take(pa.array(own[starts])), pa.array(pos[at].astype(np.int32)), tokens.take(pa.array(codes[at]))]
            out = pa.RecordBatch.from_arrays(out, [name for name, _ in fields])
            yield from (out.slice(i, ROWS_OUT) for i in range(0, len(out), ROWS_OUT))

    def rows(some: DataFrame, by_doc: bool = False) -> DataFrame:
        return some.select("doc_id", words.alias("words")).mapInArrow(lambda batches: run(batches, by_doc), T.StructType([T.StructField(*f) for f in fields]))

    if ids_differ or (sharing := _sharing(docs)) is None:
        return merged_terms(rows(docs))
    same = docs["doc_id"].eqNullSafe(sharing["__id"])
    first = F.min(F.struct("first_pos", "first_occurrence")).alias("f")
    met = rows(docs.join(sharing, same, "left_semi"), True).groupBy("term", F.col("first_doc")).agg(F.lit(1).cast("long").alias("df"), F.sum("cf").alias("cf"), first)
    return merged_terms(rows(docs.join(sharing, same, "left_anti")).unionByName(met.select("term", "df", "cf", "first_doc", "f.*")))


def merged_terms(parts: DataFrame) -> DataFrame:
    """One row a term from the terms of several batches."""
    first = F.min(F.struct("first_doc", "first_pos", "first_occurrence")).alias("f")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), first).select("term", "df", "cf", "f.*")


def value_postings(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Postings of the terms field:value of facet fields (arrays), without positions that text could meet."""
    rows = None
    for name in fields:
        own = docs.select("doc_id", F.explode(name).alias("v")).select("doc_id", value_term(name, F.col("v")).alias("term"))
        own = own.groupBy("term", "doc_id").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", F.array().cast("array<int>").alias("positions"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def number_rows(rows: DataFrame, key: str, first: int) -> DataFrame:
    """rows with doc_id = first, first + 1, ... in an order of hash buckets: counts a bucket give each its offset."""
    bucket = F.pmod(F.xxhash64(key), F.lit(ID_BUCKETS)).cast("int")
    placed = rows.withColumn("__bucket", bucket)
    counts = {r[0]: r[1] for r in placed.groupBy("__bucket").count().collect()}  # ID_BUCKETS rows at most
    offsets, total = [], first
    for b in range(ID_BUCKETS):
        offsets.append(total)
        total += counts.get(b, 0)
    order = Window.partitionBy("__bucket").orderBy(key)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("__bucket") + 1)
    return placed.withColumn("doc_id", base + F.row_number().over(order) - 1).drop("__bucket")


class Snapshot:
    """The batches of some commits, all tables of the same ones."""

    def __init__(self, index: Index, commits: list):
        self.spark, self.root, self.analyzer, self.live = index.spark, index.root, index.analyzer, commits

    def snapshot(self) -> Snapshot:
        return self

    def table(self, name: str) -> DataFrame:
        if not self.live:
            raise IndexStateError("the index is empty")
        return self.spark.read.parquet(*[f"{self.root}/{name}/{r.batch}" for r in self.live])

    @property
    def docs(self) -> DataFrame:
        return self.table("docs")

    @property
    def postings(self) -> DataFrame:
        return self.table("postings")

    @property
    def terms(self) -> DataFrame:
        return merged_terms(self.table("terms"))

    def number_of_docs(self) -> int:
        return sum(r.n_docs for r in self.live)

    def frequencies(self, words: list[str]) -> dict[str, int]:
        """Document frequencies of the given terms (a row each)."""
        if not words:
            return {}
        rows = self.table("terms").where(F.col("term").isin(*words)).groupBy("term").agg(F.sum("df").alias("df")).collect()
        return {r.term: r.df for r in rows}


class Index:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, facets: Sequence[str] = ("authors", "subject"), text_fields: Sequence[str] = ("title", "authors", "abstract", "subject", "body"), analyzer: Analyzer | None = None, dimension: int | None = None, wait_seconds: float = 600, stale_seconds: float = 6 * 3600):
        self.spark, self.root = spark, root.rstrip("/")
        self.wait_seconds, self.stale_seconds = wait_seconds, stale_seconds
        self.facets, self.text_fields = tuple(facets), tuple(text_fields)
        self.analyzer, self.dimension = analyzer or Analyzer(), dimension

    # what is there

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def commits(self) -> list:
        """Records of the batches that are in force, oldest first."""
        if not self._exists(f"{self.root}/commits"):
            return []
        rows = self.spark.read.schema(COMMIT).json(f"{self.root}/commits").orderBy("seq", "batch").collect()
        gone = {b for r in rows for b in r.replaces or []}
        return [r for r in rows if r.batch not in gone]

    def batches(self) -> list[str]:
        return [r.batch for r in self.commits()]

    def snapshot(self) -> Snapshot:
        """The index as it is now: what reads it sees neither later commits nor compaction."""
        return Snapshot(self, self.commits())

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    @property
    def docs(self) -> DataFrame:
        return self.snapshot().docs

    @property
    def postings(self) -> DataFrame:
        return self.snapshot().postings

    @property
    def terms(self) -> DataFrame:
        return self.snapshot().terms

    def number_of_docs(self) -> int:
        return self.snapshot().number_of_docs()

    def frequencies(self, words: list[str]) -> dict[str, int]:
        return self.snapshot().frequencies(words)

    def get(self, ext_id: str, fields: Sequence[str] = ()) -> DataFrame:
        """The document of an external id; only the named fields that there are."""
        docs = self.docs.where(F.col("ext_id") == ext_id)
        return docs.select("ext_id", *[f for f in fields if f in docs.columns]) if fields else docs

    # writing

    @contextlib.contextmanager
    def _writing(self) -> Iterator[None]:
        """One writer at a time: a file that only one can create. One left by a writer that died goes after `stale_seconds`."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/writer")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        until = time.time() + self.wait_seconds
        while not fs.createNewFile(path):
            with contextlib.suppress(Py4JJavaError):  # it may go meanwhile
                if time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > self.stale_seconds:
                    fs.delete(path, False)
                    continue
            if time.time() > until:
                raise IndexStateError("another writer is at work")
            time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(path, False)

    def add(self, docs: DataFrame, id_column: str = "id") -> tuple[int, DataFrame]:
        """Appends documents; returns how many were new, and the others as (ext_id, reason). Ids that are there already stay as
        they are; of equal ids in docs the first row is kept; vectors of another length than the first
        are refused; null ids are refused."""
        with self._writing():
            return self._add(docs, id_column)

    def _add(self, docs: DataFrame, id_column: str = "id") -> tuple[int, DataFrame]:
        commits = self.commits()
        fields = [c for c in docs.columns if c != id_column]
        staged_path = f"{self.root}/staging/{uuid.uuid4().hex}"
        docs.select(F.col(id_column).cast("string").alias("ext_id"), *fields, F.monotonically_increasing_id().alias("__at")).write.parquet(staged_path)
        staged = self.spark.read.parquet(staged_path)
        reason = F.when(F.col("ext_id").isNull(), F.lit("no id"))
        if self.dimension and "vector" in fields:
            reason = reason.when(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") != self.dimension), F.lit("vector of wrong length"))
        # rows without an id don't meet in one task
        order = Window.partitionBy("ext_id", F.when(F.col("ext_id").isNull(), F.col("__at"))).orderBy("__at")
        marked = staged.withColumn("__n", F.row_number().over(order)).withColumn("__reason", reason.when(F.col("__n") > 1, F.lit("repeated in this batch")))
        if commits:
            known = self.docs.select("ext_id", F.lit(True).alias("__known"))
            marked = marked.join(known, "ext_id", "left").withColumn("__reason", F.coalesce("__reason", F.when(F.col("__known"), F.lit("already there")))).drop("__known")
        failures = marked.where("__reason is not null").select("ext_id", F.col("__reason").alias("reason"))
        fresh = number_rows(marked.where("__reason is null").drop("__n", "__reason", "__at"), "ext_id", max((r.first_id + r.n_docs for r in commits), default=1))
        first = max((r.first_id + r.n_docs for r in commits), default=1)
        batch = uuid.uuid4().hex
        fresh.select("doc_id", "ext_id", *fields).write.parquet(f"{self.root}/docs/{batch}")
        written = self.spark.read.parquet(f"{self.root}/docs/{batch}")
        n = written.count()
        self._write_terms(written, batch)
        self._commit(batch, first, n, [], max((r.seq for r in commits), default=0) + 1)
        return n, failures

    def _text(self, docs: DataFrame) -> DataFrame:
        parts = [F.array_join(F.coalesce(f, F.array().cast("array<string>")), " ") if dict(docs.dtypes)[f].startswith("array") else F.col(f) for f in self.text_fields if f in docs.columns]
        return docs.withColumn("__text", document_text(*parts))

    def _write_terms(self, docs: DataFrame, batch: str) -> None:
        text = self._text(docs).select("doc_id", "__text")
        # numbers of documents differ
        postings, terms = postings_of(text, "__text", self.analyzer, True), terms_of(text, "__text", self.analyzer, True)
        if facets := [f for f in self.facets if f in docs.columns]:
            values = value_postings(docs, facets)
            postings = postings.unionByName(values.sortWithinPartitions("term", "doc_id"))
            own = values.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("doc_id").alias("first_doc"))
            terms = terms.unionByName(own.select("term", "df", "cf", "first_doc", F.lit(0).alias("first_pos"), F.col("term").alias("first_occurrence")))
        postings.write.parquet(f"{self.root}/postings/{batch}")
        terms.sortWithinPartitions("term").write.parquet(f"{self.root}/terms/{batch}")

    def _commit(self, batch: str, first: int, n: int, replaces: list[str], seq: int) -> None:
        self.spark.createDataFrame([(batch, seq, first, n, replaces)], COMMIT).coalesce(1).write.mode("append").json(f"{self.root}/commits")

    def compact(self, target: int = 1) -> tuple[int, int]:
        """Joins the smallest adjacent pairs of batches until `target` are left; returns their number before and after."""
        with self._writing():
            before = len(self.batches())
            while len(live := self.commits()) > max(1, target):
                pairs = [(live[i].n_docs + live[i + 1].n_docs, i) for i in range(len(live) - 1)]
                i = min(pairs)[1]
                self._join(live[i], live[i + 1])
            return before, len(self.batches())

    def vacuum(self) -> list[str]:
        """Deletes the tables of batches that compaction has replaced, and what appends have staged; returns the batches. No
        reader of an earlier snapshot, no append and no frame of refused documents may be in use."""
        if not self._exists(f"{self.root}/commits"):
            return []
        rows = self.spark.read.schema(COMMIT).json(f"{self.root}/commits").collect()
        gone = sorted({b for r in rows for b in r.replaces or []})
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [*(f"{self.root}/{name}/{b}" for b in gone for name in ("docs", "postings", "terms")), f"{self.root}/staging"]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        return gone

    def _join(self, a, b) -> None:
        batch = uuid.uuid4().hex
        try:
            read = lambda name: self.spark.read.parquet(f"{self.root}/{name}/{a.batch}", f"{self.root}/{name}/{b.batch}")
            read("docs").write.parquet(f"{self.root}/docs/{batch}")
            read("postings").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{self.root}/postings/{batch}")
            merged_terms(read("terms")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.root}/terms/{batch}")
        except Exception as e:
            raise MergeError(f"batches {a.batch} and {b.batch}") from e
        self._commit(batch, min(a.first_id, b.first_id), a.n_docs + b.n_docs, [a.batch, b.batch], a.seq)
