"""Files: documents, vectors, taxonomies, query logs, and what to do with bad lines."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import StoreError



def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
DOCUMENT = _schema(id=_TEXT, title=_TEXT, authors=_TEXTS, abstract=_TEXT, subject=_TEXTS, body=_TEXT, vector=T.ArrayType(T.FloatType()))
CRAWLED = _schema(id=_TEXT, date=_TEXT, title=_TEXT, authors=_TEXT, abstract=_TEXT, subject=_TEXT, body=_TEXT)
CATEGORY = _schema(code=_TEXT, name=_TEXT, in_archive=_TEXT, is_active=T.BooleanType(), is_general=T.BooleanType(), description=_TEXT)


def read_documents(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """Documents of newline-delimited JSON (plain or gzip), and the lines that are none as (line, reason).

    A document needs an id, a title and an abstract; other fields may be missing, and unknown ones are ignored."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    # Spark reads only lines that are parsed whole when the corrupt column alone is asked for, so parse from text
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    reason = F.when(F.col("d._corrupt").isNotNull() | F.col("d").isNull(), F.lit("not a JSON object of documents"))
    for name in ("id", "title", "abstract"):
        if name in schema.names:
            reason = reason.when(F.col(f"d.{name}").isNull(), F.lit(f"no {name}"))
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select(*[F.col(f"d.{n}").alias(n) for n in schema.names])
    return good, rows.where("reason is not null").select(F.col("value").alias("line"), "reason")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of lines id,[v1,v2,...]; a line that is none is an error when it is read."""
    parts = F.split("value", ",", 2)
    parsed = F.from_json(F.get(parts, F.lit(1)), "array<float>")
    ok = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("not a vector: "), F.substring("value", 1, 80)))).otherwise(parsed)
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("id"), ok.alias("vector"))


def read_numbered_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of such lines in file order, ids being the rows' numbers from 0."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("at"), F.from_json(F.get(F.split("value", ",", 2), F.lit(1)), "array<float>").alias("vector"))
    part = F.shiftright("at", 33)
    counts = {r[0]: r[1] for r in rows.groupBy(part.alias("p")).count().collect()}  # one row a file split
    total, offsets = 0, []
    for p in sorted(counts):
        offsets += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += counts[p]
    if not offsets:
        return rows.select(F.col("at").alias("id"), "vector")
    number = F.create_map(*offsets)[part] + F.row_number().over(Window.partitionBy(part).orderBy("at")) - 1
    return rows.select(number.alias("id"), "vector")


def with_vectors(docs: DataFrame, vectors: DataFrame, strict: bool = True) -> DataFrame:
    """docs joined with their vectors by id; documents without one stay without if not strict. Vectors of no document are an error."""
    if vectors.join(docs, "id", "left_anti").limit(1).collect():
        raise StoreError("a vector has no document")
    return docs.drop("vector").join(vectors, "id", "inner" if strict else "left")


def write_lines(rows: DataFrame, path: str, compression: str | None = None) -> None:
    rows.write.json(path, compression=compression)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected_hits) of a query log, expected_hits null where a line has none."""
    hits = F.regexp_extract("value", r",(\d+)\s*$", 1)
    return spark.read.text(path).where(F.trim("value") != "").select(F.regexp_replace("value", r",\d+\s*$", "").alias("query"), F.when(hits != "", hits.cast("long")).alias("expected_hits"))


#: What a crawled page's elements of these classes are, and the label at their beginning.
PAGE_FIELDS = {"dateline": ("date", ""), "title": ("title", "Title:"), "authors": ("authors", "Authors:"), "abstract": ("abstract", "Abstract:"), "subjects": ("subject", "")}


class _ByClass(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, wanted: frozenset):
        super().__init__()
        self.wanted, self.open, self.found = wanted, [], {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            return
        names = (dict(attrs).get("class") or "").split()
        self.open.append((tag, [n for n in names if n in self.wanted and n not in self.found]))
        for n in self.open[-1][1]:
            self.found[n] = []

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        for _, names in self.open:
            for n in names:
                self.found[n].append(data)


def page_fields(page: str | None, classes: tuple[str, ...]) -> list[str | None]:
    """The text of the first element of each class in a page, without its label; None where there is none."""
    parser = _ByClass(frozenset(classes))
    parser.feed(page or "")
    parser.close()
    row = []
    for c in classes:
        text = "".join(parser.found[c]) if c in parser.found else None
        label = PAGE_FIELDS.get(c, ("", ""))[1]
        row.append(text.replace(label, "").replace("\n", " ").strip() if text is not None else None)
    return row


def html_fields(html: Column, classes: tuple[str, ...] = tuple(PAGE_FIELDS)) -> Column:
    """struct of the text of the first element of each class; null where a page has none. Names: those of PAGE_FIELDS, or the class."""
    names = [PAGE_FIELDS[c][0] if c in PAGE_FIELDS else c for c in classes]

    @F.pandas_udf(", ".join(f"`{n}` string" for n in names))
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_fields(page, classes) for page in pages], columns=names, dtype="object")

    return run(html)


def dealt(rows: DataFrame) -> DataFrame:
    """rows in two tasks a core at least, for costly work on each: a small file is read by one task, however many rows it has."""
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def html_title(html: Column) -> Column:
    """The text of the title element by built-in functions: references of the five basic characters decoded."""
    text = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def read_pdfs(spark: SparkSession, path: str, parse: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of binary files by a parser of your own; a file that it can't parse has a null text."""

    @F.pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        def one(content: bytes) -> str | None:
            try:
                return parse(bytes(content))
            except Exception:
                return None

        return contents.map(one)

    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("text"))
