"""From documents to packed sequences: five stages, each of one operator, each over all that the one before it kept.

1. quality: documents that the classifier scores below 0.3 go.
2. near_dedup: of each class of near duplicates the document of the least doc_id stays.
3. decontamination: documents that hold a benchmark item, also with other numbers, names or units, go.
4. secrets: each secret in a text is replaced by a mark of its kind; the documents stay.
5. packing: token sequences along a space-filling curve.

Null texts are empty ones from stage 4 on; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontamination, near_dedup, packing, quality, secrets
from scriptorium.llm.common import cut, read_table

LEAST_QUALITY = 0.3

#: SQL can express neither the classifier nor the classes of near duplicates; tests compare the stages with plain versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.withColumn("__score", quality.quality_score(F.col("text"), model))
    return scored.where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.without_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is written in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
