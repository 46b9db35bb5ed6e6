"""The pipeline against plain versions of its stages."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_operators import EDGES, SECRETS, check_pieces, edges, plain_classes, plain_spans, texts

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept or texts(spark)
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        kept = {r.doc_id: r.text for r in docs.collect()}
        assert set(kept) <= set(before)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert all(d in kept for d in before if labels.get(d) == 1)
            assert any(d not in kept for d in before)
        elif name == "near_dedup":
            assert set(kept) == {c for _, c in plain_classes(before.items())}
        elif name == "decontamination":
            words = lambda t: " ".join(re.findall(r"[^\W\d_]+|\d+", t.lower()))
            items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(kept) == {d for d, t in before.items() if not any(f" {i} " in f" {words(t)} " for i in items)}
        elif name == "secrets":
            assert set(kept) == set(before)
            assert all((kept[d] == t) == (not plain_spans(t, SECRETS)) for d, t in before.items())
            assert not any(plain_spans(t, SECRETS) for t in kept.values())
            assert all(r.n_chars == len(kept[r.doc_id]) for r in docs.collect())
    import public_tokenizers

    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), list(kept.items()), public_tokenizers.path("word_bpe_49k.json"))


def test_quality_stage(spark):
    where = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{where}/documents.parquet"), where).select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    assert all(d in kept for d, x in labels.items() if x == 1)
    assert sum(d in kept for d, x in labels.items() if x == 0) <= 0.2 * sum(x == 0 for x in labels.values())


def test_edges(spark):
    docs = edges(spark)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = corpus_pipeline.cut(out, "test")
    assert docs.where("text = ''").count() == 2
    assert docs.where(F.col("spans") != "clash").count() == 0
    assert docs.count() <= len(EDGES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
