import gzip

import pytest

from scriptorium.errors import StoreError
from scriptorium.sources import files
from scriptorium.streaming.ingest import ingest, read_stream
from scriptorium.operators.index import Index


def test_documents_and_vectors(spark, tmp_path):
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        f.write('{"id": "a", "title": "A", "abstract": "x", "authors": ["P"]}\n\n{"id": "b", "title": "B", "abstract": "y"}\n')
    good, bad = files.read_documents(spark, str(tmp_path / "d.json.gz"))
    assert bad.count() == 0
    assert [(r.id, r.authors) for r in good.orderBy("id").collect()] == [("a", ["P"]), ("b", None)]
    (tmp_path / "v.txt").write_text("a,[1.0, 2.0]\nb,[3.0, 4.0]\n")
    vectors = files.read_vectors(spark, str(tmp_path / "v.txt"))
    assert [(r.id, r.vector) for r in files.with_vectors(good, vectors).orderBy("id").collect()] == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    assert [(r.id, r.vector) for r in files.read_numbered_vectors(spark, str(tmp_path / "v.txt")).orderBy("id").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    (tmp_path / "w.txt").write_text("z,[1.0]\n")
    with pytest.raises(StoreError):
        files.with_vectors(good, files.read_vectors(spark, str(tmp_path / "w.txt")))
    (tmp_path / "x.txt").write_text("a;1\n")
    with pytest.raises(Exception, match="not a vector"):
        files.read_vectors(spark, str(tmp_path / "x.txt")).collect()


def test_other_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert files.read_json_array(spark, str(tmp_path / "a.json"), "x int").count() == 2
    (tmp_path / "q.txt").write_text('deep AND learning,12\n"a b"\n#2(a,b),3\n')
    assert {(r.query, r.expected_hits) for r in files.read_queries(spark, str(tmp_path / "q.txt")).collect()} == {("deep AND learning", 12), ('"a b"', None), ("#2(a,b)", 3)}
    (tmp_path / "p.pdf").write_bytes(b"%PDF text")
    assert [r.text for r in files.read_pdfs(spark, str(tmp_path / "p.pdf"), lambda b: b.decode()[5:]).collect()] == ["text"]
    out = str(tmp_path / "out")
    files.write_lines(spark.range(3), out)
    assert spark.read.json(out).count() == 3


def test_html_fields(spark):
    page = "<h1 class='title mathjax'><span>Title:</span> A\nB &amp; C</h1><div class=authors>Authors:<a>X</a>, <a>Y</a><br></div>"
    row = spark.createDataFrame([(page,), (None,)], "html string").select(files.html_fields(files.F.col("html")).alias("f")).collect()
    assert (row[0].f.title, row[0].f.authors, row[0].f.abstract) == ("A B & C", "X, Y", None)
    assert row[1].f.title is None


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"id": "a", "title": "A", "abstract": "x"}\n{"id": "b", "title": "B", "abstract": "y"}\n')
    index = Index(spark, str(tmp_path / "index"))
    run = lambda: ingest(index, read_stream(spark, str(source)), str(tmp_path / "ck")).awaitTermination()
    run()
    (source / "2.json").write_text('{"id": "b", "title": "again", "abstract": "x"}\n{"id": "c", "title": "C", "abstract": "y"}\n{"id": "d"}\n')
    run()
    assert {r.ext_id: r.title for r in index.docs.collect()} == {"a": "A", "b": "B", "c": "C"}
