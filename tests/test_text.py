import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import stats, text
from scriptorium.functions.porter import stem
from scriptorium.functions.text import Analyzer


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("word", "expected"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conformabli", "conform"), ("vietnamization", "vietnam"), ("electrical", "electr"), ("adjustable", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("is", "is")],
)
def test_porter(word, expected):
    assert stem(word) == expected


def test_tokens_as_python_has_them(spark):
    for value in ["Hello, wörld! x_y 12.5", "  edge ", "", "日本 語a-b"]:
        assert one(spark, value, text.tokenize) == re.split(r"\W+", value)


def test_analyzer(spark):
    x = Analyzer(frozenset({"the"}), stem=True)
    assert one(spark, "The Runners, running " + "z" * 26, x.terms) == ["runner", "run"]
    assert [tuple(r) for r in one(spark, "The Runners running", x.terms_with_tokens)] == [("runner", "Runners"), ("run", "running")]
    assert x.term("The") is None
    assert x.term("Running") == "run"


def test_cleaning(spark):
    assert one(spark, "Hello, wörld 12 a1b2c3d mailto:x@y.z http://q.r/1 ab figure.", text.clean_body) == " Hello wrld abcd x@y.z http://q.r/1 figure"
    assert one(spark, "exam- ple", text.clean_body) == " example"
    assert one(spark, "A (b (c) d), E and F,  and ", text.authors) == ["A", "E", "F"]
    assert one(spark, "A (b, C", text.authors) == ["A (b", "C"]
    assert one(spark, "a.b..c. ", text.sentences) == ["a", "b", "c", " "]
    assert one(spark, "X (cs.AI); Y (math.CO)", text.codes_in_parentheses) == ["cs.AI", "math.CO"]
    assert one(spark, "Title:\nSome title\n", lambda c: text.metadata_value(c, "Title:")) == "Some title"
    assert one(spark, "a b c d", lambda c: text.ngrams(F.split(c, " "), 3)) == ["a b c", "b c d"]
    assert one(spark, "a b", lambda c: text.ngrams(F.split(c, " "), 3)) == []
    assert one(spark, "theory", lambda c: text.highlight(c, "the")) == "the<b>ory</b>"


def test_map_codes(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "b")], "id int, codes string")
    lookup = spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "code string, name string")
    found = {r.id: r.names for r in text.map_codes(rows, "id", text.split_codes(F.col("codes")), lookup).collect()}
    assert found == {1: ["Alpha", "Beta"], 2: ["Beta"]}
    with pytest.raises(KeyError):
        text.map_codes(rows, "id", text.split_codes(F.lit("z")), lookup)


def test_rows_without_codes(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, ""), (3, None), (4, "z b")], "id int, codes string")
    lookup = spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "code string, name string")
    found = text.map_codes(rows, "id", text.split_codes(F.col("codes")), lookup, strict=False).collect()
    assert sorted((r.id, r.names) for r in found) == [(1, ["Alpha"]), (1, ["Beta"]), (2, []), (3, []), (4, ["Beta"])]


def test_deep_parentheses(spark):
    deep = "a" + "(" * 40 + "x" + ")" * 40 + "b ((c) d"
    assert one(spark, deep, text.without_parentheses) == "ab ( d"
    assert one(spark, ") a (b) (", text.without_parentheses) == ") a  ("


def test_dates(spark):
    long = spark.range(1).select(text.paper_id(F.to_date(F.lit("2024-03-01")), F.lit(123456)).alias("p")).first()
    assert long.p == "2403.123456"
    row = spark.range(1).select(text.paper_id(F.to_date(F.lit("2021-03-01")), F.lit(42)).alias("p")).first()
    assert row.p == "2103.00042"
    year, month = text.id_year_month(F.lit("arXiv:2103.00042"))
    assert spark.range(1).select(text.age_in_years(year, month, 2022, 9).alias("a")).first().a == 2


def test_statistics(spark):
    cells = [F.lit(float(x)) for x in (10, 20, 30, 40)]
    row = spark.range(1).select(stats.chi_square(*cells).alias("c"), stats.mutual_information(*cells).alias("m")).first()
    assert row.c == pytest.approx(100 * (10 * 40 - 20 * 30) ** 2 / (40 * 30 * 60 * 70))
    assert row.m == pytest.approx(0.0058, abs=5e-4)
    assert spark.range(1).select(stats.mutual_information(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(8.0)).alias("m")).first().m == pytest.approx(0.7219, abs=1e-4)
