"""Scalar functions (genre parsing cases from the reference's dataset tests)."""

import pytest
from pyspark.sql import functions as F

from rankfold import functions as fn


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("Action|Comedy", ["Action", "Comedy"]),
        (" Action | Comedy ", ["Action", "Comedy"]),
        ("(no genres listed)", []),
        ("Action||Drama", ["Action", "Drama"]),
        (None, []),
        ("Drama", ["Drama"]),
    ],
)
def test_parse_genres(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "g string")
    assert df.select(fn.parse_genres("g").alias("x")).first().x == expected


def test_movie_year_and_score(spark):
    df = spark.createDataFrame([("Toy Story (1995)", 0.0), ("No year", float("-inf"))], "t string, s double")
    rows = df.select(fn.movie_year("t").alias("y"), fn.sigmoid_score("s").alias("p")).collect()
    assert rows[0].y == 1995 and rows[1].y is None
    assert rows[0].p == 0.5 and rows[1].p == 0.0


def test_f1_and_validation(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0), (0.5, 0.5, 10), (0.2, 0.4, 501)], "p double, r double, k int")
    rows = df.select(fn.safe_f1("p", "r").alias("f"), fn.valid_top_k("k").alias("v")).collect()
    assert rows[0].f == 0.0 and rows[1].f == pytest.approx(0.5) and rows[2].f == pytest.approx(2 * 0.2 * 0.4 / 0.6)
    assert [r.v for r in rows] == [False, True, False]


def test_title_search(spark):
    df = spark.createDataFrame([("Big Widget (1990)",), (None,), ("gear",)], "t string")
    assert [r.m for r in df.select(fn.title_contains("t", "WIDGET").alias("m")).collect()] == [True, False, False]
