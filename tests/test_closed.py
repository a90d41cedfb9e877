"""Closed answers on values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import closed as C


def one(spark, value, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)).select(value.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("form", "answer", "want"),
    [
        ("1: P\n2: F\n3: P", "3) fałsz\n1. Prawda\n2 – f", "1: P\n2: F\n3: F"),
        ("1: P\n2: F", "P F P", "1: P\n2: F"),
        ("1: P\n2: F", "**1: F**\n1: P", "1: F\n2: ?"),
        ("1: A\nb: 7", "1. C, because\nb- 12;", "1: C\nb: 12"),
        ("1: A\nb: 7", "P F", "1: ?\nb: ?"),
        ("B", "It is C, then A", "C"),
        ("B", "none", "n"),
        ("free", "  `as` it is ", "as it is"),
        ("1: P", None, "1: ?"),
        ("a.c: P", "1: P", "1: P"),
    ],
)
def test_coercion(spark, form, answer, want):
    assert one(spark, C.coerced(F.col("a"), F.col("f")), a=answer, f=form) == want


def test_neutral_form_shows_no_value(spark):
    assert one(spark, C.neutral(F.col("f")), f="1: P\n2: C\n3: 17\n4: word") == "1: P/F\n2: letter\n3: number\n4: word"
    assert one(spark, C.neutral(F.col("f")), f="D") == "letter" and one(spark, C.neutral(F.col("f")), f="a text") == "a text"


@pytest.mark.parametrize(
    ("votes", "want"),
    [
        (["1: P", "1: F", "1: P"], "1: P"),
        (["1: F", "1: P"], "1: F"),
        (["2: A\n1: B", "1) B\n2) C", "2. C\n1: D"], "2: C\n1: B"),
        (["x", "1: A"], "1: A"),
        (["x", "x", "1: A"], "x"),
        (["", "y", "y"], "y"),
    ],
)
def test_votes(spark, votes, want):
    rows = spark.createDataFrame([(7, i, v) for i, v in enumerate(votes)], "item_id int, pos int, answer string")
    assert [tuple(r) for r in C.voted(rows).collect()] == [(7, want)]


def test_rotations_cancel_the_place(spark):
    shown = C.orders(spark.createDataFrame([(1, ["x", "y", "z"]), (2, [])], "item_id int, options array<string>"), both_ways=True).collect()
    assert [r["options"] for r in sorted(shown, key=lambda r: (r["shift"], r["backwards"]))] == [["x", "y", "z"], ["z", "y", "x"], ["y", "z", "x"], ["x", "z", "y"], ["z", "x", "y"], ["y", "x", "z"]]
    replies = spark.createDataFrame([(1, ["x", "y", "z"], "B"), (1, ["y", "z", "x"], "<think>C</think>A."), (1, ["z", "x", "y"], "A"), (1, ["z", "x", "y"], "H")], "item_id int, options array<string>, reply string")
    scores = spark.createDataFrame([(1, "x", 9.0), (1, "y", 1.0), (1, "z", 1.0), (2, "u", 1.0), (2, "t", 1.0)], "item_id int, option string, score double")
    assert {tuple(r) for r in C.rotation_winner(replies, scores).collect()} == {(1, "y", 2), (2, "t", 0)}


def test_labelled_points(spark):
    table = F.create_map(F.lit("0"), F.lit(0), F.lit("1"), F.lit(0), F.lit("2"), F.lit(1), F.lit("3"), F.lit(2))

    def points(answer):
        return one(spark, C.labelled_points(F.col("a"), F.array(*map(F.lit, "123")), F.array(*map(F.lit, "PFP")), table), a=answer)

    assert [points("1: P\n2: F\n3: P"), points("1: P\n2: F"), points("1: F\n1: P\n2: F"), points("1: P\n1: F\n2: F"), points(None)] == [2, 1, 1, 0, 0]
