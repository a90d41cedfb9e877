"""Rules, summaries and comparisons of runs, on rows worked out by hand."""

import pytest

from siltstone.operators import runs as R

ITEMS = "item_id string, type string, max_points double, question_hash string, selected boolean"
ROWS = "variant string, item_id string, type string, max_points double, question_hash string, status string, points double, seconds double, calls double, prediction string, error_type string, finish array<string>, usage array<struct<prompt:bigint,completion:bigint,total:bigint>>"


def items(spark, third=True):
    return spark.createDataFrame([("1", "choice", 1.0, "h1", True), ("2", "essay", 15.0, "h2", True), ("3", "image", 2.0, "h3", third)], ITEMS)


def row(item, kind, most, points, **other):
    base = {"variant": "direct", "item_id": item, "type": kind, "max_points": most, "question_hash": f"h{item}", "status": "ok", "points": points, "seconds": 1.0, "calls": 1.0}
    base |= {"prediction": '{"answer": "A"}', "error_type": None, "finish": ["stop"], "usage": [(10, 5, 15)]}
    return tuple((base | other).values())


GOOD = [row("1", "choice", 1.0, 1.0), row("2", "essay", 15.0, None), row("3", "image", 2.0, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_pending_points_widen_the_bounds(spark):
    got = R.summary(items(spark), frame(spark, GOOD), ["direct"], 5).first()
    assert (got["lower"], got["upper"], got["pending_points"], got["target_status"]) == (1, 18, 17, "grading_incomplete")
    assert got["run_complete"] and not got["grading_complete"] and got["all_selected"]


def test_what_did_not_run_may_still_give_points(spark):
    got = R.summary(items(spark, False), frame(spark, GOOD[:1]), ["direct"], 5).first()
    assert (got["missing"], got["excluded"], got["whole"], got["upper"], got["target_status"]) == (1, 1, 18, 16, "run_incomplete")
    flags = {(r["flag"], r["item_id"]) for r in R.flagged(items(spark, False), frame(spark, GOOD[:1]), ["direct"]).collect()}
    assert flags == {("missing", "2"), ("excluded", "3")}


@pytest.mark.parametrize(
    ("rule", "rows"),
    [
        ("duplicate", [GOOD[0], GOOD[0]]),
        ("unknown_item", [row("9", "choice", 1.0, 1.0)]),
        ("changed_question", [row("1", "choice", 1.0, 1.0, question_hash="other")]),
        ("points_above_max", [row("1", "choice", 1.0, 2.0)]),
        ("bad_points", [row("1", "choice", 1.0, float("nan"))]),
        ("bad_seconds", [row("1", "choice", 1.0, 1.0, seconds=-1.0)]),
        ("failed_with_points", [row("1", "choice", 1.0, 1.0, status="error")]),
        ("bad_calls", [row("1", "choice", 1.0, 1.0, calls=1.5)]),
        ("unknown_status", [row("1", "choice", 1.0, 0.0, status="odd")]),
        ("unknown_variant", [row("1", "choice", 1.0, 1.0, variant="other")]),
    ],
)
def test_rules_of_rows(spark, rule, rows):
    assert rule in {r["rule"] for r in R.row_problems(items(spark), frame(spark, rows), ["direct"]).collect()}
    assert R.row_problems(items(spark), frame(spark, GOOD), ["direct"]).count() == 0


def test_excluded_items_have_no_results(spark):
    assert {r["rule"] for r in R.row_problems(items(spark, False), frame(spark, GOOD), ["direct"]).collect()} == {"excluded_item"}


def test_failures_are_told_apart(spark):
    rows = [
        row("1", "choice", 1.0, 0.0, status="error", prediction=None, error_type="JSONDecodeError", finish=["length"], usage=[(20, 10, 30)]),
        row("2", "essay", 15.0, 0.0, status="error", prediction=None, error_type="Timeout", finish=[], usage=[(None, None, None)]),
        row("3", "image", 2.0, 0.0, status="over_budget", prediction='{"answer": ""}', usage=[]),
    ]
    got = R.summary(items(spark), frame(spark, rows), ["direct"], 5).first()
    assert (got["format_failure"], got["technical_failure"], got["over_budget"], got["truncated"], got["empty_answers"]) == (1, 1, 1, 1, 1)
    assert (got["total_tokens"], got["total_unknown"], got["target_status"]) == (30, 2, "invalid_submission_format")


def test_comparison(spark):
    all_graded = [row("1", "choice", 1.0, 1.0), row("2", "essay", 15.0, 9.0), row("3", "image", 2.0, 1.0)]
    now = frame(spark, [row("1", "choice", 1.0, 0.0), *GOOD[1:]])
    got = R.compared(items(spark), now, frame(spark, all_graded), {"direct": "direct"}).first()
    assert (got["common"], got["delta"], got["full_delta"]) == (1, -1, None)
    other = frame(spark, [row("1", "choice", 1.0, 1.0, variant="bm25"), row("2", "essay", 15.0, 10.0, variant="bm25"), row("3", "image", 2.0, 1.0, variant="bm25")])
    got = R.compared(items(spark), other, frame(spark, all_graded), {"bm25": "direct"}).first()
    assert (got["common"], got["full_delta"], got["previous_variant"]) == (3, 1, "direct")
    # An item that the later run doesn't have keeps the full difference from being given.
    assert R.compared(items(spark), frame(spark, all_graded[:2]), frame(spark, all_graded), {"direct": "direct"}).first()["full_delta"] is None
    with pytest.raises(ValueError):
        R.compared(items(spark), now, now, {"direct": "nowhere"})


def test_contracts(spark):
    schema = "lang string, exam string, keys string, rubric string, inputs string, max_points int"
    now = spark.createDataFrame([("a", "e", "k", "r", "i", 5), ("b", "e", "k", None, "i", 5), ("c", "e", "k", "r", "i", 5)], schema)
    before = spark.createDataFrame([("a", "e", "k", "r", "i", 5), ("b", "e", "k2", None, "i", 5)], schema)
    assert {tuple(r) for r in R.comparable(now, before, "lang").collect()} == {("a", "paired"), ("b", "incomparable"), ("c", "incomparable")}


def test_suite(spark):
    schema = "exam_id string, lower double, upper double, whole double, run_complete boolean, grading_complete boolean"
    assert R.suite_total(spark.createDataFrame([("p", 9.0, 9.0, 45.0, True, True)], schema)).first()["percent"] == 20
    got = R.suite_total(spark.createDataFrame([("p", 0.0, 45.0, 45.0, True, False)], schema)).first()
    assert (got["percent"], got["lower"], got["upper"], got["complete"]) == (None, 0, 45, False)
    papers = spark.createDataFrame([("p", 1, 45.0)], "exam_id string, items int, points double")
    report = ("p", "m", "h", "bm25", 1, 45.0, True, 0)
    schema = "exam_id string, model string, model_hash string, variant string, items int, whole double, all_selected boolean, essays int"

    def rules(*reports):
        return {r["rule"] for r in R.suite_problems(papers, spark.createDataFrame(list(reports), schema), "m", "h", "bm25", 45.0).collect()}

    assert rules(report) == set() and rules() == {"missing_report"} and rules(report, report) == {"duplicate_report"}
    assert rules(("p", "x", "h", "bm25", 1, 45.0, True, 0)) == {"wrong_model"} and rules(("p", "m", "h", "bm25", 1, 60.0, True, 1)) == {"wrong_denominator", "essay"}


def test_item_view_fills_missing_columns(spark):
    got = R.item_view(frame(spark, GOOD).drop("error_type", "calls")).first()
    assert len(got) == 9 and got["calls"] is None and got["points"] == 1
