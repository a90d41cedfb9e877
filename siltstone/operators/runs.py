"""Runs of a system over pinned items: rules of result rows, summaries by variant, comparisons, suites.

Items have item_id, type, max_points, question_hash, selected.  Result rows have variant, item_id, type,
max_points, question_hash, status, points (null: grading is pending), seconds, calls, prediction (JSON, or
null), error_type, finish (why each generation ended) and usage (token counts of each call).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import violation
from .quality import reasons_of

# What a result may be.
STATUSES = ("ok", "error", "over_budget", "abstained")
TOKEN_FIELDS = ("prompt", "completion", "total")


def not_a_count(x: Column) -> Column:
    """Null, negative or not finite."""
    x = x.cast("double")
    return F.coalesce(F.isnan(x) | (x < 0) | (x == float("inf")), F.lit(True))


def answer_type(prediction: Column) -> Column:
    """The JSON type of the field `answer`: STRING, BIGINT, ...; null if there is no such field, or no object."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(prediction), "$.answer", "variant"))


def format_failure(prediction: Column, finish: Column, error_type: Column, string_answer: bool = True) -> Column:
    """A prediction without an answer (of text, if so wanted), or none although the model spoke and JSON didn't parse.

    An empty answer has the right format.
    """
    kind = answer_type(prediction)
    bad = kind.isNull() if not string_answer else ~kind.eqNullSafe(F.lit("STRING"))
    return F.when(prediction.isNotNull(), bad).otherwise(F.coalesce((F.size(finish) > 0) & (error_type == "JSONDecodeError"), F.lit(False)))


def truncated(finish: Column) -> Column:
    return F.coalesce(F.exists(finish, lambda r: r == "length"), F.lit(False))


def row_problems(items: DataFrame, rows: DataFrame, variants: list[str]) -> DataFrame:
    """rule, entity_id, detail: every rule that a result row breaks."""
    spec = items.select("item_id", *[F.col(c).alias(f"_{c}") for c in ("type", "max_points", "question_hash", "selected")])
    known = rows.join(spec, "item_id", "left")
    c = F.col
    listed = c("_selected").isNotNull()
    changed = ~(c("type").eqNullSafe(c("_type")) & c("max_points").eqNullSafe(c("_max_points")) & c("question_hash").eqNullSafe(c("_question_hash")))
    rules = [
        ("unknown_variant", ~c("variant").isin(*variants)),
        ("unknown_item", ~listed),
        ("excluded_item", listed & ~c("_selected")),
        ("changed_question", listed & changed),
        ("unknown_status", ~c("status").isin(*STATUSES)),
        ("bad_points", c("points").isNotNull() & not_a_count(c("points"))),
        ("points_above_max", c("points") > c("_max_points")),
        ("failed_with_points", (c("status") != "ok") & ~c("points").eqNullSafe(F.lit(0))),
        ("bad_seconds", not_a_count(c("seconds"))),
        ("bad_calls", not_a_count(c("calls")) | (c("calls") != F.floor("calls"))),
    ]
    broken = known.select("variant", "item_id", F.explode(reasons_of(rules)).alias("rule"))
    found = broken.select("rule", F.col("item_id").cast("string").alias("entity_id"), F.col("variant").alias("detail"))
    again = rows.groupBy("variant", "item_id").agg(F.count("*").alias("n")).where("n > 1")
    return found.unionByName(violation(again, "duplicate", F.col("item_id"), F.col("variant")))


def _per_item(items: DataFrame, rows: DataFrame, variants: list[str], string_answer: bool) -> DataFrame:
    """A row for each variant and item, with the result where there is one, and flags."""
    wanted = items.select("item_id", "type", "selected", F.col("max_points").alias("most"), F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))
    r = rows.drop("type", "max_points").withColumn("ran", F.lit(True))
    both = wanted.join(r, ["variant", "item_id"], "left").withColumn("ran", F.coalesce("ran", F.lit(False)))
    bad = F.col("ran") & format_failure(F.col("prediction"), F.col("finish"), F.col("error_type"), string_answer)
    flags = {
        "missing": F.col("selected") & ~F.col("ran"),
        "excluded": ~F.col("selected"),
        "pending": F.col("ran") & F.col("points").isNull(),
        "abstained": F.col("status") == "abstained",
        "format_failure": bad,
        "technical_failure": (F.col("status") == "error") & ~bad,
        "over_budget": F.col("status") == "over_budget",
        "truncated": truncated(F.col("finish")),
    }
    return both.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


FLAGS = ("missing", "excluded", "pending", "abstained", "format_failure", "technical_failure", "over_budget", "truncated")


def flagged(items: DataFrame, rows: DataFrame, variants: list[str], string_answer: bool = True) -> DataFrame:
    """variant, flag, item_id: which items a summary counts under each flag, as rows and not as lists that grow."""
    each = _per_item(items, rows, variants, string_answer)
    return each.select("variant", "item_id", F.explode(reasons_of([(f, F.col(f)) for f in FLAGS])).alias("flag")).select("variant", "flag", "item_id")


def summary(items: DataFrame, rows: DataFrame, variants: list[str], target: float | None = None, string_answer: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """By variant (and by further columns of items): points with bounds, counts by flag, calls, tokens, seconds, status.

    Items that did not run may still give all their points, as may pending ones; excluded ones count in
    the whole only.
    """
    each = _per_item(items, rows, variants, string_answer)
    c, ran = F.col, F.col("ran")

    def points(when: Column, what: str):
        return F.coalesce(F.sum(F.when(when, c(what))), F.lit(0)).cast("double")

    calls = F.coalesce(F.sum("calls"), F.lit(0)).cast("long")
    uses = F.coalesce(F.sum(F.when(F.size("usage") > 0, F.size("usage"))), F.lit(0))
    tokens = []
    for field in TOKEN_FIELDS:
        known = F.filter(F.transform(F.coalesce("usage", F.array()), lambda u: u[field]), lambda x: x.isNotNull())
        reported = F.sum(F.when(ran, F.size(known)).otherwise(0))
        total = F.sum(F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + x)))
        tokens += [total.alias(f"{field}_tokens"), (F.greatest(calls, uses) - reported).cast("long").alias(f"{field}_unknown")]
    kind = answer_type(c("prediction"))
    text = F.get_json_object("prediction", "$.answer")
    out = each.groupBy("variant", *by).agg(
        F.count("*").alias("items"),
        F.count_if("selected").alias("selected"),
        F.count_if("ran").alias("processed"),
        F.count_if(kind.isNotNull() & (text != "")).alias("answered"),
        F.count_if((kind == "STRING") & (text == "")).alias("empty_answers"),
        *[F.count_if(f).alias(f) for f in FLAGS],
        points(ran, "points").alias("lower"),
        points(c("pending"), "most").alias("pending_points"),
        points(c("missing"), "most").alias("missing_points"),
        points(c("excluded"), "most").alias("excluded_points"),
        F.sum("most").cast("double").alias("whole"),
        calls.alias("calls"),
        *tokens,
        F.round(F.sum("seconds"), 6).alias("seconds"),
    )
    out = out.withColumn("upper", c("lower") + c("pending_points") + c("missing_points"))
    goal = F.lit(target).cast("double")
    status = F.when(goal.isNull(), "target_not_specified").when(c("missing") > 0, "run_incomplete").when(c("pending") > 0, "grading_incomplete")
    status = status.when(c("format_failure") > 0, "invalid_submission_format").when(c("lower") >= goal, "reached_provisionally").otherwise("below_target")
    return out.withColumns({"run_complete": c("missing") == 0, "grading_complete": c("pending") == 0, "all_selected": c("excluded") == 0, "target_status": status})


#: What two runs must have in common, else their points say nothing about each other.
CONTRACT = ("exam", "keys", "rubric", "inputs", "max_points")


def comparable(now: DataFrame, before: DataFrame, on: str) -> DataFrame:
    """on, status: paired if all of CONTRACT is equal, incomparable if not, or if the earlier run is unknown."""
    old = before.select(on, *[F.col(c).alias(f"_{c}") for c in CONTRACT], F.lit(True).alias("_known"))
    same = F.coalesce(F.col("_known"), F.lit(False))
    for c in CONTRACT:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return now.join(old, on, "left").select(on, F.when(same, "paired").otherwise("incomparable").alias("status"))


def compared(items: DataFrame, now: DataFrame, before: DataFrame, variants: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """By variant of the later run, which the map pairs with one of the earlier: common graded items, and differences.

    The full difference is given only if both runs cover all items and all are graded.  A map to a
    variant that the earlier run doesn't have is an error.
    """
    asked = before.sparkSession.createDataFrame([(v,) for v in sorted(set(variants.values()))], "variant string")
    if wrong := sorted(r[0] for r in asked.join(before.select("variant").distinct(), "variant", "left_anti").collect()):  # as many names as the map has at most
        raise ValueError(f"no such earlier variants: {wrong}")
    pairs = F.element_at(F.create_map(*[F.lit(x) for pair in variants.items() for x in pair]), F.col("variant"))
    wanted = items.select("item_id", *by, "selected", F.col("max_points").alias("most"), F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant")).withColumn("previous_variant", pairs)
    new = now.select("variant", "item_id", F.col("points").alias("new"))
    old = before.select(F.col("variant").alias("previous_variant"), "item_id", F.col("points").alias("old"))
    both = wanted.join(new, ["variant", "item_id"], "left").join(old, ["previous_variant", "item_id"], "left")
    graded = F.col("new").isNotNull() & F.col("old").isNotNull()
    delta = F.sum(F.when(graded, F.col("new") - F.col("old")))
    return both.groupBy("variant", "previous_variant", *by).agg(
        F.count_if(graded).alias("common"),
        F.coalesce(F.sum(F.when(graded, F.col("most"))), F.lit(0)).cast("double").alias("common_max"),
        F.coalesce(delta, F.lit(0)).cast("double").alias("delta"),
        F.when(F.bool_and(graded & F.col("selected")), delta).cast("double").alias("full_delta"),
    )


def suite_problems(papers: DataFrame, reports: DataFrame, model: str, model_hash: str, variant: str, points: float) -> DataFrame:
    """rule, entity_id, detail: what keeps reports from being one suite.

    papers: exam_id, items, points.  reports: exam_id, model, model_hash, variant, items, whole,
    all_selected, essays.
    """
    c = F.col
    has = papers.select("exam_id", c("items").alias("_items"), c("points").alias("_points"))
    both = has.join(reports, "exam_id", "full_outer")
    found, expected = c("model").isNotNull(), c("_items").isNotNull()
    rules = [
        ("missing_report", expected & ~found),
        ("unknown_paper", found & ~expected),
        ("wrong_model", found & ((c("model") != model) | ~c("model_hash").eqNullSafe(F.lit(model_hash)))),
        ("wrong_variant", found & ~c("variant").eqNullSafe(F.lit(variant))),
        ("wrong_denominator", expected & ((c("_points") != points) | (found & ((c("whole") != c("_points")) | (c("items") != c("_items")))))),
        ("partial_selection", found & ~c("all_selected")),
        ("essay", found & (c("essays") > 0)),
    ]
    broken = both.select("exam_id", "variant", F.explode(reasons_of(rules)).alias("rule")).select("rule", c("exam_id").cast("string").alias("entity_id"), c("variant").alias("detail"))
    again = reports.groupBy("exam_id").agg(F.count("*").alias("n")).where("n > 1")
    return broken.unionByName(violation(again, "duplicate_report", c("exam_id"), c("n")))


def suite_total(reports: DataFrame) -> DataFrame:
    """One row: points, bounds, and a percentage only if every paper ran and is graded."""
    done = F.bool_and(F.col("run_complete") & F.col("grading_complete"))
    sums = [F.sum(c).cast("double").alias(c) for c in ("lower", "upper", "whole")]
    return reports.agg(F.count("*").alias("papers"), *sums, done.alias("complete"), F.when(done, F.round(F.sum("lower") * 100.0 / F.sum("whole"), 4)).alias("percent"))


def item_view(rows: DataFrame) -> DataFrame:
    """The nine columns of a report's item, null where a row has none."""
    wanted = ("variant", "item_id", "type", "points", "max_points", "status", "seconds", "calls", "error_type")
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in wanted])
