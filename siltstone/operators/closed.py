"""Closed answers: coercion to the form that was asked for, votes by line, rotations, points from keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The forms of labelled lines in answer formats, in answers, in votes and in keyed answers.
FORMAT_LINE = r"^([0-9A-Za-z]{1,3})\s*:\s*(.+)$"
ANSWER_LINE = r"^\s*([0-9A-Za-z]{1,3})\s*[:.)\-–]\s*(.+?)\s*$"
VOTE_LINE = r"^([0-9A-Za-z]{1,3})\s*[:.)]\s*(.+)$"
KEY_LINE = r"^\s*([0-9A-Za-z]{1,3})\s*:\s*(\S+)"


def _bare(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def filled_lines(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: _bare(x)), lambda x: x != "")


def _labelled(lines: Column, pattern: str) -> Column:
    """Structs (label, value) of the lines that fit."""
    fit = F.filter(lines, lambda x: x.rlike(pattern))
    return F.transform(fit, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("label"), F.regexp_extract(x, pattern, 2).alias("value")))


def coerced(answer: Column, form: Column) -> Column:
    """An answer in the form of an example: labelled lines in order, one letter, or as it is.

    Labels and values come from the answer's lines, the first of each label; `?` where there is none.
    If the values are P and F only, whatever begins like true or false in either language of the
    papers is mapped, and values on one line without labels are dealt in order.
    """
    bare = F.regexp_replace(F.coalesce(answer, F.lit("")), "[*_`#]", "")
    asked = filled_lines(form)

    def by_label(slots: Column) -> Column:
        two = F.forall(slots, lambda s: s["value"].isin("P", "F"))
        mine = F.filter(_labelled(F.split(bare, r"\r?\n"), ANSWER_LINE), lambda g: F.exists(slots, lambda s: s["label"] == g["label"]))
        alone = F.regexp_extract_all(bare, F.lit(r"\b([PF])\b"), 1)

        def value(v: Column) -> Column:
            truth = F.when(v.rlike("(?i)^(p|prawda)"), "P").when(v.rlike("(?i)^(f|fałsz)"), "F").otherwise(F.upper(F.left(v, F.lit(1))))
            return F.when(two, truth).otherwise(F.get(F.split(v, r"[\s,;.]"), 0))

        def line(s: Column, i: Column, found: Column) -> Column:
            first = F.get(F.filter(found, lambda g: g["label"] == s["label"]), 0)["value"]
            given = F.when(F.size(found) > 0, value(first)).otherwise(F.when(two, F.get(alone, i)))
            return F.concat(s["label"], F.lit(": "), F.coalesce(given, F.lit("?")))

        return T.bound(mine, lambda found: F.array_join(F.transform(slots, lambda s, i: line(s, i, found)), "\n"))

    labelled = (F.size(asked) > 0) & F.forall(asked, lambda x: x.rlike(FORMAT_LINE))
    letter = F.regexp_extract(bare, r"\b([A-F])\b", 1)
    single = F.when(letter != "", letter).otherwise(F.left(_bare(bare), F.lit(1)))
    return F.when(labelled, T.bound(_labelled(asked, FORMAT_LINE), by_label)).when(_bare(form).rlike("^[A-F]$"), single).otherwise(_bare(bare))


def neutral(form: Column) -> Column:
    """An example of an answer with each value replaced by its kind: a truth value, a letter, a number, or itself."""
    asked = filled_lines(form)
    labelled = (F.size(asked) > 0) & F.forall(asked, lambda x: x.rlike(FORMAT_LINE))

    def kind(v: Column) -> Column:
        return F.when(v.isin("P", "F"), "P/F").when(v.rlike("^[A-Z]$"), "letter").when(v.rlike("^[0-9]+$"), "number").otherwise(v)

    lines = F.transform(_labelled(asked, FORMAT_LINE), lambda s: F.concat(s["label"], F.lit(": "), kind(_bare(s["value"]))))
    return F.when(labelled, F.array_join(lines, "\n")).when(_bare(form).rlike("^[A-F]$"), "letter").otherwise(form)


def voted(answers: DataFrame) -> DataFrame:
    """item_id, answer: the majority of each labelled line if labelled lines have as many votes as whole answers, else of those.

    answers: item_id, pos, answer.  An answer counts by line if all its lines are labelled.  Of equals
    the one seen first wins; labels keep the order in which they were first seen.
    """
    rows = answers.select("item_id", "pos", _bare(F.col("answer")).alias("whole"), filled_lines(F.col("answer")).alias("lines"))
    rows = rows.withColumn("by_line", (F.size("lines") > 0) & F.forall("lines", lambda x: x.rlike(VOTE_LINE)))
    lines = F.transform(_labelled(F.col("lines"), VOTE_LINE), lambda s, i: F.struct(s["label"].alias("label"), _bare(s["value"]).alias("value"), i.alias("i")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.col("whole").alias("value"), F.lit(0).alias("i")))
    votes = rows.select("item_id", "pos", F.explode(F.when(F.col("by_line"), lines).otherwise(whole)).alias("v"))
    votes = votes.select("item_id", F.col("v.label").alias("label"), F.col("v.value").alias("value"), F.struct("pos", F.col("v.i").alias("i")).alias("at"))
    counted = votes.groupBy("item_id", "label", "value").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = F.struct("n", (-F.col("first.pos")).alias("p"), (-F.col("first.i")).alias("i"))
    best = counted.groupBy("item_id", "label").agg(F.max_by("value", order).alias("value"), F.sum("n").alias("n"), F.min("first").alias("first"))
    line = F.struct("first", F.concat("label", F.lit(": "), "value").alias("line"))
    keyed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), line))), lambda x: x["line"]), "\n")
    per = best.groupBy("item_id").agg(
        keyed.alias("keyed"),
        F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).alias("of_lines"),
        F.max(F.when(F.col("label").isNull(), F.col("value"))).alias("plain"),
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("of_wholes"),
    )
    return per.select("item_id", F.when(F.col("of_lines") >= F.col("of_wholes"), F.col("keyed")).otherwise(F.col("plain")).alias("answer"))


def orders(items: DataFrame, both_ways: bool = False) -> DataFrame:
    """item_id, shift, backwards, options: an item's options in every cyclic order, and each order backwards if wanted."""
    ways = [False, True] if both_ways else [False]
    rows = items.where(F.size("options") > 0).select("item_id", "options", F.explode(F.sequence(F.lit(0), F.size("options") - 1)).alias("shift"))
    turned = F.expr("concat(slice(options, shift + 1, size(options)), slice(options, 1, shift))")
    rows = rows.select("item_id", "shift", turned.alias("options"), F.explode(F.array(*[F.lit(w) for w in ways])).alias("backwards"))
    return rows.select("item_id", "shift", "backwards", F.when(F.col("backwards"), F.reverse("options")).otherwise(F.col("options")).alias("options"))


def rotation_winner(replies: DataFrame, scores: DataFrame) -> DataFrame:
    """item_id, option, votes: the option with most votes over all orders, then with the best score, then the first by name.

    replies: item_id, options (as they were shown), reply; the first letter A to H that stands alone
    names a place among them.  scores: item_id, option, score; an option without votes can win by score.
    """
    letter = F.regexp_extract(T.strip_thinking(F.col("reply")), r"\b([A-H])\b", 1)
    picked = replies.select("item_id", F.get("options", F.ascii(letter) - ord("A")).alias("option"))
    votes = picked.where("option is not null").groupBy("item_id", "option").agg(F.count("*").alias("votes"))
    all_ = scores.join(votes, ["item_id", "option"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    top = all_.groupBy("item_id").agg(F.max(F.struct("votes", "score")).alias("b"))
    first = all_.join(top, "item_id").where((F.col("votes") == F.col("b.votes")) & F.col("score").eqNullSafe(F.col("b.score")))
    return first.groupBy("item_id").agg(F.min("option").alias("option"), F.first("votes").alias("votes"))


def labelled_points(answer: Column, labels: Column, expected: Column, points_by_correct: Column) -> Column:
    """Points for the number of labels whose last line in the answer has the expected value; 0 where the map has none."""
    lines = F.split(F.coalesce(answer, F.lit("")), r"\r?\n")

    def right(found: Column) -> Column:
        hits = F.transform(labels, lambda x, i: F.try_element_at(F.filter(found, lambda g: g["label"] == x), F.lit(-1))["value"].eqNullSafe(F.get(expected, i)))
        return F.coalesce(F.try_element_at(points_by_correct, F.size(F.filter(hits, lambda h: h)).cast("string")), F.lit(0))

    return T.bound(_labelled(lines, KEY_LINE), right)


def totals(items: DataFrame, group: str) -> DataFrame:
    """By group: points in all, of closed and of open items with their maxima, and open items that wait for a grade.

    items: kind (closed or open), points (null: pending), max_points.
    """
    def part(kind: str, what: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(what))), F.lit(0)).cast("long")

    return items.groupBy(group).agg(
        F.coalesce(F.sum("points"), F.lit(0)).cast("long").alias("total"), part("closed", "points").alias("closed"), part("closed", "max_points").alias("closed_max"),
        part("open", "points").alias("open"), part("open", "max_points").alias("open_max"), F.count_if((F.col("kind") == "open") & F.col("points").isNull()).alias("pending"),
    )
