"""Answers: normalising, voting, keys, points, and what to send where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def majority(votes: DataFrame) -> DataFrame:
    """item_id, value, n: the most frequent value; of equals the one seen first.  votes: item_id, pos, value."""
    counted = votes.groupBy("item_id", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counted.groupBy("item_id").agg(F.max_by(F.struct("value", "n"), F.struct("n", (-F.col("first")).alias("o"))).alias("b"))
    return best.select("item_id", "b.value", "b.n")


def medoid(samples: DataFrame) -> DataFrame:
    """item_id, pos, similarity: the sample with the largest sum of Jaccard similarities, of sets of runs of word characters, to the others; ties to the first.

    samples: item_id, pos, text; an item's samples are a handful of answers to one question.
    """
    bag = F.struct("pos", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), 0)).alias("bag"))
    items = samples.groupBy("item_id").agg(F.array_sort(F.collect_list(bag)).alias("bags"))

    def nearness(mine: Column, all_: Column) -> Column:
        others = F.filter(all_, lambda other: other["pos"] != mine["pos"])
        return F.round(F.aggregate(others, F.lit(0.0), lambda sum_, other: sum_ + T.jaccard(mine["bag"], other["bag"])), 6)

    scored = F.transform("bags", lambda mine: F.struct(nearness(mine, F.col("bags")).alias("s"), (-mine["pos"]).alias("o"), mine["pos"].alias("pos")))
    best = items.select("item_id", F.array_max(scored).alias("b"))
    return best.select("item_id", "b.pos", F.col("b.s").alias("similarity"))


def choice_points(answer: Column, expected: Column, most: Column, strict: bool = False) -> Column:
    """All points if the first letter A to F that stands alone is the key; strict: if the answer is nothing else."""
    found = F.regexp_extract(answer, r"^\s*([A-F])\W*$" if strict else r"\b([A-F])\b", 1)
    return F.when(found == expected, most).otherwise(F.lit(0))


def partial_points(right: Column, of: Column) -> Column:
    """Of three, two right give 1 and three 2; of other numbers, only all give 1."""
    return F.when(of == 3, F.when(right == 3, 2).when(right == 2, 1).otherwise(0)).otherwise(F.when(right == of, 1).otherwise(0))


def scored(answers: DataFrame, grades: DataFrame, group: str) -> DataFrame:
    """By group: answers, graded, pending, points.  A missing grade is pending, not 0."""
    rows = answers.join(grades, "doc_id", "left")
    return rows.groupBy(group).agg(F.count("*").alias("answers"), F.count("points").alias("graded"), F.count_if(F.col("points").isNull()).alias("pending"), F.coalesce(F.sum("points"), F.lit(0)).cast("long").alias("points"))


def rendered(answer_json: Column, slots: list[str], allowed: list[str]) -> Column:
    """Slots in order from a JSON object that has exactly them, with allowed values only; else null."""
    m = F.from_json(answer_json, "map<string,string>")
    right = (F.size(F.map_keys(m)) == len(slots)) & F.forall(F.array(*[F.lit(s) for s in slots]), lambda s: F.coalesce(F.element_at(m, s).isin(*allowed), F.lit(False)))
    return F.when(right, F.concat_ws("\n", *[F.concat(F.lit(f"{s}: "), F.element_at(m, F.lit(s))) for s in slots]))


def single_field(answer_json: Column, field: str = "answer") -> Column:
    """The field of a JSON object that has no other; else null."""
    return F.when(F.array_join(F.json_object_keys(answer_json), ",") == field, F.get_json_object(answer_json, f"$.{field}"))


def closed_structure(kind: Column, prompt: Column, slots: Column, values: Column, kinds=("choice", "labelled")) -> Column:
    """Whether a closed answer can be asked for by slots: a known kind, no call to explain, slots and values unique and not empty."""
    def unique(a):
        return (F.size(a) > 0) & (F.size(F.array_distinct(a)) == F.size(a))

    return F.coalesce(kind.isin(*kinds) & ~F.lower(prompt).rlike("uzasadn|wyjaśn|explain|justify") & unique(slots) & unique(values), F.lit(False))


def template_rows(template: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each template row, in its order; a missing answer is the empty text."""
    return template.join(answers, "doc_id", "left").select("doc_id", F.coalesce("answer", F.lit("")).alias("answer"))


def submission_problems(answers: DataFrame, most_chars: int = 100_000, least_words: int = 300) -> DataFrame:
    """doc_id, problems: of each submitted text."""
    from .quality import reasons_of

    text = F.col("text")
    rules = [("empty", F.trim(text) == ""), ("too_long", F.length(text) > most_chars), ("thinking", text.rlike("(?i)</?think>")), ("byte_order_mark", text.startswith("﻿")), ("too_short", T.word_count(text) < least_words)]
    return answers.select("doc_id", reasons_of(rules).alias("problems")).where(F.size("problems") > 0)


def blinded(packet: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """For graders sort_key, answer_id, text, without runs' names; and the whole packet with the same key.

    sort_key orders the packet by hash; a gapless number would need all rows in one order.
    """
    keyed = packet.withColumn("sort_key", F.sha2(F.concat(F.lit(seed), "answer_id"), 256))
    return keyed.select("sort_key", "answer_id", "text"), keyed


def shuffled(rows: DataFrame, seed: str, n: int, id_col: str = "doc_id") -> DataFrame:
    """A sample of n rows, by hash of seed and id: the same on every engine."""
    order = F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256)
    return rows.orderBy(order, id_col).limit(n)


def chat(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: turns in order with role marks."""
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    grouped = turns.select("conv_id", F.struct("turn", line.alias("line")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return grouped.select("conv_id", F.size("ts").alias("n_turns"), F.array_join(F.transform("ts", lambda t: t["line"]), "").alias("text"))


def scored_answers(keys: DataFrame, answers: DataFrame, grades: DataFrame, items: DataFrame) -> DataFrame:
    """id, kind, points, max_points, state of each item of the keys or the exam.

    keys: id, kind (choice, labelled_components or another), expected (array), labels, points_by_correct
    (map).  answers: id, answer.  grades: id, points.  items: id, max_points.  Closed items are scored
    from the key, one without an answer as an empty answer (`closed`); the others need a grade
    (`graded`), without which they are `pending`, with null points.  An item of the exam without a key
    is graded by hand.  Without max_points a closed item has the most that its key gives.
    """
    from .closed import labelled_points

    c = F.col
    rows = keys.join(items, "id", "full_outer").join(answers.select("id", "answer"), "id", "left").join(grades.select("id", c("points").alias("grade")), "id", "left")
    kind = F.coalesce("kind", F.lit("manual"))
    closed = kind.isin("choice", "labelled_components")
    answer = F.coalesce("answer", F.lit(""))
    by_key = F.when(kind == "choice", choice_points(answer, F.get("expected", 0), F.lit(1))).otherwise(labelled_points(answer, c("labels"), c("expected"), c("points_by_correct")))
    most = F.coalesce("max_points", F.when(closed, F.coalesce(F.array_max(F.map_values("points_by_correct")), F.lit(1))))
    state = F.when(closed, "closed").when(c("grade").isNotNull(), "graded").otherwise("pending")
    return rows.select("id", kind.alias("kind"), F.when(closed, by_key).otherwise(c("grade")).cast("int").alias("points"), most.cast("int").alias("max_points"), state.alias("state"))
