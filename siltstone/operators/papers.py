"""Exam papers from the texts of their pages: tasks, nested by their numbers, with exact spans into unmodified pages.

A paper is one text: its pages in order, a form feed on a line of its own between them.  Headings are
found within a page; only they, without texts, meet their paper's other headings, and a page's text is
joined once to the spans that it gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunking import _placed
from .datasets import union_spans

# How a task is headed, what stands between pages, and what marks a page of a marking scheme.
TASK_HEAD = r"^[ \t]*Zadanie[ \t]+([0-9]+(?:\.[0-9]+)?)\.?[ \t]*(?:\([ \t]*0[ \t]*[–−-][ \t]*([0-9]+)[ \t]*\))?"
BETWEEN = "\n\f\n"
MARKING = "Zasady oceniania"


def heads(pages: DataFrame) -> DataFrame:
    """paper_id, page, start, original, points of each heading, without texts.  pages: paper_id, page, text."""
    found = F.filter(_placed(F.col("text")), lambda x: x["line"].rlike(TASK_HEAD))
    rows = pages.select("paper_id", "page", F.explode(found).alias("x"))
    points = F.regexp_extract("x.line", TASK_HEAD, 2)
    return rows.select("paper_id", "page", "x.start", F.regexp_extract("x.line", TASK_HEAD, 1).alias("original"), F.when(points != "", points).cast("int").alias("points"))


def _spans(ranges: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """ranges (paper_id, at, begin, end as (page, start)) by page: paper_id, at, and an array of spans, those of empty pages too."""
    rows = ranges.where("begin < end").select("paper_id", "at", "begin", "end", F.explode(F.sequence("begin.page", "end.page")).alias("page"))
    rows = rows.join(sizes, ["paper_id", "page"])
    start = F.when(F.col("page") == F.col("begin.page"), F.col("begin.start")).otherwise(F.lit(0).cast("long"))
    stop = F.when(F.col("page") == F.col("end.page"), F.least("end.start", "size")).otherwise(F.col("size"))
    rows = rows.select("paper_id", "at", F.struct(F.col("page"), start.alias("start"), stop.alias("end")).alias("s")).where("s.start <= s.end")
    return rows.groupBy("paper_id", "at").agg(F.array_sort(F.collect_list("s")).alias(name))


def tasks(pages: DataFrame) -> DataFrame:
    """paper_id, task_id, original, prompt, source_text, spans, pages, points, notes, in review.

    A task goes from its heading to the next one, over pages too.  A heading `n` with subitems `n.m`
    anywhere in the paper is no task: what lies between it and its first subitem is the source that
    they share, if just one such heading stands before a subitem.  Numbers that occur more than once
    become `n~1`, `n~2`.  notes: duplicate_heading, no_parent, no_points.  Spans are half-open, in characters.
    """
    c = F.col
    sizes = pages.select("paper_id", "page", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    ends = sizes.groupBy("paper_id").agg(F.max(F.struct("page", c("size").alias("start"))).alias("last"))
    at = heads(pages).withColumn("at", F.struct("page", "start")).withColumn("root", F.substring_index("original", ".", 1)).withColumn("child", F.contains("original", F.lit(".")))
    paper, group, same = Window.partitionBy("paper_id"), Window.partitionBy("paper_id", "root"), Window.partitionBy("paper_id", "original")
    before = group.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("next", F.lead("at").over(paper.orderBy("at"))).withColumn("of", F.count("*").over(same)).withColumn("nth", F.row_number().over(same.orderBy("at")))
    at = at.withColumn("first_child", F.min(F.when(c("child"), c("at"))).over(group)).withColumn("roots", F.count(F.when(~c("child"), 1)).over(before)).withColumn("parent", F.min(F.when(~c("child"), c("at"))).over(before))
    own = at.join(ends, "paper_id").withColumn("end", F.coalesce("next", "last")).where(c("child") | c("first_child").isNull())
    nested = c("first_child").isNotNull()
    shared = nested & (c("roots") == 1)
    own = own.withColumn("task_id", F.when(c("of") > 1, F.concat("original", F.lit("~"), c("nth").cast("string"))).otherwise(c("original")))
    notes = F.array_compact(F.array(F.when(nested & ~shared, "no_parent"), F.when(c("of") > 1, "duplicate_heading"), F.when(c("points").isNull(), "no_points")))
    rows = own.select("paper_id", "at", "task_id", "original", "points", notes.alias("notes"), F.when(shared, c("parent")).alias("parent"), F.when(shared, c("first_child")).alias("first_child"), "end")
    mine = _spans(rows.select("paper_id", "at", c("at").alias("begin"), "end"), sizes, "own")
    given = _spans(rows.where("parent IS NOT NULL").select("paper_id", "at", c("parent").alias("begin"), c("first_child").alias("end")), sizes, "given")
    rows = rows.drop("end", "parent", "first_child").join(mine, ["paper_id", "at"], "left").join(given, ["paper_id", "at"], "left")
    none = F.array().cast("array<struct<page:bigint,start:bigint,end:bigint>>")
    rows = rows.withColumn("own", F.coalesce("own", none)).withColumn("given", F.coalesce("given", none))
    parts = rows.select("paper_id", "at", F.explode(F.concat(F.transform("own", lambda s: F.struct(F.lit(True).alias("mine"), s.alias("s"))), F.transform("given", lambda s: F.struct(F.lit(False).alias("mine"), s.alias("s"))))).alias("p"))
    parts = parts.select("paper_id", "at", "p.mine", "p.s", c("p.s.page").alias("page")).join(pages.select("paper_id", "page", "text"), ["paper_id", "page"])
    cut = F.substring(F.coalesce("text", F.lit("")), (c("s.start") + 1).cast("int"), (c("s.end") - c("s.start")).cast("int"))
    parts = parts.select("paper_id", "at", "mine", F.struct("page", cut.alias("text")).alias("t"))
    joined = lambda which: F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, c("t")))), lambda t: t["text"]), BETWEEN), r"^\s+|\s+$", "")
    texts = parts.groupBy("paper_id", "at").agg(joined(c("mine")).alias("prompt"), joined(~c("mine")).alias("source_text"))
    rows = rows.join(texts, ["paper_id", "at"], "left").withColumn("spans", F.filter(union_spans(c("given"), c("own")), lambda s: s["start"] < s["end"]))
    return rows.select(
        "paper_id", "task_id", "original", F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce("source_text", F.lit("")).alias("source_text"),
        "spans", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["page"]))).alias("pages"), "points", "notes",
    )


def marking_schemes(pages: DataFrame, most: int = 3) -> DataFrame:
    """paper_id, n of papers that look like marking schemes: so many pages name one; they must not be read as tasks."""
    return pages.where(F.contains("text", F.lit(MARKING))).groupBy("paper_id").agg(F.count("*").alias("n")).where(F.col("n") >= most)
