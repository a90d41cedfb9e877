"""Routing of essay tasks to prepared texts: only to what a person has reviewed, and only when nothing is left open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .quality import first_match

# Fixed value: how a task numbers its topics.
TOPIC_LINE = r"(?m)^\s*([0-9]+)\.\s+"


def offered_topics(tasks: DataFrame) -> DataFrame:
    """tasks with introduction, labels and topics (in order) of their prompts."""
    parts = F.split("prompt", TOPIC_LINE)
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    labels = F.regexp_extract_all("prompt", F.lit(TOPIC_LINE), 1)
    topics = F.transform(F.slice(parts, F.lit(2), F.size(labels)), bare)
    return tasks.withColumn("labels", labels).withColumn("introduction", T.squeezed(F.element_at(parts, 1))).withColumn("topics", topics)


def routes(tasks: DataFrame, introductions: DataFrame, reviewed: DataFrame, matches: DataFrame) -> DataFrame:
    """task_id, status, reason, topic, record_id, attempts: a task's first topic for which a prepared text fits, or why there is none.

    tasks: task_id, prompt, images (array), source_text, topic_options (the labels that it should have,
    null if unknown), min_words.  introductions: text.  reviewed: question, scope_id.  matches: scope_id,
    status (matched or what stands against it), record_id, n_words.

    The reasons, in this order: task_specific_sources, unknown_topic_structure (labels missing, doubled
    or not those expected), unknown_length_requirement, global_requirements_not_reviewed (the
    introduction isn't a known one), no_compatible_essay.  Texts are compared without case and spacing
    only: a changed number or a negation makes another topic.  attempts: for each topic its label and
    scope_not_reviewed, what the match says, or too_short.
    """
    c = F.col
    known = introductions.select(F.sha2(T.squeezed(c("text")), 256).alias("_intro")).distinct().withColumn("_known", F.lit(True))
    rows = offered_topics(tasks).withColumn("_intro", F.sha2("introduction", 256)).join(known, "_intro", "left")
    structure = c("topic_options").isNull() | (F.size("labels") == 0) | (c("labels") != c("topic_options")) | (F.size(F.array_distinct("labels")) != F.size("labels"))
    rows = rows.withColumn("blocked", first_match([
        ("task_specific_sources", (F.size("images") > 0) | (F.regexp_replace(F.coalesce("source_text", F.lit("")), r"\s+", "") != "")),
        ("unknown_topic_structure", structure),
        ("unknown_length_requirement", c("min_words").isNull() | (c("min_words") <= 0)),
        ("global_requirements_not_reviewed", c("_known").isNull()),
    ], ""))
    topics = rows.where("blocked = ''").select("task_id", "min_words", "labels", F.posexplode("topics").alias("pos", "topic"))
    topics = topics.select("task_id", "min_words", "pos", F.get("labels", c("pos")).alias("label"), F.sha2(T.squeezed(c("topic")), 256).alias("_topic"))
    scopes = reviewed.select(F.sha2(T.squeezed(c("question")), 256).alias("_topic"), "scope_id")
    tried = topics.join(scopes, "_topic", "left").join(matches.select("scope_id", c("status").alias("_status"), "record_id", "n_words"), "scope_id", "left")
    status = first_match([("scope_not_reviewed", c("scope_id").isNull()), ("no_match", c("_status").isNull()), ("too_short", (c("_status") == "matched") & (c("n_words") < c("min_words")))], "")
    tried = tried.withColumn("said", F.when(status == "", c("_status")).otherwise(status))
    one = F.struct("pos", "label", "said", F.when(c("said") == "matched", c("record_id")).alias("record_id"))
    per = tried.groupBy("task_id").agg(F.array_sort(F.collect_list(one)).alias("all"), F.min(F.when(c("said") == "matched", one)).alias("best"))
    out = rows.select("task_id", "blocked").join(per, "task_id", "left")
    found = c("best").isNotNull()
    reason = F.when(c("blocked") != "", c("blocked")).when(~found, "no_compatible_essay")
    attempts = F.transform(F.coalesce("all", F.array().cast("array<struct<pos:int,label:string,said:string,record_id:bigint>>")), lambda x: F.concat(x["label"], F.lit(": "), x["said"]))
    return out.select("task_id", F.when(found, "matched").otherwise("no_match").alias("status"), reason.alias("reason"), c("best.label").alias("topic"), c("best.record_id").alias("record_id"), attempts.alias("attempts"))
