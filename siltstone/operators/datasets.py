"""Exam datasets and corpora: import, marking, views, and the rules that each must keep."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import duplicates, gate, orphans, together, violation
from .joins import deals
from .quality import in_scope, reasons_of

# Fields that give answers away, the kind of source that only graders read, and heads of marking entries.
ANSWER_FIELDS = ("answer", "expected", "correct_answer", "solution", "rubric")
GRADING_KIND = "grading_pdf"
MARKING_HEAD = r"(?m)^Zadanie ([0-9]+(?:\.[0-9]+)?)\. \(0[–-]([0-9]+)\)\s*"


def _rules(rows: DataFrame, entity: Column, detail: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    found = rows.select(entity.cast("string").alias("entity_id"), detail.cast("string").alias("detail"), F.explode(reasons_of(rules)).alias("rule"))
    return found.select("rule", "entity_id", "detail")


def exam_items(exams: DataFrame) -> DataFrame:
    """exam_id, position, raw, keys and the fields of each item; exams: exam_id, items (JSON array, as text)."""
    each = exams.select("exam_id", F.posexplode(F.from_json("items", "array<string>")).alias("position", "raw"))
    fields = F.from_json("raw", "struct<id:string,question:string,source_text:string,max_points:double,images:array<struct<path:string,sha256:string,source_page:int>>>")
    return each.withColumn("keys", F.json_object_keys("raw")).select("*", fields.alias("f")).select("exam_id", "position", "raw", "keys", "f.*")


def import_problems(exams: DataFrame, kinds: DataFrame, files: DataFrame) -> DataFrame:
    """What keeps exams from being imported.  exams: exam_id, items, max_points (declared, or null); kinds: exam_id, id, kind; files: path, sha256."""
    # Dealt by exam once, by counted rows: what is grouped or joined by exam then lies in one task already, which takes a bounded share.
    parts = deals(exams, kinds)
    exams, kinds = exams.repartition(parts, "exam_id"), kinds.repartition(parts, "exam_id")
    items = exam_items(exams)
    c = F.col
    of_items = _rules(items, c("exam_id"), c("id"), [
        ("empty_id", F.coalesce(c("id") == "", F.lit(True))),
        ("answer_field", F.size(F.array_intersect("keys", F.array(*map(F.lit, ANSWER_FIELDS)))) > 0),
    ])
    again = duplicates(items.where("id <> ''"), "exam_id", "id")
    images = items.select("exam_id", "id", F.explode("images").alias("image")).select("exam_id", "id", "image.path", "image.sha256")
    held = images.join(files.select("path", c("sha256").alias("_sha")), "path", "left")
    of_images = _rules(held, c("id"), c("path"), [
        ("unsafe_path", c("path").rlike(r"(^/|(^|/)\.\.(/|$)|\\)")),
        ("missing_image", c("_sha").isNull()),
        ("changed_image", c("_sha") != c("sha256")),
    ])
    named, mapped = items.select("exam_id", "id").distinct(), kinds.select("exam_id", "id").distinct()
    sums = exams.join(items.groupBy("exam_id").agg(F.count("*").alias("n"), F.sum("max_points").alias("sum")), "exam_id", "left")
    of_exams = _rules(sums, c("exam_id"), c("sum"), [("no_items", F.coalesce(c("n"), F.lit(0)) == 0), ("declared_total", c("max_points") != c("sum"))])
    return together(
        of_items, of_images, of_exams, violation(again, "duplicate_id", c("exam_id"), c("id")),
        violation(named.join(mapped, ["exam_id", "id"], "left_anti"), "item_without_kind", c("exam_id"), c("id")),
        violation(mapped.join(named, ["exam_id", "id"], "left_anti"), "kind_without_item", c("exam_id"), c("id")),
    )


def imported(exams: DataFrame, kinds: DataFrame, files: DataFrame) -> DataFrame:
    """exam_id, id, question, source_text, kind, max_points, image_paths, pages; fails if anything is wrong with any exam."""
    gate(import_problems(exams, kinds, files))
    pages = F.array_sort(F.array_distinct(F.filter(F.transform("images", lambda i: i["source_page"]), lambda p: p > 0)))
    paths = F.transform("images", lambda i: F.concat(F.lit("assets/"), i["path"]))
    rows = exam_items(exams).withColumn("images", F.coalesce("images", F.array().cast("array<struct<path:string,sha256:string,source_page:int>>")))
    return rows.select("exam_id", "id", "question", F.coalesce("source_text", F.lit("")).alias("source_text"), "max_points", paths.alias("image_paths"), pages.alias("pages")).join(kinds, ["exam_id", "id"])


def dataset_problems(tasks: DataFrame, sources: DataFrame, keys: DataFrame, pages: DataFrame, exam_id: str) -> DataFrame:
    """rule, entity_id, detail: ids, references, grading kept apart, pages, points, spans, images.

    tasks: task_id, exam_id, max_points, image_paths, refs (source_id, pages, spans of page, start, end);
    sources: source_id, kind, local_path, n_pages; keys: task_id, max_points, refs (source ids);
    pages: source_id, page, text.
    """
    c = F.col
    refs = tasks.select("task_id", F.explode("refs").alias("r")).select("task_id", "r.source_id", "r.pages", "r.spans")
    held = refs.join(sources.select("source_id", "kind", "n_pages"), "source_id", "left")
    of_refs = _rules(held, c("task_id"), c("source_id"), [
        ("missing_source", c("kind").isNull()),
        ("grading_source", c("kind") == GRADING_KIND),
        ("page_outside", F.exists("pages", lambda p: p > c("n_pages"))),
    ])
    spans = refs.select("task_id", "source_id", F.explode("spans").alias("s")).select("task_id", "source_id", "s.page", "s.start", "s.end")
    cut = spans.join(pages.select("source_id", "page", F.length("text").alias("_n")), ["source_id", "page"], "left")
    of_spans = _rules(cut, c("task_id"), F.concat_ws("/", "source_id", "page"), [
        ("span_without_page", c("_n").isNull()),
        ("span_beyond_page", (c("end") > c("_n")) | (c("start") < 0) | (c("start") >= c("end"))),
    ])
    images = tasks.select("task_id", F.explode("image_paths").alias("local_path"))
    loose = orphans(images, sources.where("kind = 'image'"), "local_path")
    scored = keys.join(tasks.select("task_id", c("max_points").alias("_most"), F.lit(True).alias("_known")), "task_id", "left")
    of_keys = _rules(scored, c("task_id"), c("max_points"), [("key_without_task", c("_known").isNull()), ("key_points", c("_known") & c("max_points").isNotNull() & ~c("max_points").eqNullSafe(c("_most")))])
    key_refs = orphans(keys.select("task_id", F.explode("refs").alias("source_id")), sources, "source_id")
    there = pages.groupBy("source_id").agg(F.count("*").alias("n"), F.countDistinct("page").alias("d"), F.min("page").alias("low"), F.max("page").alias("high"))
    whole = sources.where("n_pages is not null").join(there, "source_id")
    gaps = whole.where("n <> n_pages or d <> n_pages or low <> 1 or high <> n_pages")
    again = [violation(duplicates(df, key), f"duplicate_{name}", c(key), c("n")) for df, key, name in ((tasks, "task_id", "task"), (sources, "source_id", "source"), (keys, "task_id", "key"))]
    return together(
        of_refs, of_spans, of_keys, *again, violation(loose, "unregistered_image", c("task_id"), c("local_path")),
        violation(key_refs, "key_missing_source", c("task_id"), c("source_id")), violation(gaps, "incomplete_pages", c("source_id"), c("n")),
        violation(tasks.where(c("exam_id") != exam_id), "foreign_exam", c("task_id"), c("exam_id")),
    )


def non_essay(items: DataFrame, keys: DataFrame, rest: float = 45, essay: float = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items and keys without each paper's one essay, and a manifest row for each paper; fails if a paper's points aren't `rest` and `essay`."""
    is_essay = F.col("kind") == "essay"
    sums = items.groupBy("exam_id").agg(F.count_if(is_essay).alias("essays"), F.sum(F.when(is_essay, F.col("max_points")).otherwise(0)).alias("essay_points"), F.sum(F.when(~is_essay, F.col("max_points")).otherwise(0)).alias("points"), F.count_if(~is_essay).alias("items"))
    gate(_rules(sums, F.col("exam_id"), F.col("points"), [("essays", F.col("essays") != 1), ("essay_points", F.col("essay_points") != essay), ("points", F.col("points") != rest)]))
    kept = items.where(~is_essay)
    left = keys.join(kept.select("exam_id", "id"), ["exam_id", "id"], "left_semi")
    excluded = items.where(is_essay).groupBy("exam_id").agg(F.min("id").alias("excluded_id"))
    return kept, left, sums.join(excluded, "exam_id").select("exam_id", "items", "points", "excluded_id", F.lit("nonessay").alias("scope"))


def marking_entries(text: Column) -> Column:
    """Structs (id, max_points, body) of a marking text, in order."""
    ids = F.regexp_extract_all(text, F.lit(MARKING_HEAD), 1)
    points = F.regexp_extract_all(text, F.lit(MARKING_HEAD), 2)
    bodies = F.slice(F.split(text, MARKING_HEAD), F.lit(2), F.size(ids))
    return F.zip_with(F.zip_with(ids, points, lambda i, p: F.struct(i.alias("id"), p.cast("int").alias("max_points"))), bodies, lambda e, b: F.struct(e["id"].alias("id"), e["max_points"].alias("max_points"), F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")).alias("body")))


def marking_problems(marking: DataFrame, items: DataFrame, on: str) -> DataFrame:
    """marking: on, id, max_points of what is scored; items: on, id, max_points.  Ids must be the same, once each, with equal points."""
    c = F.col
    both = marking.select(on, "id", c("max_points").alias("m")).join(items.select(on, "id", c("max_points").alias("n")), [on, "id"], "full_outer")
    found = _rules(both, c(on), c("id"), [("without_item", c("n").isNull()), ("without_marking", c("m").isNull()), ("marking_points", c("m") != c("n"))])
    return found.unionByName(violation(duplicates(marking, on, "id"), "duplicate_marking", c(on), c("id")))


def development_paper(items: DataFrame, essays: DataFrame, keys: DataFrame, prefix: str) -> DataFrame:
    """Items and essays of papers in one table: answer formats from the keys' structure, image paths under `prefix`.

    A choice shows a letter; labelled components show their labels with allowed values in turn; others nothing.
    """
    n = F.size("allowed_values")
    labelled = F.array_join(F.transform("labels", lambda x, i: F.concat(x, F.lit(": "), F.get("allowed_values", (i % n).cast("int")))), "\n")
    shape = keys.select("exam_id", "id", F.when(F.col("key_kind") == "choice", "A").when(F.col("key_kind") == "labelled_components", labelled).alias("answer_format"))
    rows = items.select("exam_id", "id", "question", "max_points", "image_paths").unionByName(essays.select("exam_id", "id", "question", "max_points", "image_paths"))
    return rows.join(shape, ["exam_id", "id"], "left").withColumn("image_paths", F.transform("image_paths", lambda p: F.concat(F.lit(prefix + "/"), p)))


def review_queue(tasks: DataFrame) -> DataFrame:
    """What a person still has to look at: tasks that aren't ready, with the reasons."""
    return tasks.where(~F.col("ready")).select("task_id", "kind", "max_points", "problems")


def review(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """tasks with a reviewer's kind and points where there are any, marked as ready; decisions name each task once, and known ones only."""
    gate(together(violation(duplicates(decisions, "task_id"), "decided_twice", F.col("task_id"), F.col("n")), violation(orphans(decisions, tasks, "task_id"), "unknown_task", F.col("task_id"), F.col("kind"))))
    new = decisions.select("task_id", F.col("kind").alias("_kind"), F.col("max_points").alias("_points"), F.lit(True).alias("_seen"))
    rows = tasks.join(new, "task_id", "left").withColumn("kind", F.coalesce("_kind", "kind")).withColumn("max_points", F.coalesce("_points", "max_points"))
    return rows.withColumn("ready", F.col("ready") | F.coalesce("_seen", F.lit(False))).drop("_kind", "_points", "_seen")


def union_spans(*spans: Column) -> Column:
    """The set of all spans, by page and start."""
    return F.array_sort(F.array_distinct(F.concat(*spans)))


def stamp(df: DataFrame) -> DataFrame:
    """df with the time of writing, in UTC; never part of what is compared."""
    return df.withColumn("created_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _article_spans(text: str, title: str, limit: int, skip: frozenset[str], lead: str) -> Iterator[tuple[str, int, int]]:
    """section, start, end of each part of each paragraph, but for heads, the title, and sections to skip with all below them."""
    from .chunking import spans

    section, skip_above = lead, None
    blank = [m.span() for m in re.finditer(r"\n\s*\n", text)]
    for start, stop in zip([0, *(b for _, b in blank)], [*(a for a, _ in blank), len(text)]):
        block = text[start:stop]
        body = block.strip()
        marks = len(body) - len(body.lstrip("="))
        if 2 <= marks <= 6 and "\n" not in body and body.endswith("=" * marks) and len(body) > 2 * marks:
            name = body.strip("=").strip()
            if skip_above is None or marks <= skip_above:
                skip_above = marks if name.casefold() in skip else None
            section = name
        elif body and body != title and skip_above is None:
            first = start + block.index(body)
            for a, b in spans(body, limit):
                yield section, first + a, first + b


def article_passages(articles: DataFrame, limit: int = 1300, least: int = 50, skip: tuple[str, ...] = (), lead: str = "Lead") -> DataFrame:
    """Passages of articles (article_id string, title, text): a prefix `title — section`, a line break, and the exact span.

    Paragraphs are cut at `limit` and never joined; a section named in skip is left out with its
    subsections; spans of fewer than `least` characters are left out but keep their ordinal.  The id
    holds the ordinal and a hash of the whole passage, prefix included.
    """
    left_out = frozenset(s.casefold() for s in skip)
    names = ["article_id", "title", "section", "ordinal", "start", "end", "body"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())

    def run(batches):
        for batch in batches:
            rows = []
            for key, title, text in zip(*(batch.column(c).to_pylist() for c in ("article_id", "title", "text"))):
                for i, (section, a, b) in enumerate(_article_spans(text or "", title, limit, left_out, lead)):
                    if len(text[a:b].strip()) >= least:
                        rows.append((key, title, section, i, a, b, text[a:b]))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    cut = articles.select("article_id", "title", "text").mapInArrow(run, "article_id string, title string, section string, ordinal int, start long, end long, body string")
    cut = cut.withColumn("prefix", F.concat("title", F.lit(" — "), "section", F.lit("\n"))).withColumn("text", F.concat("prefix", "body"))
    return cut.withColumn("body_sha256", F.sha2("body", 256)).withColumn("id", F.concat_ws(":", "article_id", F.lit("passage"), "ordinal", F.left(F.sha2("text", 256), F.lit(16))))


def corpus_problems(articles: DataFrame, passages: DataFrame, scopes: dict[str, tuple[str, str, str]], carried: tuple[str, ...] = ("source", "licence", "title")) -> DataFrame:
    """Rules of a corpus of several kinds of sources.

    articles: article_id, kind, title, text, text_sha256, source, licence.  passages: id, article_id,
    section, start, end, prefix, text, body_sha256 and the carried columns.  scopes: for each kind its
    host, path prefix and how its licence begins.
    """
    c = F.col
    fits = F.lit(False)
    for kind, (host, prefix, licence) in scopes.items():
        fits = fits | ((c("kind") == kind) & in_scope(c("source"), (host,), prefix) & ~c("source").rlike("[?#]") & c("licence").startswith(licence))
    of_articles = _rules(articles, c("article_id"), c("source"), [("text_hash", ~F.sha2("text", 256).eqNullSafe(c("text_sha256"))), ("scope", ~F.coalesce(fits, F.lit(False)))])
    held = passages.join(articles.select("article_id", c("text").alias("_text"), *[c(x).alias(f"_{x}") for x in {*carried, "title"}]), "article_id", "left")
    body = c("_text").substr(c("start").cast("int") + 1, (c("end") - c("start")).cast("int"))
    inside = (c("start") >= 0) & (c("start") < c("end")) & (c("end") <= F.length("_text"))
    other = reduce(lambda a, b: a | b, [~c(x).eqNullSafe(c(f"_{x}")) for x in carried])
    known = c("_text").isNotNull()
    of_passages = _rules(held, c("id"), c("article_id"), [
        ("unknown_article", ~known),
        ("span", known & ~inside),
        ("body_hash", known & inside & (F.sha2(body, 256) != c("body_sha256"))),
        ("prefix", known & (c("prefix") != F.concat("_title", F.lit(" — "), "section", F.lit("\n")))),
        ("passage_text", known & inside & (c("text") != F.concat("prefix", body))),
        ("provenance", known & other),
    ])
    again = [violation(duplicates(df, key), f"duplicate_{key}", c(key), c("n")) for df, key in ((articles, "article_id"), (articles, "source"), (passages, "id"))]
    return together(of_articles, of_passages, *again, violation(orphans(articles, passages, "article_id"), "unrepresented", c("article_id"), c("title")))


def cache_problems(pages: DataFrame, most_bytes: int = 4_000_000) -> DataFrame:
    """Of cached raw pages (url, final_url, html, sha256): what isn't what was fetched, or came from elsewhere, or is too large."""
    c = F.col
    return _rules(pages, c("url"), c("sha256"), [("changed", ~F.sha2("html", 256).eqNullSafe(c("sha256"))), ("redirected", ~c("final_url").eqNullSafe(c("url"))), ("too_large", F.octet_length("html") > most_bytes)])
