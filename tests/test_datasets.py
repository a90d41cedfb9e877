"""Imports, datasets, corpora, marking and vectors on rows worked out by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import datasets as D
from siltstone.operators import embedding as E
from siltstone.operators.gates import Violations


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rules(df):
    return {r["rule"] for r in df.collect()}


def exam(spark, items, declared=3.0):
    return spark.createDataFrame([("e", json.dumps(items), declared)], "exam_id string, items string, max_points double")


def kinds(spark, *pairs):
    return spark.createDataFrame([("e", *p) for p in pairs], "exam_id string, id string, kind string")


ITEMS = [{"id": "1", "question": "q", "max_points": 1, "images": [{"path": "a.png", "sha256": "x", "source_page": 4}]}, {"id": "2.1", "question": "r", "source_text": "s", "max_points": 2, "answer_format": "A"}]


def test_import(spark):
    files = spark.createDataFrame([("a.png", "x")], "path string, sha256 string")
    both = kinds(spark, ("1", "choice"), ("2.1", "essay"))
    got = {r["id"]: r for r in D.imported(exam(spark, ITEMS), both, files).collect()}
    assert got["1"]["image_paths"] == ["assets/a.png"] and got["1"]["pages"] == [4] and got["2.1"]["image_paths"] == [] and got["2.1"]["kind"] == "essay"
    changed = spark.createDataFrame([("a.png", "y")], "path string, sha256 string")
    assert rules(D.import_problems(exam(spark, ITEMS), both, changed)) == {"changed_image"}
    assert rules(D.import_problems(exam(spark, ITEMS), both, files.limit(0))) == {"missing_image"}
    assert rules(D.import_problems(exam(spark, [ITEMS[0], ITEMS[1] | {"solution": "z"}]), both, files)) == {"answer_field"}
    assert rules(D.import_problems(exam(spark, [ITEMS[0], ITEMS[0]], 2.0), kinds(spark, ("1", "choice")), files)) == {"duplicate_id"}
    assert rules(D.import_problems(exam(spark, ITEMS, 9.0), kinds(spark, ("1", "choice"), ("7", "x")), files)) == {"declared_total", "item_without_kind", "kind_without_item"}
    assert rules(D.import_problems(exam(spark, [], None), kinds(spark), files)) == {"no_items"}
    with pytest.raises(Violations):
        D.imported(exam(spark, ITEMS), both, changed)


TASKS = "task_id string, exam_id string, max_points double, image_paths array<string>, refs array<struct<source_id:string,pages:array<int>,spans:array<struct<page:int,start:int,end:int>>>>"
SOURCES = "source_id string, kind string, local_path string, n_pages int"
KEYS = "task_id string, max_points double, refs array<string>"


def test_dataset_rules(spark):
    def found(task=None, source=None, key=None, extra=()):
        base = {"task_id": "t", "exam_id": "e", "max_points": 2.0, "image_paths": ["i.png"], "refs": [("s", [1, 2], [(1, 0, 3)])]}
        tasks = spark.createDataFrame([tuple((base | (task or {})).values()), *extra], TASKS)
        sources = spark.createDataFrame([tuple(({"source_id": "s", "kind": "pdf", "local_path": "s.pdf", "n_pages": 2} | (source or {})).values()), ("i", "image", "i.png", None)], SOURCES)
        keys = spark.createDataFrame([tuple(({"task_id": "t", "max_points": 2.0, "refs": ["s"]} | (key or {})).values())], KEYS)
        pages = spark.createDataFrame([("s", 1, "abc"), ("s", 2, "")], "source_id string, page int, text string")
        return rules(D.dataset_problems(tasks, sources, keys, pages, "e"))

    assert found() == set()
    assert found(key={"max_points": None}) == set()
    assert found(task={"exam_id": "other"}) == {"foreign_exam"}
    assert found(task={"image_paths": ["j.png"]}) == {"unregistered_image"}
    assert found(task={"refs": [("x", [], [])]}) == {"missing_source"}
    assert found(task={"refs": [("s", [3], [])]}) == {"page_outside"}
    assert found(task={"refs": [("s", [1], [(1, 0, 4)])]}) == {"span_beyond_page"}
    assert found(task={"refs": [("s", [1], [(9, 0, 1)])]}) == {"span_without_page"}
    assert found(source={"kind": "grading_pdf"}) == {"grading_source"}
    assert found(source={"n_pages": 3}) == {"incomplete_pages"}
    assert found(key={"max_points": 1.0}) == {"key_points"}
    assert found(key={"task_id": "u"}) == {"key_without_task"}
    assert found(key={"refs": ["x"]}) == {"key_missing_source"}
    assert found(extra=[("t", "e", 2.0, [], [])]) == {"duplicate_task"}


def test_views_and_papers(spark):
    schema = "exam_id string, id string, kind string, max_points double, question string, image_paths array<string>"
    items = spark.createDataFrame([("e", "1", "choice", 45.0, "q", ["a.png"]), ("e", "2", "essay", 15.0, "w", [])], schema)
    keys = spark.createDataFrame([("e", "1"), ("e", "2")], "exam_id string, id string")
    kept, left, made = D.non_essay(items, keys)
    assert [r["id"] for r in kept.collect()] == [r["id"] for r in left.collect()] == ["1"] and tuple(made.first()) == ("e", 1, 45.0, "2", "nonessay")
    with pytest.raises(Violations):
        D.non_essay(items.where("id = '1'"), keys)
    shape = spark.createDataFrame([("e", "1", "labelled_components", ["1", "2", "3"], ["P", "F"])], "exam_id string, id string, key_kind string, labels array<string>, allowed_values array<string>")
    got = {r["id"]: r for r in D.development_paper(kept, items.where("kind = 'essay'"), shape, "paper").collect()}
    assert got["1"]["answer_format"] == "1: P\n2: F\n3: P" and got["1"]["image_paths"] == ["paper/a.png"] and got["2"]["answer_format"] is None


def test_marking(spark):
    text = "Intro\nZadanie 1.1. (0–2)\nFirst\nlines\n\nZadanie 2. (0-1)\n Second \n"
    got = spark.createDataFrame([("p", text)], "paper string, t string").select("paper", F.explode(D.marking_entries(F.col("t"))).alias("m")).select("paper", "m.*")
    assert [tuple(r) for r in got.collect()] == [("p", "1.1", 2, "First\nlines"), ("p", "2", 1, "Second")]
    items = spark.createDataFrame([("p", "1.1", 2), ("p", "2", 1)], "paper string, id string, max_points int")
    assert rules(D.marking_problems(got, items, "paper")) == set()
    assert rules(D.marking_problems(got.unionByName(got.where("id = '2'")), items, "paper")) == {"duplicate_marking"}
    assert rules(D.marking_problems(got, items.withColumn("max_points", F.lit(2)), "paper")) == {"marking_points"}
    assert rules(D.marking_problems(got, items.where("id = '2'"), "paper")) == {"without_item"}


def test_review(spark):
    tasks = spark.createDataFrame([("a", "x", 1.0, False, ["points"]), ("b", "y", 2.0, True, [])], "task_id string, kind string, max_points double, ready boolean, problems array<string>")
    assert [r["task_id"] for r in D.review_queue(tasks).collect()] == ["a"]
    decided = spark.createDataFrame([("a", "essay", None)], "task_id string, kind string, max_points double")
    done = D.review(tasks, decided)
    assert D.review_queue(done).count() == 0 and done.where("task_id = 'a'").first()["kind"] == "essay" and done.columns == tasks.columns
    with pytest.raises(Violations):
        D.review(tasks, decided.withColumn("task_id", F.lit("z")))
    assert D.stamp(tasks).first()["created_at"].endswith("Z")


ARTICLE = "Title\n\n" + "Lead sentence that is long enough to be kept here. " * 3 + "\n\n== Notes ==\n\n" + "Skipped paragraph of a section that is left out of all. " * 2 + "\n\n=== Deeper ===\n\nAlso skipped, for it lies below the section that is left out of it.\n\n== Life ==\n\n" + "A long paragraph. " * 30 + "\n\nshort"


def test_article_passages_and_corpus_rules(spark):
    articles = spark.createDataFrame([("a1", "wiki", "Title", ARTICLE, sha(ARTICLE), "https://x.org/wiki/A", "CC BY-SA 4.0")], "article_id string, kind string, title string, text string, text_sha256 string, source string, licence string")
    cut = D.article_passages(articles, limit=300, skip=("notes",))
    rows = cut.orderBy("ordinal").collect()
    assert [r["section"] for r in rows] == ["Lead", "Life", "Life"] and all(r["end"] - r["start"] <= 300 for r in rows)
    assert all(r["text"] == f"Title — {r['section']}\n" + ARTICLE[r["start"] : r["end"]] and r["id"] == f"a1:passage:{r['ordinal']}:{sha(r['text'])[:16]}" for r in rows)
    assert cut.exceptAll(D.article_passages(articles, limit=300, skip=("notes",))).count() == 0
    passages = cut.join(articles.select("article_id", "source", "licence"), "article_id")
    scopes = {"wiki": ("x.org", "/wiki/", "CC BY-SA")}

    def found(a=articles, p=passages):
        return rules(D.corpus_problems(a, p, scopes))

    assert found() == set()
    assert found(a=articles.withColumn("source", F.lit("https://y.org/wiki/A")), p=passages.withColumn("source", F.lit("https://y.org/wiki/A"))) == {"scope"}
    assert found(a=articles.withColumn("text_sha256", F.lit("x"))) == {"text_hash"}
    assert found(p=passages.withColumn("end", F.col("end") + 10_000)) == {"span"}
    assert found(p=passages.withColumn("body_sha256", F.lit("x"))) == {"body_hash"}
    assert found(p=passages.withColumn("licence", F.lit("x"))) == {"provenance"}
    assert found(p=passages.withColumn("section", F.lit("x"))) == {"prefix"}
    assert found(p=passages.limit(0)) == {"unrepresented"}
    assert found(p=passages.unionByName(passages)) == {"duplicate_id"}
    assert "unknown_article" in found(p=passages.withColumn("article_id", F.lit("zz")))
    page = spark.createDataFrame([("u", "u", "abc", sha("abc")), ("v", "w", "abc", "x")], "url string, final_url string, html string, sha256 string")
    assert rules(D.cache_problems(page)) == {"changed", "redirected"} and rules(D.cache_problems(page, 2)) == {"changed", "redirected", "too_large"}


class Backwards:
    identity = "backwards-1"

    def embed(self, texts, role):
        return [(i, [float(len(t)), 0.0]) for i, t in reversed(list(enumerate(texts)))]


def test_embedder(spark):
    assert E.unit_vectors([(1, [0, 2]), (0, [2, 0])], 2) == [[1, 0], [0, 1]] and E.unit_vectors([(0, [3, 4])], 1) == [[0.6, 0.8]]
    for bad in ([], [(1, [1.0])], [(0, [0.0])], [(0, [float("nan")])], [(0, [float("inf")])], [(0, [True])], [(True, [1.0])]):
        with pytest.raises(ValueError):
            E.unit_vectors(bad, 1)
    for bad in ([(0, [1.0]), (0, [1.0])], [(0, [1.0]), (1, [1.0, 0.0])]):
        with pytest.raises(ValueError):
            E.unit_vectors(bad, 2)
    texts = spark.createDataFrame([(1, "one"), (2, "three"), (3, "x")], "doc_id long, text string")
    index = E.embedded(texts, Backwards(), "document", batch=2)
    assert {(r["doc_id"], tuple(r["vector"]), r["text_sha256"] == sha(t)) for r, t in zip(index.orderBy("doc_id").collect(), ("one", "three", "x"))} == {(i, (1.0, 0.0), True) for i in (1, 2, 3)}
    with pytest.raises(ValueError):
        E.embedded(texts, Backwards(), "other")
    assert rules(E.index_problems(index, texts, "backwards-1", 2)) == set()
    assert rules(E.index_problems(index.where("doc_id > 1"), texts.where("doc_id < 3"), "backwards-2", 3)) == {"not_indexed", "unknown_text", "embedder", "size"}
    assert rules(E.index_problems(index, texts.withColumn("text", F.concat("text", F.lit("!"))), "backwards-1", 2)) == {"stale"}


def test_methods(spark):
    rows = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    queries = rows.toDF("item_id", "text")
    assert E.retrieve("tfidf", queries, rows).first()["score"] == 1
    assert E.retrieve("mine", queries, rows, {"mine": lambda q, r: r}).count() == 1
    with pytest.raises(ValueError):
        E.retrieve("mine", queries, rows)
