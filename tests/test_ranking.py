"""Rankings on odd and large inputs."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from siltstone.operators import bags as B
from siltstone.operators import retrieval as R


def test_few_cosines_of_a_group_go_on(spark):
    vectors = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)] + [(300, None), (400, [0.0, 0.0, 0.0]), (500, [float("nan"), 1.0, 1.0]), (600, [1.0, None, 1.0]), (700, [1.0, 2.0])]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = v.where("vec_id % 100 = 0")
    every = R.dense(asked, v)
    assert every.count() == 3 * 299  # odd vectors, and those of another length, take no part
    few = R.dense(asked, v, best=4)
    assert few.count() == 3 * 4
    assert sorted(R.top_k(few, 4).collect()) == sorted(R.top_k(every, 4).collect())


def test_one_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    from siltstone.operators.joins import spread

    spark.range(40).selectExpr("id AS doc_id", "concat('Größe ', id, ' mit Äpfeln ¾') AS text").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism <= spread(docs).rdd.getNumPartitions()
    assert sorted(spread(docs).collect()) == sorted(docs.collect())
    assert sorted(spread(spread(docs)).collect()) == sorted(docs.collect())


def test_partitions_follow_the_rows(spark, monkeypatch):
    from siltstone.operators import joins

    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    assert joins.deals(spark.range(5), spark.range(95)) == 10
    assert joins.deals(spark.range(5)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_frequent_terms_are_bounded(spark):
    df = spark.createDataFrame([(i, 1 + i % 40) for i in range(400)], "f long, df long")
    for most in (0, 10, 100, 400):
        least = R._frequent(df, most)
        assert df.where(f"df >= {least}").count() <= most
    assert R._frequent(df, 400) == 1


def test_no_pair_of_topic_and_entry_is_shuffled_and_tasks_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_TEXT", 100)
    topics = spark.createDataFrame([(1, "Bunt i zgoda w Dziady. Zajmij stanowisko, aspekty: bunt, zgoda"), (2, "Przyroda w Lalka")], "item_id long, text string")
    entries = spark.range(40).selectExpr("id AS doc_id", "'Bunt' AS title", "array('Dziady') AS topics", "array('pl') AS keywords", "array('zgoda') AS aspects", "concat('bunt i przyroda ', id) AS text", "1800 AS start_year", "1850 AS end_year")
    assert R.text_parts(entries) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    scored = R.bank_scores(topics, entries)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id#" in plan and not re.search("hashpartitioning\\(item_id#[0-9]+L?, doc_id", plan)
    assert scored.count() == 2 * 40
    hits = R.bm25(topics, entries.withColumn("source", F.col("title")))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id#" in plan and not re.search("hashpartitioning\\(item_id#[0-9]+L?, doc_id", plan)


def test_tokens_by_one_pattern(spark):
    import random

    from siltstone.functions import text as T

    def plainly(text, stop, prefixes):
        found = [w for w in re.findall("[a-z]+|[0-9]{3,4}", text) if len(w) >= 3 and not re.fullmatch("[ivxlcdm]+", w) and not w.startswith(tuple(prefixes))]
        return [w[:5] for w in found if w[:5] not in stop]

    draw = random.Random(7)
    parts = ["the", "thes", "dans", "dansx", "there", "interpret", "interpretx", "xiv", "xivs", "mix", "ab", "c", "1", "12345678", "1999", "words", "ivx9", "_", "-", "ż", " ", "\n", "pour"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    for stop, prefixes in ((T.STOP, T.TASK_PREFIXES), (("there", "the", "1999", "toolong"), ("words", "12", "mi")), ((), ())):
        got = rows.select("text", T.tokens(F.col("text"), stop, prefixes).alias("t")).collect()
        assert [r["t"] for r in got] == [plainly(r["text"].replace("ż", "z"), stop, prefixes) for r in got]
    assert " filter(" not in rows.select(T.tokens(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()


def test_import_rules_lie_in_tasks_that_follow_the_rows(spark, monkeypatch):
    from siltstone.operators import datasets, joins

    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    exams = spark.range(95).selectExpr("id AS exam_id", "'[{\"id\": \"a\", \"max_points\": 1}]' AS items", "CAST(1 AS DOUBLE) AS max_points")
    kinds = exams.selectExpr("exam_id", "CASE WHEN exam_id = 3 THEN 'b' ELSE 'a' END AS id", "'open' AS kind")
    found = datasets.import_problems(exams, kinds, spark.createDataFrame([("a.png", "x")], "path string, sha256 string"))
    assert sorted(r["rule"] for r in found.collect()) == ["item_without_kind", "kind_without_item"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(exam_id#[0-9]+L, 10\)", plan) and not re.search(r"hashpartitioning\(exam_id#[0-9]+L, id", plan)


def _odd_texts():
    import random

    draw = random.Random(5)
    letters = "abcde\u00e9\u0142\u4e2d\U00010400"
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(1, 6)))
    words = [word() for _ in range(60)] + ["aaaa", "aaaaaaa", "x", "_", "1999"]
    text = lambda n: " ".join(draw.choice(words) if draw.random() < 0.9 else word() for _ in range(n))
    docs = [(i, text(draw.randint(1, 40))) for i in range(120)]
    docs += [(i, docs[3][1]) for i in range(200, 210)] + [(7, text(9)), (7, docs[7][1]), (8, None), (300, None), (301, ""), (302, " .,! "), (None, text(12)), (None, docs[11][1])]
    items = [(i, text(6)) for i in range(20)] + [(30, docs[3][1]), (31, docs[11][1]), (32, docs[5][1] + " \u0436\u0436\u0436\u0436"), (33, "\u0436\u0436\u0436"), (34, None), (35, ""), (36, "aaaa aaaa"), (36, "x"), (None, docs[5][1])]
    return docs, items


def test_tfidf_on_odd_texts(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    from .compare import compare, connect

    docs, items = _odd_texts()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        pq.write_table(pa.table({key: pa.array([i for i, _ in rows], pa.int64()), "text": [text for _, text in rows]}), f"{tmp_path}/{name}.parquet")
    query, sql = entry.queries()["tfidf_match"], entry.oracle_sql()["tfidf_match"]
    con = connect(str(tmp_path))
    assert compare(spark, con, query, sql, str(tmp_path)) == ""
    monkeypatch.setattr(R, "_frequent", lambda df: 6)  # so that most features are rare
    monkeypatch.setattr(R, "ASKED_ROWS", 100)
    assert compare(spark, con, query, sql, str(tmp_path)) == ""


def test_few_pairs_of_an_item_go_on_and_no_feature_of_a_text_is_a_row(spark, monkeypatch):
    plans, kept = {}, R.kept
    monkeypatch.setattr(R, "kept", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and kept(df, name))
    monkeypatch.setattr(R, "_frequent", lambda df: 40)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words of text ', id % 97, ' ', sha2(string(id), 256)) AS text")
    items = docs.where("doc_id < 5").toDF("item_id", "text")
    few, every = R.tfidf(items, docs, best=2), R.tfidf(items, docs)
    assert every.count() == 5 * 400 and few.count() < 5 * 400 / 4
    top = lambda scored: sorted(R.top_k(scored, 2).collect())
    assert top(few) == top(every)
    assert all("Generate" not in plans[name] for name in ("tfidf-keys", "tfidf-df", "tfidf-held"))


def test_bags_in_pieces_and_slices(monkeypatch):
    docs, items = _odd_texts()

    def batches(rows):
        key = [" ".join((text or "").replace("_", "").replace(".,!", "").split()) for _, text in rows]
        return [pa.record_batch({"id": pa.array([i for i, _ in rows], pa.int64()), "key": pa.array(key), "n": pa.nulls(len(rows), pa.list_(pa.int64()))})]

    def plainly(key):
        words = key.split()
        runs = [("c", f"^{w}$"[i : i + n]) for w in words if len(w) >= 3 for n in (3, 4) for i in range(len(w) + 3 - n)]
        return sorted(Counter([("w", w) for w in words] + runs).values())

    single = [(i, text) for i, text in enumerate(t for _, t in docs)]
    bag = pa.Table.from_batches(B.bags(batches(single))).to_pylist()
    for i, key in enumerate(batches(single)[0].column("key").to_pylist()):
        assert sorted(r["tf"] for r in bag if r["id"] == i) == plainly(key)
    # A text of distinct words with their counts has the same features as the text itself.
    said = B.counted(pa.array(["aaa b aaa aaa b"]))
    told = B.counted(pa.array(["b aaa", "c"]), pa.array([[2, 3], None], pa.list_(pa.int64())))
    assert {said[0][p]: n for p, n in zip(said[2], said[3])} == {told[0][p]: n for r, p, n in zip(*told[1:]) if r == 0}
    assert B._summed(np.array([1 << 60, 3, 1 << 60]), np.array([1 << 40, 1, 2]))[1].tolist() == [1, (1 << 40) + 2]

    f, df = np.unique([r["f"] for r in bag], return_counts=True)
    known = df >= 3
    idf = lambda d: 1 + np.log((len(single) + 1) / (d + 1))
    weights = sorted((r["id"], int(np.searchsorted(f[known], r["f"])), float(r["tf"])) for r in pa.Table.from_batches(B.bags(batches(list(enumerate(t for _, t in items))))).to_pylist() if r["f"] in f[known])
    places = [np.array(c) for c in zip(*weights)]
    asked = B.Asked(f[known], idf(df[known]), (idf(2), idf(1)), 0.25, pa.array(range(len(items))), *places)

    def found(best):
        rows = pa.Table.from_batches(B.held_against(batches(single), asked, best, 2e-6, pa.int64())).to_pylist()
        norm = lambda r: (r["near"] + sum(((1 + np.log(x["tf"])) * idf(1 if df[np.searchsorted(f, x["f"])] == 1 else 2) * (0.25 if x["f"] & 1 else 1)) ** 2 for x in r["far"])) ** 0.5
        return {(p["item_id"], r["id"]): round(p["dot"] / norm(r), 9) for r in rows for p in r["with"]}

    every, few = found(None), found(2)
    for name, value in (("BATCH_TEXT", 200), ("BATCH_ROWS", 7), ("CELLS", 300), ("SLICE_ITEMS", 3), ("SLICE_FEATURES", 40), ("HELD", 50)):
        monkeypatch.setattr(B, name, value)
    assert found(None) == every
    for some in (few, found(2)):
        assert some.items() <= every.items() and len(some) < len(every) / 2
        for item in {i for i, _ in every}:
            best = lambda scores: sorted((-s, d) for (i, d), s in scores.items() if i == item)[:2]
            assert best(some) == best(every)
    counts = pa.Table.from_batches(B.frequencies(batches(single))).to_pandas().groupby("f")["df"].sum()
    assert counts.to_dict() == dict(zip(f.tolist(), df.tolist()))
