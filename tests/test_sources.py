"""Reading and writing: documents, ordered files, pictures, exports, indexes, reports, streams."""

import base64
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from siltstone.functions import text as T
from siltstone.operators import datasets as D
from siltstone.operators import quality as Q
from siltstone.operators import scoring as S
from siltstone.operators.gates import Violations
from siltstone.sources import io
from siltstone.streaming.journal import journal, windowed_latency

SCHEMA = StructType([StructField("id", StringType()), StructField("n", IntegerType())])


def test_documents_and_ordered_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"id": "a", "n": 1}, indent=1))
    assert [tuple(r) for r in io.read_json(spark, str(tmp_path / "one.json"), SCHEMA).collect()] == [("a", 1)]
    for name, ids in (("z.jsonl", "ab"), ("b.jsonl", "cd")):
        (tmp_path / name).write_text("".join(json.dumps({"id": x, "n": 1}) + "\n" for x in ids))
    rows = io.read_ordered(spark, [str(tmp_path / "z.jsonl"), str(tmp_path / "b.jsonl")], SCHEMA).collect()
    assert {(r["id"], r["file_ordinal"]) for r in rows} == {("a", 0), ("b", 0), ("c", 1), ("d", 1)}


def test_pictures(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(b"\x89PNG\x00")
    r = io.read_images(spark, str(tmp_path / "p.png")).first()
    assert r["data_url"] == "data:image/png;base64," + base64.b64encode(b"\x89PNG\x00").decode()


def test_exports_need_every_row_to_be_ready(spark, tmp_path):
    rows = spark.createDataFrame([("1", "ready", "x"), ("2", "ready", "y")], "id string, review_status string, secret string")
    io.export_ready(rows, str(tmp_path / "out"), ["id"])
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["1", "2"] and spark.read.json(str(tmp_path / "out")).columns == ["id"]
    with pytest.raises(Violations, match="not_ready 2"):
        io.export_ready(rows.withColumn("review_status", F.when(F.col("id") == "2", "needs_review").otherwise("ready")), str(tmp_path / "no"), ["id"])
    assert not (tmp_path / "no").exists()
    with pytest.raises(Exception, match="(?i)exist"):
        io.export_ready(rows, str(tmp_path / "out"), ["id"])


def test_indexes_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0]), ("a", [1.0]), ("b", None)], "id string, v array<double>")
    assert io.checked_index(df, str(tmp_path / "index")).count() == 3


def test_reports_escape_cells(spark):
    said = io.markdown(spark.createDataFrame([("a|b", None), ("x\ny", 2)], "name string, n int"), "Title")
    assert said.splitlines() == ["# Title", "", "| name | n |", "|---|---|", "| a\\|b |  |", "| x<br>y | 2 |"]


def test_digests_tell_null_from_empty(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), ("", "a"), ("a", None)], "x string, y string").select(T.digest(F.col("x"), F.col("y")).alias("d")).collect()
    d = [r["d"] for r in rows]
    assert d[0] == d[3] and len(set(d)) == 3


def test_streams(spark, tmp_path):
    inbox, out, state, seen = tmp_path / "in", tmp_path / "out", tmp_path / "state", []
    inbox.mkdir()
    for turn in range(2):
        (inbox / f"{turn}.json").write_text(json.dumps({"id": str(turn), "n": turn}) + "\n")
        journal(spark, str(inbox), SCHEMA, str(out), str(state), lambda df, epoch: seen.append((epoch, df.count()))).awaitTermination()
    assert seen == [(0, 1), (1, 1)]  # what is done isn't done again
    assert sorted(r["id"] for r in spark.read.parquet(str(out)).collect()) == ["0", "1"]
    events = "event_id long, ts timestamp_ntz, event_type string, value double"
    spark.sql("SELECT 1L AS event_id, TIMESTAMP_NTZ '2024-01-01 10:05:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT 2L, TIMESTAMP_NTZ '2024-01-01 10:55:00', 'a', 4.0D").write.parquet(str(tmp_path / "events"))
    query = windowed_latency(spark.readStream.schema(events).parquet(str(tmp_path / "events"))).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["n"], r["mean"]) for r in spark.table("windowed").collect()] == [(2, 3.0)]


def test_cited_sources_and_furniture(spark):
    source = "Intro\nŹródło 1.\nfirst\nNa podstawie: book\nźródło 2. second\nwww.x.y\nsee s. 12"
    rows = [("Use źródle 2.", "second", ["2"]), ("Use źródła 2 and źródło 9", "Intro\nŹródło 1.\nfirst\nźródło 2. second", []), ("None", "Intro\nŹródło 1.\nfirst\nźródło 2. second", [])]
    df = spark.createDataFrame([(p, source) for p, _, _ in rows], "p string, s string")
    got = [r["x"] for r in df.select(Q.question_source(F.col("p"), F.col("s")).alias("x")).collect()]
    assert [(g["text"].strip(), g["cited"]) for g in got] == [(t, c) for _, t, c in rows]
    sheet = " Name ........ x \n.....\nUzasadnienie:\nUzasadnienie: .......\nkept\n\n"
    paper = "Strona 3 z 12\f12.3.\n0–1–2\nMHIP-P1\nWięcej arkuszy znajdziesz\n text 1. \n"
    df = spark.createDataFrame([(sheet, paper)], "a string, b string")
    assert tuple(df.select(Q.without_furniture(F.col("a"), Q.SHEET), Q.without_furniture(F.col("b"), Q.PAPER)).first()) == ("Name …x\nkept", "text 1.")


def test_paragraphs_end_at_blank_lines_with_spaces(spark):
    text = "Title\n\n" + "First paragraph that is long enough to be kept here at all. " * 1 + "\n \t\n" + "Second paragraph that is long enough to be kept here too."
    rows = D.article_passages(spark.createDataFrame([("a", "Title", text)], "article_id string, title string, text string")).orderBy("ordinal").collect()
    assert [r["body"] for r in rows] == ["First paragraph that is long enough to be kept here at all.", "Second paragraph that is long enough to be kept here too."]


def test_answers_keys_and_grades(spark):
    keys = spark.createDataFrame([
        ("1", "choice", ["B"], None, None), ("2", "labelled_components", ["P", "F", "P"], ["1", "2", "3"], {"0": 0, "1": 0, "2": 1, "3": 2}), ("3", "essay", None, None, None), ("4", "choice", ["A"], None, None),
    ], "id string, kind string, expected array<string>, labels array<string>, points_by_correct map<string,int>")
    answers = spark.createDataFrame([("1", "It is B."), ("2", "1: P\n2: F\n3: F"), ("9", "unknown")], "id string, answer string")
    grades = spark.createDataFrame([("3", 7)], "id string, points int")
    items = spark.createDataFrame([("1", 1), ("3", 15), ("5", 4)], "id string, max_points int")
    rows = {r["id"]: tuple(r)[1:] for r in S.scored_answers(keys, answers, grades, items).collect()}
    assert rows == {"1": ("choice", 1, 1, "closed"), "2": ("labelled_components", 1, 2, "closed"), "3": ("essay", 7, 15, "graded"), "4": ("choice", 0, 1, "closed"), "5": ("manual", None, 4, "pending")}
