"""Small fixtures, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import gates as G
from siltstone.operators import quality as Q
from siltstone.operators import reporting as P
from siltstone.operators import retrieval as R
from siltstone.operators import scoring as S
from siltstone.sources import io


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="Łódź and Łodzi XIV 12345 interpretacja Wojny wojnami") == ["lodz", "lodzi", "1234", "wojny", "wojna"]
    assert one(spark, T.key(F.col("t")), t="  Żółw — (Ćma)! ") == "zolw cma"


def test_ngrams_of_short_texts(spark):
    assert one(spark, T.ngrams(F.col("a"), 3), a=["x", "y"]) == []
    assert one(spark, T.ngrams(F.col("a"), 2), a=["x", "y", "x", "y"]) == ["x y", "y x"]


def test_years_and_centuries(spark):
    assert one(spark, T.years(F.col("t")), t="from 499 to 966 and 2029, not 2030") == [966, 2029]
    ages = one(spark, T.century_years(F.col("t")), t="XIX w. i IV wieku, w VIIII wiek")
    assert sorted(ages) == [301, 400, 1801, 1900]
    assert sorted(one(spark, T.century_years(F.col("t")), t="od XII–XIII w, lata 50. XX w, rok 1410")) == [1101, 1300, 1410, 1950]
    assert one(spark, T.century_years(F.col("t")), t="V w. p. n. e.") == [-401, -500]


def test_spans_cover_the_text():
    text = ("One sentence. " * 50 + "x" * 700 + " tail") * 2
    cut = C.spans(text, 300)
    assert "".join(text[a:b] for a, b in cut) == text
    assert all(b - a <= 300 for a, b in cut)
    assert C.spans("", 10) == [] and C.spans("ab", 10) == [(0, 2)]


def test_packing_and_skipping():
    assert C.skipped([2, 3, 4, 2, 3], [False, True, False, False, False]) == [False, True, True, False, False]


def test_majority_and_medoid(spark):
    votes = spark.createDataFrame([(1, 0, "P"), (1, 1, "F"), (1, 2, "P"), (2, 0, "b"), (2, 1, "a")], "item_id int, pos int, value string")
    assert sorted(tuple(r) for r in S.majority(votes).collect()) == [(1, "P", 2), (2, "b", 1)]
    samples = spark.createDataFrame([(1, 0, "a b"), (1, 1, "a b c"), (1, 2, "x"), (2, 0, "only")], "item_id int, pos int, text string")
    assert sorted(tuple(r) for r in S.medoid(samples).collect()) == [(1, 0, 0.666667), (2, 0, 0.0)]


def test_decide(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.6), (2, 2, 0.59), (3, 1, 0.1), (4, 5, 0.8)], "item_id int, doc_id int, score double")
    got = {r["item_id"]: (r["doc_id"], r["status"]) for r in R.decide(rows, 0.3).collect()}
    assert got == {1: (1, "matched"), 2: (None, "ambiguous"), 3: (None, "below_threshold"), 4: (5, "matched")}


def test_diversity(spark):
    rows = spark.createDataFrame([(1, i, "s" if i < 4 else "t", 10.0 - i, 2, False) for i in range(9)], "item_id int, doc_id int, source string, score double, n_terms int, in_title boolean")
    got = [(r["doc_id"], r["rank"]) for r in R.diversified(rows).orderBy("rank").collect()]
    assert got == [(0, 1), (1, 2), (4, 3)]


def test_bounds_keep_pending_and_excluded_apart(spark):
    items = spark.createDataFrame([("a", 1, 1, True), ("a", None, 15, True), ("a", None, 2, False)], "g string, points int, max_points int, selected boolean")
    r = P.bounds(items, [["g"]], ["g"]).first()
    assert (r["lower"], r["upper"], r["whole"], r["pending"], r["excluded"]) == (1, 16, 18, 1, 1)


def test_paths_and_urls(spark):
    for path, good in (("a/b", True), ("/a", False), ("a/../b", False), ("..", False), ("a\\b", False), ("", False)):
        assert one(spark, Q.safe_path(F.col("p")), p=path) is good
    for url, good in (("https://a.b/x", True), ("http://localhost:80/v1", True), ("http://a.b", False), ("https://u@a.b", False), ("https://a.b?x", False)):
        assert one(spark, Q.endpoint_allowed(F.col("u")), u=url) is good


def test_gate(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    G.gate(G.violation(rows.where("id > 5"), "none", F.col("id"), F.col("id")))
    with pytest.raises(G.Violations, match="dup 1"):
        G.gate(G.violation(G.duplicates(rows, "id"), "dup", F.col("id"), F.col("n")))


def test_dataset_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    io.save_dataset({"tasks": rows}, str(tmp_path / "d"))
    assert io.load_dataset(spark, str(tmp_path / "d"))["tasks"].count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        io.save_dataset({"tasks": rows}, str(tmp_path / "d"))
    (tmp_path / "x.jsonl").write_text('{"id": 1, "t": "a"}\n\n{"id": "no"}\n')
    with pytest.raises(G.Violations):
        io.read_jsonl(spark, str(tmp_path / "x.jsonl"), rows.schema)


def test_journal(spark, tmp_path):
    from siltstone.streaming.journal import journal

    schema = spark.range(1).schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1}\n{"id": 2}\n')
    for _ in range(2):  # the second run finds nothing new
        journal(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
