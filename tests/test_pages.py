"""Pages, papers, crawls, files, runs: fixtures of known outcome."""

import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siltstone.functions import exam as X
from siltstone.functions import fold
from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import crawl as W
from siltstone.operators import html as H
from siltstone.operators import papers as P
from siltstone.operators import quality as Q
from siltstone.operators import reporting, resume
from siltstone.operators import retrieval as R
from siltstone.operators import routing as G
from siltstone.operators import submission as S
from siltstone.operators.gates import Violations
from siltstone.operators.joins import overlap_join
from siltstone.sources import io

RULE = H.PageRule(body_class="article-body", drop_classes=("tabs",))


def page(content, rule=RULE, title="Castles of the north"):
    html = f'<html><body><nav>Home | All castles</nav><main><div class="x article-body">{content}</div></main></body></html>'
    return H.article(html, "https://h.example/a/castles.html", title, rule)


def test_article_drops_navigation_and_keeps_inline_text():
    a = page(
        '<div class="tabs">Plan Summary</div><p>2. 07. Castles of the north</p><p>IV. Brick and stone</p>'
        "<p>Builders on the coast had no stone, so they burnt <i>clay</i>; walls rose fast.<br>Within forty years each river had its keep, and each keep its mill and its bell.</p>"
        "<p>Najważniejsze daty</p><p>1309 – a new seat</p><p>Zobacz też: rivers</p><p>Rozwiąż quiz: which keep is it?</p>"
        '<p> <a href="/plans.PDF">All plans</a></p><p><img src="/keep.png" alt="A keep"></p>'
    )
    assert a["status"] == "ok" and a["title"] == "2. 07. Castles of the north"
    assert "clay; walls rose fast. Within forty years" in a["text"]
    for gone in ("All castles", "Summary", "rivers", "which keep", "All plans"):
        assert gone not in a["text"]
    last = a["passages"][-1]
    assert last["section"] == "Najważniejsze daty" and a["text"][last["start"] : last["end"]] == "1309 – a new seat"
    assert a["images"] == [{"src": "https://h.example/keep.png", "alt": "A keep"}]
    assert all(a["text"][b["start"] : b["end"]] == b["text"] for b in a["blocks"])


def test_bold_paragraph_is_a_heading():
    a = page("<p><b>Who paid</b> <strong>for the walls</strong></p><p>" + "Towns paid for most of the walls, and guilds for the gates. " * 3 + "</p><p><b>Not</b> a heading</p>")
    assert [b["kind"] for b in a["blocks"]] == ["paragraph", "paragraph", "paragraph"]  # the space between is no bold text
    a = page("<p><b>Who paid for the walls</b></p><p>" + "Towns paid for most of the walls, and guilds for the gates. " * 3 + "</p><p><b>Not</b> a heading</p>")
    assert [b["kind"] for b in a["blocks"]] == ["heading", "paragraph", "paragraph"] and a["passages"][0]["section"] == "Who paid for the walls"


def test_nested_items_tables_and_direct_text_once():
    a = page(
        "<div>Three kinds of gates were built on this coast, and some of them can be seen there to this day.<ol><li>Water gates<ul><li>for <b>boats</b></li><li>for mills</li></ul></li></ol>"
        "<table><thead><tr><th>Built</th><th>Gate</th></tr></thead><tr><td>1320</td><td>High <i>Gate</i></td></tr></table>Text behind a table stays.</div>"
    )
    texts = [b["text"] for b in a["blocks"]]
    assert texts == ["Three kinds of gates were built on this coast, and some of them can be seen there to this day.", "Water gates", "for boats", "for mills", "Built | Gate", "1320 | High Gate", "Text behind a table stays."]
    assert [b["kind"] for b in a["blocks"]].count("table_row") == 2
    assert a["blocks"][1]["path"].endswith("/ol/li") and a["blocks"][3]["path"].endswith("/ol/li/ul/li[2]")


def test_long_paragraphs_are_split_without_loss():
    a = page("<p>II. Supplies</p><p>" + "Grain came by river, salt by road. Bells told the hours! " * 60 + "</p><p>The last siege: 1410.</p>", H.PageRule(body_class=RULE.body_class, limit=150))
    assert all(p["end"] - p["start"] <= 150 for p in a["passages"])
    held = "".join(a["text"][p["start"] : p["end"]] for p in a["passages"])
    assert "".join(held.split()) == "".join(a["text"][a["blocks"][1]["start"] :].split())
    assert len(a["passages"]) > 20


def test_pages_that_cant_be_read():
    assert H.article("<main><p>A menu</p></main>", None, None, RULE)["status"] == "no_body"
    assert page("   ")["status"] == "empty" and page("<img src=a.png>")["status"] == "empty"
    assert page("<p>short</p><p>x</p>")["status"] == "short"
    # A row's text outside its cells is in no block.
    assert page("<table><tr>loose words<td>cell</td></tr></table><p>" + "long enough text " * 20 + "</p>")["status"] == "coverage"


def test_deep_and_wide_pages():
    deep = H.article("<body>" + "<div><b>" * 5000 + "deep text", None, "T", H.PageRule(least_text=0, least_blocks=0))
    assert deep["status"] == "ok" and [b["text"] for b in deep["blocks"]] == ["deep text"]
    wide = H.article("<body>" + "<p>x</p>" * 20_000, None, "T", H.PageRule(least_text=0, least_blocks=0))
    assert wide["blocks"][-1]["path"] == "/body/p[20000]"


def test_html_operators(spark):
    html = "<nav><p>menu</p></nav><h2>Head</h2><h3>Sub</h3><p>A<br>b &amp; c</p><ul><li>x<li>y</ul><table><tr><td>966</td><td>Baptism</td></tr></table><script>var p='<p>'</script><p>open"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    rule = H.PageRule(least_text=0, least_blocks=0)
    rows = H.html_blocks(pages, rule).orderBy("pos").collect()
    assert [(r["kind"], r["text"], r["section"]) for r in rows] == [("heading", "Sub", "Sub"), ("paragraph", "A b & c", "Sub"), ("paragraph", "x", "Sub"), ("paragraph", "y", "Sub"), ("table_row", "966 | Baptism", "Sub"), ("paragraph", "open", "Sub")]
    assert {r["page_id"]: r["status"] for r in H.articles(pages, rule).collect()} == {1: "ok", 2: "empty", 3: "empty"}
    cut = H.section_passages(pages, rule).collect()
    assert [r["text"] for r in cut] == ["Head — Sub\n" + "A b & c\n\nx\n\ny\n\n966 | Baptism\n\nopen"]


def papers(spark, *texts):
    return spark.createDataFrame([("p", i, x) for i, x in enumerate(texts, 1)], "paper_id string, page long, text string")


def test_shared_sources_over_pages(spark):
    texts = ["Instructions\n  Zadanie 4.\nA map of trade routes.", "Its legend.\nZadanie 4.1. (0–2)\nName two ports.\nZadanie 4.2 (0-3)\nSay why.", "Zadanie 5. (0–1)\nDate it."]
    rows = P.tasks(papers(spark, *texts)).orderBy("task_id").collect()
    assert [(r["task_id"], r["points"]) for r in rows] == [("4.1", 2), ("4.2", 3), ("5", 1)]
    for r in rows[:2]:
        assert r["source_text"] == "Zadanie 4.\nA map of trade routes.\n\f\nIts legend." and r["pages"] == [1, 2] and r["notes"] == []
        assert all(texts[s["page"] - 1][s["start"] : s["end"]] for s in r["spans"])
    assert rows[0]["prompt"] == "Zadanie 4.1. (0–2)\nName two ports." and rows[2]["source_text"] == ""


def test_repeated_headings_empty_pages_and_missing_parents(spark):
    rows = P.tasks(papers(spark, "Zadanie 6.\nred\nZadanie 6.\nblue")).orderBy("task_id").collect()
    assert [(r["task_id"], r["points"], r["notes"]) for r in rows] == [("6~1", None, ["duplicate_heading", "no_points"]), ("6~2", None, ["duplicate_heading", "no_points"])]
    assert P.tasks(papers(spark, "", None, "nothing to do here")).count() == 0
    alone = P.tasks(papers(spark, "Zadanie 4.1. (0-2)\nx", "", "more\nZadanie 5. (0 − 3)\ny")).orderBy("task_id").collect()
    assert [(r["task_id"], r["points"], r["notes"]) for r in alone] == [("4.1", 2, ["no_parent"]), ("5", 3, [])]
    assert alone[0]["prompt"] == "Zadanie 4.1. (0-2)\nx\n\f\n\n\f\nmore" and alone[0]["pages"] == [1, 3]
    assert P.marking_schemes(papers(spark, "Zasady oceniania", "x Zasady oceniania", "Zasady oceniania")).count() == 1


def test_crawl(spark):
    pages = spark.createDataFrame([("http://h/a", "<a href='b#x'>b</a><a href=/c?start=20>c</a><a href='#top'>t</a>"), ("http://h/b#y", '<a class="k" HREF="http://h/a">back</a><a href="?start=2">n</a>'), ("http://h/c?start=20", "<a href='//o/d'>d</a>")], "url string, html string")
    seeds = spark.createDataFrame([(1, "http://h/a")], "seed int, url string")
    rows = {(r["url"], r["round"], r["known"]) for r in W.crawl(pages, seeds).collect()}
    assert rows == {("http://h/a", 0, True), ("http://h/b", 1, True), ("http://h/c?start=20", 1, True), ("http://h/b?start=2", 2, False), ("http://o/d", 2, False)}
    assert W.crawl(pages, seeds, rounds=1).count() == 3
    with pytest.raises(Violations, match="too_many_pages"):
        W.crawl(pages, seeds, most=2)


def test_nested_leaks(spark):
    rows = ['{"gold": 1}', '{"a": {"b": [{"c": [[{"rubric": null}]]}]}, "solution" : 2}', '{"a": "say \\"gold\\": 1", "b": "{\\"rubric\\": 1}"}', '{"g\\u006fld": 1}', "[1, 2]", '{"gold": ', None, '"gold"']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")
    found = [r["l"] for r in df.select("i", Q.leaked_fields(F.col("j")).alias("l")).orderBy("i").collect()]
    assert found == [["gold"], ["rubric", "solution"], [], ["gold"], [], [], [], []]


def test_folding_equals_the_database(spark):
    letters = [chr(c) for c in range(1, 0x2000) if not 0x13A0 <= c <= 0x13FD and c != 0x1C89] + list("⁰₉ℂⅣ½ﬁﬆＡｚ～日本語—…")[:-1]
    df = spark.createDataFrame([("x" + c + "y",) for c in letters], "t string")
    bad = [(r["t"], r["f"]) for r in df.select("t", fold.folded(F.col("t")).alias("f")).collect() if r["f"] != "".join(fold.folded_char(c, True) for c in r["t"])]
    assert bad == []
    texts = ["Żółć — ŁÓDŹ!", "STRASSE straße", "école École", "ΣΑΣ σας", "İstanbul", "  a\t b\nc ", "don't", "x² ½"]

    def key(value):
        value = unicodedata.normalize("NFKD", value.casefold().replace("ł", "l"))
        return " ".join("".join(c if c.isalnum() or c == "_" or c.isspace() else " " for c in value if not unicodedata.combining(c)).split())

    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    assert [r["k"] for r in df.select("i", T.key(F.col("t")).alias("k")).orderBy("i").collect()] == [key(x) for x in texts]
    squeezed = [" ".join(unicodedata.normalize("NFC", x).casefold().split()) for x in texts]
    got = [r["k"] for r in df.select("i", T.squeezed(F.col("t")).alias("k")).orderBy("i").collect()]
    assert [unicodedata.normalize("NFC", x) for x in got] == [unicodedata.normalize("NFC", x) for x in squeezed]


def test_order_statistics_in_bounded_memory(spark):
    n = 200_000
    big = spark.range(n).select(F.lit("a").alias("g"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    small = spark.createDataFrame([("b", 1.0), ("b", 2.0), ("c", None), ("d", 5.0), ("d", 5.0), (None, 3.0), ("e", -1e308), ("e", 1e308), ("e", 0.0)], "g string, v double")
    rows = {r["g"]: r for r in reporting.latency(big.unionByName(small), "g", "v", held=100).collect()}
    assert (rows["a"]["median"], rows["a"]["p95"], rows["a"]["most"], rows["a"]["n"]) == ((n - 1) / 2, n * 0.95 - 1, n - 1, n)
    assert (rows["b"]["median"], rows["b"]["p95"]) == (1.5, 2.0) and rows["c"]["median"] is None and rows["c"]["n"] == 0
    assert rows["d"]["median"] == 5.0 and rows[None]["p95"] == 3.0 and rows["e"]["median"] == 0.0
    seven = spark.createDataFrame([("x", float(i)) for i in range(1, 38)], "g string, v double")
    assert reporting.latency(seven, "g", "v").first()["p95"] == 36.0


def test_bad_lines_have_file_and_number(spark, tmp_path):
    good = json.dumps({"a": 1})
    (tmp_path / "one.jsonl").write_text("\n".join([good] * 500 + ["", "{bad", good, '{"a": "x"}', ""]))
    (tmp_path / "two.jsonl").write_text(good + "\nnope\n")
    schema = StructType([StructField("a", IntegerType())])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many parts of a file
    try:
        rows = {(r["file"].rsplit("/")[-1], r["line"]) for r in io.bad_lines(spark, str(tmp_path), schema).collect()}
        assert rows == {("one.jsonl", 502), ("one.jsonl", 504), ("two.jsonl", 2)}
        with pytest.raises(Violations, match="one.jsonl:502"):
            io.read_jsonl(spark, str(tmp_path), schema)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert io.read_jsonl(spark, str(tmp_path / "two.jsonl"), schema, strict=False).count() == 2


def test_exact_bytes_out(spark, tmp_path):
    texts = ["no newline", "ends\n", "", "ż\r\n"]
    rows = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(texts)], "name string, content string")
    noted = {r["name"]: r for r in S.write_bytes(rows, f"file://{tmp_path}/out").collect()}
    for i, x in enumerate(texts):
        data = (tmp_path / "out" / f"t{i}").read_bytes()
        assert data == x.encode() and noted[f"t{i}"]["sha256"] == hashlib.sha256(data).hexdigest() and noted[f"t{i}"]["length"] == len(data)


def upload(answers, **top):
    return json.dumps({"exam_id": "e", "answers": answers} | top).encode()


def test_uploads(spark, tmp_path):
    good = [{"id": "1", "answer": "A"}, {"id": "26", "answer": "Temat 2.\n" + "word " * 300}]
    files = {
        "good": upload(good), "bom": b"\xef\xbb\xbf" + upload(good), "latin": upload(good)[:-1] + b"\xe9}", "big": upload(good) + b" " * (1 << 20), "extra": upload(good, x=1),
        "ids": upload([{"id": 1, "answer": "A"}, {"id": "9", "answer": None}, *good[1:], *good[1:]]), "short": upload([good[0], {"id": "26", "answer": "Temat 1. few"}]), "broken": b"[",
        "think": upload([{"id": "1", "answer": "</think>A"}, good[1]]), "other": upload(good, exam_id="f"),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    template = spark.createDataFrame([(0, "1"), (1, "26")], "ordinal int, id string")
    read = S.read_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "([^/]*)$", 1))
    found = sorted((r["entity_id"], r["rule"]) for r in S.file_problems(read, template, "e").collect())
    assert found == sorted([
        ("bom", "byte_order_mark"), ("latin", "not_utf8"), ("latin", "not_json"), ("big", "too_large"), ("extra", "top_level_keys"), ("broken", "not_json"), ("think", "thinking"), ("other", "exam_id"),
        ("ids", "id_not_string"), ("ids", "answer_not_string"), ("ids", "unknown_id"), ("ids", "duplicate_id"), ("short", "essay_too_short"),
    ])
    rows = S.aligned(read.where("path = 'think'"), template).orderBy("ordinal").collect()
    assert [(r["id"], r["answer"]) for r in rows] == [("1", "</think>A"), ("26", good[1]["answer"])]


def test_resumed_runs(spark, tmp_path):
    items = spark.range(50).select(F.col("id").alias("item_id"), F.concat(F.lit("q"), "id").alias("question"))
    root, calls = f"file://{tmp_path}/run", []

    def answer(rows, stop_at=None):
        calls.append(1)
        if stop_at is not None and len(calls) == stop_at:
            raise KeyboardInterrupt
        return rows.select("item_id", F.upper("question").alias("answer"))

    with pytest.raises(KeyboardInterrupt):
        resume.Run(items, "item_id", root, {"m": 1}, parts=4).advance(lambda r: answer(r, 3))
    run = resume.Run(items, "item_id", root, {"m": 1}, parts=4)
    assert len(run.finished()) == 2 and 0 < run.rows().count() < 50
    with pytest.raises(Violations, match="begun already"):
        run.advance(answer, resume=False)
    rows = run.advance(answer)
    assert rows.count() == 50 and len(calls) == 5  # two parts, the one that broke off, and the two that were left
    with pytest.raises(Violations, match="config"):
        resume.Run(items, "item_id", root, {"m": 2}, parts=4).advance(answer)
    with pytest.raises(Violations, match="inputs"):
        resume.Run(items.withColumn("question", F.lower("question")).where("item_id <> 7"), "item_id", root, {"m": 1}, parts=4).advance(answer)
    resume.same_answers(rows, rows.withColumn("points", F.lit(1)), "item_id", ["answer"])
    with pytest.raises(Violations, match="grading_changed"):
        resume.same_answers(rows, rows.withColumn("answer", F.when(F.col("item_id") == 3, "x").otherwise(F.col("answer"))), "item_id", ["answer"])


def test_pinned_files_and_drift(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    files = {"keys": str(tmp_path / "a"), "exam": str(tmp_path / "b")}
    before = spark.createDataFrame(resume.pinned(spark, files, {"x": 1, "y": 2}).collect(), "role string, path string, sha256 string")
    assert resume.drift(before, resume.pinned(spark, files, {"y": 2, "x": 1})).isEmpty()
    (tmp_path / "b").write_text("changed")
    assert {(r["rule"], r["entity_id"]) for r in resume.drift(before, resume.pinned(spark, files, {"x": 2})).collect()} == {("changed", "exam"), ("changed", "config")}
    assert {(r["rule"], r["entity_id"]) for r in resume.drift(before, resume.pinned(spark, {"keys": files["keys"]}, {"x": 1, "y": 2})).collect()} == {("gone", "exam")}


def test_bank_scores(spark):
    topics = spark.createDataFrame([
        (1, "Rewolucja przemysłowa w Anglii była przełomem dla rzemieślników. Zajmij stanowisko wobec tezy, uwzględniając aspekty: gospodarczy, społeczny. 1780 i 1840"),
        (2, "Zamki krzyżackie przetrwały"),
    ], "item_id long, text string")
    entries = spark.createDataFrame([
        (10, "Rewolucja przemysłowa", ["Anglia"], ["fabryka"], ["gospodarczy"], "Rzemieślnicy tracili pracę. Rzemieślnicy szukali jej.", 1760, 1850),
        (11, "Coś innego", ["Rewolucja"], [], [], "przemysłowa rewolucja Anglii", 1200, 1300),
        (12, "Zupełnie obce", [], [], ["społeczny"], "nic", None, None),
    ], "doc_id long, title string, topics array<string>, keywords array<string>, aspects array<string>, text string, start_year int, end_year int")
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in R.bank_scores(topics, entries, R.BankRule(boiler=("byla", "dla"))).collect()}
    # By hand: stems rewol, przem (subject), angli (subject and name), prze(lomem), rzemi.
    from math import log

    idf = lambda df: log(1 + (3 - df + 0.5) / (df + 0.5))
    df = {"rewol": 2, "przem": 2, "angli": 2, "przel": 0, "rzemi": 1}
    weight = {"rewol": 2, "przem": 2, "angli": 2, "przel": 1, "rzemi": 1}
    worth = {t: weight[t] * idf(df[t]) for t in df}
    whole = sum(worth.values())
    terms = (worth["rewol"] + worth["przem"] + 0.9 * worth["angli"] + 0.7 * 2 / 4 * worth["rzemi"]) / whole
    # The thesis's pairs are rewol przem, przem angli, angli przel, przel rzemi: the first entry has two of them, the second one.
    first = (terms + 0.3 * 2 / 4 + 0.3 * 2 / 3 + 0.15 * 1 / 2) * 1.15
    assert got[1, 10] == pytest.approx(first, abs=2e-6)
    second = ((0.9 * worth["rewol"] + 0.7 / 4 * worth["przem"] + 0.7 / 4 * worth["angli"]) / whole + 0.3 * 1 / 4) * 0.6
    assert got[1, 11] == pytest.approx(second, abs=2e-6)
    assert got[1, 12] == pytest.approx(0.15 / 2, abs=2e-6) and not any(i == 2 for i, _ in got)


def test_topic_parts(spark):
    df = spark.createDataFrame([("Jan III Sobieski był Królem. Wielki Wódz-Hetman z Polski. Oceń to.",)], "t string")
    r = df.select(X.thesis(F.col("t")).alias("th"), X.subject(F.col("t")).alias("s"), X.names(F.col("t")).alias("n")).first()
    assert r["th"] == "Jan III Sobieski był Królem. Wielki Wódz-Hetman z Polski" and r["s"] == "Jan III Sobieski"
    assert r["n"] == ["III", "Sobieski", "Królem", "Wódz-Hetman", "Polski"]


def test_overlaps(spark):
    left = spark.createDataFrame([(1, 100, 200), (2, -50, -40), (3, 300, 300), (4, None, 5), (5, 9, 3)], "a int, low int, high int")
    right = spark.createDataFrame([(1, 205, 400), (2, 206, 210), (3, -35, 1000), (4, 0, 94), (5, 0, 95), (6, None, None)], "b int, start int, end int")
    want = {(1, 1), (1, 3), (1, 5), (2, 3), (3, 1), (3, 3)}
    assert {(r["a"], r["b"]) for r in overlap_join(left, right, "low", "high", "start", "end", 5, 16).collect()} == want
    assert overlap_join(left, right, "low", "high", "start", "end", 5, 1000).count() == len(want)


def test_routes(spark):
    ok = dict(images=[], source_text="", topic_options=["1", "2"], min_words=300)
    tasks = {1: ok, 2: ok | {"images": ["a"]}, 3: ok | {"topic_options": None}, 4: ok | {"min_words": 0}, 5: ok, 6: ok, 7: ok | {"min_words": 500}}
    text = {5: "First of all, be brief.\nWrite on one of these.\n1. Mills\n2. Bells of the coast", 6: "Write on one of these.\n1. Mills\n2. No bells of the coast"}
    rows = [(k, text.get(k, "WRITE on one  of these.\n1. Mills.\n2. bells   of the Coast "), v["images"], v["source_text"], v["topic_options"], v["min_words"]) for k, v in tasks.items()]
    tasks = spark.createDataFrame(rows, "task_id long, prompt string, images array<string>, source_text string, topic_options array<string>, min_words int")
    known = spark.createDataFrame([("write on one of these.",)], "text string")
    reviewed = spark.createDataFrame([("Bells of the coast", 1)], "question string, scope_id long")
    matches = spark.createDataFrame([(1, "matched", 77, 400)], "scope_id long, status string, record_id long, n_words int")
    got = {r["task_id"]: r for r in G.routes(tasks, known, reviewed, matches).collect()}
    assert (got[1]["status"], got[1]["topic"], got[1]["record_id"], got[1]["attempts"]) == ("matched", "2", 77, ["1: scope_not_reviewed", "2: matched"])
    assert [got[k]["reason"] for k in range(2, 8)] == ["task_specific_sources", "unknown_topic_structure", "unknown_length_requirement", "global_requirements_not_reviewed", "no_compatible_essay", "no_compatible_essay"]
    assert got[7]["attempts"][1] == "2: too_short"


def test_occurrences_within_the_row(spark):
    rows = C.occurrence_ids(spark.createDataFrame([(1, "a\nb\na\n\na"), (1, "a"), (2, None)], "doc_id int, text string")).collect()
    assert sorted((r["pos"], r["line_id"]) for r in rows) == [(0, "a"), (0, "a~1"), (1, "b"), (2, "a~2"), (4, "a~3")]
