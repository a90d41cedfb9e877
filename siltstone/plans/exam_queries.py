"""Exam papers, their parts and their sets of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exam as E
from ..functions import text as T
from ..operators import closed as C
from ..operators import gates as G
from .base import query

_PAPER = "'Zadanie ' || p_partkey || '.' || p_size % 4 || ' (0–' || p_size % 5 || ')' || chr(10) || p_name || chr(10) || 'Zadanie ' || (p_partkey + 1) || '.' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '1. ' || p_type || chr(10) || '2. ' || p_brand ELSE 'A) ' || p_name END || chr(10) || '.......'"


def _paper():
    key, size = F.col("p_partkey"), F.col("p_size")
    rest = F.when(size % 2 == 0, F.concat(F.lit("1. "), "p_type", F.lit("\n2. "), "p_brand")).otherwise(F.concat(F.lit("A) "), "p_name"))
    return F.concat(F.lit("Zadanie "), key.cast("string"), F.lit("."), (size % 4).cast("string"), F.lit(" (0–"), (size % 5).cast("string"), F.lit(")\n"), "p_name", F.lit("\nZadanie "), (key + 1).cast("string"), F.lit(".\n"), rest, F.lit("\n......."))


_HEAD = r"(?m)^Zadanie ([0-9]+(?:\.[0-9]+)*)\.?(?: \(0[–-]([0-9]+)\))?"


@query(rf"""WITH p AS (SELECT p_partkey, {_PAPER} AS t FROM part), h AS (SELECT p_partkey, unnest(regexp_extract_all(t, '{_HEAD}', 1)) AS id, unnest(regexp_extract_all(t, '{_HEAD}', 2)) AS pts FROM p)
SELECT p_partkey, id, CASE WHEN pts <> '' THEN pts::INT END AS points FROM h""")
def task_headings(t):
    return t("part").select("p_partkey", F.explode(E.headings(_paper())).alias("h")).select("p_partkey", "h.id", "h.points")


@query(rf"""WITH p AS (SELECT p_partkey, {_PAPER} || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Temat nr 1: ' || p_name || chr(10) || '  temat 2) ' || p_type || chr(10) || '  and more' ELSE '' END AS t FROM part),
n AS (SELECT p_partkey, t, len(regexp_extract_all(t, '{E.NUMBERED}')) AS n, len(regexp_extract_all(t, '{E.LOOSELY}')) AS m FROM p)
SELECT p_partkey, trim(regexp_replace(unnest(CASE WHEN n > 0 THEN string_split_regex(t, '{E.NUMBERED}')[2:] ELSE string_split_regex(t, '{E.LOOSELY}')[2:] END), '\s+', ' ', 'g')) AS topic FROM n""")
def topic_split(t):
    more = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("\nTemat nr 1: "), "p_name", F.lit("\n  temat 2) "), "p_type", F.lit("\n  and more"))).otherwise("")
    return t("part").select("p_partkey", F.explode(E.topics(F.concat(_paper(), more))).alias("topic"))


@query(rf"""WITH p AS (SELECT p_partkey, {_PAPER} AS t FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(t, '{_HEAD}', '', 'g'), '\(0[–-][0-9]+\)', '', 'g'), '(?m)^[.…_]{{5,}}$', '', 'g')) AS task FROM p""")
def essay_tasks(t):
    return t("part").select("p_partkey", E.essay_task(_paper()).alias("task"))


@query(r"""SELECT doc_id, trim(string_split_regex(split_part(split_part(text, chr(10), 1), '.', 1), '(?i)(^|[^\p{L}\p{N}_])(is|of|de|und)($|[^\p{L}\p{N}_])')[1]) AS subject FROM documents""")
def subject_split(t):
    return t("documents").select("doc_id", E.subject(F.substring_index(T.first_line(F.col("text")), ".", 1), ("is", "of", "de", "und")).alias("subject"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS ls FROM part), e AS (SELECT p_partkey, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: ls[i] || ': ' || CASE WHEN i % 2 = 1 THEN 'P' ELSE 'F' END), chr(10)) AS example FROM p)
SELECT p_partkey, example, regexp_replace(example, '(?m)^([^:\\n]+): .*$', '\\1: …', 'g') AS neutral FROM e""".replace("\\\\", "\\"))
def answer_formats(t):
    rows = t("part").select("p_partkey", E.example_format(F.split("p_name", " ")).alias("example"))
    return rows.select("p_partkey", "example", E.neutral_format(F.col("example")).alias("neutral"))


@query("""SELECT d.doc_id, concat_ws(chr(10) || chr(10), 'Task:' || chr(10) || d.lang, CASE WHEN d.n_chars < 500 AND trim(d.text) <> '' THEN 'Source:' || chr(10) || d.text END,
  'Points:' || chr(10) || l.quality::VARCHAR) AS prompt, 'Extra source 1:' || chr(10) || d.lang || chr(10) || chr(10) || 'Extra source 2:' || chr(10) || d.source AS refs
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def prompt_parts(t):
    rows = t("documents").join(t("labels"), "doc_id", "left")
    parts = {"Task": F.col("lang"), "Source": F.when(F.col("n_chars") < 500, F.col("text")), "Points": F.col("quality").cast("string")}
    return rows.select("doc_id", E.prompt(parts).alias("prompt"), E.numbered_references(F.array("lang", "source")).alias("refs"))


_NUMERALS = "[" + ", ".join(f"'{n}'" for n in T.CENTURIES) + "]"
#: A decade, a range of centuries, a century, two years (one out of range), and years before the common era.
_AGES = f"""p_name || ' ' || (900 + p_partkey % 1200)::VARCHAR || ' lata ' || (p_size % 10 * 10)::VARCHAR || '. ' || {_NUMERALS}[p_size % 21 + 1] || ' w. oraz ' || {_NUMERALS}[p_partkey % 21 + 1] || '–' || {_NUMERALS}[(p_partkey + p_size) % 21 + 1] || ' w i ' || CASE WHEN p_size % 3 = 0 THEN 'VIIII wiek' ELSE {_NUMERALS}[(p_partkey + 7) % 21 + 1] || ' wieku' END || CASE WHEN p_partkey % 4 = 0 THEN ' p. n. e.' ELSE '' END"""


def _ages():
    names = F.array(*[F.lit(n) for n in T.CENTURIES])
    key, size = F.col("p_partkey"), F.col("p_size")

    def numeral(n):
        return F.element_at(names, (n % 21 + 1).cast("int"))

    last = F.when(size % 3 == 0, "VIIII wiek").otherwise(F.concat(numeral(key + 7), F.lit(" wieku")))
    return F.concat("p_name", F.lit(" "), (key % 1200 + 900).cast("string"), F.lit(" lata "), (size % 10 * 10).cast("string"), F.lit(". "), numeral(size), F.lit(" w. oraz "), numeral(key), F.lit("–"), numeral(key + size), F.lit(" w i "), last, F.when(key % 4 == 0, " p. n. e.").otherwise(""))


def _century(x: str) -> str:
    return f"list_position({_NUMERALS}, {x})"


@query(rf"""WITH p AS (SELECT p_partkey, {_AGES} AS t FROM part), y AS (
  SELECT p_partkey, t, unnest(list_concat(
    list_filter(list_transform(regexp_extract_all(t, '\b([0-9]{{3,4}})\b', 1), lambda x: x::INT), lambda x: x >= 500 AND x <= 2029),
    list_transform(range(1, len(regexp_extract_all(t, '{T.DECADE}', 1)) + 1), lambda i: ({_century(f"regexp_extract_all(t, '{T.DECADE}', 2)[i]")} - 1) * 100 + regexp_extract_all(t, '{T.DECADE}', 1)[i]::INT),
    flatten(list_transform(range(1, len(regexp_extract_all(t, '{T.CENTURY_RANGE}', 1)) + 1), lambda i: [({_century(f"regexp_extract_all(t, '{T.CENTURY_RANGE}', 1)[i]")} - 1) * 100 + 1, {_century(f"regexp_extract_all(t, '{T.CENTURY_RANGE}', 2)[i]")} * 100])),
    flatten(list_transform(list_filter(regexp_extract_all(t, '{T.CENTURY}', 1), lambda c: list_contains({_NUMERALS}, c)), lambda c: [({_century('c')} - 1) * 100 + 1, {_century('c')} * 100])))) AS y FROM p)
SELECT p_partkey, (CASE WHEN regexp_matches(t, '{T.BEFORE}') THEN -y ELSE y END)::INT AS year FROM y WHERE y IS NOT NULL""")
def century_years(t):
    return t("part").select("p_partkey", F.explode(T.century_years(_ages())).alias("year"))


_REPLY = "CASE WHEN event_id % 7 = 0 THEN 'none' ELSE concat('<think>A B</think> Answer: ', substr('ABCDEFGH', CAST(1 + event_id % 5 AS INT), 1), '.') END"


@query(rf"""WITH o AS (SELECT DISTINCT user_id AS item_id, event_type AS option FROM events), l AS (SELECT item_id, list_sort(list(option)) AS options FROM o GROUP BY item_id),
r AS (SELECT user_id AS item_id, event_id % len(options) AS shift, event_id % 2 = 1 AS backwards, options, trim(regexp_replace({_REPLY}, '(?s)<think>.*?</think>', '', 'g')) AS reply FROM events JOIN l ON l.item_id = user_id),
p AS (SELECT item_id, CASE WHEN backwards THEN list_reverse(turned) ELSE turned END[strpos('ABCDEFGH', regexp_extract(reply, '\b([A-H])\b', 1))] AS option
      FROM (SELECT *, list_concat(options[shift + 1:], options[1:shift]) AS turned FROM r) WHERE regexp_matches(reply, '\b[A-H]\b')),
v AS (SELECT item_id, option, count(*) AS votes FROM p GROUP BY ALL),
s AS (SELECT user_id AS item_id, event_type AS option, max(value) AS score FROM events GROUP BY ALL)
SELECT item_id, option, votes FROM (SELECT s.item_id, s.option, coalesce(votes, 0) AS votes, row_number() OVER (PARTITION BY s.item_id ORDER BY coalesce(votes, 0) DESC, score DESC, s.option) AS n FROM s LEFT JOIN v ON s.item_id = v.item_id AND s.option = v.option) WHERE n = 1""")
def rotation_votes(t):
    e = t("events")
    items = e.groupBy(F.col("user_id").alias("item_id")).agg(F.array_sort(F.collect_set("event_type")).alias("options"))  # no more than the types of events
    shown = C.orders(items, both_ways=True)
    asked = e.selectExpr("user_id AS item_id", "event_id", "event_id % 2 = 1 AS backwards", f"{_REPLY} AS reply").join(items.select("item_id", F.size("options").alias("n")), "item_id")
    replies = asked.withColumn("shift", (F.col("event_id") % F.col("n")).cast("int")).join(shown, ["item_id", "shift", "backwards"])
    return C.rotation_winner(replies, e.groupBy(F.col("user_id").alias("item_id"), F.col("event_type").alias("option")).agg(F.max("value").alias("score")))


@query("""SELECT a.k AS ordinal, a.n_name AS paper, b.c_name AS report FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) a JOIN (SELECT *, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) b USING (k)""")
def papers_with_reports(t):
    papers = t("nation").select((F.col("n_nationkey") + 1).alias("ordinal"), F.col("n_name").alias("paper"))
    first = t("customer").agg(F.min("c_custkey").alias("low"))
    reports = t("customer").crossJoin(F.broadcast(first)).select((F.col("c_custkey") - F.col("low") + 1).alias("ordinal"), F.col("c_name").alias("report"))
    return papers.join(reports, "ordinal").select(F.col("ordinal").cast("long"), "paper", "report")


@query("""SELECT doc_id, count(*) FILTER (k = 1) AS items, count(*) FILTER (k = 2) AS keys FROM (SELECT doc_id, 1 AS k FROM documents UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY doc_id HAVING count(*) FILTER (k = 1) <> 1 OR count(*) FILTER (k = 2) <> 1""")
def id_sets(t):
    both = t("documents").select("doc_id", F.lit(1).alias("k")).unionByName(t("labels").select("doc_id", F.lit(2).alias("k")))
    rows = both.groupBy("doc_id").agg(F.count_if(F.col("k") == 1).alias("items"), F.count_if(F.col("k") == 2).alias("keys"))
    return rows.where("items <> 1 or keys <> 1")


@query("""SELECT page_id, url FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) NOT IN (SELECT doc_id::VARCHAR FROM documents WHERE lang = 'en' UNION SELECT (doc_id + 1)::VARCHAR FROM documents WHERE lang = 'en')""")
def not_fetched(t):
    names = t("documents").where("lang = 'en'").select(F.explode(F.array(F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string"))).alias("name"))
    return t("pages").withColumn("name", F.regexp_extract("url", "/([0-9]+)", 1)).join(names, "name", "left_anti").select("page_id", "url")


@query("""SELECT o_orderkey, count(*) FILTER (l_quantity >= 45) AS essays, sum(CASE WHEN l_quantity < 45 THEN l_linenumber ELSE 0 END)::BIGINT AS rest FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(*) FILTER (l_quantity >= 45) = 1""")
def non_essay_view(t):
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_quantity") >= 45).alias("essays"), F.sum(F.when(F.col("l_quantity") < 45, F.col("l_linenumber")).otherwise(0)).cast("long").alias("rest"))
    return rows.join(t("orders"), "o_orderkey", "left_semi").where("essays = 1")


@query("""
WITH i AS (SELECT l_orderkey AS exam_id, l_linenumber AS id FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_linenumber = 1) = 1 AND count(*) FILTER (l_linenumber = 2) = 1))
SELECT exam_id, count(*) FILTER (id <> 1) AS items, sum(CASE WHEN id = 2 THEN 45 ELSE 0 END)::BIGINT AS points, 1 AS excluded_id, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (id <> 1) AS kept FROM i GROUP BY exam_id""")
def non_essay_papers(t):
    """Line 1 of an order is its essay of 15 points, line 2 has all the others' 45."""
    from ..operators.datasets import non_essay

    n = F.col("l_linenumber")
    whole = t("lineitem").groupBy("l_orderkey").agg(F.count_if(n == 1).alias("a"), F.count_if(n == 2).alias("b")).where("a = 1 AND b = 1")
    items = t("lineitem").join(whole, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("exam_id"), n.alias("id"), F.when(n == 1, "essay").otherwise("choice").alias("kind"), F.when(n == 1, 15).when(n == 2, 45).otherwise(0).alias("max_points"))
    _, keys, papers = non_essay(items, items.select("exam_id", "id"))
    left = keys.groupBy("exam_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("kept"))
    return papers.join(left, "exam_id").select("exam_id", "items", "points", "excluded_id", "kept")


@query("""SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role FROM conversations WHERE role <> 'system') c ANTI JOIN (SELECT DISTINCT label AS k FROM embeddings WHERE label < 1) r ON c.turn = r.k""")
def unregistered_parts(t):
    used = t("conversations").where("role <> 'system'").withColumn("k", F.col("turn").cast("int"))
    return G.orphans(used, t("embeddings").where("label < 1").select(F.col("label").alias("k")), "k").select("conv_id", "turn", "role")


@query("""WITH b AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 6) AS seconds, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (value > 95) AS over FROM events GROUP BY user_id)
SELECT user_id, n, failed, seconds, coalesce(over, '') AS over FROM b""")
def variant_summary(t):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("value") > 95, F.col("event_id")))), lambda x: x.cast("string")), ",")
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 6).alias("seconds"), ids.alias("over"))
