"""Votes, keys, points and renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import closed as C
from ..operators import scoring as S
from .base import query


@query("""WITH v AS (SELECT user_id AS item_id, event_type AS value, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT item_id, value, n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first) AS r FROM v) WHERE r = 1""")
def vote_majority(t):
    return S.majority(t("events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("value")))


@query(r"""WITH b AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS bag FROM conversations),
p AS (SELECT a.conv_id, a.turn, round(sum(CASE WHEN len(list_distinct(list_concat(a.bag, b.bag))) > 0 THEN len(list_intersect(a.bag, b.bag))::DOUBLE / len(list_distinct(list_concat(a.bag, b.bag))) ELSE 0 END), 6) AS s
      FROM b a JOIN b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY ALL),
m AS (SELECT b.conv_id, b.turn, coalesce(s, 0) AS s FROM b LEFT JOIN p USING (conv_id, turn))
SELECT conv_id AS item_id, turn AS pos, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS r FROM m) WHERE r = 1""")
def medoid(t):
    return S.medoid(t("conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("pos"), "text"))


@query(r"""SELECT doc_id, CASE WHEN regexp_extract(a, '\b([A-F])\b', 1) = 'B' THEN 2 ELSE 0 END::INT AS points, CASE WHEN regexp_extract(a, '^\s*([A-F])\W*$', 1) = 'B' THEN 2 ELSE 0 END::INT AS strict_points
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'B.' WHEN 1 THEN 'Answer B because A' WHEN 2 THEN 'A' ELSE text END AS a FROM documents)""")
def choice_points(t):
    i = F.col("doc_id") % 4
    a = F.when(i == 0, "B.").when(i == 1, "Answer B because A").when(i == 2, "A").otherwise(F.col("text"))
    return t("documents").select("doc_id", S.choice_points(a, F.lit("B"), F.lit(2)).alias("points"), S.choice_points(a, F.lit("B"), F.lit(2), True).alias("strict_points"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN n = 3 THEN CASE r WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END WHEN r = n THEN 1 ELSE 0 END::INT AS points FROM (SELECT l_orderkey, l_linenumber, 2 + l_linenumber % 2 AS n, l_linenumber % 4 AS r FROM lineitem)")
def points_map(t):
    n, r = F.lit(2) + F.col("l_linenumber") % 2, F.col("l_linenumber") % 4
    return t("lineitem").select("l_orderkey", "l_linenumber", S.partial_points(r, n).alias("points"))


@query("""SELECT source, count(*) AS answers, count(quality) AS graded, count(*) FILTER (quality IS NULL) AS pending, coalesce(sum(quality), 0)::BIGINT AS points FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def score_left_join(t):
    return S.scored(t("documents"), t("labels").select("doc_id", F.col("quality").alias("points")), "source")


_FORM = "CASE doc_id % 4 WHEN 0 THEN concat(chr(9), '1: P', chr(10), ' 2: F') WHEN 1 THEN concat('1: A', chr(10), 'b: 7') WHEN 2 THEN 'B' ELSE 'free text' END"
_ANSWER = "CASE doc_id % 9 WHEN 0 THEN concat('1) prawda', chr(10), '2 – Fałsz') WHEN 1 THEN 'P F P' WHEN 2 THEN concat('**2: F**', chr(10), '1: P', chr(10), '1: F') WHEN 3 THEN 'It is C, then A.' WHEN 4 THEN concat('1. C, because', chr(10), 'b- 12;', chr(10), 'z: 1') WHEN 5 THEN NULL WHEN 6 THEN '' WHEN 7 THEN concat('1: x', chr(10), substr(text, 1, 40)) ELSE concat(chr(10), chr(9), text, ' ', chr(10)) END"
_LINES = "list_filter(list_transform(string_split_regex({0}, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query(rf"""
WITH a AS (SELECT doc_id, {_FORM} AS form, regexp_replace(coalesce({_ANSWER}, ''), '[*_`#]', '', 'g') AS bare FROM documents),
l AS (SELECT *, {_LINES.format("form")} AS fl, string_split_regex(bare, '\r?\n') AS al, regexp_extract_all(regexp_replace(bare, '[À-ɏ]', 'w', 'g'), '\b([PF])\b', 1) AS alone FROM a),
g AS (SELECT *, list_transform(fl, lambda x: regexp_extract(x, '{C.FORMAT_LINE}', 1)) AS labels, list_transform(fl, lambda x: regexp_extract(x, '{C.FORMAT_LINE}', 2)) AS vals,
        len(fl) > 0 AND len(list_filter(fl, lambda x: NOT regexp_matches(x, '{C.FORMAT_LINE}'))) = 0 AS labelled FROM l),
m AS (SELECT *, len(list_filter(vals, lambda v: v NOT IN ('P', 'F'))) = 0 AS two, list_filter(al, lambda x: regexp_matches(x, '{C.ANSWER_LINE}') AND list_contains(labels, regexp_extract(x, '{C.ANSWER_LINE}', 1))) AS mine FROM g),
v AS (SELECT *, list_transform(labels, lambda k, i: CASE WHEN len(mine) > 0 THEN regexp_extract(list_filter(mine, lambda x: regexp_extract(x, '{C.ANSWER_LINE}', 1) = k)[1], '{C.ANSWER_LINE}', 2) END) AS raw FROM m),
c AS (SELECT *, list_transform(raw, lambda r, i: labels[i] || ': ' || coalesce(CASE WHEN len(mine) = 0 THEN CASE WHEN two THEN alone[i] END WHEN NOT two THEN string_split_regex(r, '[\s,;.]')[1]
        WHEN regexp_matches(r, '(?i)^(p|prawda)') THEN 'P' WHEN regexp_matches(r, '(?i)^(f|fałsz)') THEN 'F' ELSE upper(left(r, 1)) END, '?')) AS out FROM v)
SELECT doc_id, CASE WHEN labelled THEN array_to_string(out, chr(10)) WHEN regexp_full_match(trim(form), '[A-F]') THEN CASE WHEN regexp_matches(regexp_replace(bare, '[À-ɏ]', 'w', 'g'), '\b[A-F]\b') THEN regexp_extract(regexp_replace(bare, '[À-ɏ]', 'w', 'g'), '\b([A-F])\b', 1) ELSE left(regexp_replace(bare, '^\s+|\s+$', '', 'g'), 1) END ELSE regexp_replace(bare, '^\s+|\s+$', '', 'g') END AS answer,
  CASE WHEN labelled THEN array_to_string(list_transform(vals, lambda x, i: labels[i] || ': ' || CASE WHEN x IN ('P', 'F') THEN 'P/F' WHEN regexp_full_match(x, '[A-Z]') THEN 'letter' WHEN regexp_full_match(x, '[0-9]+') THEN 'number' ELSE x END), chr(10)) WHEN regexp_full_match(trim(form), '[A-F]') THEN 'letter' ELSE form END AS neutral
FROM c""")
def closed_coerce(t):
    rows = t("documents").selectExpr("doc_id", f"{_FORM} AS form", f"{_ANSWER} AS answer")
    return rows.select("doc_id", C.coerced(F.col("answer"), F.col("form")).alias("answer"), C.neutral(F.col("form")).alias("neutral"))


_VOTE = "CASE event_id % 5 WHEN 0 THEN concat('1: ', event_type, chr(10), '2) ', user_id % 3) WHEN 1 THEN concat('2: ', event_id % 2, chr(10), '1. ', event_type) WHEN 2 THEN event_type WHEN 3 THEN concat('a: ', event_id % 2) ELSE concat(' ', event_id % 3, ' ') END"


@query(rf"""
WITH a AS (SELECT user_id AS item_id, event_id AS pos, trim({_VOTE}) AS whole, {_LINES.format(_VOTE)} AS ls FROM events),
b AS (SELECT *, len(ls) > 0 AND len(list_filter(ls, lambda x: NOT regexp_matches(x, '{C.VOTE_LINE}'))) = 0 AS by_line FROM a),
v AS (SELECT item_id, pos, regexp_extract(ls[i], '{C.VOTE_LINE}', 1) AS label, trim(regexp_extract(ls[i], '{C.VOTE_LINE}', 2)) AS value, i FROM b, range(1, 10) r(i) WHERE by_line AND i <= len(ls)
      UNION ALL SELECT item_id, pos, NULL, whole, 0 FROM b WHERE NOT by_line),
c AS (SELECT item_id, label, value, count(*) AS n, min((pos, i)) AS first FROM v GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY item_id, label ORDER BY n DESC, first) AS r, sum(n) OVER (PARTITION BY item_id, label) AS all_n, min(first) OVER (PARTITION BY item_id, label) AS seen FROM c),
p AS (SELECT item_id, string_agg(label || ': ' || value, chr(10) ORDER BY seen) FILTER (label IS NOT NULL) AS keyed, sum(all_n) FILTER (label IS NOT NULL) AS k, max(value) FILTER (label IS NULL) AS plain, coalesce(sum(all_n) FILTER (label IS NULL), 0) AS m FROM w WHERE r = 1 GROUP BY item_id)
SELECT item_id, CASE WHEN k >= m THEN keyed ELSE plain END AS answer FROM p""")
def closed_votes(t):
    return C.voted(t("events").selectExpr("user_id AS item_id", "event_id AS pos", f"{_VOTE} AS answer"))


_KEYED = "concat('1: ', CASE WHEN l_linenumber % 2 = 0 THEN 'P' ELSE 'F' END, chr(10), '2 : ', l_returnflag, chr(10), '1: ', CASE WHEN l_quantity < 25 THEN 'P' ELSE 'F' END, chr(10), '3: ', l_linestatus, ' x')"


@query(r"""SELECT l_orderkey, l_linenumber, CASE (l_quantity < 25)::INT + (l_returnflag = 'A')::INT + (l_linestatus = 'F')::INT WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS points FROM lineitem""")
def labelled_points(t):
    table = F.create_map(F.lit("0"), F.lit(0), F.lit("2"), F.lit(1), F.lit("3"), F.lit(2))
    rows = t("lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_KEYED} AS answer")
    return rows.select("l_orderkey", "l_linenumber", C.labelled_points(F.col("answer"), F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.array(F.lit("P"), F.lit("A"), F.lit("F")), table).alias("points"))


@query("""SELECT lang, coalesce(sum(points), 0)::BIGINT AS total, coalesce(sum(points) FILTER (kind = 'closed'), 0)::BIGINT AS closed, sum(most) FILTER (kind = 'closed')::BIGINT AS closed_max, coalesce(sum(points) FILTER (kind = 'open'), 0)::BIGINT AS open, sum(most) FILTER (kind = 'open')::BIGINT AS open_max, count(*) FILTER (kind = 'open' AND points IS NULL) AS pending
FROM (SELECT lang, CASE WHEN d.n_chars < 2000 THEN 'closed' ELSE 'open' END AS kind, CASE WHEN d.n_chars < 2000 THEN doc_id % 2 ELSE quality END AS points, 1 + doc_id % 3 AS most FROM documents d LEFT JOIN labels USING (doc_id)) GROUP BY lang""")
def score_totals(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    short = F.col("n_chars") < 2000
    return C.totals(d.select("lang", F.when(short, "closed").otherwise("open").alias("kind"), F.when(short, F.col("doc_id") % 2).otherwise(F.col("quality")).alias("points"), (F.col("doc_id") % 3 + 1).alias("max_points")), "lang")


#: Answers as JSON objects: two slots in either order with values from the row, some not allowed, some with a slot too many or too few.
_SLOTS = """concat('{', CASE WHEN user_id % 2 = 0 THEN '' ELSE concat('"1": "', substr('PFX', 1 + event_id % 3, 1), '"', CASE WHEN user_id % 7 = 3 THEN '' ELSE ', ' END) END,
  CASE WHEN user_id % 7 = 3 THEN '' ELSE concat('"2": "', substr('FP', 1 + user_id % 2, 1), '"') END, CASE WHEN user_id % 2 = 0 THEN concat(CASE WHEN user_id % 7 = 3 THEN '' ELSE ', ' END, '"1": "', event_type, '"') ELSE '' END,
  CASE WHEN event_id % 11 = 0 THEN ', "3": "P"' ELSE '' END, CASE WHEN event_id % 13 = 0 THEN '' ELSE '}' END)"""
_ALLOWED = ["P", "F", "click", "view"]
_FIELD = """concat('{"answer": ', CASE event_id % 4 WHEN 0 THEN concat('"', event_type, '"') WHEN 1 THEN '7' WHEN 2 THEN 'null' ELSE '""' END, CASE WHEN user_id % 3 = 0 THEN ', "why": "no"' ELSE '' END, '}')"""


@query(f"""
WITH a AS (SELECT event_id, {_SLOTS} AS a, {_FIELD} AS b FROM events),
j AS (SELECT event_id, CASE WHEN json_valid(a) THEN a END AS a, b FROM a)
SELECT event_id, CASE WHEN list_sort(json_keys(a)) = ['1', '2'] AND (a->>'$.1') IN {tuple(_ALLOWED)} AND (a->>'$.2') IN {tuple(_ALLOWED)} THEN '1: ' || (a->>'$.1') || chr(10) || '2: ' || (a->>'$.2') END AS rendered,
  CASE WHEN json_keys(b) = ['answer'] THEN b->>'$.answer' END AS single FROM j""")
def answer_render(t):
    rows = t("events").selectExpr("event_id", f"{_SLOTS} AS a", f"{_FIELD} AS b")
    return rows.select("event_id", S.rendered(F.col("a"), ["1", "2"], _ALLOWED).alias("rendered"), S.single_field(F.col("b")).alias("single"))


@query("""SELECT p_partkey, p_size % 2 = 0 AND NOT regexp_matches(lower(p_name), 'uzasadn|wyjaśn|explain|justify') AND len(list_distinct(string_split(p_name, ' '))) = len(string_split(p_name, ' ')) AS closed FROM part""")
def closed_structure(t):
    kind = F.when(F.col("p_size") % 2 == 0, "choice").otherwise("essay")
    return t("part").select("p_partkey", S.closed_structure(kind, F.col("p_name"), F.split("p_name", " "), F.array(F.lit("P"), F.lit("F"))).alias("closed"))


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, '') AS answer FROM documents d LEFT JOIN labels l USING (doc_id)")
def template_rows(t):
    return S.template_rows(t("documents").select("doc_id"), t("labels").select("doc_id", F.col("quality").cast("string").alias("answer")))


@query(r"""WITH p AS (SELECT doc_id, list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN length(text) > 20000 THEN 'too_long' END, CASE WHEN regexp_matches(text, '(?i)</?think>') THEN 'thinking' END,
 CASE WHEN len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '')) < 300 THEN 'too_short' END], lambda x: x IS NOT NULL) AS problems FROM documents) SELECT * FROM p WHERE len(problems) > 0""")
def submission_problems(t):
    return S.submission_problems(t("documents"), 20_000)


@query("""WITH a AS (SELECT left(sha256(trim(text)), 16) AS answer_id, min(text) AS text FROM documents GROUP BY 1)
SELECT sha256('blind' || answer_id) AS sort_key, answer_id, text FROM a""")
def blinded_packet(t):
    packet = t("documents").groupBy(T.short_id(F.trim("text")).alias("answer_id")).agg(F.min("text").alias("text"))
    return S.blinded(packet, "blind")[0]


@query("""SELECT conv_id, count(*)::INT AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def chat_render(t):
    return S.chat(t("conversations"))


@query(r"""
WITH k AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'labelled_components' ELSE 'essay' END AS kind FROM documents WHERE doc_id % 10 < 8),
i AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 > 0 THEN 1 + doc_id % 3 END AS m FROM documents WHERE doc_id % 10 > 0),
a AS (SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'B, since ' || text WHEN 1 THEN '1: P' || chr(10) || ' 2:F x' WHEN 4 THEN '2: F' || chr(10) || '1: F' ELSE text END AS answer FROM documents WHERE doc_id % 7 > 0),
r AS (SELECT coalesce(k.id, i.id) AS id, coalesce(kind, 'manual') AS kind, m, coalesce(answer, '') AS a, quality FROM k FULL JOIN i ON k.id = i.id LEFT JOIN a ON a.id = coalesce(k.id, i.id) LEFT JOIN labels l ON l.doc_id = coalesce(k.id, i.id)),
g AS (SELECT *, list_filter(string_split_regex(a, '\r?\n'), lambda x: regexp_matches(x, '^\s*([0-9A-Za-z]{1,3})\s*:\s*(\S+)')) AS ls FROM r),
n AS (SELECT *, CASE WHEN regexp_extract(list_filter(ls, lambda x: regexp_extract(x, '^\s*([0-9A-Za-z]{1,3})\s*:', 1) = '1')[-1], '^\s*[0-9A-Za-z]{1,3}\s*:\s*(\S+)', 1) = 'P' THEN 1 ELSE 0 END
   + CASE WHEN regexp_extract(list_filter(ls, lambda x: regexp_extract(x, '^\s*([0-9A-Za-z]{1,3})\s*:', 1) = '2')[-1], '^\s*[0-9A-Za-z]{1,3}\s*:\s*(\S+)', 1) = 'F' THEN 1 ELSE 0 END AS hits FROM g)
SELECT id, kind, CASE kind WHEN 'choice' THEN CASE WHEN regexp_extract(regexp_replace(a, '[À-ɏ]', 'w', 'g'), '\b([A-F])\b', 1) = 'B' THEN 1 ELSE 0 END WHEN 'labelled_components' THEN [0, 1, 3][hits + 1] ELSE quality END::INT AS points,
  coalesce(m, CASE kind WHEN 'choice' THEN 1 WHEN 'labelled_components' THEN 3 END)::INT AS max_points, CASE WHEN kind IN ('choice', 'labelled_components') THEN 'closed' WHEN quality IS NOT NULL THEN 'graded' ELSE 'pending' END AS state FROM n""")
def scored_items(t):
    d, i = t("documents"), F.col("doc_id")
    kind = F.when(i % 3 == 0, "choice").when(i % 3 == 1, "labelled_components").otherwise("essay")
    one = F.lit(None).cast("map<string,int>")
    keys = d.where(i % 10 < 8).select(
        i.alias("id"), kind.alias("kind"), F.when(i % 3 == 0, F.array(F.lit("B"))).otherwise(F.array(F.lit("P"), F.lit("F"))).alias("expected"), F.array(F.lit("1"), F.lit("2")).alias("labels"),
        F.when(i % 3 == 1, F.create_map(F.lit("0"), F.lit(0), F.lit("1"), F.lit(1), F.lit("2"), F.lit(3))).otherwise(one).alias("points_by_correct"),
    )
    items = d.where(i % 10 > 0).select(i.alias("id"), F.when(i % 4 > 0, i % 3 + 1).cast("int").alias("max_points"))
    answer = F.when(i % 6 == 0, F.concat(F.lit("B, since "), "text")).when(i % 6 == 1, "1: P\n 2:F x").when(i % 6 == 4, "2: F\n1: F").otherwise(F.col("text"))
    answers = d.where(i % 7 > 0).select(i.alias("id"), answer.alias("answer"))
    grades = t("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("points"))
    return S.scored_answers(keys, answers, grades, items)
