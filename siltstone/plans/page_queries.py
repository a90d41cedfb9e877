"""Pages, papers, crawls, leaks, routes and uploaded files."""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import crawl as W
from ..operators import html as H
from ..operators import papers as P
from ..operators import quality as Q
from ..operators import routing as R
from ..operators import submission as S
from .base import query

#: The tables' pages hold furniture beside the article and no headings but marked ones.
_RULE = H.PageRule(drop_tags=("script", "style", "nav", "form", "footer"), drop_classes=("ad",), headings=(), bold_heading=0, least_text=0, least_blocks=0)

#: Character references that stand for no letter and need no semicolon, the longest first, so that none is taken for its beginning.
_BARE = "|".join(sorted((n for n, c in html5.items() if not n.endswith(";") and not re.search(r"\w", c)), key=lambda n: (-len(n), n)))
#: What is left of HTML without references, tags and signs; a reference may be cut off by a tag, and so goes first.
_LETTERS = r"regexp_replace(regexp_replace(regexp_replace(x, '&(?:[a-z]+;|(?:" + _BARE + r");?)', '', 'g'), '<[^>]*(>|$)', '', 'g'), '[^\p{L}\p{N}_]+', '', 'g')"
#: The letters and numbers of a page, from the raw HTML by replacing, without any tree.
_RAW = rf"""
WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<body[^>]*>(.*)', 1) AS x FROM pages),
b AS (SELECT page_id, regexp_replace(x, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav>.*?</nav>|<footer>.*?(</footer>|$)|<div class="ad">.*?</div>', '', 'g') AS x FROM a),
letters AS (SELECT page_id, x, {_LETTERS} AS l FROM b)
"""


def _compact(c):
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]+", "")


@query(_RAW + "SELECT page_id, CASE WHEN l = '' THEN 'empty' ELSE 'ok' END AS status, length(l)::INT AS letters, sha256(l) AS letters_sha256 FROM letters")
def html_letters(t):
    """What an article's blocks keep of a page is all of its letters and numbers, in order."""
    rows = H.articles(t("pages"), _RULE)
    kept = _compact(F.coalesce(F.concat("title", F.array_join(F.transform("blocks", lambda b: b["text"]), "")), F.lit("")))
    return rows.select("page_id", "status", F.length(kept).alias("letters"), F.sha2(kept, 256).alias("letters_sha256"))


@query(_RAW + rf""", h AS (SELECT page_id, regexp_replace(x, '(?s)<h[1-6]>.*?</h[1-6]>', '', 'g') AS x FROM letters),
p AS (SELECT page_id, {_LETTERS} AS l FROM h)
SELECT page_id, sha256(l) AS letters_sha256, TRUE AS within, TRUE AS placed FROM p WHERE l <> ''""")
def passage_letters(t):
    """Passages keep all letters and numbers below the headings, within the limit, each where its span says."""
    rows = H.section_passages(t("pages"), _RULE)
    body = F.array_sort(F.collect_list(F.struct("start", "body")))
    rows = rows.groupBy("page_id").agg(body.alias("b"), F.bool_and(F.col("end") - F.col("start") <= _RULE.limit).alias("within"), F.bool_and(F.length("body") == F.col("end") - F.col("start")).alias("placed"))
    return rows.select("page_id", F.sha2(_compact(F.array_join(F.transform("b", lambda x: x["body"]), "")), 256).alias("letters_sha256"), "within", "placed")


_PAGE = """CASE (conv_id + turn) % 4 WHEN 0 THEN 'Zadanie ' || (turn + 1) || '.' || chr(10) || text
  WHEN 1 THEN 'Zadanie ' || turn || '.1. (0–2)' || chr(10) || left(text, length(text) // 2) || chr(10) || ' Zadanie ' || turn || '.2 ( 0-1 )' || chr(10) || substr(text, length(text) // 2 + 1)
  WHEN 2 THEN text ELSE 'Zadanie 7. (0–3) x' || chr(10) || text END"""


@query(rf"""
WITH pg AS (SELECT conv_id AS paper_id, turn + 1 AS page, {_PAGE} AS text FROM conversations),
o AS (SELECT *, length(text) AS size, coalesce(sum(length(text) + 3) OVER (PARTITION BY paper_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM pg),
f AS (SELECT paper_id, string_agg(text, chr(10) || chr(12) || chr(10) ORDER BY page) AS whole FROM pg GROUP BY paper_id),
ln AS (SELECT paper_id, page, off, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM o),
lp AS (SELECT *, (off + coalesce(sum(length(line) + 1) OVER (PARTITION BY paper_id, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos FROM ln),
hd AS (SELECT paper_id, pos, regexp_extract(line, '{P.TASK_HEAD}', 1) AS original, regexp_extract(line, '{P.TASK_HEAD}', 2) AS pts FROM lp WHERE regexp_matches(line, '{P.TASK_HEAD}')),
g AS (SELECT *, split_part(original, '.', 1) AS root, contains(original, '.') AS child, lead(pos) OVER (PARTITION BY paper_id ORDER BY pos) AS nxt,
        count(*) OVER (PARTITION BY paper_id, original) AS n, row_number() OVER (PARTITION BY paper_id, original ORDER BY pos) AS nth FROM hd),
k AS (SELECT *, min(CASE WHEN child THEN pos END) OVER (PARTITION BY paper_id, root) AS kid,
        count(*) FILTER (NOT child) OVER (PARTITION BY paper_id, root ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS roots,
        min(CASE WHEN NOT child THEN pos END) OVER (PARTITION BY paper_id, root) AS top FROM g),
t AS (SELECT k.*, whole, coalesce(nxt, length(whole)) AS stop, kid IS NOT NULL AND roots = 1 AS shared FROM k JOIN f USING (paper_id) WHERE child OR kid IS NULL),
r AS (SELECT paper_id, pos, pos AS a, stop AS b FROM t UNION ALL SELECT paper_id, pos, top, kid FROM t WHERE shared),
s AS (SELECT r.paper_id, r.pos, string_agg(DISTINCT printf('%04d:%06d-%06d', page, greatest(a, off) - off, least(b, off + size) - off), ' ' ORDER BY printf('%04d:%06d-%06d', page, greatest(a, off) - off, least(b, off + size) - off)) AS spans
      FROM r JOIN o ON o.paper_id = r.paper_id AND greatest(a, off) < least(b, off + size) GROUP BY r.paper_id, r.pos)
SELECT paper_id, CASE WHEN n > 1 THEN original || '~' || nth ELSE original END AS task_id, try_cast(nullif(pts, '') AS INT) AS points,
  sha256(regexp_replace(substr(whole, (pos + 1)::BIGINT, (stop - pos)::BIGINT), '^\s+|\s+$', '', 'g')) AS prompt_sha256,
  sha256(CASE WHEN shared AND kid > top THEN regexp_replace(substr(whole, (top + 1)::BIGINT, (kid - top)::BIGINT), '^\s+|\s+$', '', 'g') ELSE '' END) AS source_sha256, spans,
  array_to_string(list_filter([CASE WHEN kid IS NOT NULL AND NOT shared THEN 'no_parent' END, CASE WHEN n > 1 THEN 'duplicate_heading' END, CASE WHEN pts = '' THEN 'no_points' END], lambda x: x IS NOT NULL), ' ') AS notes
FROM t JOIN s USING (paper_id, pos)""")
def paper_tasks(t):
    pages = t("conversations").selectExpr("conv_id AS paper_id", "turn + 1 AS page", _PAGE.replace("//", "div").replace("left(text, length(text) div 2)", "left(text, int(length(text) div 2))").replace("substr(text, length(text) div 2 + 1)", "substr(text, int(length(text) div 2 + 1))") + " AS text")
    rows = P.tasks(pages)
    spans = F.array_join(F.transform("spans", lambda s: F.format_string("%04d:%06d-%06d", s["page"], s["start"], s["end"])), " ")
    return rows.select("paper_id", "task_id", "points", F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("source_text", 256).alias("source_sha256"), spans.alias("spans"), F.array_join("notes", " ").alias("notes"))


#: Fields that give grades away at depths 1 to 4, in lists, behind an escape; names inside strings only; and what is no JSON.
_PLANTED = r"""CASE click_id % 11 WHEN 0 THEN '{"rubric": 1, "p": ' || props || '}' WHEN 1 THEN '{"p": ' || props || ', "a": {"gold": [1, 2]}}' WHEN 2 THEN '[{"a": [{"expected": ' || props || '}]}]'
  WHEN 3 THEN '{"a": [{"b": [[{"solution": null}]], "solution": 1}], "p": ' || props || '}' WHEN 4 THEN '{"note": "say \"solution\": no, {\"gold\": 1}", "p": ' || props || '}' WHEN 5 THEN '{"gold": 1}' WHEN 6 THEN '{"rubric": ' WHEN 7 THEN NULL ELSE props END"""
_FIELDS = "[" + ", ".join(f"'{x}'" for x in Q.GRADING_FIELDS) + "]"


@query(f"""
WITH j AS (SELECT click_id, kind, {_PLANTED} AS x FROM clicks), v AS (SELECT DISTINCT x FROM j WHERE json_valid(x)),
k AS (SELECT v.x, list_sort(list_distinct(list(t.key) FILTER (list_contains({_FIELDS}, t.key)))) AS found FROM v, json_tree(v.x) t GROUP BY v.x)
SELECT click_id, array_to_string(coalesce(found, []), ' ') AS leaked FROM j LEFT JOIN k USING (x)""")
def grading_leak(t):
    planted = _PLANTED.replace("\\", "\\\\")
    return t("clicks").selectExpr("click_id", f"{planted} AS x").select("click_id", F.array_join(Q.leaked_fields(F.col("x")), " ").alias("leaked"))


_ROUNDS = 5


@query(rf"""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
p AS (SELECT a.page_id, regexp_replace(a.url, '#.*$', '') AS url, a.html || '<a class=x href=''' || b.url || '''>n</a>' AS html FROM pages a, n JOIN pages b ON b.page_id = (a.page_id * 7 + 3) % n),
l AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1)) AS raw FROM p),
e AS (SELECT DISTINCT url, CASE WHEN starts_with(x, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || x ELSE x END AS target FROM (SELECT url, regexp_replace(trim(raw, '"'''), '#.*$', '') AS x FROM l)),
r AS (SELECT page_id AS seed, url, 0 AS round FROM p WHERE page_id < 3
      UNION SELECT r.seed, e.target, r.round + 1 FROM r JOIN e ON e.url = r.url WHERE r.round < {_ROUNDS} AND e.target <> r.url)
SELECT seed, url, min(round)::INT AS round, url IN (SELECT url FROM p) AS known FROM r GROUP BY seed, url""")
def page_crawl(t):
    pages = t("pages").select("page_id", "url", "html")
    n = F.broadcast(pages.agg(F.count("*").alias("n")))
    to = pages.select(F.col("page_id").alias("_to"), F.col("url").alias("_url"))
    more = pages.crossJoin(n).join(to, F.col("_to") == (F.col("page_id") * 7 + 3) % F.col("n"))
    more = more.select("page_id", "url", F.concat("html", F.lit("<a class=x href='"), "_url", F.lit("'>n</a>")).alias("html"))
    return W.crawl(more, more.where("page_id < 3").select(F.col("page_id").alias("seed"), "url"), _ROUNDS)


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(rf"""
WITH n AS (SELECT count(*) AS n FROM benchmark), f AS (SELECT item_id, {_FLAT} AS x FROM benchmark),
t AS (SELECT a.item_id, a.x AS own, b.x AS other, lower(a.x) AS k2, lower(b.x) AS k1 FROM f a, n JOIN f b ON b.item_id = (a.item_id + 1) % n),
rv AS (SELECT replace(lower(x), 'ß', 'ss') AS k, item_id AS scope FROM f WHERE item_id % 3 = 0),
tr AS (SELECT item_id, p.pos, p.label, rv.scope, 250 + rv.scope * 5 AS words FROM t, (VALUES (0, '1'), (1, '2')) p(pos, label) LEFT JOIN rv ON rv.k = replace(CASE p.pos WHEN 0 THEN k1 ELSE k2 END, 'ß', 'ss')),
s AS (SELECT *, CASE WHEN scope IS NULL THEN 'scope_not_reviewed' WHEN scope % 9 = 0 THEN 'no_match' WHEN scope % 2 = 1 THEN 'ambiguous' WHEN words < 300 THEN 'too_short' ELSE 'matched' END AS said FROM tr),
b AS (SELECT item_id, CASE WHEN item_id % 11 = 5 OR item_id % 13 = 4 THEN 'task_specific_sources' WHEN item_id % 6 = 1 OR item_id % 7 = 3 THEN 'unknown_topic_structure' WHEN item_id % 8 = 2 THEN 'unknown_length_requirement'
         WHEN item_id % 5 = 0 THEN 'global_requirements_not_reviewed' ELSE '' END AS blocked FROM f),
g AS (SELECT item_id, list(label || ': ' || said ORDER BY pos) AS attempts, min(pos) FILTER (said = 'matched') AS best FROM s GROUP BY item_id)
SELECT b.item_id AS task_id, CASE WHEN blocked = '' AND best IS NOT NULL THEN 'matched' ELSE 'no_match' END AS status, CASE WHEN blocked <> '' THEN blocked WHEN best IS NULL THEN 'no_compatible_essay' END AS reason,
  CASE WHEN blocked = '' THEN (best + 1)::VARCHAR END AS topic, CASE WHEN blocked = '' THEN (SELECT scope + 1000 FROM s WHERE s.item_id = b.item_id AND s.pos = best) END AS record_id,
  CASE WHEN blocked = '' THEN array_to_string(attempts, '; ') ELSE '' END AS attempts
FROM b JOIN g USING (item_id)""")
def essay_routes(t):
    c = F.col
    f = t("benchmark").select("item_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("x"))
    n = F.broadcast(f.agg(F.count("*").alias("n")))
    other = f.select(c("item_id").alias("_o"), c("x").alias("other"))
    i = c("item_id")
    rows = f.crossJoin(n).join(other, c("_o") == (i + 1) % c("n"))
    intro = F.when(i % 5 == 0, "Another one.").otherwise("Choose  one TOPIC.")
    second = F.when(i % 7 == 3, "\n1. ").otherwise("\n 2. ")
    tasks = rows.select(
        i.alias("task_id"), F.concat(intro, F.lit("\n1.  "), "other", second, F.regexp_replace("x", " ", "\n\t")).alias("prompt"),
        F.when(i % 11 == 5, F.array(F.lit("a.png"))).otherwise(F.array().cast("array<string>")).alias("images"), F.when(i % 13 == 4, "A source").otherwise(" \n").alias("source_text"),
        F.when(i % 6 != 1, F.array(F.lit("1"), F.lit("2"))).alias("topic_options"), F.when(i % 8 == 2, 0).otherwise(300).alias("min_words"),
    )
    reviewed = f.where(i % 3 == 0).select(c("x").alias("question"), i.alias("scope_id"))
    matches = f.where((i % 3 == 0) & (i % 9 != 0)).select(i.alias("scope_id"), F.when(i % 2 == 0, "matched").otherwise("ambiguous").alias("status"), (i + 1000).alias("record_id"), (i * 5 + 250).alias("n_words"))
    known = tasks.sparkSession.createDataFrame([("choose one  topic.",)], "text string")
    return R.routes(tasks, known, reviewed, matches).withColumn("attempts", F.array_join("attempts", "; "))


_ANSWERS = [f"q{i}" for i in range(1, 5)]
#: A file for each document, with one fault in most: of bytes, of the top level, of entries, of ids, of the essay.
_FILE = r"""concat(CASE doc_id % 23 WHEN 1 THEN '{"exam_id": "e"' WHEN 2 THEN '{"exam_id": "other", "answers": [' WHEN 3 THEN '{"exam_id": "e", "note": 1, "answers": [' WHEN 4 THEN '{"exam_id": "e", "exam_id": "e", "answers": [' ELSE '{"exam_id": "e", "answers": [' END,
  CASE WHEN doc_id % 23 = 1 THEN '' ELSE concat('{"id": "q1", "answer": ', CASE doc_id % 23 WHEN 5 THEN '7' WHEN 6 THEN '["x"]' WHEN 7 THEN '"a <think>b</think>"' WHEN 8 THEN concat('"', repeat('x', 100001), '"') ELSE '"A"' END, '}, ',
    CASE doc_id % 23 WHEN 9 THEN '{"id": 2, "answer": "B"}' WHEN 10 THEN '{"id": "q2", "answer": "B", "why": 1}' WHEN 11 THEN '{"id": "q1", "answer": "B"}' WHEN 12 THEN '{"id": "q9", "answer": "B"}' WHEN 13 THEN '{"id": "q2"}' ELSE '{"id": "q2", "answer": "B"}' END, ', ',
    '{"id": "q3", "answer": "', CASE doc_id % 23 WHEN 14 THEN 'No number. ' ELSE 'Temat 2. ' END, BODY, '"}]}') END)"""
_BODY = "regexp_replace(text, '[^A-Za-z0-9 ]', ' '{0})"
_UTF8 = "^(?:[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|(?:E[1-9A-CEF])(?:[89AB].){2}|ED[89].[89AB].|F0[9AB].(?:[89AB].){2}|F[1-3](?:[89AB].){3}|F48.(?:[89AB].){2})*$"


@query(rf"""
WITH f AS (SELECT doc_id, 'f' || doc_id AS path, {_FILE.replace("BODY", _BODY.format(", 'g'"))} AS x FROM documents),
h AS (SELECT doc_id, path, x, CASE doc_id % 23 WHEN 15 THEN 'EFBBBF' ELSE '' END || hex(encode(x)) || CASE doc_id % 23 WHEN 16 THEN 'FF' WHEN 17 THEN 'C3A9' WHEN 18 THEN repeat('20', 1100000) ELSE '' END AS b FROM f),
j AS (SELECT *, doc_id % 23 NOT IN (16, 17) AND json_valid(x) AS ok, json_keys(CASE WHEN json_valid(x) THEN x END) AS keys FROM h),
p AS (SELECT *, ok AND len(keys) = len(list_distinct(keys)) AS read FROM j),
e AS (SELECT path, unnest(json_extract(x, '$.answers[*]')) AS e, generate_subscripts(json_extract(x, '$.answers[*]'), 1) - 1 AS pos FROM p WHERE read),
q AS (SELECT path, pos, array_to_string(list_sort(json_keys(e)), ',') AS keys, e->>'$.id' AS id, json_type(e, '$.id') AS idt, e->>'$.answer' AS answer, coalesce(json_type(e, '$.answer'), 'NULL') AS kind FROM e),
i AS (SELECT unnest(['q1', 'q2', 'q3', 'q4']) AS id), c AS (SELECT path, id, count(*) AS n FROM q WHERE id IS NOT NULL GROUP BY ALL),
y AS (SELECT path, arg_min(id, pos) AS id, arg_min(answer, pos) AS answer FROM q WHERE kind = 'VARCHAR' AND regexp_matches(answer, '{S.TOPIC}') GROUP BY path)
SELECT 'not_utf8' AS rule, path AS entity_id FROM p WHERE NOT regexp_matches(b, '{_UTF8}') UNION ALL SELECT 'byte_order_mark', path FROM p WHERE starts_with(b, 'EFBBBF') UNION ALL SELECT 'too_large', path FROM p WHERE length(b) // 2 > 1048576
UNION ALL SELECT 'repeated_keys', path FROM p WHERE ok AND NOT read UNION ALL SELECT 'not_json', path FROM p WHERE NOT ok
UNION ALL SELECT 'top_level_keys', path FROM p WHERE read AND list_sort(keys) <> ['answers', 'exam_id'] UNION ALL SELECT 'exam_id', path FROM p WHERE read AND (x->>'$.exam_id') IS DISTINCT FROM 'e'
UNION ALL SELECT 'id_not_string', path FROM q WHERE idt <> 'VARCHAR' UNION ALL SELECT 'entry_keys', path FROM q WHERE keys <> 'answer,id' UNION ALL SELECT 'answer_not_string', path FROM q WHERE kind <> 'VARCHAR'
UNION ALL SELECT 'answer_too_long', path FROM q WHERE kind = 'VARCHAR' AND length(answer) > 100000 UNION ALL SELECT 'thinking', path FROM q WHERE kind = 'VARCHAR' AND regexp_matches(answer, '</?think>')
UNION ALL SELECT 'duplicate_id', path FROM c WHERE n > 1 UNION ALL SELECT 'unknown_id', path FROM c WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT 'missing_id', p.path FROM p, i WHERE read AND NOT EXISTS (SELECT 1 FROM c WHERE c.path = p.path AND c.id = i.id)
UNION ALL SELECT 'essay_too_short', path FROM y WHERE len(list_filter(string_split_regex(answer, '\s+'), lambda w: w <> '')) < 300""")
def upload_check(t):
    """Bytes of a file for each document; the essay is the entry that names a topic."""
    text = _FILE.replace("BODY", _BODY.format("")).replace("\\", "\\\\")
    k = F.col("doc_id") % 23
    rows = t("documents").selectExpr("doc_id", f"{text} AS x")
    lead = F.when(k == 15, F.unhex(F.lit("EFBBBF"))).otherwise(F.lit(b""))
    tail = F.when(k == 16, F.unhex(F.lit("FF"))).when(k == 17, F.unhex(F.lit("C3A9"))).when(k == 18, F.repeat(F.lit(" "), 1_100_000).cast("binary")).otherwise(F.lit(b""))
    files = rows.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.concat(lead, F.col("x").cast("binary"), tail).alias("content"))
    template = files.sparkSession.createDataFrame([(x,) for x in _ANSWERS], "id string")
    return S.file_problems(files, template, "e").select("rule", "entity_id")
