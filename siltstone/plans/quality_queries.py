"""Filters, contamination, duplicates and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import html as H
from ..operators import quality as Q
from ..operators.scoring import shuffled
from .base import key, ngrams, query, words

#: Pages of the tables may hold few words.
PAGES = H.PageRule(least_text=0, least_blocks=0)


_GRAMS = f"""
WITH b AS (SELECT DISTINCT unnest({ngrams('ws', 8)}) AS gram FROM (SELECT list_filter(string_split({key('text')}, ' '), lambda w: w <> '') AS ws FROM benchmark)),
m AS (SELECT doc_id, {ngrams('ws', 8)} AS g FROM (SELECT doc_id, list_filter(string_split({key('text')}, ' '), lambda w: w <> '') AS ws FROM documents)),
h AS (SELECT doc_id, count(*) AS shared FROM (SELECT doc_id, unnest(g) AS gram FROM m) JOIN b USING (gram) GROUP BY doc_id),
s AS (SELECT doc_id, len(g)::BIGINT AS grams, coalesce(shared, 0)::BIGINT AS shared FROM m LEFT JOIN h USING (doc_id)),
c AS (SELECT *, CASE WHEN grams > 0 THEN round(shared::DOUBLE / grams, 6) ELSE 0 END AS contained FROM s)"""


@query(_GRAMS + "SELECT *, contained > 0.1::DOUBLE AS contaminated FROM c")
def contamination_8gram(t):
    return Q.contamination(t("documents"), t("benchmark"))


@query("SELECT left(sha256(trim(text)), 16) AS answer_id, min(doc_id) AS first_id, count(*) AS uses FROM documents GROUP BY 1")
def exact_dups(t):
    return Q.distinct_answers(t("documents"))[0]


@query("""
SELECT d.doc_id, g.grade FROM documents d JOIN (SELECT left(sha256(trim(x.text)), 16) AS h, min(l.quality) AS grade FROM documents x JOIN labels l USING (doc_id) GROUP BY 1) g ON left(sha256(trim(d.text)), 16) = g.h""")
def grades_by_answer(t):
    first, rows = Q.distinct_answers(t("documents"))
    grades = rows.join(t("labels"), "doc_id").groupBy("answer_id").agg(F.min("quality").alias("grade"))
    return rows.join(grades, "answer_id").select("doc_id", "grade")


@query(f"""{_GRAMS},
r AS (SELECT CASE WHEN n_chars > 8000 THEN 'essay' WHEN doc_id % 10 = 9 THEN 'later_paper' WHEN trim(text) = '' THEN 'empty' WHEN len({words('text')}) < 20 THEN 'too_short' WHEN toxic = 1 THEN 'toxic' WHEN contained > 0.1::DOUBLE THEN 'contaminated' ELSE 'kept' END AS reason
      FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def filter_cascade(t):
    found = Q.contamination(t("documents"), t("benchmark")).select("doc_id", "contaminated")
    rows = t("documents").join(t("labels"), "doc_id", "left").join(found, "doc_id", "left")
    reason = Q.first_match([("essay", F.col("n_chars") > 8000), ("later_paper", F.col("doc_id") % 10 == 9), ("empty", F.trim("text") == ""), ("too_short", T.word_count(F.col("text")) < 20), ("toxic", F.col("toxic") == 1), ("contaminated", F.col("contaminated"))], "kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
SELECT doc_id, line_key FROM (SELECT doc_id, {key('split_part(text, chr(10), 1)')} AS line_key, row_number() OVER (PARTITION BY {key('split_part(text, chr(10), 1)')} ORDER BY doc_id) AS n
  FROM documents WHERE len({words('text')}) >= 320 AND len(list_filter(string_split(split_part(text, chr(10), 2), ' '), lambda w: w <> '')) > 0) WHERE n = 1""")
def bank_merge(t):
    rows = t("documents").select("doc_id", "text", T.key(T.first_line(F.col("text"))).alias("line_key"))
    topics = F.filter(F.split(F.split_part("text", F.lit("\n"), F.lit(2)), " "), lambda w: w != "")
    return Q.accepted_once(rows, Q.bank_entry(F.col("doc_id"), T.word_count(F.col("text")), topics), "line_key", "doc_id").select("doc_id", "line_key")


@query(f"""
SELECT doc_id, list_filter([CASE WHEN lang <> 'en' THEN 'period' END, CASE WHEN doc_id % 3 > 0 AND (doc_id % 5 = 0 OR {key("lang || '!'")} <> {key("CASE WHEN doc_id % 3 = 1 THEN 'ÉN' ELSE 'Dé' END")}) THEN 'intent' END,
   CASE WHEN source IS NULL OR source = 'src1' THEN 'entities' END, CASE WHEN NOT list_contains(list_transform(list_slice(string_split(text, ' '), 1, 12), lambda w: {key('w')}), 'of') THEN 'aspects' END,
   CASE WHEN len({words('text')}) < 300 THEN 'too_short' END], lambda x: x IS NOT NULL) AS reasons
FROM documents""")
def essay_exclusions(t):
    c, i = F.col("text"), F.col("doc_id")
    year = F.when(F.col("lang") == "en", 1900).otherwise(1800)
    none = F.array().cast("array<string>")
    wanted = F.when(F.col("source").isNull() | (F.col("source") == "src1"), F.array(F.lit("Żagań"))).otherwise(none)
    intent, asked = F.when(i % 5 > 0, F.concat("lang", F.lit("!"))), F.when(i % 3 == 1, "ÉN").when(i % 3 == 2, "Dé")
    reasons = Q.exclusions(year, year + 9, F.lit(1900), F.lit(1909), F.array(F.col("source")), wanted, F.slice(F.split("text", " "), 1, 12), F.array(F.lit("OF!")), T.word_count(c), 300, intent, asked)
    return t("documents").select("doc_id", reasons.alias("reasons"))


_LINE = r"regexp_matches(l, '(?i)^\s*[0-9]{1,3}\s*$') OR regexp_matches(l, '(?i)^\s*[.…_-]{5,}\s*$') OR regexp_matches(l, '(?i)^\s*(?:strona|page)\s+[0-9]+') OR regexp_matches(l, '(?i)^\s*https?://\S+\s*$')"


@query(f"SELECT doc_id, array_to_string(list_filter(string_split(text || chr(10) || '12' || chr(10) || 'https://a.b/c' || chr(10) || '......' || chr(10) || 'Strona 3 z 4', chr(10)), lambda l: NOT ({_LINE})), chr(10)) AS text FROM documents")
def drop_lines(t):
    text = F.concat("text", F.lit("\n12\nhttps://a.b/c\n......\nStrona 3 z 4"))
    return t("documents").select("doc_id", Q.clean_lines(text).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size >= 10 OR starts_with(p_name, 'Jeden tekst') THEN 'essay' WHEN starts_with(p_name, 'Tekst') THEN 'open' ELSE 'closed' END AS kind FROM part")
def item_kind(t):
    return t("part").select("p_partkey", Q.item_kind(F.col("p_size"), F.col("p_name")).alias("kind"))


@query("SELECT event_id, coalesce(value > 50 AND NOT isnan(value - 50) AND value < 'inf'::DOUBLE, false) AS good FROM events")
def finite_positive(t):
    return t("events").select("event_id", Q.finite_positive(F.col("value") - 50).alias("good"))


@query(r"""SELECT page_id, p <> '' AND NOT regexp_matches(p, '(^/|(^|/)\.\.(/|$)|\\)') AS safe
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?://[^/]*', '') WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN 'a/../' || page_id ELSE '' END AS p FROM pages)""")
def safe_path(t):
    i = F.col("page_id") % 4
    p = F.when(i == 0, F.regexp_replace("url", "^https?://[^/]*", "")).when(i == 1, F.regexp_replace("url", "^https?://", "")).when(i == 2, F.concat(F.lit("a/../"), F.col("page_id").cast("string"))).otherwise("")
    return t("pages").select("page_id", Q.safe_path(p).alias("safe"))


@query(r"""SELECT page_id, regexp_extract(url, '^https://([^/?#]*)', 1) IN ('thther.example.org', 'therin.example.net') AND starts_with(regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1), '/en/')
 AND (regexp_extract(url, '^[^?#]*\?([^#]*)', 1) = '' OR regexp_full_match(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), 'start=[0-9]+')) AS in_scope FROM pages""")
def url_scope(t):
    return t("pages").select("page_id", Q.in_scope(F.col("url"), ("thther.example.org", "therin.example.net"), "/en/").alias("in_scope"))


@query(r"""SELECT page_id, (starts_with(url, 'https://') OR (starts_with(url, 'http://') AND regexp_full_match(regexp_extract(url, '^(?:https?)://([^/?#]*)', 1), '(localhost|127\.0\.0\.1)(:[0-9]+)?')))
 AND regexp_extract(url, '^(?:https?)://([^/?#]*)', 1) <> '' AND NOT contains(regexp_extract(url, '^(?:https?)://([^/?#]*)', 1), '@') AND NOT regexp_matches(url, '[?#]') AS allowed FROM pages""")
def endpoint_rule(t):
    return t("pages").select("page_id", Q.endpoint_allowed(F.col("url")).alias("allowed"))


@query("SELECT event_id, len(list_filter(json_keys(props), lambda k: list_contains(['k', 'points'], k)))::INT AS leaked FROM events")
def field_leak(t):
    return t("events").select("event_id", F.size(Q.leaked_fields(F.col("props"), ("k", "points"))).alias("leaked"))


@query("""SELECT doc_id, CASE WHEN len(c) > 0 AND len(list_filter(c, lambda x: NOT list_contains(['1', '2', '3'], x))) = 0 THEN list_filter(['1', '2', '3'], lambda n: list_contains(c, n)) ELSE ['1', '2', '3'] END AS blocks
FROM (SELECT doc_id, list_distinct(regexp_extract_all('see src ' || (doc_id % 5)::VARCHAR || ' and src ' || (doc_id % 3)::VARCHAR, 'src\\s+([0-9]+)', 1)) AS c FROM documents)""".replace("\\\\", "\\"))
def source_blocks(t):
    prompt = F.concat(F.lit("see src "), (F.col("doc_id") % 5).cast("string"), F.lit(" and src "), (F.col("doc_id") % 3).cast("string"))
    return t("documents").select("doc_id", Q.cited_blocks(prompt, F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("blocks"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE length(trim(text)) >= 150 AND lang IN ('en', 'de')")
def short_filter(t):
    return t("documents").where((F.length(F.trim("text")) >= 150) & F.col("lang").isin("en", "de")).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, substr(text, 1, 80) AS head FROM documents ORDER BY sha256('s1' || doc_id::VARCHAR), doc_id LIMIT 50")
def seeded_sample(t):
    return shuffled(t("documents"), "s1", 50).select("doc_id", F.substring("text", 1, 80).alias("head"))


@query(r"""SELECT doc_id, trim(regexp_replace('<think>' || text || '</think> ' || text, '(?s)<think>.*?</think>', '', 'g')) AS answer,
 trim(regexp_replace('[IMG 1] ' || text || ' [image: map] end', '(?i)\[(?:image|img|obraz)[^\]]*\]', '', 'g')) AS prompt FROM documents""")
def stripped_markup(t):
    a = F.concat(F.lit("<think>"), "text", F.lit("</think> "), "text")
    return t("documents").select("doc_id", T.strip_thinking(a).alias("answer"), T.without_markers(F.concat(F.lit("[IMG 1] "), "text", F.lit(" [image: map] end"))).alias("prompt"))


_LINES = "WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), s AS (SELECT doc_id, pos, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)"


@query(_LINES + """ SELECT s.doc_id, start, coalesce(lead(start) OVER (PARTITION BY s.doc_id ORDER BY start), length(d.text)::BIGINT) AS "end", line FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE length(line) BETWEEN 1 AND 60""")
def line_segments(t):
    return C.segments(t("documents"))


@query("SELECT conv_id, turn, coalesce(sum(length(text) + 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM conversations")
def page_offsets(t):
    return C.page_offsets(t("conversations"))


@query(_LINES + """ SELECT doc_id, pos::INT AS pos, CASE WHEN count(*) OVER (PARTITION BY doc_id, line) > 1 THEN line || '~' || row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) ELSE line END AS line_id FROM s WHERE line <> ''""")
def occurrence_ids(t):
    return C.occurrence_ids(t("documents"))


@query(_LINES + """ SELECT doc_id, pos::INT AS pos, last_value(CASE WHEN length(line) BETWEEN 1 AND 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM s""")
def section_fill(t):
    return C.filled_sections(t("documents"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_seen(t):
    rows = t("documents").withColumn("k", F.struct("source", "lang"))
    return C.first_seen(rows, "k", "doc_id").select("doc_id", "source")


@query("""WITH o AS (SELECT p_partkey AS item_id, string_split(p_name, ' ') AS options FROM part)
SELECT item_id, s::INT AS shift, list_concat(options[s + 1:], options[1:s]) AS options FROM (SELECT item_id, options, unnest(range(0, len(options))) AS s FROM o)""")
def rotations(t):
    return C.rotations(t("part").select(F.col("p_partkey").alias("item_id"), F.split("p_name", " ").alias("options")))


@query(r"""
WITH RECURSIVE p AS (
  SELECT doc_id, text, -1 AS ordinal, 0::BIGINT AS start, 0::BIGINT AS stop FROM documents
  UNION ALL
  SELECT doc_id, text, ordinal + 1, stop, stop + CASE WHEN length(text) - stop <= 1300 THEN length(text) - stop
      WHEN length(regexp_extract(substr(text, stop + 1, 1300), '(?s)^(.*[.!?]\s+)', 1)) > 650 THEN length(regexp_extract(substr(text, stop + 1, 1300), '(?s)^(.*[.!?]\s+)', 1))
      WHEN length(regexp_extract(substr(text, stop + 1, 1300), '(?s)^(.*) ', 1)) > 0 THEN length(regexp_extract(substr(text, stop + 1, 1300), '(?s)^(.*) ', 1)) ELSE 1300 END
  FROM p WHERE stop < length(text))
SELECT doc_id, ordinal::INT AS ordinal, start, stop AS "end", substr(text, start + 1, stop - start) AS body, doc_id || '-' || ordinal || '-' || left(sha256(substr(text, start + 1, stop - start)), 16) AS passage_id FROM p WHERE ordinal >= 0""")
def passages(t):
    return C.passages(t("documents"))


@query(r"""SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), lambda x: trim(x, '"''')))) AS link FROM pages""")
def page_links(t):
    return C.page_links(t("pages"))


@query()
def html_blocks(t):
    return H.html_blocks(t("pages"), PAGES)


@query()
def section_passages(t):
    return H.section_passages(t("pages"), PAGES)


#: A document as a question: its sources are its lines dealt in turn, with bibliography between them; the prompt cites one, two or a missing one.
_SOURCES = "concat('Źródło 1.', chr(10), text, chr(10), 'Na podstawie: x', chr(10), ' źródło  2. ', substr(text, 1, 200), chr(10), 'see b.org or s. 12', chr(10), 'ŹRÓDŁO 3.', chr(10), source, CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), 'Źródło 1. again') ELSE '' END)"
_PROMPT = "concat('Use ', CASE doc_id % 4 WHEN 0 THEN 'źródle 2' WHEN 1 THEN 'źródła 3 and Źródło 1' WHEN 2 THEN 'źródło 9 and źródło 1' ELSE 'nothing' END, ' of ', lang)"


@query(rf"""
WITH q AS (SELECT doc_id, {_SOURCES} AS s, {_PROMPT} AS p FROM documents),
b AS (SELECT doc_id, s, regexp_extract_all(s, '{Q.SOURCE_HEAD}', 1) AS ids, string_split_regex(s, '{Q.SOURCE_HEAD}')[2:] AS bodies, list_sort(list_distinct(regexp_extract_all(p, '{Q.SOURCE_CITED}', 1))) AS cited FROM q),
k AS (SELECT *, len(cited) > 0 AND len(list_filter(cited, lambda c: NOT list_contains(ids, c))) = 0 AS known FROM b),
f AS (SELECT doc_id, known, cited, CASE WHEN known THEN array_to_string(list_transform(list_filter(list_filter(range(1, len(ids) + 1), lambda i: list_position(ids, ids[i]) = i), lambda i: list_contains(cited, ids[i])),
   lambda i: bodies[list_max(list_filter(range(1, len(ids) + 1), lambda j: ids[j] = ids[i]))]), chr(10)) ELSE s END AS x FROM k)
SELECT doc_id, sha256(array_to_string(list_filter(string_split_regex(x, '\r\n|\r|\n'), lambda l: NOT regexp_matches(l, '{Q.REFERENCE_LINE}')), chr(10))) AS text_sha256, CASE WHEN known THEN array_to_string(cited, ',') ELSE '' END AS cited FROM f""")
def cited_sources(t):
    rows = t("documents").selectExpr("doc_id", f"{_SOURCES} AS s", f"{_PROMPT} AS p").select("doc_id", Q.question_source(F.col("p"), F.col("s")).alias("x"))
    return rows.select("doc_id", F.sha2("x.text", 256).alias("text_sha256"), F.array_join("x.cited", ",").alias("cited"))


_SHEET = "concat('  Strona 3 z 12', chr(10), text, chr(12), '0–1–2', chr(10), ' ......___  ', chr(10), 'Name ………… here', chr(10), 'Uzasadnienie: ......', chr(10), 'MHIP-2024 x', chr(10), '12.3.', chr(10), chr(9), 'Więcej arkuszy', chr(10), source)"


def _furniture(rule):
    dots = f"list_transform(b, lambda x: regexp_replace(x, '{rule['dots']}', ' …', 'g'))" if rule["dots"] else "b"
    whole = "(?:" + "|".join(rule["whole"]) + ")"
    starts = "".join(f" OR starts_with(d[i], '{x}')" for x in rule["begins"])
    return f"(SELECT sha256(array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: NOT (b[i] = '' OR regexp_full_match(b[i], '{whole}') OR regexp_full_match(d[i], '{whole}'){starts})), lambda i: d[i]), chr(10))) FROM (SELECT b, {dots} AS d))"


@query(rf"""
WITH l AS (SELECT doc_id, list_transform(string_split_regex({_SHEET}, '\r\n|\r|\n|\f'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS b FROM documents)
SELECT doc_id, {_furniture(Q.SHEET)} AS sheet_sha256, {_furniture(Q.PAPER)} AS paper_sha256 FROM l""")
def furniture(t):
    rows = t("documents").selectExpr("doc_id", f"{_SHEET} AS s")
    return rows.select("doc_id", F.sha2(Q.without_furniture(F.col("s"), Q.SHEET), 256).alias("sheet_sha256"), F.sha2(Q.without_furniture(F.col("s"), Q.PAPER), 256).alias("paper_sha256"))


@query(r"""SELECT page_id, list_filter([CASE WHEN page_id % 7 = 0 THEN 'missing' END, CASE WHEN page_id % 5 = 0 THEN 'disambiguation' END, CASE WHEN length(regexp_replace(coalesce(x, ''), '^\s+|\s+$', '', 'g')) < 150 THEN 'too_short' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT page_id, CASE WHEN page_id % 7 > 0 THEN regexp_extract(html, '<h1>(.*?)</h1>', 1) || repeat(' ', page_id % 200) || regexp_extract(html, '<p>([^<]*)</p>', 1) END AS x FROM pages)""")
def article_filter(t):
    i = F.col("page_id")
    text = F.when(i % 7 > 0, F.concat(F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.repeat(F.lit(" "), (i % 200).cast("int")), F.regexp_extract("html", "<p>([^<]*)</p>", 1)))
    return t("pages").select("page_id", Q.article_reasons(i % 7 == 0, i % 5 == 0, text).alias("reasons"))
