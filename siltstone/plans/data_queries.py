"""Datasets, corpora and indexes, with violations planted by the rows' own numbers.  Expressions are read by both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as D
from ..operators import embedding as E
from .base import query


def _sql(columns: dict) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def _exprs(columns: dict) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


_MARKING = "concat('Intro', chr(10), 'Zadanie ', p_partkey, '. (0–', p_size % 4, ')', chr(10), p_name, chr(10), p_brand, chr(10), 'Zadanie ', p_partkey, '.1. (0-2) ', p_type, chr(10))"


@query(rf"""WITH p AS (SELECT p_partkey, {_MARKING} AS t FROM part),
e AS (SELECT p_partkey, regexp_extract_all(t, '{D.MARKING_HEAD}', 1) AS ids, regexp_extract_all(t, '{D.MARKING_HEAD}', 2) AS pts, string_split_regex(t, '{D.MARKING_HEAD}') AS parts FROM p)
SELECT p_partkey, ids[i] AS id, pts[i]::INT AS max_points, regexp_replace(parts[i + 1], '^\s+|\s+$', '', 'g') AS body FROM e, range(1, 10) r(i) WHERE i <= len(ids)""")
def marking_entries(t):
    rows = t("part").selectExpr("p_partkey", f"{_MARKING} AS t")
    return rows.select("p_partkey", F.explode(D.marking_entries(F.col("t"))).alias("m")).select("p_partkey", "m.*")


@query("""WITH i AS (SELECT l_orderkey AS k, l_linenumber AS id, l_quantity + CASE WHEN l_linenumber = 5 AND l_quantity > 40 THEN 1 ELSE 0 END AS n FROM lineitem WHERE NOT (l_linenumber = 3 AND l_quantity < 10)),
m0 AS (SELECT l_orderkey AS k, l_linenumber AS id, l_quantity AS m FROM lineitem WHERE NOT (l_linenumber = 4 AND l_quantity < 10)), m AS (FROM m0 UNION ALL (FROM m0 WHERE id = 6 AND m > 45)),
b AS (SELECT coalesce(m.k, i.k) AS k, coalesce(m.id, i.id) AS id, m, n FROM m FULL JOIN i ON m.k = i.k AND m.id = i.id)
SELECT rule, k::VARCHAR AS entity_id, id::VARCHAR AS detail FROM (
  SELECT 'without_item' AS rule, k, id FROM b WHERE n IS NULL UNION ALL SELECT 'without_marking', k, id FROM b WHERE m IS NULL UNION ALL SELECT 'marking_points', k, id FROM b WHERE m <> n
  UNION ALL SELECT 'duplicate_marking', k, id FROM m GROUP BY k, id HAVING count(*) > 1)""")
def marking_check(t):
    l = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("max_points"))
    items = l.where("NOT (id = 3 AND max_points < 10)").withColumn("max_points", F.expr("max_points + CASE WHEN id = 5 AND max_points > 40 THEN 1 ELSE 0 END"))
    marking = l.where("NOT (id = 4 AND max_points < 10)")
    return D.marking_problems(marking.unionByName(marking.where("id = 6 AND max_points > 45")), items, "k")


_TASK = {"task_id": "p_partkey", "exam_id": "CASE WHEN p_partkey % 97 = 0 THEN 'other' ELSE 'e' END", "max_points": "p_size", "image": "p_brand", "source_id": "p_partkey % 110", "page": "p_size % 6 + 1", "stop": "p_size % 25"}
_SOURCE = {"source_id": "s_suppkey", "kind": "CASE s_suppkey % 10 WHEN 0 THEN 'grading_pdf' WHEN 1 THEN 'image' ELSE 'pdf' END", "local_path": "concat('Brand#', s_suppkey % 60)", "n_pages": "CASE WHEN s_suppkey % 10 > 1 THEN 2 + s_suppkey % 4 END"}
_KEY = {"task_id": "CASE WHEN p_partkey % 89 = 0 THEN p_partkey + 1000000 ELSE p_partkey END", "max_points": "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END", "source_id": "p_partkey % 105"}


@query(f"""WITH t0 AS (SELECT {_sql(_TASK)} FROM part), t AS (FROM t0 UNION ALL (FROM t0 WHERE task_id % 101 = 0)), s AS (SELECT {_sql(_SOURCE)} FROM supplier), k AS (SELECT {_sql(_KEY)} FROM part),
g AS (SELECT s_suppkey AS source_id, i AS page, s_name AS text FROM supplier, range(1, 6) r(i) WHERE i <= 2 + s_suppkey % 3 AND s_suppkey % 10 > 1),
v AS (
  SELECT 'missing_source' AS rule, task_id AS e, source_id::VARCHAR AS d FROM t WHERE source_id NOT IN (SELECT source_id FROM s)
  UNION ALL SELECT 'grading_source', task_id, source_id::VARCHAR FROM t JOIN s USING (source_id) WHERE s.kind = 'grading_pdf'
  UNION ALL SELECT 'page_outside', task_id, source_id::VARCHAR FROM t JOIN s USING (source_id) WHERE page > n_pages
  UNION ALL SELECT 'span_without_page', task_id, t.source_id || '/' || t.page FROM t LEFT JOIN g ON t.source_id = g.source_id AND t.page = g.page WHERE g.page IS NULL
  UNION ALL SELECT 'span_beyond_page', task_id, t.source_id || '/' || t.page FROM t LEFT JOIN g ON t.source_id = g.source_id AND t.page = g.page WHERE stop > length(text) OR stop <= 0
  UNION ALL SELECT 'key_without_task', k.task_id, k.max_points::VARCHAR FROM k WHERE k.task_id NOT IN (SELECT task_id FROM t)
  UNION ALL SELECT 'key_points', k.task_id, k.max_points::VARCHAR FROM k JOIN t USING (task_id) WHERE k.max_points <> t.max_points
  UNION ALL SELECT 'duplicate_task', task_id, count(*)::VARCHAR FROM t GROUP BY task_id HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_source', source_id, count(*)::VARCHAR FROM s GROUP BY source_id HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_key', task_id, count(*)::VARCHAR FROM k GROUP BY task_id HAVING count(*) > 1
  UNION ALL SELECT 'unregistered_image', task_id, image FROM t WHERE image NOT IN (SELECT local_path FROM s WHERE kind = 'image')
  UNION ALL SELECT 'key_missing_source', task_id, source_id::VARCHAR FROM k WHERE source_id NOT IN (SELECT source_id FROM s)
  UNION ALL SELECT 'incomplete_pages', s.source_id, count(*)::VARCHAR FROM s JOIN g USING (source_id) WHERE n_pages IS NOT NULL GROUP BY s.source_id, n_pages HAVING count(*) <> n_pages
  UNION ALL SELECT 'foreign_exam', task_id, exam_id FROM t WHERE exam_id <> 'e')
SELECT rule, e::VARCHAR AS entity_id, d AS detail FROM v""")
def dataset_check(t):
    span = F.struct(F.col("page").cast("int").alias("page"), F.lit(0).alias("start"), F.col("stop").cast("int").alias("end"))
    ref = F.struct("source_id", F.array(F.col("page").cast("int")).alias("pages"), F.array(span).alias("spans"))
    tasks = t("part").selectExpr(*_exprs(_TASK)).select("task_id", "exam_id", "max_points", F.array("image").alias("image_paths"), F.array(ref).alias("refs"))
    tasks = tasks.unionByName(tasks.where("task_id % 101 = 0"))
    sources = t("supplier").selectExpr(*_exprs(_SOURCE))
    keys = t("part").selectExpr(*_exprs(_KEY)).select("task_id", "max_points", F.array("source_id").alias("refs"))
    pages = t("supplier").where("s_suppkey % 10 > 1").select(F.col("s_suppkey").alias("source_id"), F.explode(F.sequence(F.lit(1), (F.col("s_suppkey") % 3 + 2).cast("int"))).alias("page"), F.col("s_name").alias("text"))
    return D.dataset_problems(tasks, sources, keys, pages, "e")


_ARTICLE = {
    "article_id": "doc_id",
    "kind": "CASE WHEN doc_id % 43 = 0 THEN 'other' ELSE lang END",
    "title": "substr(text, 1, 12)",
    "text": "text",
    "text_sha256": "CASE WHEN doc_id % 29 = 0 THEN 'x' ELSE sha END",
    "source": "concat('https://', CASE WHEN doc_id % 17 = 0 THEN 'bad' ELSE lang END, '.org/wiki/', doc_id, CASE WHEN doc_id % 19 = 0 THEN '?start=1' ELSE '' END)",
    "licence": "CASE WHEN doc_id % 23 = 0 THEN 'none' ELSE 'CC BY-SA 4.0' END",
}
_STOP = "CASE WHEN doc_id % 37 = 0 THEN 1000000 ELSE length(text) END"
_PASSAGE = {
    "id": "concat('p', doc_id)",
    "article_id": "CASE WHEN doc_id % 41 = 0 THEN -doc_id - 1 ELSE doc_id END",
    "title": "substr(text, 1, 12)",
    "section": "source",
    "start": "0",
    "stop": _STOP,
    "prefix": "concat(substr(text, 1, 12), CASE WHEN doc_id % 47 = 0 THEN ' - ' ELSE ' — ' END, source, chr(10))",
    "body": "text",
    "licence": "CASE WHEN doc_id % 53 = 0 THEN 'none' WHEN doc_id % 23 = 0 THEN 'none' ELSE 'CC BY-SA 4.0' END",
    "source": _ARTICLE["source"],
}
_SCOPES = {lang: (f"{lang}.org", "/wiki/", "CC BY-SA") for lang in ("en", "de", "fr", "es")}


@query(f"""WITH d AS (SELECT *, sha256(text) AS sha FROM documents), a AS (SELECT {_sql(_ARTICLE)} FROM d),
p0 AS (SELECT {_sql(_PASSAGE)} FROM d WHERE doc_id % 31 <> 0), p1 AS (SELECT * EXCLUDE (stop, body), stop AS "end", prefix || body AS text, sha256(CASE WHEN id LIKE '%77' THEN 'x' ELSE body END) AS body_sha256 FROM p0),
p AS (FROM p1 UNION ALL (FROM p1 WHERE id LIKE '%99')),
h AS (SELECT p.*, a.text AS t, a.title AS t2, a.licence AS l2, a.source AS s2, "end" <= length(a.text) AND start < "end" AS inside, a.article_id IS NOT NULL AS known, a.text AS held FROM p LEFT JOIN a USING (article_id)),
v AS (
  SELECT 'text_hash' AS rule, article_id::VARCHAR AS e, source AS d FROM a WHERE sha256(text) <> text_sha256
  UNION ALL SELECT 'scope', article_id::VARCHAR, source FROM a WHERE NOT (kind IN ('en', 'de', 'fr', 'es') AND starts_with(source, 'https://' || kind || '.org/wiki/') AND NOT contains(source, '?') AND starts_with(licence, 'CC BY-SA'))
  UNION ALL SELECT 'unknown_article', id, article_id::VARCHAR FROM h WHERE NOT known
  UNION ALL SELECT 'span', id, article_id::VARCHAR FROM h WHERE known AND NOT inside
  UNION ALL SELECT 'body_hash', id, article_id::VARCHAR FROM h WHERE known AND inside AND sha256(held) <> body_sha256
  UNION ALL SELECT 'prefix', id, article_id::VARCHAR FROM h WHERE known AND prefix <> t2 || ' — ' || section || chr(10)
  UNION ALL SELECT 'passage_text', id, article_id::VARCHAR FROM h WHERE known AND inside AND text <> prefix || held
  UNION ALL SELECT 'provenance', id, article_id::VARCHAR FROM h WHERE known AND (source <> s2 OR licence <> l2 OR title <> t2)
  UNION ALL SELECT 'duplicate_id', id, count(*)::VARCHAR FROM p GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'unrepresented', article_id::VARCHAR, title FROM a WHERE article_id NOT IN (SELECT article_id FROM p))
SELECT rule, e AS entity_id, d AS detail FROM v""")
def corpus_check(t):
    d = t("documents").withColumn("sha", F.sha2("text", 256))
    p = d.where("doc_id % 31 <> 0").selectExpr(*_exprs(_PASSAGE)).withColumn("text", F.concat("prefix", "body"))
    p = p.withColumn("body_sha256", F.sha2(F.when(F.col("id").endswith("77"), "x").otherwise(F.col("body")), 256)).withColumnRenamed("stop", "end").drop("body")
    return D.corpus_problems(d.selectExpr(*_exprs(_ARTICLE)), p.unionByName(p.where("id LIKE '%99'")), _SCOPES)


_ITEMS_JSON = "concat('[{\"id\": \"', o_orderkey, '\", \"question\": \"q\", \"max_points\": ', o_orderkey % 7, CASE WHEN o_orderkey % 13 = 0 THEN ', \"rubric\": {\"a\": 1}' ELSE '' END, '}, {\"id\": \"', CASE o_orderkey % 17 WHEN 0 THEN concat('', o_orderkey) WHEN 1 THEN '' ELSE 'b' END, '\", \"max_points\": 2, \"images\": [{\"path\": \"', CASE o_orderkey % 19 WHEN 0 THEN '../x' WHEN 1 THEN 'none' ELSE 'a.png' END, '\", \"sha256\": \"', CASE WHEN o_orderkey % 23 = 0 THEN 'y' ELSE 'x' END, '\", \"source_page\": 3}]}]')"


@query(f"""WITH e AS (SELECT o_orderkey AS k, {_ITEMS_JSON} AS js, CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE o_orderkey % 7 + 2 END AS declared FROM orders),
i AS (SELECT k, declared, unnest(from_json(js, '["JSON"]')) AS j FROM e), f AS (SELECT k, declared, j, j ->> '$.id' AS id, json_keys(j) AS ks, (j ->> '$.max_points')::INT AS pts, j ->> '$.images[0].path' AS path, j ->> '$.images[0].sha256' AS sha FROM i),
n AS (SELECT DISTINCT k, id FROM f), m AS (SELECT k, k::VARCHAR AS id FROM e UNION ALL SELECT k, 'b' FROM e WHERE k % 31 <> 0)
SELECT rule, e::VARCHAR AS entity_id, d AS detail FROM (
  SELECT 'empty_id' AS rule, k::VARCHAR AS e, id AS d FROM f WHERE id = ''
  UNION ALL SELECT 'answer_field', k::VARCHAR, id FROM f WHERE list_has_any(ks, ['answer', 'expected', 'correct_answer', 'solution', 'rubric'])
  UNION ALL SELECT 'unsafe_path', id, path FROM f WHERE path = '../x'
  UNION ALL SELECT 'missing_image', id, path FROM f WHERE path <> 'a.png'
  UNION ALL SELECT 'changed_image', id, path FROM f WHERE path = 'a.png' AND sha <> 'x'
  UNION ALL SELECT 'declared_total', k::VARCHAR, sum(pts)::DOUBLE::VARCHAR FROM f GROUP BY k, declared HAVING sum(pts) <> declared
  UNION ALL SELECT 'duplicate_id', k::VARCHAR, id FROM f WHERE id <> '' GROUP BY k, id HAVING count(*) > 1
  UNION ALL SELECT 'item_without_kind', k::VARCHAR, id FROM n ANTI JOIN m USING (k, id)
  UNION ALL SELECT 'kind_without_item', k::VARCHAR, id FROM m ANTI JOIN n USING (k, id))""")
def import_check(t):
    o = t("orders")
    exams = o.select(F.col("o_orderkey").alias("exam_id"), F.expr(_ITEMS_JSON).alias("items"), F.expr("CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE o_orderkey % 7 + 2 END").cast("double").alias("max_points"))
    kinds = o.select(F.col("o_orderkey").alias("exam_id"), F.col("o_orderkey").cast("string").alias("id"), F.lit("open").alias("kind"))
    kinds = kinds.unionByName(o.where("o_orderkey % 31 <> 0").select(F.col("o_orderkey").alias("exam_id"), F.lit("b").alias("id"), F.lit("open").alias("kind")))
    return D.import_problems(exams, kinds, exams.sparkSession.createDataFrame([("a.png", "x")], "path string, sha256 string"))


@query("""WITH x0 AS (SELECT vec_id + CASE WHEN vec_id % 41 = 0 THEN 1000000 ELSE 0 END AS doc_id, CASE WHEN vec_id % 7 = 0 THEN 'stale' ELSE sha256(vec_id::VARCHAR) END AS text_sha256, CASE WHEN vec_id % 11 = 0 THEN 'old' ELSE 'm' END AS embedder,
   list_transform(embedding, lambda v: v::DOUBLE * CASE WHEN vec_id % 13 = 0 THEN 2 ELSE 1 END / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))[1:CASE WHEN vec_id % 17 = 0 THEN 63 ELSE 64 END] AS vector FROM embeddings),
x AS (SELECT * FROM x0 UNION ALL SELECT * FROM x0 WHERE doc_id % 19 = 3),
d AS (SELECT vec_id AS doc_id, sha256(vec_id::VARCHAR) AS sha FROM embeddings),
b AS (SELECT coalesce(x.doc_id, d.doc_id) AS doc_id, x.* EXCLUDE doc_id, sha FROM x FULL JOIN d ON x.doc_id = d.doc_id)
SELECT 'indexed_twice' AS rule, doc_id::VARCHAR AS entity_id, count(*)::VARCHAR AS detail FROM x GROUP BY doc_id HAVING count(*) > 1 UNION ALL
SELECT rule, doc_id::VARCHAR AS entity_id, embedder AS detail FROM (
  SELECT 'not_indexed' AS rule, doc_id, embedder FROM b WHERE vector IS NULL UNION ALL SELECT 'unknown_text', doc_id, embedder FROM b WHERE vector IS NOT NULL AND sha IS NULL
  UNION ALL SELECT 'stale', doc_id, embedder FROM b WHERE text_sha256 <> sha UNION ALL SELECT 'embedder', doc_id, embedder FROM b WHERE embedder <> 'm'
  UNION ALL SELECT 'size', doc_id, embedder FROM b WHERE len(vector) <> 64 UNION ALL SELECT 'not_unit', doc_id, embedder FROM b WHERE abs(list_dot_product(vector, vector) - 1) > 1e-6)""")
def index_gate(t):
    from ..operators.retrieval import unit

    v = t("embeddings")
    longer = F.when(F.col("vec_id") % 13 == 0, 2.0).otherwise(1.0)
    vector = F.slice(F.transform(unit(F.col("embedding")), lambda x: x * longer), F.lit(1), F.when(F.col("vec_id") % 17 == 0, 63).otherwise(64))
    text = F.col("vec_id").cast("string")
    index = v.select((F.col("vec_id") + F.when(F.col("vec_id") % 41 == 0, 1_000_000).otherwise(0)).alias("doc_id"), F.when(F.col("vec_id") % 7 == 0, "stale").otherwise(F.sha2(text, 256)).alias("text_sha256"), F.when(F.col("vec_id") % 11 == 0, "old").otherwise("m").alias("embedder"), vector.alias("vector"))
    index = index.unionByName(index.where("doc_id % 19 = 3"))
    return E.index_problems(index, v.select(F.col("vec_id").alias("doc_id"), text.alias("text")), "m", 64)


@query("""SELECT rule, url AS entity_id, sha AS detail FROM (SELECT url, CASE WHEN page_id % 5 = 0 THEN 'x' ELSE sha256(html) END AS sha, html, CASE WHEN page_id % 7 = 0 THEN url || '#' ELSE url END AS final FROM pages) p,
  (VALUES ('changed'), ('redirected'), ('too_large')) r(rule) WHERE CASE rule WHEN 'changed' THEN sha256(html) <> sha WHEN 'redirected' THEN final <> url ELSE strlen(html) > 2000 END""")
def cache_check(t):
    p = t("pages")
    sha = F.when(F.col("page_id") % 5 == 0, "x").otherwise(F.sha2("html", 256))
    final = F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("#"))).otherwise(F.col("url"))
    return D.cache_problems(p.select("url", "html", sha.alias("sha256"), final.alias("final_url")), 2000)


@query("""SELECT task_id, CASE WHEN r.kind IS NOT NULL THEN r.kind ELSE t.kind END AS kind, coalesce(r.max_points, t.max_points) AS max_points, problems
FROM (SELECT doc_id AS task_id, lang AS kind, n_chars % 5 AS max_points, [source] AS problems, doc_id % 3 = 0 AS ready FROM documents) t LEFT JOIN (SELECT doc_id, 'seen' AS kind, quality AS max_points FROM labels) r ON doc_id = task_id WHERE NOT (ready OR r.kind IS NOT NULL)""")
def review_queue(t):
    tasks = t("documents").selectExpr("doc_id AS task_id", "lang AS kind", "n_chars % 5 AS max_points", "array(source) AS problems", "doc_id % 3 = 0 AS ready")
    return D.review_queue(D.review(tasks, t("labels").selectExpr("doc_id AS task_id", "'seen' AS kind", "quality AS max_points").join(tasks.select("task_id"), "task_id", "left_semi")))


@query("""SELECT p_brand AS exam_id, p_partkey AS id, p_name AS question, p_size AS max_points, ['p/' || p_type] AS image_paths,
  CASE WHEN p_size > 40 THEN NULL WHEN p_partkey % 3 = 0 THEN 'A' WHEN p_partkey % 3 = 1 THEN '1: P' || chr(10) || '2: F' || chr(10) || '3: P' END AS answer_format FROM part WHERE p_size <= 40 OR p_partkey % 2 = 0""")
def development_papers(t):
    p = t("part")
    rows = p.select(F.col("p_brand").alias("exam_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.col("p_size").alias("max_points"), F.array("p_type").alias("image_paths"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "choice").when(F.col("p_partkey") % 3 == 1, "labelled_components").otherwise("manual")
    keys = p.where("p_size <= 40").select(F.col("p_brand").alias("exam_id"), F.col("p_partkey").alias("id"), kind.alias("key_kind"), F.array(*map(F.lit, "123")).alias("labels"), F.array(F.lit("P"), F.lit("F")).alias("allowed_values"))
    return D.development_paper(rows.where("max_points <= 40"), rows.where("max_points > 40 AND id % 2 = 0"), keys, "p")
