"""Reports and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import gates as G
from ..operators import reporting as P
from ..operators.joins import deals
from ..sources.io import manifest
from .base import query


@query("SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type")
def latency_stats(t):
    return P.latency(t("events"), "event_type", "value")


_ITEMS = "SELECT d.doc_id AS item_id, d.lang, d.source, l.quality AS points, 1 + d.doc_id % 3 AS max_points, d.doc_id % 11 <> 0 AS selected FROM documents d LEFT JOIN labels l USING (doc_id)"


def _items(t):
    d = t("documents").join(t("labels").select("doc_id", F.col("quality").alias("points")), "doc_id", "left")
    return d.select(F.col("doc_id").alias("item_id"), "lang", "source", "points", (F.col("doc_id") % 3 + 1).alias("max_points"), (F.col("doc_id") % 11 != 0).alias("selected"))


_BOUNDS = "count(*) AS items, count(*) FILTER (selected AND points IS NOT NULL) AS graded, count(*) FILTER (selected AND points IS NULL) AS pending, count(*) FILTER (NOT selected) AS excluded, coalesce(sum(points) FILTER (selected), 0)::BIGINT AS lower, (coalesce(sum(points) FILTER (selected), 0) + coalesce(sum(max_points) FILTER (selected AND points IS NULL), 0))::BIGINT AS upper, sum(max_points)::BIGINT AS whole"


@query(f"SELECT lang, source, {_BOUNDS} FROM ({_ITEMS}) GROUP BY GROUPING SETS ((lang), (lang, source))")
def bounds_by_group(t):
    return P.bounds(_items(t), [["lang"], ["lang", "source"]], ["lang", "source"])


@query(f"""SELECT source, CASE WHEN pending > 0 AND source <> 'src1' THEN 'grading_incomplete' WHEN lower % 3 = 1 THEN 'invalid_submission_format' WHEN lower >= 10 THEN 'target_reached' ELSE 'below_target' END AS status FROM (SELECT source, {_BOUNDS} FROM ({_ITEMS}) GROUP BY source)""")
def target_status(t):
    b = P.bounds(_items(t), [["source"]], ["source"])
    pending = F.when(F.col("source") == "src1", 0).otherwise(F.col("pending"))
    return b.select("source", P.target_status(F.lit(0), pending, F.when(F.col("lower") % 3 == 1, 1).otherwise(0), F.col("lower"), F.lit(10)).alias("status"))


@query(f"SELECT count(*) AS papers, sum(lower)::BIGINT AS lower, sum(upper)::BIGINT AS upper, sum(whole)::BIGINT AS whole, bool_and(pending = 0) AS complete, CASE WHEN bool_and(pending = 0) THEN round(sum(lower) * 100.0::DOUBLE / sum(whole), 4) END AS percent FROM (SELECT lang, {_BOUNDS} FROM ({_ITEMS}) GROUP BY lang)")
def suite(t):
    return P.suite(P.bounds(_items(t), [["lang"]], ["lang"]))


@query("""SELECT event_type, sum(k)::BIGINT AS known, count(k) AS reported, (greatest(sum(1 + event_id % 2), count(*)) - count(k))::BIGINT AS unknown
FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN (props->>'$.k')::BIGINT END AS k FROM events) GROUP BY event_type""")
def token_usage(t):
    k = F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k").cast("long"))
    return P.tokens_used(t("events"), "event_type", k, F.lit(1) + F.col("event_id") % 2)


@query("SELECT count(*) AS tasks, count(*) FILTER (quality = 1) AS ready, coalesce(sum(quality), 0)::BIGINT AS points, count(*) FILTER (quality IS NULL) AS unknown FROM documents LEFT JOIN labels USING (doc_id)")
def dataset_summary(t):
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return rows.agg(F.count("*").alias("tasks"), F.count_if(F.col("quality") == 1).alias("ready"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("points"), F.count_if(F.col("quality").isNull()).alias("unknown"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_keys(t):
    return G.orphans(t("labels"), t("documents").where("lang = 'en'"), "doc_id").select("doc_id", "quality")


@query("SELECT 'missing_order' AS rule, l_orderkey::VARCHAR AS entity_id, l_linenumber::VARCHAR AS detail FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL UNION ALL SELECT 'shipped_before_order', l_orderkey::VARCHAR, l_linenumber::VARCHAR FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate")
def reference_check(t):
    n = deals(t("lineitem"), t("orders"))  # both joins take the same shuffles
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").repartition(n, "l_orderkey")
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate").repartition(n, "o_orderkey")
    missing = l.join(o.where("o_orderstatus <> 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    early = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate")
    return G.together(G.violation(missing, "missing_order", F.col("l_orderkey"), F.col("l_linenumber")), G.violation(early, "shipped_before_order", F.col("l_orderkey"), F.col("l_linenumber")))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def dup_ids(t):
    return G.duplicates(t("documents"), "source", "lang")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' END AS problem FROM (SELECT doc_id FROM documents WHERE lang <> 'fr') d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL")
def template_diff(t):
    return G.membership(t("documents").where("lang <> 'fr'"), t("labels"), "doc_id")


@query("SELECT doc_id, quality, 'left' AS side FROM (SELECT doc_id, quality FROM labels EXCEPT ALL SELECT doc_id, quality FROM labels WHERE toxic = 0) UNION ALL SELECT doc_id, quality, 'right' FROM (SELECT doc_id, quality FROM labels WHERE toxic = 0 EXCEPT ALL SELECT doc_id, quality FROM labels)")
def bag_equal(t):
    rows = t("labels")
    return G.unequal(rows.select("doc_id", "quality"), rows.where("toxic = 0").select("doc_id", "quality"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def set_diff(t):
    return t("documents").where("lang = 'en'").select("doc_id").distinct().join(t("labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM documents WHERE n_chars > 1000) GROUP BY doc_id HAVING count(*) > 1")
def union_collisions(t):
    d = t("documents")
    return G.duplicates(d.where("lang = 'en'").select("doc_id").unionByName(d.where("n_chars > 1000").select("doc_id")), "doc_id").select("doc_id")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS declared, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice HAVING abs(sum(l_extendedprice) - o_totalprice) > 0.005::DOUBLE")
def declared_total(t):
    sums = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    return t("orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).where("abs(s - o_totalprice) > 0.005D").select("o_orderkey", F.round("o_totalprice", 2).alias("declared"), F.round("s", 2).alias("total"))


@query("SELECT l_orderkey, l_linenumber, p_size, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > p_size AND p_size IS NOT NULL")
def points_mismatch(t):
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).where("l_quantity > p_size").select("l_orderkey", "l_linenumber", "p_size", "l_quantity")


@query("SELECT doc_id AS bad, CASE doc_id % 10 WHEN 0 THEN 'span' ELSE 'unrepresented' END AS rule FROM documents WHERE text <> '' AND doc_id % 10 < 2")
def span_check(t):
    """Of every tenth document the first passage is spoilt, of every tenth all passages are lost; all others must be found whole."""
    docs = t("documents")
    cut = C.passages(docs).where("doc_id % 10 <> 1")
    cut = cut.withColumn("body", F.when((F.col("doc_id") % 10 == 0) & (F.col("ordinal") == 0), F.concat("body", F.lit("x"))).otherwise(F.col("body")))
    bad = G.bad_spans(cut, docs).select(F.col("doc_id").alias("bad"), F.lit("span").alias("rule"))
    return bad.unionByName(G.unrepresented(docs.where("text <> ''"), cut).select(F.col("doc_id").alias("bad"), F.lit("unrepresented").alias("rule")))


@query("SELECT doc_id, quality, toxic FROM labels EXCEPT SELECT doc_id, quality, 0 FROM labels")
def regrade_check(t):
    rows = t("labels")
    return G.unequal(rows, rows.withColumn("toxic", F.lit(0))).where("side = 'left'").drop("side")


@query("""SELECT 'points_above_max' AS rule, l_orderkey::VARCHAR || '/' || l_linenumber AS entity_id, l_discount::VARCHAR AS detail FROM lineitem WHERE l_discount > 0.09::DOUBLE
UNION ALL SELECT 'failed_with_points', l_orderkey::VARCHAR || '/' || l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45
UNION ALL SELECT 'unknown_item', l_orderkey::VARCHAR || '/' || l_linenumber, l_partkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def run_rows_check(t):
    l = t("lineitem").withColumn("e", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    e = F.col("e")
    unknown = l.join(t("part").where("p_size > 5"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    found = [G.violation(l.where("l_discount > 0.09D"), "points_above_max", e, F.col("l_discount")), G.violation(l.where("l_returnflag = 'R' AND l_quantity > 45"), "failed_with_points", e, F.col("l_returnflag")), G.violation(unknown, "unknown_item", e, F.col("l_partkey"))]
    return G.together(*found)


@query("SELECT name, rows FROM (SELECT 'labels' AS name, count(*) AS rows FROM labels UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages)")
def manifest_counts(t):
    return manifest({n: t(n) for n in ("labels", "documents", "pages")}).select("name", "rows")


@query("SELECT doc_id, source, lang, n_chars FROM documents")
def whitelisted(t):
    return t("documents").select("doc_id", "source", "lang", "n_chars")


@query("""SELECT vec_id, 'not_unit' AS rule FROM embeddings WHERE abs(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) > 1e-3 UNION ALL SELECT vec_id, 'dimension' FROM embeddings WHERE len(embedding) <> 64 UNION ALL SELECT vec_id, 'label' FROM embeddings WHERE label > 8""")
def embedding_index_check(t):
    from ..operators.retrieval import dot

    v = t("embeddings")
    e = F.col("embedding")
    rules = {"not_unit": F.abs(dot(e, e) - 1) > 1e-3, "dimension": F.size(e) != 64, "label": F.col("label") > 8}
    return reduce(DataFrame.unionByName, [v.where(c).select("vec_id", F.lit(n).alias("rule")) for n, c in rules.items()])


@query("""SELECT d.doc_id, CASE WHEN d.source = 'src0' THEN 'has_sources' WHEN d.n_chars < 300 THEN 'unknown_minimum' WHEN r.k IS NULL THEN 'not_reviewed' ELSE 'routed' END AS route
FROM documents d LEFT JOIN (SELECT DISTINCT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM documents WHERE lang = 'en') r ON trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')) = r.k""".replace("\\\\", "\\"))
def essay_route(t):
    from ..operators.quality import first_match

    d = t("documents").withColumn("k", F.sha2(T.squeezed(F.col("text")), 256))
    known = d.where("lang = 'en'").select("k").distinct().withColumn("reviewed", F.lit(True))
    rows = d.join(known, "k", "left")
    return rows.select("doc_id", first_match([("has_sources", F.col("source") == "src0"), ("unknown_minimum", F.col("n_chars") < 300), ("not_reviewed", F.col("reviewed").isNull())], "routed").alias("route"))
