"""Runs of a system over documents as items: their rows follow from the documents by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from .base import query

_ITEM = {"item_id": "doc_id", "type": "lang", "max_points": "1 + doc_id % 3", "question_hash": "left(sha2, 16)", "selected": "doc_id % 11 <> 0"}
_STATUS = "CASE doc_id % 9 WHEN 1 THEN 'error' WHEN 2 THEN 'over_budget' WHEN 3 THEN 'abstained' ELSE 'ok' END"
_ROW = {
    "item_id": "doc_id",
    "type": "lang",
    "max_points": "1 + doc_id % 3",
    "question_hash": "left(sha2, 16)",
    "status": _STATUS,
    "points": f"CASE WHEN ({_STATUS}) <> 'ok' THEN 0 ELSE quality END",
    "seconds": "n_chars / 100.0",
    "calls": "1 + doc_id % 2",
    "prediction": """CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '{"answer": ""}' WHEN 2 THEN '{"answer": 3}' WHEN 3 THEN '{"other": "x"}' WHEN 4 THEN '[1]' ELSE concat('{"answer": "', lang, '"}') END""",
    "error_type": "CASE WHEN doc_id % 16 = 0 THEN 'JSONDecodeError' WHEN doc_id % 8 = 0 THEN 'Timeout' END",
    "reason": "CASE WHEN doc_id % 6 = 0 THEN NULL WHEN n_chars > 3000 THEN 'length' ELSE 'stop' END",
    "prompt": "CASE WHEN doc_id % 4 > 0 THEN n_chars END",
    "completion": "CASE WHEN doc_id % 3 > 0 THEN doc_id % 50 END",
}
_ROW["total"] = f"({_ROW['prompt']}) + ({_ROW['completion']})"
#: What is wrong with some rows of the query that checks rules.
_PLANTED = {
    "status": f"CASE WHEN doc_id % 29 = 0 THEN 'odd' ELSE {_STATUS} END",
    "points": f"CASE WHEN doc_id % 17 = 3 THEN 9 WHEN doc_id % 17 = 4 THEN -1 ELSE {_ROW['points']} END",
    "seconds": "CASE WHEN doc_id % 19 = 1 THEN CAST('NaN' AS DOUBLE) WHEN doc_id % 19 = 2 THEN -1.0 WHEN doc_id % 19 = 3 THEN NULL ELSE n_chars / 100.0 END",
    "calls": "CASE WHEN doc_id % 23 = 0 THEN 1.5 ELSE 1 END",
    "question_hash": "CASE WHEN doc_id % 31 = 0 THEN 'changed' ELSE left(sha2, 16) END",
    "item_id": "CASE WHEN doc_id % 41 = 0 THEN doc_id + 1000000 ELSE doc_id END",
}
#: The runs: variant, and which documents have a result.
_RUNS = {"a": "doc_id % 5 <> 1 AND doc_id % 11 <> 0", "b": "doc_id % 7 <> 2 AND doc_id % 11 <> 0"}


def _sql_rows(columns: dict, runs: dict = _RUNS) -> str:
    chosen = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return " UNION ALL ".join(f"SELECT '{v}' AS variant, {chosen} FROM d WHERE {w}" for v, w in runs.items())


_SQL = f"""
WITH d AS (SELECT documents.*, sha256(text) AS sha2, quality FROM documents LEFT JOIN labels USING (doc_id)),
i AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _ITEM.items())} FROM d),
r AS ({_sql_rows(_ROW)}),
w AS (SELECT i.item_id, i.type, i.selected, i.max_points AS most, v.variant FROM i, (VALUES ('a'), ('b')) v(variant)),
j AS (SELECT w.*, r.status, r.points, r.seconds, r.calls, r.prediction, r.error_type, r.reason, r.prompt, r.completion, r.total, r.item_id IS NOT NULL AS ran,
        CASE WHEN json_valid(r.prediction) THEN json_type(r.prediction, '$.answer') END AS kind, r.prediction ->> '$.answer' AS answer
      FROM w LEFT JOIN r ON w.variant = r.variant AND w.item_id = r.item_id),
k AS (SELECT *, CASE WHEN prediction IS NOT NULL THEN kind IS DISTINCT FROM 'VARCHAR' ELSE coalesce(reason IS NOT NULL AND error_type = 'JSONDecodeError', false) END AS bad FROM j),
f AS (SELECT *, selected AND NOT ran AS missing, NOT selected AS excluded, ran AND points IS NULL AS pending, coalesce(status = 'abstained', false) AS abstained,
        ran AND bad AS format_failure, coalesce(status = 'error', false) AND NOT bad AS technical_failure, coalesce(status = 'over_budget', false) AS over_budget, coalesce(reason = 'length', false) AS truncated FROM k)
"""


def _docs(t):
    return t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left").withColumn("sha2", F.sha2("text", 256))


def _items(t):
    return _docs(t).selectExpr(*[f"{e} AS {n}" for n, e in _ITEM.items()])


def _rows(t, columns: dict = _ROW, runs: dict = _RUNS):
    docs, out = _docs(t), None
    for variant, where in runs.items():
        part = docs.where(where).selectExpr(f"'{variant}' AS variant", *[f"{e} AS {n}" for n, e in columns.items()])
        out = part if out is None else out.unionByName(part)
    finish = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(F.array().cast("array<string>"))
    return out.withColumn("finish", finish).withColumn("usage", F.array(F.struct(*R.TOKEN_FIELDS)))


def _token_sql(field: str) -> str:
    return f"sum({field})::BIGINT AS {field}_tokens, (greatest(coalesce(sum(calls), 0), count(*) FILTER (ran)) - count({field}))::BIGINT AS {field}_unknown"


_SUMMARY = f"""SELECT variant, count(*) AS items, count(*) FILTER (selected) AS selected, count(*) FILTER (ran) AS processed,
  count(*) FILTER (kind IS NOT NULL AND answer <> '') AS answered, count(*) FILTER (kind = 'VARCHAR' AND answer = '') AS empty_answers,
  {", ".join(f"count(*) FILTER ({x}) AS {x}" for x in R.FLAGS)},
  coalesce(sum(points) FILTER (ran), 0)::DOUBLE AS lower, coalesce(sum(most) FILTER (pending), 0)::DOUBLE AS pending_points, coalesce(sum(most) FILTER (missing), 0)::DOUBLE AS missing_points,
  coalesce(sum(most) FILTER (excluded), 0)::DOUBLE AS excluded_points, sum(most)::DOUBLE AS whole, sum(calls)::BIGINT AS calls,
  {", ".join(map(_token_sql, R.TOKEN_FIELDS))}, round(sum(seconds), 6)::DOUBLE AS seconds FROM f GROUP BY variant"""


@query(_SQL + f""", s AS ({_SUMMARY})
SELECT *, lower + pending_points + missing_points AS upper, missing = 0 AS run_complete, pending = 0 AS grading_complete, excluded = 0 AS all_selected,
  CASE WHEN missing > 0 THEN 'run_incomplete' WHEN pending > 0 THEN 'grading_incomplete' WHEN format_failure > 0 THEN 'invalid_submission_format' WHEN lower >= 30 THEN 'reached_provisionally' ELSE 'below_target' END AS target_status FROM s""")
def run_summary(t):
    return R.summary(_items(t), _rows(t), list(_RUNS), 30).withColumn("seconds", F.col("seconds").cast("double"))


@query(_SQL + " UNION ALL ".join(f"SELECT variant, '{x}' AS flag, item_id FROM f WHERE {x}" for x in R.FLAGS))
def run_flags(t):
    return R.flagged(_items(t), _rows(t), list(_RUNS))


_DIRTY = _ROW | _PLANTED
_DIRTY_RUNS = {"a": "doc_id % 5 <> 1", "c": "doc_id % 37 = 0", "b": "doc_id % 53 = 0"}


@query(f"""
WITH d AS (SELECT documents.*, sha256(text) AS sha2, quality FROM documents LEFT JOIN labels USING (doc_id)),
i AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _ITEM.items())} FROM d),
r0 AS ({_sql_rows(_DIRTY, _DIRTY_RUNS)}), r AS (FROM r0 UNION ALL (FROM r0 WHERE variant = 'b')),
j AS (SELECT r.*, i.type AS t2, i.max_points AS m2, i.question_hash AS h2, i.selected FROM r LEFT JOIN i USING (item_id)),
v AS (
  SELECT 'unknown_variant' AS rule, item_id, variant FROM j WHERE variant NOT IN ('a', 'b')
  UNION ALL SELECT 'unknown_item', item_id, variant FROM j WHERE selected IS NULL
  UNION ALL SELECT 'excluded_item', item_id, variant FROM j WHERE NOT selected
  UNION ALL SELECT 'changed_question', item_id, variant FROM j WHERE selected IS NOT NULL AND (type IS DISTINCT FROM t2 OR max_points IS DISTINCT FROM m2 OR question_hash IS DISTINCT FROM h2)
  UNION ALL SELECT 'unknown_status', item_id, variant FROM j WHERE status NOT IN ('ok', 'error', 'over_budget', 'abstained')
  UNION ALL SELECT 'bad_points', item_id, variant FROM j WHERE points < 0
  UNION ALL SELECT 'points_above_max', item_id, variant FROM j WHERE points > m2
  UNION ALL SELECT 'failed_with_points', item_id, variant FROM j WHERE status <> 'ok' AND points IS DISTINCT FROM 0
  UNION ALL SELECT 'bad_seconds', item_id, variant FROM j WHERE seconds IS NULL OR isnan(seconds) OR seconds < 0
  UNION ALL SELECT 'bad_calls', item_id, variant FROM j WHERE calls <> floor(calls)
  UNION ALL SELECT 'duplicate', item_id, variant FROM r GROUP BY variant, item_id HAVING count(*) > 1)
SELECT rule, item_id::VARCHAR AS entity_id, variant AS detail FROM v""")
def run_rules(t):
    rows = _rows(t, _DIRTY, _DIRTY_RUNS)
    return R.row_problems(_items(t), rows.unionByName(rows.where("variant = 'b'")), ["a", "b"])


@query(_SQL + """SELECT x.variant, 'b' AS previous_variant, x.type, count(*) FILTER (x.points IS NOT NULL AND y.points IS NOT NULL) AS common,
  coalesce(sum(x.most) FILTER (x.points IS NOT NULL AND y.points IS NOT NULL), 0)::DOUBLE AS common_max, coalesce(sum(x.points - y.points), 0)::DOUBLE AS delta,
  (CASE WHEN bool_and(x.selected AND x.points IS NOT NULL AND y.points IS NOT NULL) THEN sum(x.points - y.points) END)::DOUBLE AS full_delta
FROM f x JOIN f y ON x.variant = 'a' AND y.variant = 'b' AND x.item_id = y.item_id GROUP BY x.variant, x.type""")
def run_compare(t):
    rows = _rows(t)
    return R.compared(_items(t), rows.where("variant = 'a'"), rows.where("variant = 'b'"), {"a": "b"}, by=("type",))


_CONTRACT = "max(length(text))::VARCHAR AS exam, min(doc_id) // 2 AS keys, count(*) // 10 AS rubric, sum(n_chars) % 3 AS inputs, sum(1 + doc_id % 3) AS max_points"


@query(f"""WITH n AS (SELECT lang, {_CONTRACT} FROM documents GROUP BY lang), o AS (SELECT lang, {_CONTRACT} FROM documents WHERE lang <> 'en' AND (lang <> 'fr' OR doc_id % 2 = 0) GROUP BY lang)
SELECT n.lang, CASE WHEN n.exam IS NOT DISTINCT FROM o.exam AND n.keys IS NOT DISTINCT FROM o.keys AND n.rubric IS NOT DISTINCT FROM o.rubric AND n.inputs IS NOT DISTINCT FROM o.inputs AND n.max_points IS NOT DISTINCT FROM o.max_points THEN 'paired' ELSE 'incomparable' END AS status
FROM n LEFT JOIN o ON n.lang = o.lang""")
def comparable_runs(t):
    def contracts(docs):
        return docs.groupBy("lang").agg(F.max(F.length("text")).cast("string").alias("exam"), F.expr("min(doc_id) div 2").alias("keys"), F.expr("count(*) div 10").alias("rubric"), F.expr("sum(n_chars) % 3").alias("inputs"), F.expr("sum(1 + doc_id % 3)").alias("max_points"))

    d = t("documents")
    return R.comparable(contracts(d), contracts(d.where("lang <> 'en' AND (lang <> 'fr' OR doc_id % 2 = 0)")), "lang")


_PAPER = {"exam_id": "n_nationkey", "items": "3", "points": "CASE WHEN n_nationkey % 9 = 4 THEN 44.0 ELSE 45.0 END"}
_REPORT = {
    "exam_id": "CASE WHEN s_nationkey = 3 THEN 99 ELSE s_nationkey END",
    "model": "CASE WHEN s_suppkey % 7 = 0 THEN 'other' ELSE 'm' END",
    "model_hash": "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'h' END",
    "variant": "CASE WHEN s_suppkey % 5 = 0 THEN 'direct' ELSE 'bm25' END",
    "items": "CASE WHEN s_suppkey % 13 = 0 THEN 4 ELSE 3 END",
    "whole": "45.0",
    "all_selected": "s_suppkey % 6 <> 0",
    "essays": "CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END",
}
_PAPERS = f"SELECT {', '.join(f'{e} AS {n}' for n, e in _PAPER.items())} FROM nation"
_REPORTS = f"SELECT {', '.join(f'{e} AS {n}' for n, e in _REPORT.items())} FROM supplier WHERE s_suppkey % 3 <> 1"


@query(f"""WITH p AS ({_PAPERS}), r AS ({_REPORTS}), b AS (SELECT coalesce(p.exam_id, r.exam_id) AS exam_id, p.items AS i2, p.points, r.* EXCLUDE exam_id FROM p FULL JOIN r ON p.exam_id = r.exam_id),
v AS (SELECT 'missing_report' AS rule, exam_id, variant FROM b WHERE model IS NULL
  UNION ALL SELECT 'unknown_paper', exam_id, variant FROM b WHERE i2 IS NULL
  UNION ALL SELECT 'wrong_model', exam_id, variant FROM b WHERE model <> 'm' OR model IS NOT NULL AND model_hash IS DISTINCT FROM 'h'
  UNION ALL SELECT 'wrong_variant', exam_id, variant FROM b WHERE variant <> 'bm25'
  UNION ALL SELECT 'wrong_denominator', exam_id, variant FROM b WHERE i2 IS NOT NULL AND (points <> 45 OR whole <> points OR items <> i2)
  UNION ALL SELECT 'partial_selection', exam_id, variant FROM b WHERE NOT all_selected
  UNION ALL SELECT 'essay', exam_id, variant FROM b WHERE essays > 0
  UNION ALL SELECT 'duplicate_report', exam_id, count(*)::VARCHAR FROM r GROUP BY exam_id HAVING count(*) > 1)
SELECT rule, exam_id::VARCHAR AS entity_id, variant AS detail FROM v""")
def suite_gate(t):
    papers = t("nation").selectExpr(*[f"{e} AS {n}" for n, e in _PAPER.items()])
    reports = t("supplier").where("s_suppkey % 3 <> 1").selectExpr(*[f"{e} AS {n}" for n, e in _REPORT.items()])
    return R.suite_problems(papers, reports, "m", "h", "bm25", 45.0)


@query(_SQL + """SELECT variant, item_id, CASE WHEN ran THEN format_failure ELSE false END AS bad_format, truncated FROM f WHERE ran""")
def format_check(t):
    rows = _rows(t)
    return rows.select("variant", "item_id", R.format_failure(F.col("prediction"), F.col("finish"), F.col("error_type")).alias("bad_format"), R.truncated(F.col("finish")).alias("truncated"))
