"""Tokens, statistics and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.joins import overlap_join, spread
from .base import key, ngrams, norm, query, title, toks, words


@query(rf"""
SELECT doc_id, {key('text')} AS text_key, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS squeezed,
       regexp_replace(text, '[^\p{{L}}\p{{N}}]+', '', 'g') AS compact, {norm(title('text'))} AS title,
       len({words('text')})::INT AS n_words, left(sha256(text), 16) AS text_id
FROM documents""")
def text_keys(t):
    c = F.col("text")
    return t("documents").select("doc_id", T.key(c).alias("text_key"), T.squeezed(c).alias("squeezed"), T.compact(c).alias("compact"), T.plain(T.title(c)).alias("title"), T.word_count(c).alias("n_words"), T.short_id(c).alias("text_id"))


@query(f"SELECT doc_id, array_to_string({toks('text')}, ' ') AS tokens FROM documents")
def tokens(t):
    return spread(t("documents").select("doc_id", "text")).select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY ALL")
def term_freq(t):
    return R.postings(t("documents"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY term")
def doc_freq(t):
    return R.doc_freq(R.postings(t("documents")))


@query(f"SELECT count(*) AS n, round(avg(len({toks('text')})), 6) AS avg_len FROM documents")
def corpus_stats(t):
    return R.corpus_stats(t("documents")).select("n", F.round("avg_len", 6).alias("avg_len"))


@query(f"SELECT doc_id, gram FROM (SELECT doc_id, unnest({ngrams('ws', 8)}) AS gram FROM (SELECT doc_id, list_filter(string_split({key('text')}, ' '), lambda w: w <> '') AS ws FROM documents))")
def word_ngrams(t):
    ws = F.filter(F.split(T.key(F.col("text")), " "), lambda w: w != "")
    return spread(t("documents").select("doc_id", "text")).select("doc_id", F.explode(T.ngrams(ws, 8)).alias("gram"))


#: Words, and of words of three characters and more their runs of 3 and 4; {0} has id and w.
_FEATURE = "SELECT id, 'w:' || w AS f FROM {0} UNION ALL SELECT id, 'c:' || unnest(list_transform(range(1, length(w) + 4 - n), lambda i: substr('^' || w || '$', i::INT, n::INT))) FROM {0}, (VALUES (3), (4)) v(n) WHERE length(w) >= 3"


@query(f"WITH w AS (SELECT doc_id AS id, unnest(list_filter(string_split({key('text')}, ' '), lambda w: w <> '')) AS w FROM documents) SELECT id AS doc_id, f, count(*) AS tf FROM ({_FEATURE.format('w')}) GROUP BY ALL")
def char_ngrams(t):
    return R.feature_counts(t("documents"), "doc_id")


@query(f"SELECT doc_id, pair FROM (SELECT doc_id, unnest({ngrams('ts', 2)}) AS pair FROM (SELECT doc_id, {toks('text')} AS ts FROM documents))")
def adjacent_pairs(t):
    return spread(t("documents").select("doc_id", "text")).select("doc_id", F.explode(T.pairs(T.tokens(F.col("text")))).alias("pair"))


@query(f"""
WITH d AS (SELECT doc_id, source, {toks('text')} AS toks, list_distinct({toks(title('text'))}) AS title FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM d),
po AS (SELECT doc_id, source, term, count(*) AS tf, any_value(len) AS len, any_value(title) AS title
       FROM (SELECT doc_id, source, len(toks) AS len, title, unnest(toks) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
q AS (SELECT item_id, term, CASE WHEN list_contains(prompt, term) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
      FROM (SELECT item_id, {toks("split_part(text, '.', 1)")} AS prompt, unnest(list_distinct({toks('text')})) AS term FROM benchmark)),
k AS (SELECT item_id, term, w * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS worth,
             NOT regexp_full_match(term, '[0-9]+') AND df::DOUBLE / n < 0.2::DOUBLE AS inf, avg_len
      FROM q JOIN df USING (term), st),
s AS (SELECT item_id, doc_id, source,
        round(sum(worth * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)) + CASE WHEN list_contains(title, term) THEN 2.5::DOUBLE ELSE 0 END)), 6) AS score,
        count(*) FILTER (inf) AS n_terms, coalesce(bool_or(inf AND list_contains(title, term)), false) AS in_title
      FROM po JOIN k USING (term) GROUP BY ALL),
g AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM s WHERE n_terms >= 2 OR in_title),
a AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS m FROM g WHERE score >= 0.45::DOUBLE * best),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM a WHERE m <= 2)
SELECT item_id, rank::INT AS rank, doc_id, source, score, n_terms, in_title FROM b WHERE rank <= 3""")
def bm25_topk(t):
    return R.bm25(t("benchmark"), t("documents"))


_TFIDF = f"""
WITH rw AS (SELECT doc_id AS id, unnest(list_filter(string_split({key('text')}, ' '), lambda w: w <> '')) AS w FROM documents),
     qw AS (SELECT item_id AS id, unnest(list_filter(string_split({key('text')}, ' '), lambda w: w <> '')) AS w FROM benchmark),
     rf AS (SELECT id, f, count(*) AS tf FROM ({_FEATURE.format('rw')}) GROUP BY ALL),
     qf AS (SELECT id, f, count(*) AS tf FROM ({_FEATURE.format('qw')}) GROUP BY ALL),
     df AS (SELECT f, count(*) AS df FROM rf GROUP BY f), n AS (SELECT count(*) AS n FROM documents),
     ql AS (SELECT id, qf.f, (1 + ln(tf)) * (1 + ln((n + 1) / (coalesce(df, 0) + 1.0::DOUBLE))) * CASE WHEN starts_with(qf.f, 'c:') THEN 0.25::DOUBLE ELSE 1 END AS w FROM qf LEFT JOIN df ON qf.f = df.f, n),
     rl AS (SELECT id, rf.f, (1 + ln(tf)) * (1 + ln((n + 1) / (df + 1.0::DOUBLE))) * CASE WHEN starts_with(rf.f, 'c:') THEN 0.25::DOUBLE ELSE 1 END AS v FROM rf JOIN df ON rf.f = df.f, n),
     qn AS (SELECT id, sqrt(sum(w * w)) AS nq FROM ql GROUP BY id), rn AS (SELECT id, sqrt(sum(v * v)) AS nr FROM rl GROUP BY id),
     s AS (SELECT ql.id AS item_id, rl.id AS doc_id, sum(w * v) AS dot FROM ql JOIN rl ON ql.f = rl.f GROUP BY ALL),
     c AS (SELECT item_id, doc_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, dot / (nq * nr))), 6) AS score FROM s JOIN qn ON qn.id = item_id JOIN rn ON rn.id = doc_id),
     o AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM c WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)),
     d AS (SELECT item_id, doc_id, score, CASE WHEN score <= 0 OR score < 0.3::DOUBLE THEN 'below_threshold' WHEN score - second <= 1e-12 OR score - second < 0.03::DOUBLE THEN 'ambiguous' ELSE 'matched' END AS status FROM o WHERE n = 1)
SELECT item_id, CASE WHEN status = 'matched' THEN doc_id END AS doc_id, score, status FROM d"""


@query(_TFIDF)
def tfidf_match(t):
    return R.decide(R.tfidf(t("benchmark"), t("documents"), best=2), 0.3)


_DENSE = """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS item_id, r.vec_id AS doc_id, round(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, list_dot_product(q.v, r.v))), 6) AS score FROM u q JOIN u r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)
"""


@query(_DENSE + "SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def dense_topk(t):
    v = t("embeddings")
    return R.top_k(R.dense(v.where("vec_id % 100 = 0"), v, best=10), 10)


@query(_DENSE + """, o AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)),
d AS (SELECT item_id, doc_id, score, CASE WHEN score <= 0 OR score < 0.3::DOUBLE THEN 'below_threshold' WHEN score - second <= 1e-12 OR score - second < 0.03::DOUBLE THEN 'ambiguous' ELSE 'matched' END AS status FROM o WHERE n = 1)
SELECT item_id, CASE WHEN status = 'matched' THEN doc_id END AS doc_id, score, status FROM d""")
def dense_match(t):
    v = t("embeddings")
    return R.decide(R.dense(v.where("vec_id % 100 = 0"), v, best=2), 0.3)


#: What the tables' languages have in the place of verbs and empty words.
_RULE = R.BankRule(predicates=("is", "was", "ist", "est", "para", "that"), boiler=("there", "inter"))
_TOPIC = "regexp_replace(text, '[.]?\\s*$', '') || '. Zajmij stanowisko, aspekty: ' || split_part(text, ' ', 2) || ', ' || split_part(text, ' ', 3) || ' i ' || split_part(text, ' ', 4) || ' w ' || CASE WHEN item_id % 3 > 0 THEN (1000 + item_id * 37 % 900)::VARCHAR ELSE 'wieku' END"
_PREDICATE = r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(_RULE.predicates) + r")($|[^\p{L}\p{N}_])"


def _topics(t):
    part = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    when = F.when(F.col("item_id") % 3 > 0, (F.col("item_id") * 37 % 900 + 1000).cast("string")).otherwise("wieku")
    text = F.concat(F.regexp_replace("text", r"[.]?\s*$", ""), F.lit(". Zajmij stanowisko, aspekty: "), part(2), F.lit(", "), part(3), F.lit(" i "), part(4), F.lit(" w "), when)
    return t("benchmark").select("item_id", text.alias("text"))


def _entries(t):
    """Documents as entries of a bank: a title line, the second line as topic, their first words as aspects, a period for three in four."""
    second = F.split_part("text", F.lit("\n"), F.lit(2))
    start = F.when(F.col("doc_id") % 4 > 0, F.col("n_chars") % 900 + 1000)
    return t("documents").select(
        "doc_id", T.title(F.col("text")).alias("title"), F.array(second).alias("topics"), F.array("lang", "source").alias("keywords"),
        F.array(F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))).alias("aspects"), "text", start.alias("start_year"), (start + 30).alias("end_year"),
    )


_BOILER = "[" + ", ".join(f"'{w}'" for w in _RULE.boiler) + "]"
_BANK = rf"""
WITH d0 AS (SELECT doc_id, {title('text')} AS title, split_part(text, chr(10), 2) AS topic, concat_ws(' ', lang, source) AS keywords, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS aspects, text, n_chars FROM documents),
d AS (SELECT *, concat_ws(' ', title, topic, keywords) AS head,
        list_sort(list_filter(list_transform(regexp_extract_all(topic || ' ' || text, '\b([0-9]{{3,4}})\b', 1), lambda y: y::INT), lambda y: y >= 500 AND y <= 2029)) AS ys FROM d0),
e AS (SELECT doc_id, {toks('text')} AS body, {toks('title')} AS title, {toks('head')} AS head, ' ' || array_to_string({toks("head || ' ' || left(text, 1500)")}, ' ') || ' ' AS near, {toks("lower(aspects || ' ' || topic)")} AS mine,
        CASE WHEN doc_id % 4 > 0 THEN 1000 + n_chars % 900 ELSE ys[len(ys) // 10 + 1] END AS start_year, CASE WHEN doc_id % 4 > 0 THEN 1030 + n_chars % 900 ELSE ys[len(ys) * 9 // 10 + 1] END AS end_year FROM d),
n AS (SELECT count(*) AS n FROM documents),
t0 AS (SELECT item_id, {_TOPIC} AS text FROM benchmark),
t1 AS (SELECT *, string_split_regex(text, '\.\s+(Zajmij|Oceń)')[1] AS thesis FROM t0),
t2 AS (SELECT item_id, text, thesis, string_split_regex(thesis, '{_PREDICATE}')[1] AS subject,
         array_to_string(regexp_extract_all(regexp_replace(thesis, '(^|[.!?]\s)\p{{Lu}}[\p{{L}}\p{{N}}_]*', '\1', 'g'), '(^|[^\p{{L}}\p{{N}}_])(\p{{Lu}}[\p{{L}}\p{{N}}_-]+)', 2), ' ') AS named,
         array_to_string(regexp_extract_all(lower(text), 'aspekt[\p{{L}}\p{{N}}_]*:?\s+((?:[\p{{L}}\p{{N}}_-]+(?:,\s*|\s+i\s+|\s+oraz\s+)?){{1,4}})', 1), ' ') AS aspects,
         list_filter(list_transform(regexp_extract_all(text, '\b([0-9]{{3,4}})\b', 1), lambda y: y::INT), lambda y: y >= 500 AND y <= 2029) AS ys FROM t1),
t AS (SELECT item_id, list_filter({toks('thesis')}, lambda w: NOT list_contains({_BOILER}, w)) AS seq, list_concat({toks('subject')}, {toks('named')}) AS strong, list_distinct({toks('aspects')}) AS aspects, list_min(ys) AS low, list_max(ys) AS high FROM t2),
k AS (SELECT item_id, term, CASE WHEN list_contains(strong, term) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM (SELECT item_id, strong, unnest(list_distinct(seq)) AS term FROM t)),
bag AS (SELECT doc_id, term, count(*) FILTER (place = 'b') AS tf, bool_or(place = 't') AS in_title, bool_or(place = 'h') AS in_head FROM (
  SELECT doc_id, unnest(body) AS term, 'b' AS place FROM e UNION ALL SELECT doc_id, unnest(title), 't' FROM e UNION ALL SELECT doc_id, unnest(head), 'h' FROM e) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM bag GROUP BY term),
i AS (SELECT item_id, term, w, w * ln(1.0::DOUBLE + (n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS worth FROM k LEFT JOIN df USING (term), n),
whole AS (SELECT item_id, sum(worth) AS whole, count(*) FILTER (w > 1) AS of_strong FROM i GROUP BY item_id),
got AS (SELECT item_id, doc_id, sum(worth * CASE WHEN in_title THEN 1.0::DOUBLE WHEN in_head THEN 0.9::DOUBLE ELSE 0.7::DOUBLE * least(tf, 4) / 4 END) AS got, count(*) FILTER (w > 1 AND in_title) AS strong FROM bag JOIN i USING (term) GROUP BY ALL),
a AS (SELECT item_id, doc_id, len(list_intersect(t.aspects, e.mine)) AS aspects FROM t, e WHERE list_has_any(t.aspects, e.mine)),
c AS (SELECT item_id, doc_id, coalesce(got, 0) AS got, coalesce(strong, 0) AS strong, coalesce(a.aspects, 0) AS aspects FROM got FULL JOIN a USING (item_id, doc_id)),
s AS (SELECT c.item_id, c.doc_id, round(CASE WHEN coalesce(whole, 0) > 0 THEN (got / whole
        + 0.3::DOUBLE * CASE WHEN len(seq) > 1 THEN len(list_filter(range(1, len(seq)), lambda x: contains(near, seq[x] || ' ' || seq[x + 1])))::DOUBLE / (len(seq) - 1) ELSE 0 END
        + 0.3::DOUBLE * CASE WHEN of_strong > 0 THEN c.strong::DOUBLE / of_strong ELSE 0 END
        + 0.15::DOUBLE * CASE WHEN len(t.aspects) > 0 THEN c.aspects::DOUBLE / len(t.aspects) ELSE 0 END)
        * CASE WHEN low IS NULL OR start_year IS NULL THEN 1.0::DOUBLE WHEN low <= end_year + 5 AND high >= start_year - 5 THEN 1.15::DOUBLE ELSE 0.6::DOUBLE END ELSE 0 END, 6) AS score
      FROM c JOIN t USING (item_id) JOIN e USING (doc_id) LEFT JOIN whole USING (item_id))
"""


@query(_BANK + "SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank FROM s) WHERE rank <= 5")
def bank_score(t):
    scored = R.bank_scores(_topics(t), _entries(t), _RULE)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("item_id", "rank", "doc_id", "score")


@query(_BANK + """, o AS (SELECT item_id // 4 AS task_id, item_id, doc_id, score, row_number() OVER w AS n, round(score - coalesce(lead(score) OVER w, 0), 6) AS margin FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id DESC))
SELECT task_id, item_id, doc_id, score, margin FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, margin DESC, item_id) AS m FROM o WHERE n = 1) WHERE m = 1""")
def best_topic(t):
    scored = R.bank_scores(_topics(t), _entries(t), _RULE).withColumn("task_id", F.expr("item_id div 4"))
    return R.best_topic(scored, "task_id")


@query("""
WITH t AS (SELECT item_id, 1000 + item_id * 37 % 900 AS low, 1000 + item_id * 37 % 900 + item_id % 7 * 40 AS high FROM benchmark),
e AS (SELECT doc_id, 1000 + n_chars % 900 AS start_year, 1000 + n_chars % 900 + doc_id % 50 AS end_year FROM documents WHERE doc_id % 4 > 0)
SELECT item_id, doc_id, low, high, start_year, end_year FROM t, e WHERE low <= end_year + 5 AND high >= start_year - 5""")
def period_pairs(t):
    low = F.col("item_id") * 37 % 900 + 1000
    asked = t("benchmark").select("item_id", low.alias("low"), (low + F.col("item_id") % 7 * 40).alias("high"))
    start = F.when(F.col("doc_id") % 4 > 0, F.col("n_chars") % 900 + 1000)
    entries = t("documents").select("doc_id", start.alias("start_year"), (start + F.col("doc_id") % 50).alias("end_year"))
    return overlap_join(asked, entries, "low", "high", "start_year", "end_year", 5)


@query("""
WITH y AS (SELECT p_partkey AS doc_id, list_sort(list_filter(list_transform(regexp_extract_all(p_name || ' ' || (900 + p_partkey % 1100)::VARCHAR || ' and ' || (1000 + p_size * 20)::VARCHAR || ' to ' || p_partkey::VARCHAR, '\\b([0-9]{3,4})\\b', 1), lambda x: x::INT), lambda x: x >= 500 AND x <= 2029)) AS ys FROM part)
SELECT doc_id, ys[len(ys) // 10 + 1] AS start_year, ys[len(ys) * 9 // 10 + 1] AS end_year FROM y WHERE len(ys) > 0""")
def entry_periods(t):
    text = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 1100 + 900).cast("string"), F.lit(" and "), (F.col("p_size") * 20 + 1000).cast("string"), F.lit(" to "), F.col("p_partkey").cast("string"))
    return R.entry_periods(t("part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


@query("""
SELECT o_orderkey, l_linenumber, CASE WHEN year(o_orderdate) <= year(l_shipdate) + 0 AND year(o_orderdate) >= year(l_shipdate) - 0 THEN 1.15::DOUBLE ELSE 0.6::DOUBLE END AS factor
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def period_overlap(t):
    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = F.year("o_orderdate"), F.year("l_shipdate")
    return rows.select("o_orderkey", "l_linenumber", R.period_factor(a, a, b, b, 0).alias("factor"))
