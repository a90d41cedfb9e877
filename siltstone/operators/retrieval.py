"""Ranking of documents for queries: weighted BM25, TF-IDF and vector cosine, stored-essay scores.

Candidates come from equi joins on terms (an inverted index), never from a product of queries and
documents; scores are summed by partial aggregation, rounded, and every ranking has a tie-break.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import exam as E
from ..functions import text as T
from . import bags as B
from .joins import BROADCAST_ROWS, small, spread
from .tables import kept


@dataclass(frozen=True)
class Ranking:
    """Parameters of focused retrieval."""

    k1: float = 1.2
    b: float = 0.75
    title_bonus: float = 2.5
    prompt_weight: float = 2.0
    common: float = 0.20  #: a term in this share of documents, or more, isn't informative
    least_overlap: int = 2
    relative: float = 0.45
    per_source: int = 2
    k: int = 3
    places: int = 6


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return spread(docs.select("doc_id", "text")).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def doc_freq(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n documents and their average number of tokens."""
    return spread(docs.select("text")).agg(F.count("*").alias("n"), F.avg(F.size(T.tokens(F.col("text"))).cast("double")).alias("avg_len"))


def query_terms(queries: DataFrame, rule: Ranking = Ranking()) -> DataFrame:
    """item_id, term, weight: the prompt is the first sentence, and its terms weigh more."""
    split = queries.select("item_id", F.array_distinct(T.tokens(F.substring_index("text", ".", 1))).alias("prompt"), F.array_distinct(T.tokens(F.col("text"))).alias("all"))
    return split.select("item_id", "prompt", F.explode("all").alias("term")).select("item_id", "term", F.when(F.array_contains("prompt", F.col("term")), rule.prompt_weight).otherwise(1.0).alias("weight"))


#: Stands for a document itself among its terms; no token is empty.
_ITSELF = ""


def _asked_postings(docs: DataFrame, asked: DataFrame, keep: list[str], places: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the terms that are asked for: postings (doc_id, keep, len, a flag for each place, term, tf), df by term; and a row n, avg_len.

    Documents are dealt by their id, a few MB of text to a task: postings are counted, and later scored, where they lie, and only
    lists of a document's asked terms are written and dealt again.  Each document has a posting of its own, for counts that all
    documents take part in.
    """
    parts = text_parts(docs)
    base = docs.select("doc_id", *keep, "text").repartition(parts, "doc_id")
    base = base.select("doc_id", *keep, T.tokens(F.col("text")).alias("tokens"), *[F.array_distinct(T.tokens(text)).alias(f"_{name}") for name, text in places.items()])
    terms = asked.select("term").union(docs.sparkSession.createDataFrame([(_ITSELF,)], "term string")).distinct()
    rows = base.select("doc_id", *keep, F.size("tokens").alias("len"), *[f"_{name}" for name in places], F.explode(F.concat("tokens", F.array(F.lit(_ITSELF)))).alias("term"))
    rows = rows.join(small(terms), "term", "left_semi")
    flags = [F.array_contains(f"_{name}", F.col("term")).alias(name) for name in places]
    counted = rows.select("doc_id", *keep, "len", *flags, "term").groupBy("doc_id", *keep, "len", *places, "term").agg(F.count("*").alias("tf"))
    lists = kept(counted.groupBy("doc_id", *keep, "len").agg(F.collect_list(F.struct(*places, "term", "tf")).alias("has")), "postings")
    each = lambda held: held.select("doc_id", *keep, "len", F.explode("has").alias("h")).select("doc_id", *keep, "len", "h.*")
    df = each(lists).groupBy("term").agg(F.count("*").alias("df"))
    own = F.when(F.col("term") == _ITSELF, F.col("tf"))
    itself = each(lists).agg(F.coalesce(F.sum(own), F.lit(0)).alias("n"), (F.sum((F.col("len") * own).cast("double")) / F.sum(own)).alias("avg_len"))
    return each(lists.repartition(parts, "doc_id")), df, itself


def bm25(queries: DataFrame, docs: DataFrame, rule: Ranking = Ranking(), broad=()) -> DataFrame:
    """item_id, rank, doc_id, source, score, n_terms, in_title: at most k passages for a query, or none.

    A document must share two informative terms with the query, or have one in its title; it is scored
    on all terms that they share, and kept if it reaches `relative` of the query's best; at most
    `per_source` documents come from one source.
    """
    asked = query_terms(queries, rule)
    posted, df, stats = _asked_postings(docs, asked, ["source"], {"named": T.title(F.col("text"))})
    stats = F.broadcast(stats)  # one row
    known = asked.join(df, "term").crossJoin(stats)
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    informative = ~F.col("term").rlike("^[0-9]+$") & ~F.col("term").isin(*(broad or ("",))) & (F.col("df") / F.col("n") < rule.common)
    known = known.select("item_id", "term", (F.col("weight") * idf).alias("worth"), informative.alias("informative"), "avg_len")
    hit = posted.join(small(known, bound=asked), "term")
    tf = F.col("tf") * (rule.k1 + 1) / (F.col("tf") + rule.k1 * (1 - rule.b + rule.b * F.col("len") / F.col("avg_len")))
    scored = hit.groupBy("item_id", "doc_id", "source").agg(
        F.round(F.sum(F.col("worth") * (tf + F.when(F.col("named"), rule.title_bonus).otherwise(0.0))), rule.places).alias("score"),
        F.count_if("informative").alias("n_terms"),
        F.coalesce(F.bool_or(F.col("informative") & F.col("named")), F.lit(False)).alias("in_title"),
    )
    passed = scored.where((F.col("n_terms") >= rule.least_overlap) | F.col("in_title"))
    return diversified(kept(passed, "bm25-scored"), rule)


def diversified(scored: DataFrame, rule: Ranking = Ranking()) -> DataFrame:
    """Of scored hits those near the best, at most per_source from a source, at most k in all."""
    order = [F.desc("score"), F.col("doc_id")]
    # A query's hits never meet in one task: its best score is a partial maximum, and only per_source hits of each source go on.
    best = scored.groupBy("item_id").agg(F.max("score").alias("best"))
    near = scored.join(best, "item_id").where(F.col("score") >= rule.relative * F.col("best"))
    few = near.withColumn("n", F.row_number().over(Window.partitionBy("item_id", "source").orderBy(*order))).where(F.col("n") <= rule.per_source)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= rule.k)
    return ranked.select("item_id", "rank", "doc_id", "source", "score", "n_terms", "in_title")


#: Bytes of text whose features a task counts.
TASK_TEXT = 4 << 20


def text_parts(texts: DataFrame) -> int:
    """A number of partitions that follows the text: a few MB of it have millions of features, and a task's counts stay in memory."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(-(-size // TASK_TEXT), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def feature_counts(texts: DataFrame, id_col: str) -> DataFrame:
    """id, f, tf in letters: `w:` words and, of words of 3 characters and more, their `c:` character runs."""
    words, run = _runs(texts, id_col)
    f = F.when(F.col("at") == 0, F.concat(F.lit("w:"), "w")).otherwise(F.concat(F.lit("c:"), run))
    return words.select(id_col, f.alias("f"), "n").groupBy(id_col, "f").agg(F.sum("n").alias("tf"))


def _runs(texts: DataFrame, id_col: str):
    """Rows id, w, n (how often a text has the word), at; and the word's run of characters that the place `at` names."""
    ws = F.filter(F.split(T.key(F.col("text")), " "), lambda w: w != "")
    words = texts.select(id_col, "text").repartition(text_parts(texts), id_col).select(id_col, F.explode(ws).alias("w")).groupBy(id_col, "w").agg(F.count("*").alias("n"))
    size = F.length("w")
    # Place 0 is the word; then come the runs of 3 of the padded word, size of them, and the runs of 4.
    words = words.select(id_col, "w", "n", F.explode(F.sequence(F.lit(0), F.when(size >= 3, size * 2 - 1).otherwise(0))).alias("at"))
    padded = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    return words, F.when(F.col("at") <= size, F.substring(padded, F.col("at"), F.lit(3))).otherwise(F.substring(padded, F.col("at") - size, F.lit(4)))


def _keys(texts: DataFrame, id_col: str) -> DataFrame:
    """id, key, n: each id's words with single spaces between; n is null, or how often each word counts.

    Rows that share an id are one text, of their distinct words; no other text is shuffled.
    """
    key = T.key(F.col("text"))
    own = texts.select(F.col(id_col).alias("id"), "text")
    single = lambda rows: rows.select("id", key.alias("key"), F.lit(None).cast("array<bigint>").alias("n"))
    again = kept(own.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("again")), "tfidf-again")
    if again.isEmpty():
        return single(spread(own))
    of, own = small(again), spread(own)
    same = F.col("id").eqNullSafe(F.col("again"))
    words = own.join(of, same, "left_semi").select("id", F.explode(F.split(key, " ")).alias("w")).where("w <> ''").groupBy("id", "w").agg(F.count("*").alias("n"))
    merged = words.groupBy("id").agg(F.collect_list(F.struct("w", "n")).alias("has")).select("id", F.array_join("has.w", " ").alias("key"), F.col("has.n").alias("n"))
    return single(own.join(of, same, "left_anti")).union(merged)


def tfidf(queries: DataFrame, records: DataFrame, char_weight: float = 0.25, places: int = 6, best: int | None = None) -> DataFrame:
    """item_id, doc_id, score: cosine of (1 + ln tf)(1 + ln((N + 1)/(df + 1))), character runs weighing less.

    Query features that no record has count in the query's norm, with a document frequency of 0.
    best: all pairs that are among an item's so many highest scores, ties to the smaller doc_id, and some others; without it, all pairs.

    A record's features are counted where its text lies, once for their document frequencies and once to be held against all queries.
    Frequent features and those of queries are known there; the others are rare, so that their part of the norm is bounded, and only
    of records that may be among the best are they shuffled to meet their frequencies.
    """
    asked = _keys(queries, "item_id").mapInArrow(B.bags, StructType([StructField("id", queries.schema["item_id"].dataType), StructField("f", LongType()), StructField("tf", LongType())]))
    asked = kept(asked.where("id IS NOT NULL"), "tfidf-asked")
    texts = kept(_keys(records, "doc_id"), "tfidf-keys")
    df = kept(texts.select("key", "n").mapInArrow(B.frequencies, "f long, df long").groupBy("f").agg(F.sum("df").alias("df")), "tfidf-df")
    n, least = records.count(), _frequent(df)
    of_asked = df.join(small(asked.select("f").distinct(), bound=asked), "f", "left_semi")
    idf = F.lit(1.0) + F.log(F.lit(n + 1) / (F.coalesce("df", F.lit(0)) + F.lit(1.0)))
    worth = lambda tf: (F.lit(1.0) + F.log(tf)) * idf * F.when(F.col("f").bitwiseAND(1) == 1, char_weight).otherwise(1.0)
    weights = kept(asked.join(of_asked, "f", "left").select("id", "f", "df", worth("tf").alias("w")), "tfidf-weights")
    often = df.where(F.col("df") >= least).toArrow()  # no more than BROADCAST_ROWS
    blocks = max(1, -(-weights.count() // ASKED_ROWS))
    return reduce(DataFrame.union, [_held(texts, df, weights.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block), often, n, least, char_weight, places, best) for block in range(blocks)])


#: Features of items that are held against records at once.
ASKED_ROWS = 2_000_000


def _held(texts: DataFrame, df: DataFrame, weights: DataFrame, often: pa.Table, n: int, least: int, char_weight: float, places: int, best: int | None) -> DataFrame:
    """item_id, doc_id, score of the items that have these weights: ASKED_ROWS of them, and what one item has."""
    rows = weights.orderBy("id").toArrow()
    item_type, id_type = weights.schema["id"].dataType, texts.schema["id"].dataType
    item = rows.column("id").combine_chunks().dictionary_encode()
    w, f, of = (rows.column(c).to_numpy() for c in ("w", "f", "df"))
    met = ~np.isnan(of)  # of what no record has there is only the norm
    known, first = np.unique(np.concatenate((often.column("f").to_numpy(), f[met])), return_index=True)
    idf = 1 + np.log((n + 1) / (np.concatenate((often.column("df").to_numpy(), of[met]))[first] + 1.0))
    at = item.indices.to_numpy().astype(np.int64)
    norm = np.sqrt(np.bincount(at, w * w, len(item.dictionary)))
    rare = tuple(float(1 + np.log((n + 1) / (d + 1))) for d in (min(least - 1, n), min(1, n)))
    held = B.Asked(known, idf * np.where(known & 1, char_weight, 1.0), rare, char_weight, item.dictionary, at[met], np.searchsorted(known, f[met]), (w / norm[at])[met])
    shared = texts.sparkSession.sparkContext.broadcast(held)  # no more than BROADCAST_ROWS features and the block's weights
    pair = StructType([StructField("item_id", item_type), StructField("dot", DoubleType())])
    other = StructType([StructField("f", LongType()), StructField("tf", LongType())])
    schema = StructType([StructField("id", id_type), StructField("near", DoubleType()), StructField("far", ArrayType(other)), StructField("with", ArrayType(pair))])
    to = to_arrow_type(id_type)
    found = kept(texts.mapInArrow(lambda batches: B.held_against(batches, shared.value, best, 2 * 10.0**-places, to), schema), "tfidf-held")
    far = found.select("id", F.explode("far").alias("x")).select("id", "x.*")
    worth = (F.lit(1.0) + F.log("tf")) * (F.lit(1.0) + F.log(F.lit(n + 1) / (F.col("df") + F.lit(1.0)))) * F.when(F.col("f").bitwiseAND(1) == 1, char_weight).otherwise(1.0)
    far = df.join(small(far), "f").groupBy("id").agg(F.sum(worth * worth).alias("far"))
    normed = found.select("id", "near", "with").join(far, "id", "left").select("id", F.sqrt(F.col("near") + F.coalesce("far", F.lit(0.0))).alias("norm"), F.explode("with").alias("p"))
    pairs = normed.select("id", "norm", "p.*")
    return pairs.select("item_id", F.col("id").alias("doc_id"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dot") / F.col("norm"))), places).alias("score"))


def _frequent(df: DataFrame, most: int = BROADCAST_ROWS) -> int:
    """The least power of two that no more than `most` terms have as their document frequency, or more."""
    counts = df.groupBy(F.floor(F.log2("df")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()  # 63 rows at most
    least, n = 63, 0
    for power, count in counts:
        n += count
        if n > most:
            break
        least = power
    return 2**least - (least == 63)


def _two_best(scored: DataFrame, by: list[str], order: list) -> DataFrame:
    """by, doc_id and score of the first in order, and the second's score (null if there is none).

    Each task keeps its two best before they are shuffled.
    """
    two = scored.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("n <= 2")
    first = lambda c: F.max(F.when(F.col("n") == 1, F.col(c))).alias(c)
    return two.groupBy(*by).agg(first("doc_id"), first("score"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("second"))


def decide(scored: DataFrame, least: float, margin: float = 0.03) -> DataFrame:
    """item_id, doc_id, score, status: matched, below_threshold or ambiguous; the answer is given only when matched."""
    top = _two_best(scored, ["item_id"], [F.desc("score"), F.col("doc_id")])
    gap = F.col("score") - F.col("second")
    status = F.when((F.col("score") <= 0) | (F.col("score") < least), "below_threshold").when((gap <= 1e-12) | (gap < margin), "ambiguous").otherwise("matched")
    top = top.select("item_id", "doc_id", "score", status.alias("status"))
    return top.select("item_id", F.when(F.col("status") == "matched", F.col("doc_id")).alias("doc_id"), "score", "status")


#: Queries and records that meet in one group of `dense`.
QUERY_BLOCK, RECORD_BLOCK = 1024, 8192


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(vector):
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: x.cast("double") / norm)


def dense(queries: DataFrame, records: DataFrame, places: int = 6, best: int | None = None) -> DataFrame:
    """item_id, doc_id, score: cosine of stated queries (a bounded set) with all rows; a query's own row is left out.

    Queries and records are dealt to blocks of a counted size, and each pair of blocks meets in a group of its own.
    Vectors null, zero or with null or non-finite components take no part, nor do those of different lengths with each other.
    best: of a group only so many of a query's highest scores, ties to the smaller doc_id, go on; without it, all do.
    """
    norm = dot(F.col("embedding"), F.col("embedding"))
    fit = (norm > 0) & (norm < float("inf"))
    q = queries.where(fit).select(F.col("vec_id").alias("item_id"), unit(F.col("embedding")).alias("q"))
    r = records.where(fit).select(F.col("vec_id").alias("doc_id"), unit(F.col("embedding")).alias("r"))
    across, down = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-records.count() // RECORD_BLOCK))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.select("item_id", "q", block("item_id", across).alias("a"), every(down).alias("b"))
    r = r.select("doc_id", "r", block("doc_id", down).alias("b"), every(across).alias("a"))

    def meet(asked: pa.Table, found: pa.Table) -> pa.Table:
        items, docs, scores = _cosines(asked.column("item_id"), asked.column("q"), found.column("doc_id"), found.column("r"), places, best)
        return pa.table({"item_id": items, "doc_id": docs, "score": scores})

    return q.groupBy("a", "b").cogroup(r.groupBy("a", "b")).applyInArrow(meet, "item_id long, doc_id long, score double")


def _cosines(items, q, docs, r, places: int, best: int | None):
    """Ids and scores of all queries with all records of a group; vectors are held against those of their own length."""
    out: list[tuple] = []
    items, docs = items.to_numpy(), docs.to_numpy()
    sizes = [pc.list_value_length(v).to_numpy() for v in (q, r)]
    for n in set(sizes[0].tolist()) & set(sizes[1].tolist()):
        at, to = np.flatnonzero(sizes[0] == n), np.flatnonzero(sizes[1] == n)
        left, right = (np.array(pc.list_flatten(v.take(pa.array(k))).to_numpy(), float).reshape(len(k), n) for v, k in ((q, at), (r, to)))
        order = np.argsort(docs[to], kind="stable")
        right, ids = right[order], docs[to][order]
        for i, vector in enumerate(left):
            score = np.round(np.clip(right @ vector, -1.0, 1.0), places) + 0.0
            own = ids != items[at[i]]
            score, mine = score[own], ids[own]
            if best is not None and len(score) > best:
                first = _first(score, best)
                score, mine = score[first], mine[first]
            out.append((np.full(len(mine), items[at[i]]), mine, score))
    return [np.concatenate(c) if c else np.array([], kind) for c, kind in zip(list(zip(*out)) or [()] * 3, (np.int64, np.int64, float))]


def _first(score, best: int):
    """Places of the highest scores, the earlier ones first among equals."""
    least = np.partition(score, len(score) - best)[len(score) - best]
    near = np.flatnonzero(score >= least)
    return near[np.argsort(-score[near], kind="stable")[:best]]


def top_k(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


@dataclass(frozen=True)
class BankRule:
    """How prepared texts are scored for topics."""

    instructions: tuple[str, ...] = E.INSTRUCTIONS
    predicates: tuple[str, ...] = E.PREDICATES
    boiler: tuple[str, ...] = ()  #: stems that say nothing about a topic
    head: float = 0.9
    body: float = 0.7
    body_tf: int = 4
    strong: float = 2.0  #: weight of a subject's terms and of names
    pairs: float = 0.3
    pair_chars: int = 1500  #: how much of the text takes part in pairs, beside the head
    subject: float = 0.3
    aspects: float = 0.15
    inside: float = 1.15
    outside: float = 0.6
    slack: int = 5
    places: int = 6


def topic_terms(topics: DataFrame, rule: BankRule = BankRule()) -> DataFrame:
    """item_id, terms (struct term, weight, n), low, high: what is asked of an entry.

    `w` terms are the stems of the thesis, the strong ones in its subject (what stands before the first
    predicate) or in a name within a sentence; `p` terms are its adjacent pairs, as often as it has
    them; `a` terms are aspects that the topic lists.  low and high are the years that it spans.
    """
    t = topics.select("item_id", "text", E.thesis(F.col("text"), rule.instructions).alias("thesis"))
    strong = F.concat(T.tokens(E.subject(F.col("thesis"), rule.predicates)), T.tokens(F.array_join(E.names(F.col("thesis")), " ")))
    said = F.filter(T.tokens(F.col("thesis")), lambda w: ~w.isin(*(rule.boiler or ("",))))
    t = t.select("item_id", said.alias("seq"), strong.alias("strong"), F.array_distinct(T.tokens(F.array_join(E.aspects(F.col("text")), " "))).alias("aspects"), T.century_years(F.col("text")).alias("years"))
    one = lambda kind, term, weight, n: F.struct(F.concat(F.lit(kind), term).alias("term"), weight.alias("weight"), n.cast("long").alias("n"))
    words = F.transform(F.array_distinct("seq"), lambda w: one("w", w, F.when(F.array_contains("strong", w), rule.strong).otherwise(1.0), F.lit(1)))
    both = F.when(F.size("seq") > 1, F.transform(F.sequence(F.lit(1), F.size("seq") - 1), lambda i: F.array_join(F.slice("seq", i, 2), " "))).otherwise(F.array().cast("array<string>"))
    pairs = T.bound(both, lambda all_pairs: F.transform(F.array_distinct(all_pairs), lambda p: one("p", p, F.lit(0.0), F.size(F.filter(all_pairs, lambda x: x == p)))))
    aspects = F.transform("aspects", lambda w: one("a", w, F.lit(0.0), F.lit(1)))
    return t.select("item_id", F.concat(words, pairs, aspects).alias("terms"), F.array_min("years").alias("low"), F.array_max("years").alias("high"))


def _entry_terms(entries: DataFrame, asked: DataFrame, rule: BankRule) -> DataFrame:
    """doc_id, start_year, end_year, has: of the terms asked for, those that an entry has, as an array of term, in_title, in_head, tf.

    A pair counts where its stems follow each other in the head or the text's beginning, also as end
    and beginning of longer stems: entries first give what any such pair has, the last three letters of
    the one and the first three of the other, and only what is asked for is taken apart.
    """
    head = F.concat_ws(" ", "title", "topics", "keywords")
    own = entries.select(
        "doc_id", "start_year", "end_year", T.tokens(F.col("title")).alias("title"), T.tokens(head).alias("head"), T.tokens(F.col("text")).alias("body"),
        T.tokens(F.concat_ws(" ", head, F.left("text", F.lit(rule.pair_chars)))).alias("near"), T.tokens(F.lower(F.concat_ws(" ", "aspects", "topics"))).alias("mine"),
    )
    # Words are exploded as they are, each with the one behind it: no lambda sees them.
    none = F.array().cast("array<string>")
    place = lambda name, stems, behind=none: F.struct(F.lit(name).alias("place"), F.arrays_zip(stems.alias("w"), behind.alias("rest")).alias("ws"))
    pair_ends, behind = (F.slice("near", at, F.greatest(F.size("near") - 1, F.lit(0))) for at in (1, 2))
    places = F.array(place("title", F.array_distinct("title")), place("head", F.array_distinct("head")), place("body", F.col("body")), place("mine", F.array_distinct("mine")), place("pair", pair_ends, behind))
    rows = own.select("doc_id", "start_year", "end_year", F.explode(places).alias("p")).select("doc_id", "start_year", "end_year", "p.place", F.explode("p.ws").alias("w"))
    rows = rows.select("doc_id", "start_year", "end_year", "place", F.col("w.w").alias("w"), F.col("w.rest").alias("rest"))
    near_pair = lambda x, y: F.concat(F.lit("k"), F.right(x, F.lit(3)), F.lit(" "), F.left(y, F.lit(3)))  # noqa: E731  no token is shorter
    term = F.when(F.col("place") == "pair", near_pair(F.col("w"), F.col("rest"))).otherwise(F.concat(F.when(F.col("place") == "mine", "a").otherwise("w"), "w"))
    pair = F.split(F.expr("substring(term, 2)"), " ")
    of_pairs = asked.where(F.startswith("term", F.lit("p"))).select(near_pair(F.get(pair, 0), F.get(pair, 1)).alias("term"))
    rows = rows.withColumn("term", term).join(small(asked.select("term").union(of_pairs).distinct()), "term", "left_semi")
    lengths = range(3, T.STEM + 1)
    inside = F.array(*[F.when((F.length("w") >= m) & (F.length("rest") >= n), F.concat(F.lit("p"), F.right("w", F.lit(m)), F.lit(" "), F.left("rest", F.lit(n)))) for m in lengths for n in lengths])
    rows = rows.select("doc_id", "start_year", "end_year", "place", F.explode(F.when(F.col("place") == "pair", inside).otherwise(F.array("term"))).alias("term")).where("term IS NOT NULL")
    # Entries are dealt by their id: both groupings lie where the text is.
    terms = rows.groupBy("doc_id", "start_year", "end_year", "term").agg(F.bool_or(F.col("place") == "title").alias("in_title"), F.bool_or(F.col("place") == "head").alias("in_head"), F.count_if(F.col("place") == "body").alias("tf"))
    return terms.groupBy("doc_id", "start_year", "end_year").agg(F.collect_list(F.struct("term", "in_title", "in_head", "tf")).alias("has"))


def bank_scores(topics: DataFrame, entries: DataFrame, rule: BankRule = BankRule()) -> DataFrame:
    """item_id, doc_id, score of prepared texts for topics.

    topics: item_id, text.  entries: doc_id, title, topics, keywords and aspects (arrays), text,
    start_year and end_year (null: the 10th and 90th percentile of the years in topics and text).

    Each stem of the topic's thesis is worth its weight (the subject's and names' are strong) times
    ln(1 + (N - df + .5)/(df + .5)); it counts in full in the entry's title, .9 in its head (title,
    topics, keywords), and .7 times min(tf, 4)/4 in its text, as a share of all that the topic is worth.
    To this come .3 of the share of the thesis's adjacent pairs that head or text have, .3 of the share of
    strong stems in the title, and .15 of the share of the topic's aspects among the entry's.  Where
    both have years, the sum is multiplied by 1.15 if they overlap within 5 years, else by .6.

    Entries that share neither stem nor aspect with a topic would score 0 and are left out.
    """
    wanted = topic_terms(topics, rule)
    terms = kept(wanted.select("item_id", "low", "high", F.explode("terms").alias("t")).select("item_id", "low", "high", "t.*"), "bank-asked")
    span = span_of_years(F.concat_ws(" ", "topics", "text"))
    known = F.col("start_year").isNotNull() & F.col("end_year").isNotNull()
    own = entries.withColumn("_span", F.when(known, F.struct(F.col("start_year").cast("int").alias("start_year"), F.col("end_year").cast("int").alias("end_year"))).otherwise(span))
    own = own.withColumn("start_year", F.col("_span.start_year")).withColumn("end_year", F.col("_span.end_year"))
    # A task takes a few MB of text, and then of entries: what it counts and sums stays in memory, and no pair of a topic and an entry is shuffled.
    parts = text_parts(entries)
    of_entry = kept(_entry_terms(own.repartition(parts, "doc_id"), terms, rule), "bank-terms")
    each = lambda rows: rows.select("doc_id", "start_year", "end_year", F.explode("has").alias("h")).select("doc_id", "start_year", "end_year", "h.*")
    has = each(of_entry.repartition(parts, "doc_id"))
    df = each(of_entry).where(F.startswith("term", F.lit("w"))).groupBy("term").agg(F.count("*").alias("df"))
    n = entries.agg(F.count("*").alias("n_entries"))  # one row
    df_or_0 = F.coalesce("df", F.lit(0))
    worth = F.col("weight") * F.log(F.lit(1.0) + (F.col("n_entries") - df_or_0 + 0.5) / (df_or_0 + 0.5))
    asked = terms.join(df, "term", "left").crossJoin(F.broadcast(n)).select("item_id", "term", "weight", "n", "low", "high", worth.alias("worth"))
    kind = F.left("term", F.lit(1))
    strong, pair, aspect = (kind == "w") & (F.col("weight") > 1), kind == "p", kind == "a"
    whole = asked.groupBy("item_id").agg(
        F.sum("worth").alias("whole"), F.sum(F.when(pair, F.col("n"))).alias("of_pairs"), F.count_if(strong).alias("of_strong"), F.count_if(aspect).alias("of_aspects"),
        F.first("low").alias("low"), F.first("high").alias("high"),
    )
    hits = has.join(small(asked.select("item_id", "term", "weight", "n", "worth"), bound=terms), "term")
    part = F.when(F.col("in_title"), 1.0).when(F.col("in_head"), rule.head).otherwise(F.lit(rule.body) * F.least("tf", F.lit(rule.body_tf)) / rule.body_tf)
    sums = hits.groupBy("item_id", "doc_id", "start_year", "end_year").agg(
        F.sum(F.col("worth") * part).alias("got"), F.sum(F.when(pair, F.col("n"))).alias("pairs"), F.count_if(strong & F.col("in_title")).alias("strong"), F.count_if(aspect).alias("aspects"),
    )
    share = lambda x, of: F.when(F.col(of) > 0, F.coalesce(F.col(x), F.lit(0)) / F.col(of)).otherwise(0.0)
    score = share("got", "whole") + rule.pairs * share("pairs", "of_pairs") + rule.subject * share("strong", "of_strong") + rule.aspects * share("aspects", "of_aspects")
    dated = F.col("low").isNotNull() & F.col("start_year").isNotNull()
    times = F.when(dated, period_factor(F.col("low"), F.col("high"), F.col("start_year"), F.col("end_year"), rule.slack, rule.inside, rule.outside)).otherwise(1.0)
    scored = sums.join(small(whole, bound=terms), "item_id")
    return scored.select("item_id", "doc_id", F.round(F.when(F.col("whole") > 0, score * times).otherwise(0.0), rule.places).alias("score"))


def best_topic(scored: DataFrame, group: str) -> DataFrame:
    """Of a group's topics the one with the best (score, margin to its second); the first topic wins ties, the later entry too."""
    top = _two_best(scored, [group, "item_id"], [F.desc("score"), F.desc("doc_id")])
    top = top.withColumn("margin", F.round(F.col("score") - F.coalesce("second", F.lit(0.0)), 6))
    pick = Window.partitionBy(group).orderBy(F.desc("score"), F.desc("margin"), "item_id")
    return top.withColumn("n", F.row_number().over(pick)).where("n = 1").select(group, "item_id", "doc_id", "score", "margin")


def period_factor(low, high, start, end, slack: int = 5, inside: float = 1.15, outside: float = 0.6):
    """`inside` for periods that overlap within the slack, else `outside`."""
    return F.when((low <= end + slack) & (high >= start - slack), inside).otherwise(outside)


def span_of_years(text):
    """start_year, end_year: nearest-rank 10th and 90th percentile of the years of the common era in a text; null without any."""

    def ends(ys):
        n = F.size(ys)
        return F.when(n > 0, F.struct(F.element_at(ys, F.floor(n / 10).cast("int") + 1).alias("start_year"), F.element_at(ys, F.floor(n * 9 / 10).cast("int") + 1).alias("end_year")))

    return T.bound(F.array_sort(F.filter(T.century_years(text), lambda y: y > 0)), ends)


def entry_periods(entries: DataFrame) -> DataFrame:
    """doc_id, start_year, end_year of the entries whose text names years."""
    return entries.select("doc_id", span_of_years(F.col("text")).alias("p")).where("p is not null").select("doc_id", "p.start_year", "p.end_year")
