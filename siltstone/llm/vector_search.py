"""Approximate nearest neighbours by adaptive dimension scan within probed lists.

Vectors are turned by one random rotation, so that any block of columns is a fair sample of all.
They are dealt to lists by their nearest centre (fitted on a bounded sample); a list is cut into
pieces of at most PIECE vectors.  A query first meets one piece of its best list, whose k-th
best product is its floor, and then all pieces of its best lists.  In a piece the scan
adds one block of columns at a time to the inner products; after each block a hypothesis test
abandons the candidates whose distance, estimated from the columns so far, is significantly above
the floor's (EPSILON is the test's error bound for columns of a random rotation).  Only survivors are scored,
in double precision on the original vectors, and each piece gives its k best; the k best of all
pieces are the result.

How many lists to probe is measured: on a bounded sample of queries against a bounded sample of
vectors, the fewest lists that find GOAL of the true neighbours.  `recall` measures an index's
result against brute force.

Defined cases: vectors that are null, zero, of another length than most of the sample's, or hold
null or non-finite components take no part; finite ones of any size do; ties in score go to the smaller vec_id, and a null
vec_id takes no part either; rows that repeat a vec_id are candidates each, for each other too, and
queries each, with a result of their own; fewer candidates than k give all of them; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

K = 20
QUERY_EVERY = 20
SAMPLE_A_LIST = 8  #: vectors for each list on which the centres are fitted,
SAMPLE = 20_000  #: and at least so many
TRIALS = 200  #: queries on which the number of probes is measured
GOAL = 0.97
PIECE = 2048
ASKED = 16_384  #: queries that meet a piece in one group; a piece is copied once for each so many
BLOCK = 16
SPARSE = 0.05  #: share of living pairs below which blocks are added pair by pair
ROUNDING = 1e-5
EPSILON = 2.1  #: of the test: how many times 1/sqrt(columns) a scaled distance may err
MOST_LISTS = 16_384  #: lists grow with the root of the table's rows, up to a billion rows; it bounds the sample too
PAIRS = 1 << 19  #: query and candidate pairs that are scanned at once


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding array<double>, size: the vectors that take part, but for their length."""
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    fine = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists("embedding", lambda v: v != 0)
    return x.where(fine).withColumn("size", F.size("embedding"))


def rotation(size: int) -> np.ndarray:
    turn, r = np.linalg.qr(np.random.default_rng(29).standard_normal((size, size)))
    return turn * np.sign(np.diag(r))


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 2048) -> np.ndarray:
    """The centre with the largest product, for some rows at a time."""
    return np.concatenate([(x[at : at + rows] @ c.T).argmax(axis=1) for at in range(0, len(x), rows)]) if len(x) else np.zeros(0, np.int64)


def centres(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: unit centres."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = unit[np.random.default_rng(31).choice(len(unit), lists, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(unit, c)
        total = np.zeros_like(c)
        np.add.at(total, near, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def fit(vectors: DataFrame) -> dict | None:
    """The rotation, the centres and the number of lists to probe."""
    rows = usable(vectors)
    total = rows.count()
    lists = int(min(MOST_LISTS, max(1, np.sqrt(total) / 2)))
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, SAMPLE_A_LIST * lists)).toArrow()
    if not len(got):
        return None
    sizes, counts = np.unique(got.column("size").to_numpy(), return_counts=True)
    size = int(sizes[counts.argmax()])
    held = got.filter(pc.equal(got.column("size"), size))
    x = held.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, size)
    lists = min(lists, max(1, len(x) // SAMPLE_A_LIST))
    turn = rotation(size)
    x = x @ turn
    c = centres(x, lists)
    trial = x[: min(TRIALS, len(x))]
    near = nearest(x, c)
    k = min(K, len(x) - 1)
    # A sample has fewer neighbours as near as the whole table has, so that its need of probes is above the table's.
    rank = np.argsort(np.argsort(-(trial @ c.T), axis=1), axis=1)
    score = trial @ x.T
    score[np.arange(len(trial)), np.arange(len(trial))] = -np.inf
    found = np.argsort(-score, axis=1)[:, :k]
    need = np.sort(np.take_along_axis(rank, near[found], axis=1).ravel()) if k else np.zeros(1, int)
    probes = int(need[min(len(need) - 1, int(np.ceil(GOAL * len(need))))]) + 1
    return {"size": size, "turn": turn, "centres": c, "probes": min(lists, probes)}


def scan(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, turned: np.ndarray, asking: np.ndarray, q: np.ndarray, q_turned: np.ndarray, floor: np.ndarray, k: int):
    """Of one piece, the k best for each query, of those that may reach its floor: arrays of asking, vec_id and score.

    rows tells the piece's rows apart, ids has their vec_id, asking is the query's own row, which is no candidate.

    While most pairs live a block is one product of matrices; once few do, it is added for those only.
    The piece, and each query, are scaled by powers of two, which keep the order of a query's candidates
    and make the largest component about 1: single precision has room for vectors of any finite size.
    """
    size, n = x.shape[1], len(x)
    of_piece, of_query = _scale(turned.max(initial=0), turned.min(initial=0)), _scale(q_turned.max(axis=1, initial=0), q_turned.min(axis=1, initial=0))
    turned, q_turned = (turned * of_piece).astype(np.float32), (q_turned * of_query[:, None]).astype(np.float32)
    with np.errstate(over="ignore"):
        floor = (floor * of_piece) * of_query  # beyond single precision: no candidate of this piece reaches it
    squares = _head_squares(turned)
    out = []
    step = max(1, PAIRS // max(1, n))
    for at in range(0, len(q), step):
        own, mine = asking[at : at + step], q_turned[at : at + step]
        q_squares = _head_squares(mine)
        slack = ROUNDING * np.sqrt(q_squares[:, -1] * squares[:, -1].max())  # single precision
        with np.errstate(over="ignore"):
            least = floor[at : at + step].astype(np.float32) - slack
        alive = own[:, None] != rows[None]
        part, pairs = np.zeros(alive.shape, np.float32), None
        for a in range(0, size, BLOCK):
            b = min(size, a + BLOCK)
            # The distance over b of `size` columns, scaled up, is significantly above the floor's distance
            # if the partial product is below the sum of these two, one of the query and one of the candidate.
            f = 1.0 if b == size else b / size * (1 + EPSILON / np.sqrt(b)) ** 2
            of_q = (q_squares[:, b] - f * (q_squares[:, -1] - 2 * least)) / 2
            of_x = (squares[:, b] - f * squares[:, -1]) / 2
            if pairs is None:
                part += mine[:, a:b] @ turned[:, a:b].T
                alive &= part >= of_q[:, None] + of_x[None]
                if b == size or alive.mean() < SPARSE:
                    pairs = np.nonzero(alive)
                    part = part[pairs]
            else:
                qi, vi = pairs
                part = part + np.einsum("ij,ij->i", turned[vi, a:b], mine[qi, a:b])
                keep = part >= of_q[qi] + of_x[vi]
                pairs, part = (qi[keep], vi[keep]), part[keep]
        qi, vi = pairs
        keep = part + 2 * slack[qi] >= _kth(qi, part, len(own), k)[qi]
        qi, vi = qi[keep], vi[keep]
        exact = (x[vi] * q[at : at + step][qi]).sum(axis=1)
        order = np.lexsort((ids[vi], -exact, qi))
        first = np.searchsorted(qi[order], qi[order])
        order = order[np.arange(len(order)) - first < k]
        out.append((own[qi[order]], ids[vi[order]], exact[order]))
    return [np.concatenate(column) for column in zip(*out)]


def _scale(high, low):
    """The power of two that brings the larger of the two, without sign, to between 1 and 2; 1 for 0."""
    most = np.maximum(np.abs(high), np.abs(low))
    return np.where(most > 0, np.ldexp(1.0, -np.frexp(np.where(most > 0, most, 1.0))[1] + 1), 1.0)


def _head_squares(x: np.ndarray) -> np.ndarray:
    """The squared norm of each row's first i columns, for all i from 0 to their number."""
    out = np.zeros((len(x), x.shape[1] + 1), x.dtype)
    np.cumsum(x**2, axis=1, out=out[:, 1:])
    return out


def _kth(group: np.ndarray, value: np.ndarray, groups: int, k: int) -> np.ndarray:
    """The k-th largest value of each group; minus infinity in smaller groups."""
    order = np.lexsort((value, group))
    end = np.searchsorted(group[order], np.arange(groups), side="right")
    start = np.searchsorted(group[order], np.arange(groups), side="left")
    enough = end - start >= k
    out = np.full(groups, -np.inf)
    out[enough] = value[order][end[enough] - k]
    return out


def search(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K, index: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    index = index or fit(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(index)  # at most MOST_LISTS centres
    size = index["size"]

    def assign(batches):
        c = shared.value["centres"] @ shared.value["turn"].T
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy().reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("embedding"), pa.array(nearest(x, c).astype(np.int32))], ["row", "vec_id", "embedding", "list"])

    # row: a number of each row; it is fixed once the table is written.
    rows = usable(vectors).where(F.col("size") == size).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    dealt = cut(rows.mapInArrow(assign, "row long, vec_id long, embedding array<double>, list int"), "ann-lists")
    # One row for each list: at most MOST_LISTS.
    sizes = dealt.groupBy("list").agg(F.ceil(F.count("*") / F.lit(PIECE)).cast("int").alias("pieces"))
    sizes = F.broadcast(cut(sizes, "ann-sizes"))
    # A hot list is dealt over pieces by a hash of the row's number.
    stored = dealt.join(sizes, "list").withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")).select("list", "piece", "row", "vec_id", "embedding")

    def route(batches, probes):
        c = shared.value["centres"] @ shared.value["turn"].T
        for batch in batches:
            n = batch.num_rows
            q = batch.column("q").flatten().to_numpy().reshape(-1, size)
            best = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
            again = pa.array(np.repeat(np.arange(n), probes))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(again) for i in range(3)), pa.array(best.ravel().astype(np.int32))], ["asking", "q", "floor", "list"])

    def scanned(left: pa.Table, right: pa.Table):
        if not len(left) or not len(right):
            return [[]] * 3
        turn = shared.value["turn"]
        x = left.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, size)
        q = right.column("q").combine_chunks().flatten().to_numpy().reshape(-1, size)
        return scan(left.column("row").to_numpy(), left.column("vec_id").to_numpy(), x, x @ turn, right.column("asking").to_numpy(), q, q @ turn, right.column("floor").to_numpy(), k)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table([pa.array(c, t) for c, t in zip(scanned(left, right), (pa.int64(), pa.int64(), pa.float64()))], names=["asking", "vec_id", "score"])

    def floors(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, _, score = scanned(left, right)
        who, at, n = np.unique(ids, return_index=True, return_counts=True)
        full = n >= k  # scores descend within a query
        return pa.table([pa.array(who[full], pa.int64()), pa.array(np.asarray(score)[at[full] + k - 1], pa.float64())], names=["asking", "floor"])

    def asked(queries: DataFrame, probes: int) -> DataFrame:
        rows = queries.mapInArrow(lambda batches: route(batches, probes), "asking long, q array<double>, floor double, list int")
        return rows.join(sizes, "list")

    def met(stored: DataFrame, rows: DataFrame, f, schema: str) -> DataFrame:
        """Queries of one list and piece are dealt over chunks in the same way, so that no group grows with the table."""
        loads = F.broadcast(cut(rows.groupBy("list").agg(F.ceil(F.count("*") / F.lit(ASKED)).cast("int").alias("chunks")), "ann-loads"))  # a row for each list
        kept = stored.join(loads, "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        rows = rows.join(loads, "list").withColumn("chunk", F.pmod(F.xxhash64("asking"), F.col("chunks")).cast("int"))
        keys = ["list", "piece", "chunk"]
        return kept.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(f, schema)

    named = dealt.where(F.col("vec_id") % every == 0)
    queries = named.select(F.col("row").alias("asking"), F.col("embedding").alias("q"), F.lit(float("-inf")).alias("floor"))
    # The k-th best of one piece of a query's best list is a floor that all other pieces are held against.
    one = asked(queries, 1).withColumn("piece", F.pmod(F.xxhash64("asking"), F.col("pieces")).cast("int")).drop("pieces")
    floor = cut(met(stored, one, floors, "asking long, floor double").groupBy("asking").agg(F.max("floor").alias("low")), "ann-floors")
    queries = queries.join(floor, "asking", "left").select("asking", "q", F.coalesce("low", "floor").alias("floor"))
    rows = asked(queries, index["probes"]).select("asking", "q", "floor", "list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    found = met(stored, rows, run, "asking long, vec_id long, score double")
    order = Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named.select(F.col("row").alias("asking"), F.col("vec_id").alias("query_id")), "asking").select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, found: DataFrame, every: int = QUERY_EVERY, k: int = K, trials: int = TRIALS) -> float:
    """The share of the true neighbours that were found, for `trials` queries at most, each held against all rows.

    A hit is a result that scores no less than the true k-th neighbour, so that ties count alike.
    """
    rows = usable(vectors).select("vec_id", "embedding").dropDuplicates(["vec_id"])
    asked = rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id")).limit(trials).toPandas()
    if asked.empty:
        return 1.0
    ids, q = asked["vec_id"].to_numpy(), np.stack(asked["embedding"])

    def best(batches):
        for batch in batches:
            got = batch.column("vec_id").to_numpy()
            x = batch.column("embedding").flatten().to_numpy().reshape(-1, q.shape[1])
            score = np.where(ids[:, None] == got[None], -np.inf, q @ x.T)
            top = -np.sort(-score, axis=1)[:, :k]
            who, at = np.nonzero(np.isfinite(top))
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(top[who, at])], ["query_id", "score"])

    true = rows.mapInArrow(best, "query_id long, score double")
    true = true.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") <= k)
    true = true.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = found.dropDuplicates(["query_id", "rank"]).join(F.broadcast(true), "query_id").where(F.col("score") >= F.col("least") - 1e-9)  # at most `trials` rows
    return hits.count() / max(1, true.agg(F.sum("n")).first()[0] or 0)
