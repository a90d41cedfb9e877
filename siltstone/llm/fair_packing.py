"""Packing by deficit round-robin over source queues, so that every window has the target proportions.

Each source queues its documents, ids and end id in a row, in the order in which they are read.  A
window of `length` tokens visits the queues in turn: a queue is owed length x its share in each
window, takes that to the nearest token, and carries what it is still owed, or has had too much, as
its deficit into the next window.  Documents are cut where a queue's turn ends.  Deficits go on over
all windows: no queue is ever more than about one token away from its share of the tokens so far.

The state of the round after any number of tokens has a closed form: tokens are taken in order of
(place in the queue + 1/2) / weight, ties by queue, so a queue with weight w has had x * w tokens, to
the nearest one, when virtual time is x.  Any task can thus take up the round at any window, with
the very deficits that the windows before it leave.  Windows are made where the documents are, and
no ids are shuffled; each task needs where its documents begin in their queues, which sums of tokens
by task and source tell.  What remains after the last whole window fills windows of ever smaller
powers of two in the same way, so nothing is padded.

A source with less than one token in a window shares a queue with the others of its kind, after the
own queues; so there are at most length + 1 queues, whose totals are all that the driver sees.
Where targets are given, a queue that runs out leaves its turns to the others.

Defined cases: a null text has just the end id; a null source is a queue of its own, the last;
repeated rows and null doc_ids are documents each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pieces, small
from .token_store import encoder

LENGTH, END_ID = 2048, 1


@dataclass
class Round:
    """The round over queues with so many tokens and these weights."""

    tokens: np.ndarray
    weights: np.ndarray
    length: int = LENGTH

    def __post_init__(self):
        self.tokens, self.weights = np.asarray(self.tokens, np.int64), np.asarray(self.weights, float)
        self.whole, rest = divmod(int(self.tokens.sum()), self.length)
        self.rest = np.cumsum([0, *(1 << b for b in range(self.length.bit_length() - 1, -1, -1) if rest >> b & 1)])
        order = np.argsort(self.tokens / self.weights, kind="stable") if len(self.tokens) else []
        self.times = np.concatenate([[0.0], (self.tokens / self.weights)[order]])
        self.upto = np.minimum(self.times[:, None] * self.weights, self.tokens).sum(axis=1)

    def begin(self, window: np.ndarray) -> np.ndarray:
        """The tokens before a window."""
        return np.where(window <= self.whole, window * self.length, self.whole * self.length + self.rest[np.clip(window - self.whole, 0, len(self.rest) - 1)])

    def window(self, token: np.ndarray) -> np.ndarray:
        """The window of the token with so many before it."""
        tail = token - self.whole * self.length
        return np.where(tail < 0, token // self.length, self.whole + np.searchsorted(self.rest, tail, side="right") - 1)

    def _time(self, place: np.ndarray) -> np.ndarray:
        return (place + 0.5) / self.weights

    def _had(self, time: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """What each queue has had before a time, a row for each time; with ties, at that time too."""
        n = np.clip(np.floor(time[:, None] * self.weights + 0.5).astype(np.int64), 0, self.tokens)
        over = lambda at: np.where(ties, self._time(at) <= time[:, None], self._time(at) < time[:, None])
        for _ in range(2):  # rounding is off by one at most
            n = np.where((n > 0) & ~over(n - 1), n - 1, n)
            n = np.where((n < self.tokens) & over(n), n + 1, n)
        return n

    def served(self, total: np.ndarray) -> np.ndarray:
        """What each queue has had of the first `total` tokens of the round, a row for each total."""
        n = self._had(np.interp(total, self.upto, self.times), np.ones(len(self.tokens), bool))
        rows, last = np.arange(len(total)), len(self.tokens) - 1
        while (left := total - n.sum(axis=1)).any():
            following = np.where(n < self.tokens, self._time(n), np.inf)
            latest = np.where(n > 0, self._time(n - 1), -np.inf)[:, ::-1]
            n[rows, following.argmin(axis=1)] += left > 0
            n[rows, last - latest.argmax(axis=1)] -= left < 0
        return n

    def before(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The tokens of the round before the one at a place of a queue."""
        time = (place + 0.5) / self.weights[queue]
        had = self._had(time, np.arange(len(self.tokens)) < queue[:, None])
        had[np.arange(len(queue)), queue] = place
        return had.sum(axis=1)

    def cuts(self, queue: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple:
        """Documents of n tokens at places of their queues, cut by windows: document, window, begin and end in the queue, offset in the window."""
        first, last = self.window(self.before(queue, place)), self.window(self.before(queue, place + n - 1))
        doc = np.repeat(np.arange(len(n)), last - first + 1)
        window = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
        edges, at = np.unique(np.concatenate([window, window + 1]), return_inverse=True)
        served = self.served(self.begin(edges))
        lo, hi, q = at[: len(doc)], at[len(doc) :], queue[doc]
        begin, end = np.maximum(place[doc], served[lo, q]), np.minimum((place + n)[doc], served[hi, q])
        ahead = np.concatenate([np.zeros((len(served), 1), np.int64), np.cumsum(served, axis=1)], axis=1)
        offset = ahead[hi, q] - ahead[lo, q] + begin - served[lo, q]
        has = end > begin
        return doc[has], window[has], begin[has], end[has], offset[has]


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """part, source, doc_id, before (tokens of the source that the part has before), n, ids (little-endian)."""
    width = encoder(path).width

    def run(batches):
        own, part, had = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], f"<u{width}").tobytes()
        for batch in pieces(batches):
            before, n, ids = [], [], []
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                found = own.encode(text)
                ids.append((found if width == 4 else np.frombuffer(found, "<u4").astype("<u2").tobytes()) + end)
                before.append(had.get(source, 0))
                n.append(len(ids[-1]) // width)
                had[source] = before[-1] + n[-1]
            columns = [pa.array([part] * len(n), pa.int32()), batch.column("source"), batch.column("doc_id"), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "source", "doc_id", "before", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(run, "part int, source string, doc_id long, before long, n long, ids binary")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, targets: dict | None = None, ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue; with ids, also its ids.

    length is a power of two.  targets: source to weight; a source that isn't named, or all, weigh their tokens.
    """
    if length & length - 1 or length < 1:
        raise ValueError("length must be a power of two")
    width = encoder(path).width
    rows = cut(encoded(docs, path, end_id), "pack-ids")
    sums = cut(rows.groupBy("part", "source").agg(F.sum("n").alias("n")), "pack-sums")
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    own = totals.where(F.col("n") * length >= total).collect()  # at most `length` rows
    own.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    queues = sums.sparkSession.createDataFrame([(r["source"], i) for i, r in enumerate(own)], "s string, queue int")
    tokens = [r["n"] for r in own] + [total - sum(r["n"] for r in own)] * (total > sum(r["n"] for r in own))
    weights = [(targets or {}).get(r["source"], r["n"]) for r in own] + tokens[len(own) :]
    order = Round(tokens, weights, length)

    sums = sums.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").fillna(len(own), "queue")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy("queue", "part").agg(F.sum("n").alias("n"))  # a queue has a row for each part
    parts = parts.select("queue", "part", earlier(Window.partitionBy("queue").orderBy("part")).alias("base"))
    sums = sums.withColumn("within", earlier(Window.partitionBy("part", "queue").orderBy("source"))).join(parts, ["queue", "part"])
    places = cut(sums.select(F.col("part").alias("p"), F.col("source").alias("s"), "queue", (F.col("base") + F.col("within")).alias("base")), "pack-places")
    rows = rows.join(small(places), (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select("doc_id", "queue", (F.col("base") + F.col("before")).alias("place"), "n", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids"]

    def run(batches):
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            queue, place, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("queue", "place", "n"))
            doc, window, begin, end, offset = order.cuts(queue, place, n)
            start, stop = begin - place[doc], end - place[doc]
            payload, held = batch.column("ids"), None
            crcs, lists, known = [], [], -1
            for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist()):
                if d != known:
                    known, held = d, np.frombuffer(payload[d].as_buffer(), f"<u{width}").astype("<u4")
                crcs.append(zlib.crc32(held[a:b]))
                if ids:
                    lists.append(held[a:b].astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(doc)), *(pa.array(x) for x in (start, stop - start)), pa.array(crcs, pa.int64()), *(pa.array(x) for x in (n[doc], window, offset)), pa.array(queue[doc].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(lists, pa.list_(pa.int32()))] if ids else [])], names[: len(columns) + ids])

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int" + ", ids array<int>" * ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The windows of pack(ids=True): sequence_id, ids, and the document and length of each piece, in order; at most `length` ids a group."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["length"].alias("length"))).alias("pieces"))
