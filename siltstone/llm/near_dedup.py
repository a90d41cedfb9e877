"""Near duplicates: improved consistent weighted sampling over TF-IDF word shingles.

Texts are compared as weighted sets of five-word shingles.  A shingle weighs (1 + ln tf) * idf, with
idf = 1 + min(1, ln(N/df) / ln(RARE)): 2 for whatever less than one document in RARE holds, falling to
1 for what all hold.  df is counted over all documents into CELLS hashed cells; a cell's noise is
some hundredths of what idf takes note of while texts are much shorter than CELLS shingles.  Very long
texts fill the cells: among a dozen of 20,000 words idf of equally rare shingles spreads from 1.2 to 1.8.
idf has a ceiling on purpose: a
group of near copies that holds a third of all rows makes its own shingles common, and with ln(N/df)
alone they would weigh a tenth of a copy's few own shingles, so that true copies fell below AT_LEAST.

1. One pass counts df and gives texts with equal words one key (a 128-bit hash of the words' 64-bit hashes): a node.
2. Each node gets BANDS x ROWS samples (Ioffe's scheme: equal samples have the weighted Jaccard
   similarity as their probability); the samples of a band make its bucket.
3. Each bucket's nodes are paired with its first node, never with each other.  A pair's similarity is
   bounded from above by the nodes' weights in BINS parts of the hash space; what the bound doesn't exclude is
   computed from the nodes' stored shingles, and pairs of AT_LEAST are links.  No pair is compared twice.
4. Connected components of links are classes.  The nodes of buckets that hold several components
   are open.  They are joined on prefixes, in an order of all shingles that has those rare among open
   nodes first: a pair of AT_LEAST has a shingle that is in the part of each text that begins its
   order and outweighs what the pair may lack.  Rounds in which one node of each component meets some
   of the largest at each shingle merge components first; then every pair of open nodes that are still in
   two components is compared, unless the weights that follow the shared shingle prove it below AT_LEAST.

Large buckets meet only aggregates and shuffle joins, whose hot keys AQE splits.  Texts are read four
times; where nodes, or rows that share a class, are too many to be broadcast they are shuffled once for
their shingles, and with their rows by `keep_one`.  Of candidates the shingles are shuffled, once for
each pair that the bound leaves open.  Texts made of common passages only share prefixes nearly all with
all, and the last step writes each such pair before the bound is looked at.
Intermediate tables are written to the shared folder.

Defined cases: null texts and texts without words are one class; texts of fewer than five words have one
shingle, all their words; rows that share a doc_id may be in different classes; of a class the row
with the smallest doc_id stays (null last), and of repeats of that row, one; an empty table gives no
rows; other columns, whatever their names, are ignored by `classes` and carried along by `keep_one`;
every text is read whole, in blocks.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, small

WORDS = 5
AT_LEAST = 0.8
BANDS, ROWS = 9, 3
BASE = 0x5851F42D4C957F2D
OLDEST = 6  #: bands whose buckets have the smallest doc_id as their first node
MET = 16  #: nodes of the largest component that a node of another one meets at a shingle of a merging round
TURNS = 2  #: merging rounds; whatever they find, all remaining pairs are compared after them
RANKS = 1 << 20  #: hashed cells in which shingles of open nodes are counted, for their order
SLACK = 1e-6  #: of the weights, for rounding
BINS = 64  #: parts of the hash space whose weights bound a pair's similarity
PIECE = 1 << 16  #: characters that are hashed at once, but for longer words
CELLS = 1 << 16
RARE = 20
BLOCK = 1024  #: shingles that are sampled at once
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, marks, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    """Of each code point, whether it belongs to a word."""
    return np.fromiter((chr(i).isalnum() or i == ord("_") for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0 to BASE**n modulo 2**64, and their inverses."""
    steps = [np.full(n + 1, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
    for x in steps:
        x[0] = 1
        np.cumprod(x, out=x)
    return steps[0], steps[1]


_piece_powers = lru_cache(maxsize=1)(lambda: _powers(PIECE))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order: of each the polynomial in BASE of its characters.

    Sums of all characters' terms up to each place give each word's polynomial as a difference.
    """
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4") if text else np.zeros(0, np.uint32)
    inside = _is_word()[chars]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    out, first = [], 0
    while first < len(start):
        at = start[first]
        last = max(first + 1, int(np.searchsorted(end, at + PIECE, side="right")))
        n = end[last - 1] - at
        up, down = _piece_powers() if n <= PIECE else _powers(int(n))
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((chars[at : at + n] + np.uint32(1)) * up[:n], out=sums[1:])
            a, b = start[first:last] - at, end[first:last] - at
            out.append(_spread((sums[b] - sums[a]) * down[a]))
        first = last
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(split: list[str] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a list of words, or of their hashes, in ascending order, and their counts."""
    h = split if isinstance(split, np.ndarray) else word_hashes(" ".join(split))
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = min(WORDS, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(_spread(out), return_counts=True)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def weigh(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * idf[_cell(hashes)]


def _spread32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _uniform(x: np.ndarray) -> np.ndarray:
    """24 bits of x, as numbers between 0 and 1."""
    return (x >> np.uint32(8)).astype(np.int32).astype(np.float32) * np.float32(2.0**-24) + np.float32(2.0**-25)


def samples(hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples, as 64-bit values."""
    best, out = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64)
    k = np.arange(n)
    with np.errstate(over="ignore"):
        seeds = _spread32((k + 1).astype(np.uint32) * np.uint32(0x9E3779B1))
        for at in range(0, len(hashes), BLOCK):
            h = hashes[at : at + BLOCK]
            low, high = h.astype(np.uint32)[:, None], (h >> np.uint64(32)).astype(np.uint32)[:, None]
            log_w = np.log(weights[at : at + BLOCK, None]).astype(np.float32)
            x = _spread32(low ^ seeds)
            y = _spread32(high + x)
            z = x * np.uint32(0x9E3779B1) ^ y * np.uint32(0x85EBCA6B)
            # r and c are Gamma(2, 1), of two factors of 16 bits each; beta is uniform.
            r = -np.log(_uniform(x & np.uint32(0xFFFF0000)) * _uniform(x << np.uint32(16)))
            c = -np.log(_uniform(y & np.uint32(0xFFFF0000)) * _uniform(y << np.uint32(16)))
            beta = _uniform(z)
            t = np.floor(log_w / r + beta)
            a = np.log(c) - r * (t - beta + 1)
            first = a.argmin(axis=0)
            found = a[first, k]
            better = found < best
            best = np.where(better, found, best)
            value = _spread(h[first] + t[first, k].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out = np.where(better, value, out)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ascending hashes, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum() if len(both) else 0.0
    # The sum of maxima is all of both sides, less the smaller weight of each shared shingle.
    return float(shared / max(a[1].sum() + b[1].sum() - shared, 1e-300))


def _digest(split: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(split.tobytes())


def _read(batches):
    """The key of each row's words and, at a task's end, its counts by cell."""
    counts, rows = np.zeros(CELLS, np.int64), 0
    names = ["doc_id", "text_hash", "key", "cell", "n"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
    for batch in pieces(batches):
        keys = []
        for text in batch.column("text").to_pylist():
            split = word_hashes(text)
            keys.append(_digest(split))
            cells = _cell(shingles(split)[0])  # ascending, as the hashes are
            counts[cells[np.flatnonzero(np.diff(cells, prepend=-1))]] += 1
        rows += len(keys)
        blank = [pa.nulls(len(keys), k) for k in kinds[3:]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), *blank], names)
    seen = np.flatnonzero(counts)
    blank = [pa.nulls(len(seen) + 1, k) for k in kinds[:3]]
    yield pa.RecordBatch.from_arrays([*blank, pa.array([-1, *seen.tolist()], pa.int32()), pa.array([rows, *counts[seen].tolist()], pa.int64())], names)


def read(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """One pass: doc_id, text_hash, key of each row; and idf by cell, for which CELLS sums reach the driver."""
    rows = docs.select("doc_id", text_hash(), "text").mapInArrow(_read, "doc_id long, text_hash long, key binary, cell int, n long")
    rows = cut(rows, "near-read")
    found = rows.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = found.column("cell").to_numpy(), found.column("n").to_numpy()
    total = max(1, int(n[cell < 0].sum()))
    df = np.zeros(CELLS)
    df[cell[cell >= 0]] = n[cell >= 0]
    return rows.where("key is not null").select("doc_id", "text_hash", "key"), 1 + np.clip(np.log(total / np.maximum(df, 1)) / np.log(RARE), 0, 1)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def _signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """key, rep, buckets: a row for each node that has words."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # CELLS numbers
    bands = np.arange(BANDS, dtype=np.uint64)

    def run(batches):
        for batch in pieces(batches):
            keys, ids, out = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                split = word_hashes(text)
                if not len(split):
                    continue
                h, n = shingles(split)
                s = samples(h, weigh(h, n, shared.value), BANDS * ROWS).reshape(BANDS, ROWS)
                with np.errstate(over="ignore"):
                    x = _spread(bands + np.uint64(1))
                    for row in range(ROWS):
                        x = _spread(x * np.uint64(0x9E3779B97F4A7C15) + s[:, row])
                keys.append(_digest(split))
                ids.append(doc_id)
                out.append(x.view(np.int64))
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            offsets = pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["key", "doc_id", "buckets"])

    signed = docs.select("doc_id", "text").mapInArrow(run, "key binary, doc_id long, buckets array<long>")
    return cut(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("buckets").alias("buckets")), "near-signed")


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def _lists(columns: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, columns)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(columns) if columns else np.zeros(0), kind))


def _slices(column: pa.ListArray) -> list[np.ndarray]:
    """The numbers of each list."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def _features(docs: DataFrame, nodes: DataFrame, idf: np.ndarray) -> DataFrame:
    """key, hashes, counts, weight, bins (weight by part of the hash space) of the nodes (key, rep): of each those of its first row."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in pieces(batches):
            keys, hashes, counts, weight, bins = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                split = word_hashes(text)
                h, n = shingles(split)
                w = weigh(h, n, shared.value)
                keys.append(_digest(split))
                hashes.append(h.view(np.int64))
                counts.append(n.astype(np.int32))
                weight.append(float(w.sum()))
                bins.append(np.bincount(_bin(h), w, BINS))
            columns = [pa.array(keys, pa.binary()), _lists(hashes, pa.int64()), _lists(counts, pa.int32()), pa.array(weight, pa.float64()), _lists(bins, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "hashes", "counts", "weight", "bins"])

    wanted = small(cut(nodes.select("rep").distinct(), "near-reps"))
    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    rows = rows.mapInArrow(run, "key binary, hashes array<long>, counts array<int>, weight double, bins array<double>")
    return cut(rows.join(nodes.select("key"), "key", "left_semi").dropDuplicates(["key"]), "near-features")


def _links(pairs: DataFrame, features: DataFrame, idf: np.ndarray) -> DataFrame:
    """The pairs (a, b) of keys that are similar."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def with_both(pairs: DataFrame, *columns: str) -> DataFrame:
        for side in ("b", "a"):
            pairs = pairs.join(features.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return pairs

    most = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0.0), lambda sum_, x: sum_ + x)
    least = F.lit(AT_LEAST / (1 + AT_LEAST) - SLACK) * (F.col("weight_a") + F.col("weight_b"))
    open_ = cut(with_both(pairs, "weight", "bins").where(most >= least).select("a", "b"), "near-unsettled")

    def run(batches):
        for batch in pieces(batches):
            h = {x: _slices(batch.column(f"hashes_{x}")) for x in "ab"}
            n = {x: _slices(batch.column(f"counts_{x}")) for x in "ab"}
            sides = [[(y.view(np.uint64), weigh(y.view(np.uint64), z, shared.value)) for y, z in zip(h[x], n[x])] for x in "ab"]
            good = pa.array([similarity(x, y) >= AT_LEAST for x, y in zip(*sides)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return cut(with_both(open_, "hashes", "counts").mapInArrow(run, "a binary, b binary"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """key, label: for each node of a link the least key of its component; by least labels and pointer jumps."""
    sides = links.select("a", "b").union(links.select("b", "a")).toDF("key", "to")
    labels = cut(sides.groupBy("key").agg(F.min("to").alias("to")).select("key", F.least("key", "to").alias("label")), "near-labels")
    before = None
    while True:
        sent = sides.join(labels, "key").select(F.col("to").alias("key"), "label")
        labels = cut(labels.union(sent).groupBy("key").agg(F.min("label").alias("label")), "near-labels", labels)
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("far"))
        labels = cut(labels.join(jump, "label").select("key", F.col("far").alias("label")), "near-labels", labels)
        now = labels.agg(F.bit_xor(F.xxhash64("key", "label"))).first()[0]
        if now == before:
            return labels
        before = now


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: components are found among the labels that the links join."""
    of = labels.select(F.col("key").alias("k"), F.col("label").alias("l"))
    ends = links.join(of, F.col("a") == F.col("k"), "left").select(F.coalesce("l", "a").alias("a"), "b")
    ends = ends.join(of, F.col("b") == F.col("k"), "left").select("a", F.coalesce("l", "b").alias("b"))
    found = components(cut(ends.distinct(), "near-ends")).toDF("l", "new")
    old = labels.join(found, F.col("label") == F.col("l"), "left").select("key", F.coalesce("new", "label").alias("label"))
    fresh = found.select(F.col("l").alias("key"), F.col("new").alias("label")).join(labels.select("key"), "key", "left_anti")
    return cut(old.union(fresh), "near-labels", labels)


def prefix(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shingles that a pair of AT_LEAST may have as its first in common, and the weight from each one on.

    counts orders the shingles, rare ones first, and ties by hash.  What two texts of weights v <= w
    share weighs AT_LEAST * w and AT_LEAST / (1 + AT_LEAST) * (v + w) at least, and none of it comes
    before its first shingle.
    """
    order = np.lexsort((hashes, counts))
    rest = np.cumsum(weights[order][::-1])[::-1]
    n = int((rest >= (AT_LEAST - SLACK) * rest[0]).sum())
    return order[:n], rest[:n]


def _may_link(x: str, y: str) -> Column:
    """Whether what follows a shared shingle can hold what a pair of AT_LEAST shares."""
    least = AT_LEAST / (1 + AT_LEAST) - SLACK
    return F.least(f"{x}.rest", f"{y}.rest") >= least * (F.col(f"{x}.weight") + F.col(f"{y}.weight"))


def _pairs(met: DataFrame, compared: DataFrame | None = None) -> DataFrame:
    """The distinct pairs (a, b) of met (key, other), without those compared before."""
    pairs = met.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
    return cut(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "near-pairs")


def _rank_cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - RANKS.bit_length() + 1)).astype(np.int64)


def _postings(features: DataFrame, idf: np.ndarray) -> DataFrame:
    """shingle, key, weight (of the whole text), rest (from this shingle on), inner: prefixes of the texts.

    inner: whether a text that is not heavier than its partner can have it as the first in common.
    Shingles alone in their cell of RANKS are in one text only and left out.
    """

    def count(batches):
        n = np.zeros(RANKS, np.int64)
        for batch in pieces(batches):
            for h in _slices(batch.column("hashes")):
                n[np.unique(_rank_cell(h.view(np.uint64)))] += 1
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], ["cell", "n"])

    found = features.select("hashes").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # RANKS rows at most
    counts = np.zeros(RANKS, np.int64)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    shared = features.sparkSession.sparkContext.broadcast((counts, idf))
    least = 2 * AT_LEAST / (1 + AT_LEAST) - SLACK

    def run(batches):
        counts, idf = shared.value
        for batch in pieces(batches):
            found = []
            for h, n in zip(_slices(batch.column("hashes")), _slices(batch.column("counts"))):
                h = h.view(np.uint64)
                seen = counts[_rank_cell(h)]
                at, rest = prefix(h, weigh(h, n, idf), seen)
                known = seen[at] > 1
                found.append((h[at[known]].view(np.int64), rest[known], rest[0]))
            sizes = [len(h) for h, _, _ in found]
            keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            whole = np.repeat(np.array([x for _, _, x in found], float), sizes)
            h, rest = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind) for i, kind in ((0, np.int64), (1, float)))
            yield pa.RecordBatch.from_arrays([pa.array(h), keys, pa.array(whole), pa.array(rest), pa.array(rest >= least * whole)], ["shingle", "key", "weight", "rest", "inner"])

    return cut(features.select("key", "hashes", "counts").mapInArrow(run, "shingle long, key binary, weight double, rest double, inner boolean"), "near-postings")


def _of_several(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """posted with label and size of its component, of the shingles that nodes of several components have."""
    sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label").withColumnRenamed("key", "k")
    named = posted.join(small(sized), F.col("key") == F.col("k"), "left").drop("k")
    named = named.withColumn("label", F.coalesce("label", "key")).withColumn("size", F.coalesce("size", F.lit(1)))
    several = named.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle")
    return named.join(several, "shingle", "left_semi")


def classes_by_key(docs: DataFrame, idf: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Of the nodes that are linked to others: key, label; and key, links (with how many nodes each was found to be similar)."""
    signed = _signatures(docs, idf)
    rows = signed.select("key", "rep", F.posexplode("buckets").alias("band", "bucket"))
    # First nodes: mostly the oldest text, of which others are copies; in some bands any, for chains of copies.
    place = F.when(F.col("band") < OLDEST, F.coalesce("rep", F.lit((1 << 63) - 1))).otherwise(F.xxhash64("key", "bucket"))
    rows = rows.select("key", "rep", "bucket", F.struct(place.alias("o"), "key").alias("place"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    shared = cut(shared.select("bucket", F.col("first.key").alias("first")), "near-buckets")
    members = cut(rows.drop("place").join(shared, "bucket"), "near-members", signed)
    features = _features(docs, cut(members.select("key", "rep").distinct(), "near-nodes"), idf)
    compared = _pairs(members.where("key <> first").select("key", F.col("first").alias("other")))
    links = _links(compared, features, idf)
    labels = components(links)
    named = members.join(small(labels), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
    several = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    open_ = cut(members.join(several, "bucket", "left_semi").select("key").distinct(), "near-open")
    posted = _postings(features.join(open_, "key", "left_semi"), idf)
    kept = posted.columns
    for turn in range(TURNS):
        # At each shingle one node of each component meets up to MET nodes of the largest one there.
        # What one component alone has stays so, for components only grow together: the next round needs no more than this one's rows.
        mine = cut(_of_several(posted.select(*kept), labels).withColumn("o", F.xxhash64("key", "shingle", F.lit(turn))), "near-mine", posted)
        posted = mine
        node = F.struct("o", "key", "weight", "rest")
        one = mine.groupBy("shingle", "label").agg(F.min(node).alias("it"), F.max("size").alias("size"))
        largest = cut(one.groupBy("shingle").agg(F.max_by("label", F.struct("size", "label")).alias("label")), "near-largest")
        centres = mine.join(largest, ["shingle", "label"]).groupBy("shingle", "label", F.pmod("o", F.lit(MET)).alias("slot")).agg(F.min(node).alias("other"))
        centres = centres.select("shingle", F.col("label").alias("of"), "other")
        met = one.join(centres, "shingle").where((F.col("label") != F.col("of")) & _may_link("it", "other"))
        pairs = _pairs(met.select(F.col("it.key").alias("key"), F.col("other.key").alias("other")), compared)
        compared, found = compared.union(pairs), _links(pairs, features, idf)
        links = links.union(found)
        if not found.isEmpty():
            labels = merged(labels, found)
    # All pairs of nodes that are still in two components.
    mine = cut(_of_several(posted.select(*kept), labels).drop("size"), "near-several", posted)
    node = F.struct("weight", "key", "rest", "label")
    light = mine.where("inner").select("shingle", node.alias("x"))
    heavy = mine.select("shingle", node.alias("y"))
    both = light.join(heavy, (light["shingle"] == heavy["shingle"]) & (F.col("x.label") != F.col("y.label")) & (F.struct("x.weight", "x.key") < F.struct("y.weight", "y.key")) & _may_link("x", "y"))
    found = _links(_pairs(both.select(F.col("x.key").alias("key"), F.col("y.key").alias("other")), compared), features, idf)
    degrees = cut(links.union(found).select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links")), "near-degrees")
    return labels if found.isEmpty() else merged(labels, found), degrees


def _decided(docs: DataFrame) -> DataFrame:
    """_id, _hash, class_id, class_size, links, own, repeats: what shares a class with other rows."""
    thin, idf = read(docs)
    labels, degrees = classes_by_key(docs, idf)
    rows = thin.groupBy("doc_id", "text_hash", "key").agg(F.count("*").alias("rows"))
    rows = rows.join(small(labels.join(degrees, "key")), "key", "left").withColumn("label", F.coalesce("label", "key")).drop("key")
    rows = cut(rows.withColumn("links", F.coalesce("links", F.lit(0).cast("long"))), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash", "rows")
    table = rows.groupBy("label").agg(F.min(order).alias("first"), F.sum("rows").alias("class_size")).where("class_size > 1")
    table = cut(table, "near-classes")
    found = rows.join(small(table), "label")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return cut(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("first.doc_id").alias("class_id"), "class_size", "links", own.alias("own"), F.col("first.rows").alias("repeats")), "near-decided", rows)


def _with_class(rows: DataFrame, decided: DataFrame) -> DataFrame:
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(small(decided), same, "left")


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the class's smallest doc_id), class_size, links, kept.

    links: with how many other texts its text was compared and found similar; what a class holds
    already needs no further comparison, so that it is not the number of all similar texts.
    Repeats of the row that stays count as kept only once.
    """
    decided = _decided(docs)
    rows = _with_class(docs.select("doc_id", text_hash()), decided)
    alone = F.col("class_size").isNull()
    tied = F.coalesce(F.col("own") & (F.col("repeats") > 1), F.lit(False))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    plain = rows.where(~tied).select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", one).alias("class_size"), F.coalesce("links", none).alias("links"), (alone | F.col("own")).alias("kept"))
    again = decided.where("own and repeats > 1").select("class_id", "class_size", "links", F.explode(F.sequence(one, F.col("repeats"))).alias("i"))
    again = again.select(F.col("class_id").alias("doc_id"), "class_id", "class_size", "links", (F.col("i") == 1).alias("kept"))
    return plain.unionByName(again)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    mine = docs.select("doc_id", text_hash(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    stays = _with_class(mine, _decided(docs)).where(F.col("class_size").isNull() | F.col("own"))
    tied = F.coalesce(F.col("repeats") > 1, F.lit(False))
    return stays.where(~tied).select("_row.*").unionByName(stays.where(tied).dropDuplicates(["_id", "_hash"]).select("_row.*"))
