"""Bags of features: words and the character runs of words, counted in Arrow batches and held against queries.

A text of n words has a dozen features a word, so that rows of them cost more than all else.  A batch's
words are numbered, each word is taken apart once, and what a text has is counted and summed in arrays.
"""

from __future__ import annotations

import ctypes
import sys
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and texts, whose features are counted at once; features that a task holds before it passes them on.
BATCH_TEXT, BATCH_ROWS, HELD = 1 << 20, 1024, 2 << 20
#: Cells of a block of texts by features; items and features of a slice of queries.
CELLS, SLICE_ITEMS, SLICE_FEATURES = 2 << 20, 256, 1 << 16

#: Between the seeds of two places of a word or a run.
_STEP = np.array([0x9E3779B97F4A7C15], np.uint64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of n for each; both are natural numbers."""
    if not len(key):
        return key, n
    bits = int(n.max()).bit_length()
    if int(key.max()).bit_length() + bits < 64:  # one sort of both in one number
        both = np.sort((key << bits) | n)
        key, n = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first)


def _taken_apart(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all features of the words; for the words in turn the places of their features there; where each word's begin, and how many they are.

    The last bit of a hash is set for character runs: those of 3 and 4 of the padded word, for words of 3 letters and more.
    """
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "$^")[0].as_py()
    text = np.frombuffer(f"^{joined}$".encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(size + 2) - (size + 2)
    of = np.repeat(np.arange(len(size)), size + 2)
    at, size_of = np.arange(len(text)) - start[of], size[of]
    many = np.where(size >= 3, size * 2, 1)  # the word, its runs of 3, as many as its letters, and those of 4
    begin = np.cumsum(many) - many
    hashes, one = np.empty(many.sum(), np.uint64), np.uint64(1)
    letters = _mixed(text + (at + 8).astype(np.uint64) * _STEP)
    letters[(at == 0) | (at > size_of)] = 0
    hashes[begin] = _mixed(np.add.reduceat(letters, start)) & ~one
    # Three letters fit into one number; a fourth is added to its hash.
    run = np.zeros(len(text), np.uint64)
    run[: len(text) - 2] = (text[:-2] << np.uint64(42)) | (text[1:-1] << np.uint64(21)) | text[2:]
    run = _mixed(run + _STEP)
    longer = np.zeros(len(text), np.uint64)
    longer[: len(text) - 3] = _mixed(run[:-3] + text[3:])
    for hashed, n in ((run, 3), (longer, 4)):
        whole = np.flatnonzero((at < size_of + 3 - n) & (size_of >= 3))
        hashes[begin[of[whole]] + 1 + at[whole] + (size_of[whole] if n == 4 else 0)] = hashed[whole] | one
    coded = pa.array(hashes.view(np.int64)).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy(), begin, many


def counted(keys: pa.Array, counts: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of texts as hashes; and for each pair of a text and a feature of it, by text: the text's row, the feature's place, tf.

    keys: words with single spaces between.  counts: how often each word counts, where not null; else once.
    """
    lists = pc.split_pattern(keys, " ")
    length = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    row, words = np.repeat(np.arange(len(keys)), length), lists.flatten()
    n = np.ones(len(words), np.int64)
    if counts is not None and counts.null_count < len(counts):
        n[np.repeat(counts.is_valid().to_numpy(zero_copy_only=False), length)] = counts.flatten().to_numpy()
    real = pc.binary_length(words).to_numpy() > 0
    if not real.all():
        row, n, words = row[real], n[real], words.filter(pa.array(real))
    if not len(words):
        return (np.zeros(0, np.int64),) * 4
    coded = words.dictionary_encode()
    bits = len(coded.dictionary).bit_length()
    pair, n = _summed((row << bits) | coded.indices.to_numpy(), n)
    row, word = pair >> bits, pair & ((1 << bits) - 1)
    features, places, begin, many = _taken_apart(coded.dictionary)
    many = many[word]
    end = np.cumsum(many)
    place = places[np.repeat(begin[word] - end + many, many) + np.arange(end[-1])]
    bits = len(features).bit_length()
    pair, tf = _summed((np.repeat(row, many) << bits) | place, np.repeat(n, many))
    return features, pair >> bits, pair & ((1 << bits) - 1), tf


@contextmanager
def _reused():
    """Arrays of up to 32 MB come from memory that the worker has already, not each from the system; at the end it goes back."""
    libc = ctypes.CDLL(None) if sys.platform == "linux" else None
    if not hasattr(libc, "malloc_trim") or not hasattr(libc, "mallopt"):
        yield
        return
    trim, mmap = -1, -3  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
    libc.mallopt(mmap, 32 << 20)
    libc.mallopt(trim, 512 << 20)
    try:
        yield
    finally:
        libc.mallopt(mmap, 1 << 20)
        libc.mallopt(trim, 1 << 20)
        libc.malloc_trim(0)


def _pieces(batches):
    """Record batches in pieces of a MB of text; texts without words are left out."""
    with _reused():
        yield from _cut(batches)
    pa.default_memory_pool().release_unused()


def _cut(batches):
    for batch in batches:
        size = pc.binary_length(batch.column("key")).fill_null(0).to_numpy()
        batch, size = batch.filter(pa.array(size > 0)), size[size > 0]
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_TEXT, "right"))
            to = min(max(to, at + 1), at + BATCH_ROWS)
            yield batch.slice(at, to - at)
            at = to


def frequencies(batches):
    """f, df: in how many of the texts (key, n) each feature is; a feature's counts may come in several rows."""
    held: list = []

    def rows():
        f, df = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(f, kind="stable")
        f, df = f[order], df[order]
        first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        return f[first], np.add.reduceat(df, first)

    def out(f, df):
        yield from pa.table({"f": f, "df": df}).to_batches(max_chunksize=1 << 17)

    for piece in _pieces(batches):
        features, _, place, _ = counted(piece.column("key"), piece.column("n"))
        if len(features):
            held.append((features, np.bincount(place)))
        if sum(len(f) for f, _ in held) > HELD:
            held = [rows()]
            if len(held[0][0]) > HELD // 2:
                yield from out(*held.pop())
    if held:
        yield from out(*rows())


def bags(batches):
    """id, f, tf of the texts (id, key, n)."""
    for piece in _pieces(batches):
        features, row, place, tf = counted(piece.column("key"), piece.column("n"))
        yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(row)), pa.array(features[place]), pa.array(tf)], ["id", "f", "tf"])


@dataclass(frozen=True)
class Asked:
    """What texts are held against: frequent features and those of queries, and the queries' weights."""

    features: np.ndarray  #: hashes in order
    idf: np.ndarray  #: of each of them, with the weight of its kind
    rare: tuple[float, float]  #: the least and the largest idf of any other feature
    char_weight: float
    items: pa.Array
    item: np.ndarray  #: of each weight the place of its item, in order,
    place: np.ndarray  #: the place of its feature,
    weight: np.ndarray  #: and itself, by the item's norm

    def slices(self):
        """First and last item; their features in order; weights by feature and item.  Items without features are passed over."""
        ends = np.searchsorted(self.item, np.arange(len(self.items)), "right")
        at = 0
        while at < len(self.items):
            begin = int(ends[at - 1]) if at else 0
            to = min(max(int(np.searchsorted(ends, begin + SLICE_FEATURES, "right")), at + 1), at + SLICE_ITEMS)
            has = slice(begin, int(ends[to - 1]))
            places, column = np.unique(self.place[has], return_inverse=True)
            if len(places):
                weights = np.zeros((len(places), to - at))
                weights[column, self.item[has] - at] = self.weight[has]
                yield at, to, places, weights
            at = to


def _least_copies(piece: pa.RecordBatch, best: int) -> pa.RecordBatch:
    """The piece without those texts whose words stand in `best` texts of it with smaller ids: they can't rank among them."""
    at = pc.sort_indices(pa.table({"key": piece.column("key"), "id": piece.column("id")}), sort_keys=[("key", "ascending"), ("id", "ascending")]).to_numpy()
    same = piece.column("key").dictionary_encode().indices.to_numpy()[at]
    first = np.concatenate(([True], same[1:] != same[:-1]))
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    single = piece.column("n").is_null().to_numpy(zero_copy_only=False)
    keep = np.sort(at[(rank < best) | ~single[at]])
    return piece if len(keep) == piece.num_rows else piece.take(pa.array(keep))


def held_against(batches, asked: Asked, best: int | None, slack: float, id_type: pa.DataType):
    """id, near, far, with: of the texts (id, key, n) the sum of squares of their known features, the others with their tf, and items with
    the products of weights and theirs.

    best: pairs that can't be among an item's so many best are left out.  What the unknown features add to a text's norm lies between
    two bounds, and so does each cosine; a task leaves out those whose upper bound, and more than slack, lies below `best` lower ones.
    """
    floor = np.full((best or 0, len(asked.items)), -np.inf)
    for piece in _pieces(batches):
        piece = piece.filter(piece.column("id").is_valid())
        if best is not None and piece.num_rows:
            piece = _least_copies(piece, best)
        features, row, place, tf = counted(piece.column("key"), piece.column("n"))
        if not len(features) or not len(asked.place):
            continue
        at = np.searchsorted(asked.features, features)
        at[at == len(asked.features)] = 0
        known = asked.features[at] == features
        idf = np.where(known, asked.idf[at], np.where(features & 1, asked.char_weight, 1.0))
        value = (1 + np.log(tf)) * idf[place]
        mine = known[place]
        rows = piece.num_rows
        near = np.bincount(row[mine], value[mine] ** 2, rows)
        far = np.bincount(row[~mine], value[~mine] ** 2, rows)
        least, most = (np.sqrt(near + far * r * r) for r in asked.rare)
        row_k, at_k, value_k = row[mine], at[place[mine]], value[mine]
        found = []
        for first, last, places, weights in asked.slices():
            column = np.full(len(asked.features), -1)
            column[places] = np.arange(len(places))
            c = column[at_k]
            has = c >= 0
            row_c, c, value_c = row_k[has], c[has], value_k[has]
            step = max(1, CELLS // len(places))
            for begin in range(0, rows, step):
                end = min(begin + step, rows)
                these = slice(*np.searchsorted(row_c, [begin, end]))
                block = np.zeros((end - begin, len(places)))
                block[row_c[these] - begin, c[these]] = value_c[these]
                product = block @ weights
                there = product > 0
                if best is not None:
                    lower = np.concatenate((np.where(there, product / most[begin:end, None], -np.inf), floor[:, first:last]))
                    floor[:, first:last] = np.partition(lower, len(lower) - best, axis=0)[len(lower) - best :]
                    there &= product / least[begin:end, None] >= floor[:, first:last].min(axis=0) - slack
                r, i = np.nonzero(there)
                found.append((r + begin, i + first, product[r, i]))
        r, i, product = (np.concatenate(c) for c in zip(*found))
        if not len(r):
            continue
        if best is not None:  # by what the whole piece has shown
            fit = product / least[r] >= floor[:, i].min(axis=0) - slack
            r, i, product = r[fit], i[fit], product[fit]
        order = np.argsort(r, kind="stable")
        r, i, product = r[order], i[order], product[order]
        texts, many = np.unique(r, return_counts=True)
        number = np.full(rows, -1)
        number[texts] = np.arange(len(texts))
        others = ~mine & (number[row] >= 0)
        lists = [np.concatenate(([0], np.cumsum(n))).astype(np.int32) for n in (np.bincount(number[row[others]], minlength=len(texts)), many)]
        far_of = pa.ListArray.from_arrays(lists[0], pa.StructArray.from_arrays([pa.array(features[place[others]]), pa.array(tf[others])], ["f", "tf"]))
        with_of = pa.ListArray.from_arrays(lists[1], pa.StructArray.from_arrays([asked.items.take(pa.array(i)), pa.array(product)], ["item_id", "dot"]))
        yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(texts)).cast(id_type), pa.array(near[texts]), far_of, with_of], ["id", "near", "far", "with"])
