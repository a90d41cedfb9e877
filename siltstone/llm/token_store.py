"""Token ids as binary shards, with a minimal perfect hash index for keyed access.

Files, all under one folder that every executor sees:

- `ids-<shard>-<attempt>.bin`: the ids of the shard's documents, one after the other, as little-endian
  unsigned integers and nothing else, of 16 bits where the vocabulary has at most 65,536 ids, else of
  32; `.len` beside it: the number of ids of each document, of 32 bits each.
- `index-<bucket>-<attempt>.npz`: for the keys that hash to the bucket, a minimal perfect hash
  (levels of bit sets: a key's slot is the rank of the first bit that it has to itself) and, by
  slot, the key's fingerprint and the place of its first document: shard, row, offset.

Documents are in ascending doc_id order over all shards.  A lookup is a hash to a bucket, a few
probes and a fingerprint comparison, whatever the number of keys; an absent key is found out by its
fingerprint, but for one in 2**32.  Each task writes files of its own name, and the tables of files
hold only those of attempts that succeeded, so a repeated or lost task does no harm.

Defined cases: a null text has just the end id; null doc_ids come first and are a key too; rows that
share a doc_id are one key whose documents lie in a row, over as many shards as it takes (equal ids
are ordered by a hash of the text, so that a hot one is dealt over shards); no rows make no files;
other columns are ignored.
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path, partitions
from .word_cache import WordCache

END_ID = 0
KEYS_A_BUCKET = 200_000
GAMMA, LEVELS = 1.5, 24
U64 = np.uint64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser: every bit of the key and the seed moves every bit of the result."""
    with np.errstate(over="ignore"):
        x = keys.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def perfect_hash(keys: np.ndarray) -> dict[str, np.ndarray]:
    """The levels for distinct keys; those that no level settles (hardly any) are listed in `rest`."""
    sizes, bits, left = [], [], keys.astype(U64)
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, int(len(left) * GAMMA))
        at = (mixed(left, level) % U64(size)).astype(np.int64)
        own = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(own)
        left = left[~own[at]]
    return {"sizes": np.array(sizes, np.int64), "bits": np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8), "rest": np.sort(left)}


class PerfectHash:
    def __init__(self, stored: dict[str, np.ndarray]):
        self.sizes, self.rest = stored["sizes"], stored["rest"]
        total = int(self.sizes.sum())
        self.bits = np.unpackbits(stored["bits"], count=total).astype(bool) if total else np.zeros(0, bool)
        self.rank = np.concatenate([[0], np.cumsum(self.bits)]).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """0 to n-1, each once, for the keys it was made for; for others any slot, or -1."""
        keys = keys.astype(U64)
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                return out
            at = base + (mixed(keys[todo], level) % U64(size)).astype(np.int64)
            found = self.bits[at]
            out[todo[found]] = self.rank[at[found]]
            todo, base = todo[~found], base + size
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            found = self.rest[at] == keys[todo]
            out[todo[found]] = self.rank[-1] + at[found]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> U64(32)).astype(np.uint32)


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 as it is, the others from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class UnitEncoder:
    """The tokenizers library behind a memo of what lies between spaces.

    The byte-level pre-splitter starts a new piece at each space that follows and precedes a
    character which is no white space, so texts are cut there, and equal cuts are encoded once.
    """

    ODD = re.compile(r"[^\S \n]")
    SAFE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.split, self.piece = library.pre_tokenizer.pre_tokenize_str, library.model.tokenize
        self.special = [x.content for x in library.get_added_tokens_decoder().values()]
        self.whole = library.normalizer is not None or library.post_processor is not None
        self.width = 2 if library.get_vocab_size() <= 1 << 16 else 4
        self.bytes = _byte_letters()
        # Where the file splits words of Latin letters as `_parts` does, they needn't go through its pre-splitter.
        probes = [" abc", "AbC", " zz.", "Q,,", " it;:", "Ab!?", " é", "Žluť.", " ŉœ:!"]
        parts = [self._parts(p.removeprefix(" "), " " * p.startswith(" ")) for p in probes]
        self.plain = all([w for w, _ in self.split(p)] == [self._piece(x) for x in found] for p, found in zip(probes, parts))
        self.first, self.rest = WordCache(lambda unit: self._code(unit, "", self.first), 20_000), WordCache(lambda unit: self._code(unit, " ", self.rest), 500_000)
        self.marks = WordCache(self._ids, 1000)

    def _ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.piece(piece)]).tobytes()

    def _piece(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.bytes)

    @staticmethod
    def _parts(unit: str, lead: str) -> list[str] | None:
        """A word and the marks behind it, if the unit is that and no more."""
        word = unit.rstrip(".,;:!?")
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            return [lead + word, unit[len(word) :]] if len(word) < len(unit) else [lead + word]
        return None

    def _code(self, unit: str, lead: str, known: WordCache) -> bytes:
        """The library's ids; its own model runs on each piece that its own pre-splitter makes."""
        if self.plain and (parts := self._parts(unit, lead)):
            if len(parts) > 1:
                return known[parts[0].removeprefix(lead)] + self.marks[parts[1]]
            return self._ids(self._piece(parts[0]))
        text = lead + unit
        if self.whole or any(content in text for content in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self._ids(piece) for piece, _ in self.split(text)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " " or self.ODD.search(text):
            units = self.SAFE.split(text)
        else:
            units = text.split(" ")
        return self.first[units[0]] + b"".join(map(self.rest.__getitem__, units[1:]))


def encoder(path: str):
    """By merge ranks where the file allows it; texts for which that could differ go through UnitEncoder."""
    from .rank_encoder import encoder as ranked

    return ranked(path)


def _open(root: str):
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(root)
    return where, base


@dataclass
class TokenStore:
    """What the driver knows of a store: one entry for each shard and for each bucket."""

    root: str
    shards: list[tuple[str, int, int]]  #: file, documents, ids before it
    buckets: dict[int, str]
    n_buckets: int
    width: int  #: bytes of an id
    manifest: DataFrame


def write(docs: DataFrame, path: str, root: str | None = None) -> TokenStore:
    spark = docs.sparkSession
    root = root or new_path(spark, "tokens")
    where, base = _open(root)
    where.create_dir(base, recursive=True)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    width = encoder(path).width
    ranged = docs.select("doc_id", "text").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        own, shard, name = encoder(path), TaskContext.get().partitionId(), ""
        fs, at = _open(root)
        row = offset = 0
        lengths, out, end, kind = [], None, np.array([END_ID], f"<u{width}").tobytes(), f"<u{width}"
        for batch in batches:
            if out is None and batch.num_rows:
                name = f"ids-{shard:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{at}/{name}.bin")
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                payload = own.encode(text)
                out.write((payload if width == 4 else np.frombuffer(payload, "<u4").astype(kind).tobytes()) + end)
                sizes[i] = len(payload) // 4 + 1
            if batch.num_rows:
                starts = offset + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                rows = np.arange(row, row + batch.num_rows)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([name] * n, pa.string()), batch.column("doc_id"), pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["shard", "file", "doc_id", "row", "offset", "n"])
                lengths.append(sizes)
                row, offset = row + n, offset + int(sizes.sum())
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{at}/{name}.len") as f:
                f.write(np.concatenate(lengths).astype("<u4").tobytes())

    manifest = cut(ranged.mapInArrow(run, "shard int, file string, doc_id long, row long, offset long, n long"), "tokens-manifest")
    # One row for each shard.
    found = manifest.groupBy("shard").agg(F.first("file").alias("file"), F.count("*").alias("docs"), F.sum("n").alias("ids")).orderBy("shard").collect()
    shards: list[tuple[str, int, int]] = []
    renumber, before = {}, 0
    for r in found:
        renumber[r["shard"]] = len(shards)
        shards.append((r["file"], r["docs"], before))
        before += r["ids"]
    n_docs = sum(s[1] for s in shards)
    n_buckets = max(partitions(spark), -(-n_docs // KEYS_A_BUCKET))
    buckets = _index(manifest, root, renumber, n_buckets)
    return TokenStore(root, shards, buckets, n_buckets, width, manifest)


def _index(manifest: DataFrame, root: str, renumber: dict[int, int], n_buckets: int) -> dict[int, str]:
    places = manifest.groupBy("doc_id").agg(F.min(F.struct("shard", "row", "offset")).alias("at"), F.count("*").alias("docs"))
    places = places.select(_bucket(n_buckets), "doc_id", "at.shard", "at.row", "at.offset", "docs")
    places = places.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")

    def build(t: pa.Table, fs, at: str) -> tuple[int, str]:
        has = np.asarray(t.column("doc_id").is_valid())
        keys = t.column("doc_id").fill_null(0).to_numpy().astype(np.int64).view(U64)
        rest = {k: t.column(k).to_numpy() for k in ("row", "offset", "docs")}
        rest["shard"] = np.array([renumber[s] for s in t.column("shard").to_pylist()], np.int64)
        stored = perfect_hash(keys[has])
        slots = PerfectHash(stored).slots(keys[has])
        place = np.empty(int(has.sum()), np.int64)
        place[slots] = np.flatnonzero(has)
        bucket = t.column("bucket")[0].as_py()
        name = f"index-{bucket:06d}-{uuid.uuid4().hex}.npz"
        data = io.BytesIO()
        np.savez(data, **stored, mark=fingerprints(keys[place]), **{k: v[place] for k, v in rest.items()}, **{f"null_{k}": v[~has] for k, v in rest.items()})
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(data.getvalue())
        return bucket, name

    def run(batches):
        fs, at = _open(root)
        made = [build(t, fs, at) for t in _by_bucket(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([n for _, n in made], pa.string())], ["bucket", "file"])

    # One row for each bucket, of up to some 200,000 keys.
    return {r["bucket"]: r["file"] for r in cut(places.mapInArrow(run, "bucket int, file string"), "tokens-index").collect()}


def _bucket(n_buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("int").alias("bucket")


def _by_bucket(batches):
    """Tables of one bucket each, from batches that are in order of buckets."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = np.asarray(batch.column("bucket"))
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                if held and held[-1].column("bucket")[0].as_py() != int(at[a]):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def lookup(store: TokenStore, keys: DataFrame) -> DataFrame:
    """keys: doc_id.  Where each key's documents are: doc_id, shard, row, offset, docs; a row for each shard, none for absent keys."""
    root, buckets, shards = store.root, store.buckets, [(s[1], s[2]) for s in store.shards]

    def find(t: pa.Table, fs, at: str) -> pa.RecordBatch:
        name, out = buckets.get(t.column("bucket")[0].as_py()), []
        if name is not None:
            with fs.open_input_file(f"{at}/{name}") as f:
                index = dict(np.load(io.BytesIO(f.read())))
            ids = t.column("doc_id").combine_chunks()
            has = np.asarray(ids.is_valid())
            wanted = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            slots = PerfectHash(index).slots(wanted.view(U64))
            good = has & (slots >= 0)
            good[good] = index["mark"][slots[good]] == fingerprints(wanted.view(U64)[good])
            fields = ("shard", "row", "offset", "docs")
            hits = [(int(wanted[i]), *(int(index[k][slots[i]]) for k in fields)) for i in np.flatnonzero(good)]
            if len(index["null_docs"]):
                hits += [(None, *(int(index[f"null_{k}"][0]) for k in fields)) for _ in np.flatnonzero(~has)]
            for key, shard, row, offset, docs in hits:
                while docs > 0:
                    here = min(docs, shards[shard][0] - row)
                    out.append((key, shard, row, offset, here))
                    docs, shard, row, offset = docs - here, shard + 1, 0, 0
        columns = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "shard", "row", "offset", "docs"])

    def run(batches):
        fs, at = _open(root)
        for t in _by_bucket(batches):
            yield find(t, fs, at)

    asked = keys.select(_bucket(store.n_buckets), "doc_id").repartition(store.n_buckets, "bucket").sortWithinPartitions("bucket")
    return asked.mapInArrow(run, "doc_id long, shard int, row long, offset long, docs long")


def read(store: TokenStore, places: DataFrame, digest: bool = False) -> DataFrame:
    """The documents at the places that lookup() gives: doc_id, start, n_tokens, and ids array<long> or their ids_crc32."""
    root, shards, width = store.root, store.shards, store.width

    def run(batches):
        fs, at = _open(root)
        opened, data, lengths = None, None, None
        for batch in batches:
            out = []
            for key, shard, row, offset, docs in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if shard != opened:
                    if data is not None:
                        data.close()
                    opened, data = shard, fs.open_input_file(f"{at}/{shards[shard][0]}.bin")
                    with fs.open_input_file(f"{at}/{shards[shard][0]}.len") as f:
                        lengths = np.frombuffer(f.read(), "<u4")
                for n in lengths[row : row + docs].tolist():
                    ids = np.frombuffer(data.read_at(n * width, offset * width), f"<u{width}")
                    out.append((key, shards[shard][2] + offset, n, zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64)))
                    offset += n
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int64())))], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
        if data is not None:
            data.close()

    rows = places.select("doc_id", "shard", "row", "offset", "docs").repartition(max(len(shards), 1), "shard").sortWithinPartitions("shard", "row")
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Writes docs, looks every key up in the index, and reads all of them back."""
    store = write(docs, path)
    keys = docs.select("doc_id").distinct()
    return read(store, lookup(store, keys), digest=True)

