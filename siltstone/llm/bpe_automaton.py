"""BPE encoding and decoding through a tokenization automaton.

The automaton's arcs are labelled with tokens, and it accepts just those token sequences that BPE
makes.  It starts with one state and a loop for each base symbol, and each merge (a, b), in order of
rank, adds a gadget:

1. the new token ab goes where b goes: its state gets a copy of b's outgoing arcs;
2. the state that a leads to loses its arc b: "a b" is from now on always merged;
3. wherever an arc a leaves a state, an arc ab leaves it too: column ab is a copy of column a.

A token thus always leads to one state, so the automaton is deterministic and its table has a row
and a column for each token.  For 49,000 merges that table would have 2.4e9 cells, of which texts use
few, so a cell is filled when a word first needs it, by replaying backwards just the gadgets that
made it (Automaton.arc); a bounded memo holds the cells.

BPE's sequences are closed under prefixes, so each position of a word is reached by exactly one
path from the start.  Encoding fills one state per position from table cells, as a scanner over all
labels names the tokens that end there; no merge is applied to a text.  Decoding emits arc labels.

Defined cases: a null text is the empty one, with no tokens; any text, however long, is coded whole,
at a cost in proportion to its length but for single words, whose longest token bounds the look back.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces
from .word_cache import WordCache

PLAIN = re.compile(r"([a-z]+)([.,;:!?]*)")
END = "\ue000"  #: stands for the end of a word; byte-level symbols never hold it
TABLE_CELLS = 400_000  #: memo of the transition table


class Automaton:
    """labels: of all tokens, by id; merges: (a, b, ab) in order of rank; end: what the last symbol of a word carries."""

    def __init__(self, labels: list[str], merges: list[tuple[int, int, int]], end: str = ""):
        self.left, self.right = [-1] * len(labels), [-1] * len(labels)
        self.born = [-1] * len(labels)
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b, ab) in enumerate(merges):
            self.left[ab], self.right[ab], self.born[ab] = a, b, rank
            self.merged[a, b] = rank
        self.cells: dict[int, bool] = {}
        # All labels in one scanner: it gives the tokens that end at each position of a word.
        self.scanner = ahocorasick.Automaton()
        lives = [True] * len(labels)
        for i, label in enumerate(labels):
            if self.born[i] >= 0:
                # A gadget whose arc b was gone when it came, or one of whose tokens has no arc, never gets one.
                a, b = self.left[i], self.right[i]
                lives[i] = lives[a] and lives[b] and self._replay(a, b, self.born[i])
            if lives[i]:
                key = label.removesuffix(end) + END if end and label.endswith(end) else label
                self.scanner.add_word(key, (i, len(key)))
        self.scanner.make_automaton()
        self.tail = END if end else ""

    def arc(self, u: int, v: int) -> bool:
        """Whether the state that u leads to has an arc v."""
        return self._replay(u, v, len(self.left))

    def _replay(self, u: int, v: int, upto: int) -> bool:
        """The same, after the first `upto` gadgets."""
        born = self.born
        while True:
            rank = self.merged.get((u, v))
            if rank is not None and rank < upto:
                return False  # step 2 of that gadget
            if born[v] >= born[u]:
                if born[v] < 0:
                    return True  # a base symbol's loop
                upto = min(upto, born[v] + 1)  # step 3 copied this cell, after step 2
                v = self.left[v]
            else:
                upto = min(upto, born[u])  # step 1 copied it, before step 2
                u = self.right[u]

    def encode(self, word: str) -> list[int]:
        """The ids of a pre-split word, in the alphabet of base symbols."""
        if not word:
            return []
        cells = self.cells
        at = [-1] * (len(word) + 2)
        size = at[:]
        at[0] = -2
        for last, (token, n) in self.scanner.iter(word + self.tail):
            if at[last + 1] == -1:
                state = at[last + 1 - n]
                if state >= 0:
                    good = cells.get(state << 20 | token)
                    if good is None:
                        good = self.arc(state, token)
                        if len(cells) >= TABLE_CELLS:
                            cells.clear()
                        cells[state << 20 | token] = good
                    if not good:
                        continue
                elif state == -1:
                    continue
                at[last + 1], size[last + 1] = token, n
        out, j = [], len(word) + len(self.tail)
        while j:
            out.append(at[j])
            j -= size[j]
        out.reverse()
        return out


class Codec:
    """A tokenizer file's own normaliser and pre-splitter around the automaton."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        model = spec["model"]
        vocab = dict(model["vocab"])
        labels = [""] * len(vocab)
        for label, i in vocab.items():
            labels[i] = label
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], model.get("end_of_word_suffix") or "")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        # Where the file treats plain ASCII words as this pattern does, they needn't go through the library.
        probes = ["abc", "AbC", "zz.", "Q,,", "it;:", "don'", "x-y", "a1", "Ab!?"]
        self.plain = PLAIN if all([w for w, _ in self.split(self.normalise(p))] == [g for g in m.groups() if g] for p in probes if (m := PLAIN.fullmatch(p.lower()))) else None
        self.words = WordCache(lambda w: array("I", self.automaton.encode(w)).tobytes(), 100_000)
        self.units = WordCache(self._unit, 150_000)
        self.units[""] = b""
        size = max([len(labels), *(i + 1 for i in self.special.values())])
        names = labels + [""] * (size - len(labels))
        for content, i in self.special.items():
            names[i] = content
        self.names = [x.encode() for x in names]
        self.decimal = [str(i).encode() for i in range(size)]

    def _unit(self, unit: str) -> bytes:
        for content, i in self.special.items():
            if content in unit:
                mark = np.array([i], "<u4").tobytes()
                return mark.join(self._unit(part) for part in unit.split(content))
        if self.plain and (found := self.plain.fullmatch(unit.lower())) and unit.isascii():
            word, mark = found.groups()
            return self.words[word] + self.words[mark] if mark else self.words[word]
        return b"".join([self.words[word] for word, _ in self.split(self.normalise(unit))]) if unit else b""

    def forget(self) -> None:
        self.units.forget()
        self.units[""] = b""
        self.words.forget()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers.  Spaces end words, so what is between two is coded once."""
        return b"".join(map(self.units.__getitem__, text.split(" "))) if text else b""

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, as the file has no decoder: joined by a space."""
        return b" ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _with_memos(own: Codec, batches):
    """The batches in pieces; the codec's memos live as long as the task."""
    try:
        yield from pieces(_then(batches, own.forget))
    finally:
        own.forget()


def _then(batches, last):
    """The batches; last() is called once the one after the last is asked for, when all are coded."""
    yield from batches
    last()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches):
        own = codec(path)
        for batch in _with_memos(own, batches):
            coded = [np.frombuffer(own.encode(t), "<u4") for t in batch.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, coded)], dtype=np.int32)
            flat = np.concatenate(coded).astype(np.int32) if coded else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: what the automaton's labels spell."""

    def run(batches):
        own = codec(path)
        for batch in pieces(batches):
            texts = [own.decode(x or []).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, then decodes its ids."""

    def run(batches):
        own = codec(path)
        for batch in _with_memos(own, batches):
            count, first, second = [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.frombuffer(own.encode(text), "<u4").tolist()
                count.append(len(ids))
                first.append(hashlib.sha256(b" ".join(map(own.decimal.__getitem__, ids))).hexdigest())
                second.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
