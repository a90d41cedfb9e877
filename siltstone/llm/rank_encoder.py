"""Ids of byte-level vocabularies by merge ranks: the ids of the tokenizers library, in a third of its time.

In a byte-level file whose merges make ids in ascending order, an id is its merge's rank, and tiktoken
merges by rank.  Texts for which the two libraries could differ go to the tokenizers library itself:
those with strings of special tokens, with characters above U+024F (each has its own tables of
letters), or with very long words.  Files of another kind go there with all texts.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

from .token_store import UnitEncoder, _byte_letters

#: The pieces that a byte-level pre-splitter makes; fixed value, as in the public vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(path: str) -> dict[bytes, int] | None:
    """The ranks that a file's ids are; None if they are none."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if file.get("normalizer") or file.get("post_processor") or model["type"] != "BPE" or any(split.get(k) != v for k, v in plain.items()):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    hidden = _byte_letters()
    letters = {hidden.get(b, chr(b)): b for b in range(256)}
    special = {x["content"] for x in file.get("added_tokens", [])}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    if any(c not in letters for k in vocab for c in k):
        return None
    ids = [vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
    if len(ids) + 256 != len(vocab) or any(a >= b for a, b in zip(ids, ids[1:])) or (ids and ids[0] < 256):
        return None
    return {bytes(letters[c] for c in k): v for k, v in vocab.items()}


class RankEncoder:
    """encode(text): the ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.path, self.width = path, 2 if library.get_vocab_size() <= 1 << 16 else 4
        special = [re.escape(x.content) for x in library.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join(["[^\x00-ɏ]", r"\S{1000}", r"\s{1000}", *special])).search
        ranks = _ranks(path)
        self.ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None
        self.other: UnitEncoder | None = None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.ranked is None or self.odd(text):
            self.other = self.other or UnitEncoder(self.path)
            return self.other.encode(text)
        return array("I", self.ranked(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> RankEncoder:
    return RankEncoder(path)
