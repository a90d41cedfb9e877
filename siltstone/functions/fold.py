"""Unicode folding as native expressions: tables made from the character database, applied by translate and map look-ups.

What a character turns into doesn't depend on its neighbours, so the decomposition of a text is that of
its characters.  Texts in ASCII take the built-in lower only.  The tables are constants of a plan, which
Spark prints often, so they hold letters and marks up to U+1FFF, super- and subscripts, letter-like
signs, ligatures and full-width ASCII.  What lies outside, as Hangul and Cherokee, folds by case only;
that keeps equal texts equal.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY, _PAIR = "\u0001", "\u0002"


def _characters():
    for first, last in ((0x80, 0x1FFF), (0x2070, 0x218F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)):
        yield from map(chr, range(first, last + 1))


def folded_char(c: str, casefold: bool) -> str:
    """A character without case, marks and compatibility forms; the Polish l with a stroke is an l."""
    v = (c.casefold() if casefold else c.lower()).replace("ł", "l")
    return "".join(x for x in unicodedata.normalize("NFKD", v) if not unicodedata.combining(x))


@lru_cache
def _table(casefold: bool) -> tuple[str, str, dict[str, str]]:
    """Characters that become one other, or nothing, with what they become, as translate takes them; and those that become several."""
    one, gone, many = [], [], {}
    for c in _characters():
        f = folded_char(c, casefold)
        if f == c or c.lower() != c:  # upper case is lowered before
            continue
        if len(f) == 1:
            one.append((c, f))
        elif f:
            many[c] = f
        else:
            gone.append(c)
    return "".join(c for c, _ in one) + "".join(gone), "".join(f for _, f in one), many


def _class(characters) -> str:
    """A pattern for any of the characters, as ranges."""
    codes, out = sorted(map(ord, characters)), []
    start = last = codes[0]
    for code in [*codes[1:], -1]:
        if code != last + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{last:X}}}")
            start = code
        last = code
    return "[" + "".join(out) + "]"


def _map(table: dict[str, str]) -> Column:
    """A constant map: one literal that the optimiser folds."""
    return F.str_to_map(F.lit(_PAIR.join(k + _KEY + v for k, v in table.items())), F.lit(_PAIR), F.lit(_KEY))


def folded(text: Column, casefold: bool = True) -> Column:
    """Lower case (or casefold) without marks and compatibility forms; punctuation and white space stay."""
    before, after, many = _table(casefold)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(_spread(F.lower(text), many), before, after))


def _spread(text: Column, many: dict[str, str]) -> Column:
    """text with characters that become several; the one that is frequent is replaced, the rest are looked up in the few texts that have any."""
    rest = {k: v for k, v in many.items() if k != "ß"}
    once = F.replace(text, F.lit("ß"), F.lit(many["ß"])) if "ß" in many else text
    several = F.array_join(F.transform(F.split(once, ""), lambda c: F.coalesce(F.try_element_at(_map(rest), c), c)), "")
    # Of Latin-1 few take part: a class of few ranges is tried before that of hundreds, at whose ranges each character would be held.
    return F.when(text.rlike(_class([*(k for k in rest if k < "\u0100"), *map(chr, range(0x100, 0x3000)), *(k for k in rest if k >= "\u3000")])) & text.rlike(_class(rest)), several).otherwise(once)


@lru_cache
def _pairs() -> dict[str, str]:
    """A character and the mark behind it, to the character that has it."""
    found = {}
    for c in _characters():
        d = unicodedata.normalize("NFD", c)
        if len(d) >= 2 and unicodedata.normalize("NFC", d) == c:
            found[unicodedata.normalize("NFC", d[:-1]) + d[-1]] = c
    return {k: v for k, v in found.items() if len(k) == 2}


@lru_cache
def _cases() -> tuple[str, str, dict[str, str]]:
    one, many = [], {}
    for c in _characters():
        f = c.casefold()
        if c.lower() != c:
            continue
        if f != c and len(f) == 1:
            one.append((c, f))
        elif f != c:
            many[c] = f
    return "".join(c for c, _ in one), "".join(f for _, f in one), many


def composed(text: Column) -> Column:
    """Marks joined to the characters before them, where there is a character that has them."""
    step = lambda acc, mark: F.concat(F.left(acc, F.length(acc) - 1), F.coalesce(F.try_element_at(_map(_pairs()), F.concat(F.right(acc, F.lit(1)), mark)), F.concat(F.right(acc, F.lit(1)), mark)))
    cluster = lambda x: F.aggregate(F.split(F.substring(x, F.lit(2), F.length(x)), ""), F.left(x, F.lit(1)), lambda acc, mark: F.when(mark == "", acc).otherwise(step(acc, mark)))
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), 0)
    return F.when(text.rlike(r"\p{M}"), F.array_join(F.transform(parts, cluster), "")).otherwise(text)


def casefolded(text: Column) -> Column:
    """Casefold only: marks and punctuation stay."""
    before, after, many = _cases()
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(_spread(F.lower(text), many), before, after))
