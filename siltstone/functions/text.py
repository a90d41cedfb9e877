"""Text functions: Column to Column, all built-in, so that they stay inside code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import casefolded, composed, folded

# Words that say nothing about a topic, after cutting to stems.
STOP = ("the", "and", "that", "with", "for", "from", "this", "was", "are", "les", "des", "und", "der", "die", "das", "los", "las", "que", "pour", "dans")
#: Prefixes of words that belong to the exercise and not to its topic.
TASK_PREFIXES = ("interpret",)
STEM = 5


def plain(text: Column) -> Column:
    """Lower case without marks and compatibility forms; punctuation stays."""
    return folded(text, casefold=False)


def key(text: Column) -> Column:
    """For comparison by words: no case, marks or punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), r"[^\p{L}\p{N}_\s]", " "), r"[\s\p{Z}]+", " "))


def squeezed(text: Column) -> Column:
    """Composed characters without case, with single spaces; punctuation, marks and negations stay."""
    return F.trim(F.regexp_replace(composed(casefolded(composed(text))), r"[\s\p{Z}]+", " "))


def compact(text: Column) -> Column:
    """Letters and digits only: what a lossless split must keep."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def stem(word: Column) -> Column:
    return F.left(word, F.lit(STEM))


def tokens(text: Column, stop=STOP, prefixes=TASK_PREFIXES) -> Column:
    """Stems of words and of three- or four-digit numbers, repeats included."""
    found = F.regexp_extract_all(plain(text), F.lit(token_pattern(stop, prefixes)), 0)
    # What numbers may also begin with or be; of words the pattern has left these out.
    stop, prefixes = ([w for w in of if not _LETTERS.fullmatch(w)] for of in (stop, prefixes))
    if not any(c.isdigit() for w in stop for c in w) and not prefixes:
        return found
    return F.filter(found, lambda w: reduce(lambda good, p: good & ~F.startswith(w, F.lit(p)), prefixes, ~w.isin(*stop, "")))


_LETTERS = re.compile("[a-z]+")


def token_pattern(stop=STOP, prefixes=TASK_PREFIXES) -> str:
    """A token in one pattern, so that no word passes through a lambda.

    It takes the first letters of a run of letters, unless the run is short, a Roman numeral, begins with a prefix or has one
    of the stop words as its stem; or three or four digits.
    """
    end = "(?![a-z])"
    out = [f"[ivxlcdm]++{end}", *filter(_LETTERS.fullmatch, prefixes), *(w if len(w) == STEM else w + end for w in stop if _LETTERS.fullmatch(w) and len(w) <= STEM)]
    return f"(?<![a-z])(?!{'|'.join(out)})[a-z]{{3,{STEM}}}|[0-9]{{3,4}}"


def words(text: Column) -> Column:
    """White-space separated words, as they are."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def ngrams(items: Column, n: int) -> Column:
    """The set of runs of n items, joined by spaces; empty if there are fewer (a sequence down to 1 would run backwards)."""

    def runs(a):
        found = F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), " "))
        return F.when(F.size(a) >= n, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return bound(items, runs)


def pairs(items: Column) -> Column:
    """The set of adjacent pairs."""
    return ngrams(items, 2)


def char_grams(word: Column, n: int) -> Column:
    """All runs of n characters of a padded word."""
    return bound(F.concat(F.lit("^"), word, F.lit("$")), lambda padded: _runs(padded, n))


def _runs(padded: Column, n: int) -> Column:
    return F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, n))).otherwise(F.array().cast("array<string>"))


def features(text: Column, least: int = 3) -> Column:
    """`w:` words and, of words of `least` characters, `c:` runs of 3 and 4 characters; repeats included."""
    ws = F.filter(F.split(key(text), " "), lambda w: w != "")
    long = F.filter(ws, lambda w: F.length(w) >= least)
    chars = F.flatten(F.transform(long, lambda w: F.concat(char_grams(w, 3), char_grams(w, 4))))
    return F.concat(F.transform(ws, lambda w: F.concat(F.lit("w:"), w)), F.transform(chars, lambda c: F.concat(F.lit("c:"), c)))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def title(text: Column, mark: str = " — ") -> Column:
    """The first line, up to its section mark."""
    return F.substring_index(first_line(text), mark, 1)


def years(text: Column) -> Column:
    """Years from 500 to 2029 as integers, in order of appearance."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{3,4})\b"), 1), lambda y: y.cast("int")), lambda y: (y >= 500) & (y <= 2029))


def roman(n: int) -> str:
    out = ""
    for value, letters in ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + letters, n - value
    return out


#: Numerals of the centuries that texts speak of.
CENTURIES = {roman(n): n for n in range(1, 22)}
# How texts name decades, ranges of centuries, centuries, and years before the common era.
DECADE = r"\b([0-9]0)\.\s+([IVX]{1,5})\s+w"
CENTURY_RANGE = r"\b([IVX]{1,5})\s*[–-]\s*([IVX]{1,5})\s+w"
CENTURY = r"\b([IVX]{1,5})\s*(?:w\.|wieku|wiek)"
BEFORE = r"p\.\s*n\.\s*e\."


def century_years(text: Column) -> Column:
    """All years that a text names: plain ones, starts of decades, and first and last years of centuries and their ranges.

    Numerals that name no century are left out; a mark of years before the common era negates all.
    """
    number = F.create_map(*[F.lit(x) for pair in CENTURIES.items() for x in pair])

    def of(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), group)

    def known(years: Column) -> Column:
        return F.filter(years, lambda y: y.isNotNull())

    decades = known(F.zip_with(of(DECADE, 1), of(DECADE, 2), lambda d, c: (F.try_element_at(number, c) - 1) * 100 + d.cast("int")))
    both = F.zip_with(of(CENTURY_RANGE, 1), of(CENTURY_RANGE, 2), lambda a, b: F.array((F.try_element_at(number, a) - 1) * 100 + 1, F.try_element_at(number, b) * 100))
    ranges = F.flatten(F.filter(both, lambda p: F.forall(p, lambda y: y.isNotNull())))
    centuries = known(F.flatten(F.transform(of(CENTURY, 1), lambda c: F.array((F.try_element_at(number, c) - 1) * 100 + 1, F.try_element_at(number, c) * 100))))
    found = F.concat(years(text), decades, ranges, centuries)
    return F.when(text.rlike(BEFORE), F.transform(found, lambda y: -y)).otherwise(found)


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def without_markers(text: Column, marker: str = r"\[(?:image|img|obraz)[^\]]*\]", by: str = "") -> Column:
    return F.trim(F.regexp_replace(text, "(?i)" + marker, by))


def jaccard(a: Column, b: Column) -> Column:
    """Of word sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def digest(*parts: Column) -> Column:
    """Identity of a row: SHA-256 of its parts with an explicit separator; null is told from empty."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256)


def short_id(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def parsed_json(text: Column) -> Column:
    """A JSON text as a variant; null for what is no JSON, or is followed by anything but white space."""
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]"))), "$", "array<variant>")
    return F.when(F.size(both) == 2, F.get(both, 0))
