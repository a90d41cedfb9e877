"""How queries are registered, and the SQL pieces that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import text as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (tables by name) under its own name, with the SQL that it must equal."""

    def add(f):
        from ..sources.io import table

        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"


def norm(x: str) -> str:
    return f"strip_accents(replace(lower({x}), 'ł', 'l'))"


def toks(x: str) -> str:
    found = f"regexp_extract_all({norm(x)}, '[a-z]+|[0-9]{{3,4}}')"
    fit = f"list_filter({found}, lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[ivxlcdm]+') AND NOT starts_with(w, 'interpret'))"
    return f"list_filter(list_transform({fit}, lambda w: left(w, 5)), lambda w: NOT list_contains({STOP}, w))"


def key(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace({norm(x)}, 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(trim({x}), '\s+'), lambda w: w <> '')"


def ngrams(items: str, n: int) -> str:
    """items must be a column."""
    return f"CASE WHEN len({items}) >= {n} THEN list_distinct(list_transform(range(1, len({items}) - {n - 2}), lambda i: array_to_string({items}[i:i + {n - 1}], ' '))) ELSE [] END"


def title(x: str) -> str:
    return f"split_part(split_part({x}, chr(10), 1), ' — ', 1)"
