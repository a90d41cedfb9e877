"""Parts of exam papers: headings, topics, formats and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How papers head their tasks and number their topics.
HEADING = r"(?m)^Zadanie ([0-9]+(?:\.[0-9]+)*)\.?(?: \(0[–-]([0-9]+)\))?"
NUMBERED = r"(?m)^\s*([0-9])\.\s+"
LOOSELY = r"(?mi)^\s*(?:temat\s*(?:nr\.?\s*)?)?([0-9])\s*[.):]\s*"


def headings(text: Column) -> Column:
    """Structs (id, points) of task headings; points are null where a heading names none."""
    ids = F.regexp_extract_all(text, F.lit(HEADING), 1)
    points = F.regexp_extract_all(text, F.lit(HEADING), 2)
    return F.transform(F.arrays_zip(ids.alias("id"), points.alias("p")), lambda x: F.struct(x["id"].alias("id"), F.when(x["p"] != "", x["p"]).cast("int").alias("points")))


def topics(text: Column) -> Column:
    """Texts of numbered topics with single spaces; if there are none, of those numbered in a looser way."""

    def split(pattern: str) -> Column:
        n = F.size(F.regexp_extract_all(text, F.lit(pattern), 1))
        return F.transform(F.slice(F.split(text, pattern), F.lit(2), n), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))

    numbered = split(NUMBERED)
    return F.when(F.size(numbered) > 0, numbered).otherwise(split(LOOSELY))


# With what the instruction behind a thesis begins, the verbs that end its subject, and how a task names aspects.
INSTRUCTIONS = ("Zajmij", "Oceń", "Rozstrzygnij", "Porównaj", "Uzasadnij", "Scharakteryzuj", "Przedstaw", "Wyjaśnij", "W swojej")
PREDICATES = (
    "był", "była", "było", "byli", "były", "jest", "są", "okazała", "okazał", "okazały", "okazało", "przyniosła", "przyniósł", "przyniosły",
    "osiągnęła", "osiągnął", "zawdzięczała", "zawdzięczał", "dominowały", "dominował", "miały", "miał", "miała", "miało", "stanowiła", "stanowił", "stanowiły",
    "przyczyniły", "przyczynił", "przyczyniła", "doprowadziła", "doprowadził", "doprowadziły", "zakończyła", "zakończył", "wpłynęła", "wpłynął", "wpłynęły",
    "odegrała", "odegrał", "odegrały", "umożliwiła", "umożliwił", "zapewniała", "zapewniał", "objął", "objęła", "wynikał", "wynikała", "wynikały",
)
ASPECTS = r"aspekt[\p{L}\p{N}_]*:?\s+((?:[\p{L}\p{N}_-]+(?:,\s*|\s+i\s+|\s+oraz\s+)?){1,4})"
_LETTER = r"[\p{L}\p{N}_]"


def _word(words: tuple[str, ...]) -> str:
    return rf"(?iu)(?<!{_LETTER})(?:" + "|".join(words) + rf")(?!{_LETTER})"


def thesis(topic: Column, instructions: tuple[str, ...] = INSTRUCTIONS) -> Column:
    """The topic up to the sentence that says what to do with it."""
    return F.element_at(F.split(topic, r"\.\s+(?=" + "|".join(instructions) + ")", 2), 1)


def subject(sentence: Column, predicates: tuple[str, ...] = PREDICATES) -> Column:
    """What stands before the first predicate; the whole sentence if it has none."""
    return F.trim(F.element_at(F.split(sentence, _word(predicates), 2), 1))


def names(sentence: Column) -> Column:
    """Capitalised words of two and more characters that don't begin the text or a sentence."""
    inner = F.regexp_replace(sentence, rf"(^|[.!?]\s)\p{{Lu}}{_LETTER}*", "$1")
    return F.regexp_extract_all(inner, F.lit(rf"(?:^|(?<!{_LETTER}))(\p{{Lu}}[\p{{L}}\p{{N}}_-]+)"), 1)


def aspects(topic: Column) -> Column:
    """What a topic lists behind the word for aspects, in lower case."""
    return F.regexp_extract_all(F.lower(topic), F.lit(ASPECTS), 1)


def example_format(labels: Column, values: tuple[str, ...] = ("P", "F")) -> Column:
    """`label: value` lines, values taken in turn: shows the form and not the key."""
    turn = F.array(*[F.lit(v) for v in values])
    return F.array_join(F.transform(labels, lambda x, i: F.concat(x, F.lit(": "), F.element_at(turn, (i % len(values) + 1).cast("int")))), "\n")


def neutral_format(example: Column) -> Column:
    """An example with its values hidden."""
    return F.regexp_replace(example, r"(?m)^([^:\n]+): .*$", "$1: …")


def prompt(parts: dict[str, Column]) -> Column:
    """Named parts that are there, each under its name."""
    return F.concat_ws("\n\n", *[F.when(F.trim(c) != "", F.concat(F.lit(f"{name}:\n"), c)) for name, c in parts.items()])


def essay_task(text: Column) -> Column:
    """A task without its heading, counts of points and answer lines."""
    out = F.regexp_replace(text, HEADING, "")
    out = F.regexp_replace(out, r"\(0[–-][0-9]+\)", "")
    return F.trim(F.regexp_replace(out, r"(?m)^[.…_]{5,}$", ""))


def numbered_references(texts: Column, name: str = "Extra source") -> Column:
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit(f"{name} "), (i + 1).cast("string"), F.lit(":\n"), x)), "\n\n")
