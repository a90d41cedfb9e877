"""Cutting texts into lines, sections and passages that keep their exact place in the source.

Cuts that depend on the one before are an ordered fold; they run per document inside Arrow batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .html import cut_at

LIMIT = 1300
SEPARATOR = 3
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def _placed(text: Column) -> Column:
    """Structs (line, start): the lines of a text with their places in it, found within the row."""
    empty = F.struct(F.array().cast("array<struct<line:string,start:bigint>>").alias("out"), F.lit(0).cast("long").alias("at"))

    def add(acc: Column, line: Column) -> Column:
        one = F.array(F.struct(line.alias("line"), acc["at"].alias("start")))
        return F.struct(F.concat(acc["out"], one).alias("out"), (acc["at"] + F.length(line) + 1).alias("at"))

    return F.aggregate(F.split(text, "\n"), empty, add, lambda acc: acc["out"])


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, start: lines with their place (in characters) in the text."""
    return docs.select("doc_id", F.posexplode(_placed(F.col("text"))).alias("pos", "l")).select("doc_id", "pos", "l.line", "l.start")


def segments(docs: DataFrame) -> DataFrame:
    """Lines of 1 to 60 characters as heads, each up to the next head or the text's end."""
    heads = docs.select("doc_id", F.length("text").cast("long").alias("length"), F.filter(_placed(F.col("text")), lambda x: F.length(x["line"]).between(1, 60)).alias("heads"))
    spans = F.transform("heads", lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get("heads", i + 1)["start"], F.col("length")).alias("end"), x["line"].alias("line")))
    return heads.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.start", "s.end", "s.line")


def page_offsets(turns: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """Where each turn starts in the conversation's joined text."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + separator).over(before), F.lit(0)).cast("long").alias("offset"))


def occurrence_ids(docs: DataFrame) -> DataFrame:
    """A line's ordinal among its repeats, as `line~n` only where it is repeated.

    All is found within the row: lines sorted with their places lie beside their repeats, so a running
    count over the sorted lines is the ordinal, and the same count from behind tells whether it is alone.
    """
    held = F.filter(F.transform(F.split("text", "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("pos"))), lambda x: x["line"] != "")
    empty = F.struct(F.array().cast("array<struct<pos:int,line:string,n:int>>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        n = F.when(acc["last"] == x["line"], acc["n"] + 1).otherwise(1)
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["pos"].alias("pos"), x["line"].alias("line"), n.alias("n")))).alias("out"), x["line"].alias("last"), n.alias("n"))

    counted = docs.select("doc_id", F.aggregate(F.array_sort(held), empty, add, lambda acc: acc["out"]).alias("c"))
    rows = counted.select("doc_id", F.explode(F.transform("c", lambda x, i: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), x["n"].alias("n"), (F.get("c", i + 1)["line"] == x["line"]).alias("more")))).alias("x"))
    repeated = (F.col("x.n") > 1) | F.coalesce("x.more", F.lit(False))
    return rows.select("doc_id", "x.pos", F.when(repeated, F.concat("x.line", F.lit("~"), F.col("x.n").cast("string"))).otherwise(F.col("x.line")).alias("line_id"))


def filled_sections(docs: DataFrame, short: int = 40) -> DataFrame:
    """Each line with the last head (a short line) at or above it."""
    def add(acc: Column, line: Column) -> Column:
        head = F.when(F.length(line).between(1, short), line).otherwise(acc["head"])
        return F.struct(F.concat(acc["out"], F.array(head)).alias("out"), head.alias("head"))

    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("head"))
    sections = F.aggregate(F.split("text", "\n"), empty, add, lambda acc: acc["out"])
    return docs.select("doc_id", F.posexplode(sections).alias("pos", "section"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def rotations(items: DataFrame) -> DataFrame:
    """item_id, shift, options: all cyclic rotations of an item's options."""
    shift = F.explode(F.sequence(F.lit(0), F.size("options") - 1))
    rows = items.where(F.size("options") > 0).select("item_id", "options", shift.alias("shift"))
    return rows.select("item_id", "shift", F.expr("concat(slice(options, shift + 1, size(options)), slice(options, 1, shift))").alias("options"))


def spans(text: str, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Half-open spans of at most `limit` characters that cover the text.

    A cut is after the last sentence end and its white space, if that lies beyond the middle of the
    window, or else before its last space, or else hard.
    """
    out, at = [], 0
    while len(text) - at > limit:
        step = cut_at(text[at : at + limit], limit)
        out.append((at, at + step))
        at += step
    if at < len(text):
        out.append((at, len(text)))
    return out


def skipped(levels: list[int], dropped: list[bool]) -> list[bool]:
    """Whether each head is skipped: a dropped head skips deeper ones, until one at its level or above."""
    out, under = [], None
    for level, drop in zip(levels, dropped):
        if under is not None and level > under:
            out.append(True)
            continue
        under = level if drop else None
        out.append(drop)
    return out


def passages(docs: DataFrame, limit: int = LIMIT, least: int = 0) -> DataFrame:
    """doc_id, ordinal, start, end, text, passage_id: the title, a line break, and the exact span.

    `least` drops spans of fewer stripped characters; the default loses nothing.
    """
    def run(batches):
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):  # few texts at once, whatever their size
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                kept = [(a, b) for a, b in spans(text or "", limit) if len(text[a:b].strip()) >= least]
                rows += [(doc_id, i, a, b, text[a:b]) for i, (a, b) in enumerate(kept)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "ordinal", "start", "end", "body"])

    cut = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ordinal int, start long, end long, body string")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("ordinal").cast("string"), F.lit("-"), F.left(F.sha2("body", 256), F.lit(16)))
    return cut.select("doc_id", "ordinal", "start", "end", "body", name.alias("passage_id"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, link: distinct link targets, quoted either way or not at all, for a crawl's next round."""
    found = F.regexp_extract_all("html", F.lit(LINK), 1)
    return pages.select("page_id", F.explode(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", "")))).alias("link"))
