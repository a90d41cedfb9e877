"""Checks of uploaded answer files, on their bytes, and files written byte for byte."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# The limits of the file rules, and how an essay begins.
MOST_BYTES, MOST_CHARACTERS, LEAST_WORDS = 1 << 20, 100_000, 300
TOPIC = r"^\s*Temat\s+([0-9]+)"
THINKING = r"</?think>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content: whole files as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parsed(files: DataFrame) -> DataFrame:
    """Adds utf8, bom, text (without its mark, bad bytes replaced) and v (the document as a variant; null if it is no JSON)."""
    raw = F.col("content").cast("string")
    bom = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    text = F.make_valid_utf8(F.when(bom, F.expr("substring(content, 4)").cast("string")).otherwise(raw))
    rows = files.withColumn("utf8", F.is_valid_utf8(raw)).withColumn("bom", bom).withColumn("text", text)
    return rows.withColumn("v", T.parsed_json(F.col("text")))


def _kind(v: Column) -> Column:
    """object, array, string or another kind of a variant."""
    kind = F.lower(F.schema_of_variant(v))
    return F.when(kind.startswith("object"), "object").when(kind.startswith("array"), "array").otherwise(kind)


def _entry(e: Column) -> Column:
    """keys, id, id_kind, answer, answer_kind of an entry."""
    text = lambda name: F.try_variant_get(e, f"$.{name}", "string")
    kind = lambda name: F.coalesce(_kind(F.try_variant_get(e, f"$.{name}", "variant")), F.lit("void"))
    keys = F.array_sort(F.coalesce(F.json_object_keys(F.to_json(e)), F.array().cast("array<string>")))
    return F.struct(keys.alias("keys"), text("id").alias("id"), kind("id").alias("id_kind"), text("answer").alias("answer"), kind("answer").alias("answer_kind"))


def answer_entries(files: DataFrame) -> DataFrame:
    """path, entries: of files that are JSON, an array of what _entry() gives."""
    found = F.transform(F.try_variant_get("v", "$.answers", "array<variant>"), _entry)
    return _parsed(files).withColumn("entries", F.coalesce(found, F.array().cast("array<struct<keys:array<string>,id:string,id_kind:string,answer:string,answer_kind:string>>")))


def file_problems(files: DataFrame, template: DataFrame, exam_id: str, essay_id: str | None = None) -> DataFrame:
    """rule, entity_id (the path), detail.  files: path, content; template: id (some dozens of ids).

    A file is checked within its row.  The essay is the entry with essay_id, else the first whose answer names a topic.
    """
    c = F.col
    wanted = template.agg(F.sort_array(F.collect_set("id")).alias("wanted"))  # one row
    rows = answer_entries(files).crossJoin(F.broadcast(wanted)).withColumn("top", F.json_object_keys("text"))
    rows = rows.withColumn("ids", F.filter(F.transform("entries", lambda e: e["id"]), lambda x: x.isNotNull())).withColumn("essay", F.get(F.filter("entries", lambda e: (e["id"] == essay_id) if essay_id is not None else (e["answer_kind"] == "string") & e["answer"].rlike(TOPIC)), 0))
    is_json, again = c("v").isNotNull(), F.coalesce(F.size(F.array_distinct("top")) < F.size("top"), F.lit(False))
    given = F.try_variant_get("v", "$.exam_id", "string")
    one = lambda rule, detail: F.struct(F.lit(rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))
    when = lambda holds, rule, detail: F.when(F.coalesce(holds, F.lit(False)), one(rule, detail))
    none = F.lit("")
    of_file = F.array(
        when(~c("utf8"), "not_utf8", none), when(c("bom"), "byte_order_mark", none), when(F.octet_length("content") > MOST_BYTES, "too_large", F.octet_length("content")),
        when(~is_json & again, "repeated_keys", F.array_join("top", ",")), when(~is_json & ~again, "not_json", none),
        when(is_json & ~F.coalesce(F.array_sort("top") == F.array(F.lit("answers"), F.lit("exam_id")), F.lit(False)), "top_level_keys", F.array_join(F.array_sort("top"), ",")),
        when(is_json & ~given.eqNullSafe(F.lit(exam_id)), "exam_id", given),
    )

    def of_entry(e: Column, i: Column) -> Column:
        text, place = e["answer_kind"] == "string", F.coalesce(e["id"], i.cast("string"))
        return F.array(
            when(e["id_kind"] != "string", "id_not_string", i), when(e["keys"] != F.array(F.lit("answer"), F.lit("id")), "entry_keys", F.concat_ws(":", place, F.array_join(e["keys"], ","))),
            when(~text, "answer_not_string", F.concat_ws(":", place, e["answer_kind"])), when(text & (F.char_length(e["answer"]) > MOST_CHARACTERS), "answer_too_long", place), when(text & e["answer"].rlike(THINKING), "thinking", place),
        )

    each = lambda names, rule: F.transform(names, lambda x: one(rule, x))
    twice = F.filter(F.array_distinct("ids"), lambda x: F.size(F.filter("ids", lambda y: y == x)) > 1)
    missing = F.when(is_json, F.array_except("wanted", "ids")).otherwise(F.array().cast("array<string>"))
    of_ids = F.concat(each(twice, "duplicate_id"), each(F.array_except("ids", "wanted"), "unknown_id"), each(missing, "missing_id"))
    words = F.size(F.filter(F.split("essay.answer", r"\s+"), lambda w: w != ""))
    essay = c("essay.answer_kind") == "string"
    of_essay = F.array(when(essay & ~c("essay.answer").rlike(TOPIC), "essay_without_topic", c("essay.id")), when(essay & (words < LEAST_WORDS), "essay_too_short", words))
    found = rows.select("path", F.explode(F.array_compact(F.concat(of_file, F.flatten(F.transform("entries", of_entry)), of_ids, of_essay))).alias("p"))
    return found.select("p.rule", c("path").alias("entity_id"), "p.detail")


def aligned(files: DataFrame, template: DataFrame) -> DataFrame:
    """path, ordinal, id, answer: each file in the template's order (template: ordinal, id), the last string answer of an id, "" where there is none."""
    e = answer_entries(files).select("path", F.posexplode("entries").alias("pos", "e")).select("path", "pos", "e.*").where("id IS NOT NULL")
    e = e.groupBy("path", "id").agg(F.max_by(F.when(F.col("answer_kind") == "string", F.col("answer")), "pos").alias("answer"))
    wanted = files.select("path").distinct().crossJoin(F.broadcast(template.select("ordinal", "id")))
    return wanted.join(e, ["path", "id"], "left").select("path", "ordinal", "id", F.coalesce("answer", F.lit("")).alias("answer"))


def write_bytes(rows: DataFrame, root: str) -> DataFrame:
    """Writes each row (name, content as bytes or text) as a file of just these bytes; name, length, sha256 of what was written.

    Tasks write under a name of their own and then move, so that a lost or repeated task leaves no half file.
    """

    def run(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(root)
        where.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                part = f"{base}/.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as f:
                    f.write(content)
                where.move(part, f"{base}/{name}")
                out.append((name, len(content), hashlib.sha256(content).hexdigest()))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["name", "length", "sha256"])

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, length long, sha256 string")
