"""Reading with fixed schemas and writing without overwriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.gates import Violations, gate, violation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bad_lines(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """file, line, text of lines, but for blank ones, that don't fit the schema.

    Files are read in parts by many tasks.  A line's number is its place in its part plus the lines of
    the file's parts before it, of which there is one count for each part; only bad lines meet these counts.
    """
    full = StructType([*schema.fields, StructField("_bad", StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    parts = lines.groupBy("file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file", "part", "first", before.alias("before"))
    parsed = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("r._bad IS NOT NULL")
    return parsed.join(parts, ["file", "part"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType, strict: bool = True) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, and with `strict` a line that doesn't fit is an error that names file and line."""
    full = StructType([*schema.fields, StructField("_bad", StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    if strict:
        bad = bad_lines(spark, path, schema).orderBy("file", "line")
        gate(violation(bad, "json_line", F.concat_ws(":", F.regexp_extract("file", "([^/]*)$", 1), "line"), F.col("text").substr(1, 40)))
    return rows.drop("_bad")


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_ordered(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """Several files as one, with `file_ordinal` by their place in the list."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [read_jsonl(spark, p, schema).withColumn("file_ordinal", F.lit(i)) for i, p in enumerate(paths)])


def read_images(spark: SparkSession, path: str, kind: str = "image/png") -> DataFrame:
    """path, data_url."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.concat(F.lit(f"data:{kind};base64,"), F.base64("content")).alias("data_url"))


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").format(kind).save(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, content: an order-free hash of each table's rows."""
    from functools import reduce

    def one(name: str, df: DataFrame) -> DataFrame:
        row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("content"))

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def save_dataset(tables: dict[str, DataFrame], root: str) -> None:
    """Each table, and a manifest that `load_dataset` holds them against."""
    for name, df in tables.items():
        write_new(df, f"{root}/{name}")
    write_new(manifest(tables), f"{root}/manifest", "json")


def load_dataset(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    noted = spark.read.schema("name string, rows long, content string").json(f"{root}/manifest")
    names = sorted(r["name"] for r in noted.select("name").collect())  # a handful of tables
    tables = {n: spark.read.parquet(f"{root}/{n}") for n in names}
    if not noted.exceptAll(manifest(tables).select("name", "rows", "content")).isEmpty():
        raise Violations("a table differs from its manifest")
    return tables


def export_ready(tasks: DataFrame, path: str, columns: list[str]) -> None:
    """The whitelisted columns of all rows, if every row is ready; else nothing is written."""
    gate(violation(tasks.where("review_status <> 'ready'"), "not_ready", F.col("id"), F.col("review_status")))
    write_new(tasks.select(*columns), path, "json")


def checked_index(df: DataFrame, path: str) -> DataFrame:
    """Writes an index and reads it back; both must hold the same bag of rows."""
    from ..operators.gates import unequal

    write_new(df, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if not unequal(df, back).isEmpty():
        raise Violations("the index differs from what was written")
    return back


def markdown(rows: DataFrame, title: str) -> str:
    """A summary table (a few rows by construction) as Markdown."""
    names = rows.columns
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", "<br>")
    lines = [f"# {title}", "", "| " + " | ".join(map(cell, names)) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows.collect()]) + "\n"
