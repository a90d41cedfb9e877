"""Runs that can be taken up again: what they depend on is pinned, and what is finished is known by part."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gates import Violations, gate, together, violation


def config_digest(config: dict) -> str:
    """SHA-256 of a configuration, whatever the order of its fields."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def pinned(spark: SparkSession, files: dict[str, str], config: dict | None = None) -> DataFrame:
    """role, path, sha256 of each file that a run depends on (named by its role), and of its configuration."""
    paths = spark.createDataFrame([(role, path) for role, path in files.items()], "role string, asked string")
    found = spark.read.format("binaryFile").load(list(files.values())).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("sha256")) if files else spark.createDataFrame([], "path string, sha256 string")
    same = F.regexp_replace("asked", "^file:/+", "/") == F.col("path")
    rows = paths.join(found, same).select("role", "path", "sha256")
    return rows.unionByName(spark.createDataFrame([("config", "", config_digest(config or {}))], "role string, path string, sha256 string"))


def drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """rule, entity_id (the role), detail: what has changed, gone, or come since it was pinned."""
    both = before.select("role", F.col("sha256").alias("old")).join(now.select("role", F.col("sha256").alias("new")), "role", "full_outer")
    c = F.col
    return together(
        violation(both.where("old IS NOT NULL AND new IS NOT NULL AND old <> new"), "changed", c("role"), c("new")),
        violation(both.where("new IS NULL"), "gone", c("role"), c("old")),
        violation(both.where("old IS NULL"), "not_pinned", c("role"), c("new")),
    )


def inputs_digest(items: DataFrame) -> tuple[int, str]:
    """Number and order-free hash of rows: of the same rows in any order it is the same."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(items.columns)])
    found = items.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).first()
    return found["n"], str(found["h"])


class Run:
    """A run over items in parts, in a folder of its own: `state` pins its inputs, `rows` holds a folder for each finished part.

    Parts are the hash of an item's id, so they don't depend on how items are read.  A part counts as
    finished when its commit mark is there; what an interrupted part has written is replaced as a whole.
    """

    def __init__(self, items: DataFrame, key: str, root: str, config: dict | None = None, parts: int = 16):
        self.items, self.key, self.root, self.parts, self.spark = items, key, root.rstrip("/"), parts, items.sparkSession
        self.state = {"config": config_digest(config or {}), "parts": parts, "key": key, "inputs": list(inputs_digest(items))}

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def started(self) -> bool:
        return self._exists(f"{self.root}/state/_SUCCESS")

    def finished(self) -> list[int]:
        return [p for p in range(self.parts) if self._exists(f"{self.root}/rows/part={p}/_SUCCESS")]

    def check(self) -> None:
        """Stops if the run was begun with other inputs, or another configuration."""
        noted = json.loads(self.spark.read.text(f"{self.root}/state").first()[0])
        if changed := sorted(k for k in self.state if noted.get(k) != self.state[k]):
            raise Violations(f"the run in {self.root} was begun with other {', '.join(changed)}; prepare a new folder")

    def advance(self, answer: Callable[[DataFrame], DataFrame], resume: bool = True) -> DataFrame:
        """Answers the parts that aren't finished and gives all rows.  Without resume, a folder that was begun is an error."""
        if self.started():
            if not resume:
                raise Violations(f"the run in {self.root} has begun already; prepare a new folder")
            self.check()
        else:
            self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/state")
        done = set(self.finished())
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts))
        for p in range(self.parts):
            if p not in done:
                answer(self.items.where(part == p)).write.mode("overwrite").parquet(f"{self.root}/rows/part={p}")
        return self.rows()

    def rows(self) -> DataFrame:
        """The rows of finished parts; an interrupted run keeps them."""
        return self.spark.read.parquet(*[f"{self.root}/rows/part={p}" for p in self.finished()])


def same_answers(prepared: DataFrame, graded: DataFrame, key: str, columns: list[str]) -> None:
    """Grading may add to a run's rows but change none of these columns, nor drop or add rows."""
    left = prepared.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("old"))
    right = graded.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("new"))
    both = left.join(right, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    gate(violation(both, "grading_changed", F.col(key), F.lit(None)))
