"""Runs registered queries and their SQL side by side: python -m tests.compare NAME... [--dir sf0.01]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*'}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, bool) or value is None:
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def bag(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if the rows agree, else what differs."""
    df = query(spark, sf_dir)
    mine = bag(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    theirs = bag([d[0] for d in found.description], found.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        left, right = set(mine[1]), set(theirs[1])
        return f"{len(mine[1])} rows != {len(theirs[1])}; " + str([x for x in mine[1] if x not in right][:2]) + str([x for x in theirs[1] if x not in left][:2])
    odd = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(odd)} of {len(mine[1])} rows differ, as {odd[0]}"[:900] if odd else ""


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{args[args.index('--dir') + 1] if '--dir' in args else 'sf0.01'}"
    names = [a for a in args if not a.startswith("-") and not a.startswith("sf") and not a.startswith("check")]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con, bad = session(), connect(sf_dir), 0
    for name in names or [n for n in queries]:
        began = time.time()
        try:
            if name in oracles:
                said = compare(spark, con, queries[name], oracles[name], sf_dir) or "ok"
            else:
                df = queries[name](spark, sf_dir)
                said = f"no SQL; {len(df.collect())} rows {df.columns}"
        except Exception as error:  # noqa: BLE001
            said = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += said != "ok" and not said.startswith("no SQL")
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
