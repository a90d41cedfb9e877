"""Queries against their SQL on tables that the test data don't hold."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect


@pytest.fixture
def agree(spark, tmp_path):
    """Writes tables given as SQL, and says how a query and its SQL differ on them (empty: not at all)."""

    def run(name: str, **tables: str) -> str:
        for table, sql in tables.items():
            duckdb.sql(sql).write_parquet(f"{tmp_path}/{table}.parquet")
        return compare(spark, connect(str(tmp_path)), entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))

    return run


def test_letters_of_references_that_a_tag_cuts_off(agree):
    html = "<html><body><h1>One &amp; two &amp</h1><p>Three &lt;four&gt; &quot five&copy</p><p>Six &amper seven</p></body></html>"
    assert agree("html_letters", pages=f"SELECT 1::BIGINT AS page_id, 'https://a.example/' AS url, '{html}' AS html") == ""


def test_keys_whose_numbers_meet(agree):
    part = "SELECT i AS p_partkey, (i % 50)::INT AS p_size, 'Brand#' || i % 55 AS p_brand FROM (SELECT unnest([88, 89, 178, 1000089, 1000178, 1000200])::BIGINT AS i)"
    assert agree("dataset_check", part=part, supplier="SELECT i AS s_suppkey, 'Supplier' || i AS s_name FROM range(1, 130) r(i)") == ""
