"""Registered queries: contract of the registry, and a sample against DuckDB."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from tallypact.workload.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["B1_frequency_class", "E5_ageing_buckets", "E12_inventory_composition",
          "F1_cycle_in_force", "J3_reextraction_merge", "J18_lifecycle_replay",
          "K4_notification_outbox"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    unchecked = set(QUERIES) - set(ORACLES)
    assert unchecked == {"J11_extraction_scoring"}


def test_entry(spark):
    assert entry(spark).count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    text, ok = check.compare(spark, con, name, queries()[name], oracle_sql()[name], SF)
    assert ok, text
