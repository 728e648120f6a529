"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ("link_edges", "link_edges_parsed", "crawl_dedup_by_domain", "new_requests", "duplicate_report", "requests_accepted_with_ttl",
          "request_fingerprint_presets", "breaker_replay_long_recovery", "failure_streaks", "frontier_ranked", "politeness_plan",
          "task_transitions", "schedule_due", "webpage_validation", "pattern_email", "page_fields_xpath", "requests_with_cookies",
          "link_targets", "system_statistics", "crawl_job", "result_envelopes_roundtrip", "export_csv_roundtrip", "stream_breaker")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
