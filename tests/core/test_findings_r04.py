"""Findings of round 4: addresses of many users, whole alert documents."""

import os
from collections import Counter

import duckdb
import pytest

from logsentinel.plans import registry as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """The events of sf0.001 once more by users whose numbers give addresses with a part over 255, and all tables in DuckDB."""
    d = str(tmp_path_factory.mktemp("many"))
    for f in os.listdir(DATA):
        if f != "events.parquet":
            os.symlink(f"{DATA}/{f}", f"{d}/{f}")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    moved = events.selectExpr("event_id + 1000000 AS event_id", "ts", "user_id + 70000 AS user_id", "event_type", "value", "props")
    events.unionByName(moved).coalesce(1).write.parquet(f"{d}/events.parquet")
    duck = duckdb.connect()
    for f in os.listdir(d):
        duck.sql(f"create view {f.split('.')[0]} as select * from '{d}/{f}{'/*.parquet' if f == 'events.parquet' else ''}'")
    return d, duck


def differing(spark, tables, name):
    """Rows of the SQL that the query lacks, and the other way about, up to three each."""
    got, want = Q.queries()[name](spark, tables[0]), tables[1].sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = Counter(map(tuple, got.select(*want.columns).collect())), Counter(want.fetchall())
    assert b
    return [list((b - a).elements())[:3], list((a - b).elements())[:3]]


def test_addresses_of_a_log_are_addresses_in_a_feed(spark, many):
    assert many[1].sql("SELECT count(*) FROM events WHERE user_id >= 65536 AND event_type = 'error'").fetchall()[0][0] > 50
    assert differing(spark, many, "feed_infos") == [[], []]


def test_an_alert_document_has_its_row_and_analysis(spark, many):
    assert differing(spark, many, "alert_json") == [[], []]
    docs = Q.queries()["alert_json"](spark, many[0])
    assert {"key", "request_path", "status_code", "user_agent", "is_first_request_from_ip", "found_suspicious_path_str", "ip_failed_login_count", "ip_req_time", "path_error_event", "start_time_ms", "errors_4xx", "post_to_get_ratio"} <= set(docs.columns)
    assert docs.where("key <> ip AND key = request_path").count() > 0 and docs.where("ip_failed_login_count > 0 AND errors_4xx > 0").count() > 0
    assert docs.where("source_ip <> ip OR line_number <> line_no OR last_seen_ms <> ts_ms OR start_time_ms > ts_ms").count() == 0
