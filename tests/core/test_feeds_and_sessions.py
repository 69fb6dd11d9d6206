"""Stored generations of threat feeds, and everything that is kept of a session."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from logsentinel.config import Config
from logsentinel.operators import enrich as E
from logsentinel.operators import reports as P
from logsentinel.operators import sessions as N
from logsentinel.operators.state import load_state


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), "value string, source_id int")


def test_feed_entries_are_addresses_first_else_domains(spark):
    got = P.feed_entries(lines(spark, (" 10.0.0.1\r", 1), ("bad.example.org\t", 2), ("# note", 1), ("", 1), ("   ", 1), (None, 1), ("ab", 1), ("a.b", 3), ("300.1.1.1", 1), ("x." * 200, 1), ("10.0.0.1", 2))).collect()
    assert sorted((r["entry"], r["kind"], r["types"], r["confidence"], r["source_id"]) for r in got) == [
        ("10.0.0.1", "ip", 1, 80, 1), ("10.0.0.1", "ip", 1, 80, 2), ("300.1.1.1", "domain", 2, 80, 1), ("a.b", "domain", 2, 80, 3), ("bad.example.org", "domain", 2, 80, 2),
    ]


def test_generations_are_stored_and_old_entries_go(spark, tmp_path):
    path = f"file://{tmp_path}/feed"
    assert P.refresh_feed(spark, path, lines(spark, ("10.0.0.1", 1), ("10.0.0.1", 2), ("old.example", 1))) == 1
    assert P.refresh_feed(spark, path, lines(spark, ("10.0.0.1", 1))) == 2
    # a load that failed: its folder is not whole, so readers keep generation 2 and the next load takes number 3
    Path(f"{tmp_path}/feed/version=3").mkdir()
    Path(f"{tmp_path}/feed/version=3/part-0.parquet").write_bytes(b"cut short")
    held = {r["entry"]: (r["source_id"], r["generation"]) for r in load_state(spark, path).collect()}
    assert held == {"10.0.0.1": (1, 2), "old.example": (1, 1)}
    assert P.refresh_feed(spark, path, lines(spark, ("10.0.0.2", 3))) == 3
    assert {r["entry"] for r in load_state(spark, path).collect()} == {"10.0.0.1", "10.0.0.2", "old.example"}
    assert P.refresh_feed(spark, path, lines(spark)) == 4
    assert {r["entry"] for r in load_state(spark, path).collect()} == {"10.0.0.1", "10.0.0.2"}


def test_session_details(spark):
    schema = "line_no long, ts_ms long, ip string, user_agent string, path string, method string, status int, request_time_s double, bytes_sent long"
    rows = [(i, 1000 * i, "1.1.1.1", "a", f"/p{i}", "GET", 200, 0.5, 100) for i in range(60)]
    rows += [(60, 59_000, "1.1.1.1", "a", "/last", "BREW", 404, None, None), (61, 5_000_000, "1.1.1.1", "a", "/new", None, 401, 2.0, None), (62, 1, "2.2.2.2", None, "/x", "POST", 500, None, 7)]
    cfg = Config()
    got = {(r["session_id"]): r for r in N.session_details(N.running_sessions(spark.createDataFrame(rows, schema), cfg)).collect()}
    assert len(got) == 3
    long = next(r for r in got.values() if r["requests"] == 61)
    assert long["methods"] == "GET:60,other:1" and (long["errors_4xx"], long["errors_5xx"], long["paths"], long["agents"]) == (1, 0, 61, 1)
    assert long["last_paths"].split(" ") == [f"/p{i}" for i in range(11, 60)] + ["/last"]
    assert (long["time_n"], long["time_mean"], long["time_sd"], long["bytes_n"]) == (60, 0.5, 0.0, 60)
    assert long["requests_window"] == sum(1 for r in rows[:61] if r[1] > 59_000 - cfg.window_ms)
    late = next(r for r in got.values() if r["start_ms"] == 5_000_000)
    assert late["methods"] == "" and late["bytes_mean"] is None and late["bytes_sd"] == 0.0 and late["gap_s"] is None and late["failed_logins"] == 1
    other = next(r for r in got.values() if r["end_ms"] == 1)
    assert other["methods"] == "POST:1" and other["errors_5xx"] == 1 and other["post_get"] == 0.0


def test_session_details_of_an_empty_log(spark):
    schema = "line_no long, ts_ms long, ip string, user_agent string, path string, method string, status int, request_time_s double, bytes_sent long"
    assert N.session_details(N.running_sessions(spark.createDataFrame([], schema).withColumn("more", F.lit(1)))).count() == 0


def test_sessions_in_blocks_equal_the_plain_form(spark):
    """Gaps inside blocks, at their edges and over many empty blocks; null agents; ties; a row without a time."""
    rng = np.random.default_rng(4)
    cfg = Config()
    gap = cfg.session_gap_s * 1000
    rows = []
    for key in range(4):
        t = 0
        for i in range(400):
            t += int(rng.choice([0, 1, 1000, gap - 1, gap, gap + 1, 5 * gap, 40 * gap], p=[0.1, 0.1, 0.4, 0.1, 0.1, 0.1, 0.05, 0.05]))
            rows.append((1000 * key + i, t, f"10.0.0.{key % 2}", None if key > 1 else "agent"))
    rows.append((9999, None, "10.0.0.0", "agent"))
    rng.shuffle(rows)
    rows = [(int(n), None if t is None else int(t), ip, ua) for n, t, ip, ua in rows]
    log = spark.createDataFrame(rows, "line_no long, ts_ms long, ip string, user_agent string")
    got = {r["line_no"]: r["session_no"] for r in E.sessionize(log, cfg).collect()}
    want, state = {}, {}
    for n, t, ip, ua in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        last, count = state.get((ip, ua), (None, 0))
        count += last is None or t is None or t - last > gap
        state[ip, ua] = (t, count)
        want[n] = count
    assert got == want


def test_a_hot_key_is_spread_over_tasks(spark):
    """One address and agent with all of the rows: no task has much more than its share of the sessions' rows."""
    log = spark.range(40_000).selectExpr("id AS line_no", "id * 60000 AS ts_ms", "'10.0.0.1' AS ip", "'a' AS user_agent")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        sizes = [r["count"] for r in E.sessionize(log).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("count"), F.max("session_no")).collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 40_000 and len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]
