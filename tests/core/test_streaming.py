import json
import os
import random

import pytest
from pyspark.sql import functions as F

from logsentinel.config import Config
from logsentinel.operators import enrich as E
from logsentinel.operators import forest, metrics, reports, rules, seasonal, sessions, state
from logsentinel.operators import lookups as J
from logsentinel.plans import registry
from logsentinel.sources import logs
from logsentinel.streaming import detect, jobs
from logsentinel.streaming import state as live

DATA = "/root/testdata/sf0.001"
ROWS = "line_no long, ts_ms long, ip string, status int"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset(name)


def finish(stream, at, mode="append"):
    """Everything that a stream gives for the files there are."""
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def test_streams_of_lines_equal_the_table(spark, tmp_path):
    lines = logs.log_lines(registry.log(spark, DATA))
    lines.select("value").coalesce(2).write.text(str(tmp_path / "in"))
    good, _ = logs.parse_access_log(lines)
    parsed = jobs.parsed_stream(spark, str(tmp_path / "in"))
    assert finish(parsed.drop("line_no"), tmp_path / "a").count() == good.count()
    rows = good.withColumn("ts", F.timestamp_millis("ts_ms"))
    counts = finish(jobs.tumbling_counts(parsed, "1 day"), tmp_path / "b").collect()
    want = {r["start"]: r for r in jobs.tumbling_counts(rows, "1 day").collect()}
    assert len(counts) >= len(want) - 1 and all(want[r["start"]] == r for r in counts)
    sessions = {tuple(r) for r in finish(jobs.live_sessions(parsed), tmp_path / "c").collect()}
    assert sessions and sessions <= {tuple(r) for r in jobs.live_sessions(rows).collect()}


def test_dispatch_counts_and_repeats(spark, tmp_path):
    spark.createDataFrame([(i, f"a{i}") for i in range(5)], "i long, x string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, x string").parquet(str(tmp_path / "in"))

    def broken(batch):
        raise OSError("down")

    at, folder = str(tmp_path / "check"), tmp_path / "hook"
    folder.mkdir()
    hook = jobs.webhook(lambda text, d=str(folder): open(os.path.join(d, str(json.loads(text)["i"])), "w").close())
    keep = lambda batch: batch.write.mode("append").parquet(str(tmp_path / "out"))
    with pytest.raises(Exception, match="down"):
        jobs.dispatch(stream, {"hook": hook, "bad": broken}, at, str(tmp_path / "counts")).awaitTermination(60)
    jobs.dispatch(stream, {"hook": hook, "good": keep}, at, str(tmp_path / "counts")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5 and len(os.listdir(folder)) == 5
    failures = {r["sink"]: r["failed_pct"] for r in reports.delivery_failures(spark.read.parquet(str(tmp_path / "counts"))).collect()}
    assert failures == {"hook": 0.0, "bad": 100.0, "good": 0.0}


def test_live_windows_and_throttle_equal_the_tables(rocks, tmp_path):
    rng = random.Random(9)
    rows = [(i, t, f"10.0.0.{rng.randrange(2)}", rng.choice([200, 401])) for i, t in enumerate(sorted(rng.randrange(30) * 1000 for _ in range(80)))]
    for n, part in enumerate((rows[:40], rows[40:])):
        rocks.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part{n}"))
    stream = rocks.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part*"))
    cfg = Config(window_ms=5000)
    got = {r["line_no"]: (r["ip_req_window"], r["ip_failed_window"]) for r in finish(live.live_windows(stream, cfg, None), tmp_path / "w").collect()}
    table = rocks.createDataFrame(rows, ROWS).withColumn("path", F.lit("/a"))
    assert got == {r["line_no"]: (r["ip_req_window"], r["ip_failed_window"]) for r in E.ip_windows(table, cfg).collect()}
    named = lambda df: df.withColumns({"reason": F.col("status").cast("string"), "rule": F.lit("r")})
    kept = {r["line_no"] for r in finish(live.live_throttle(named(stream), 4, 2, None), tmp_path / "t").collect()}
    assert kept == {r["line_no"] for r in rules.throttle(named(table), 4, 2).collect()}


def test_lists_are_read_for_each_batch(spark, tmp_path):
    spark.createDataFrame([(1, "10.0.0.1"), (2, "10.0.0.9")], "line_no long, ip string").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line_no long, ip string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    calls = []

    def read():
        calls.append(1)
        return {"threats": logs.cidr_table(spark.createDataFrame([("10.0.0.9",)], "value string"))}

    live.with_lists(stream, read, lambda batch, threats: J.cidr_semi(batch, threats).write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "check")).awaitTermination(60)
    assert [r["line_no"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2] and len(calls) >= 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\ntwo\n")
    (tmp_path / "b.log").write_text("three\n")
    assert sorted(r[0] for r in logs.read_logs(spark, str(tmp_path / "*.log"), dense=True).collect()) == [1, 2, 3]
    (tmp_path / "d.json").write_text("\n".join(json.dumps({"host": "1.1.1.1", "time": f"01/Jan/2023:12:00:0{i} +0000", "url": "GET / HTTP/1.1", "st": "200"}) for i in (3, 1, 2)))
    first = logs.read_json_logs(spark, str(tmp_path / "d.json"), since_ms=1672574401000, limit=1)
    good, bad = logs.parse_access_log(first)
    assert [r["ts_ms"] for r in good.collect()] == [1672574402000] and bad.count() == 0
    (tmp_path / "f1").write_text("1.2.3.4\n# x\n5.6.0.0/16\n")
    (tmp_path / "f2").write_text("1.2.3.4\nbad\n")
    assert logs.load_threat_feeds(spark, [str(tmp_path / "f1"), str(tmp_path / "f2")]).count() == 2


def test_snapshots_models_and_feeds(spark, tmp_path):
    rows = registry.log(spark, DATA)
    for v, part in enumerate(("line_no < 500", "line_no >= 500")):
        state.save_state(state.state(rows.where(part), "ip", "ip"), str(tmp_path / "s"), v)
    os.makedirs(tmp_path / "s" / "version=7")  # not finished
    assert state.load_state(spark, str(tmp_path / "s")).agg(F.sum("n")).first()[0] == rows.where("line_no >= 500").count()
    both = state.merge_states(*(state.load_state(spark, str(tmp_path / "s"), v) for v in (0, 1)))
    assert both.agg(F.sum("n")).first()[0] == rows.count()
    x = rows.select("line_no", *[(F.rand(i) * (F.col("line_no") % 7)).alias(f) for i, f in enumerate(forest.FEATURES)])
    model = forest.fit_forest(x, 5, 64)
    assert forest.publish_model(spark, model, str(tmp_path / "m"), 1)
    assert not forest.publish_model(spark, model.assign(low=-1), str(tmp_path / "m"), 2) and not forest.publish_model(spark, model.head(0), str(tmp_path / "m"), 3)
    assert len(forest.current_model(spark, str(tmp_path / "m"))) == len(model) and (model.groupby("tree")["size"].first() == 64).all()
    forest.write_features_csv(x, str(tmp_path / "csv"))
    assert len(spark.read.csv(str(tmp_path / "csv")).columns) == 27
    odd = spark.createDataFrame([(1, *[0.0] * 27), (2, *[float("nan")] * 27), (3, *[float("inf")] * 27)], x.schema)
    assert [r["line_no"] for r in forest.training_set(odd).collect()] == [1]
    feed = spark.createDataFrame([("a", 1), ("b", 2)], "entry string, generation long")
    assert [r["entry"] for r in reports.roll_back_feed(feed, 2).collect()] == ["a"]


def test_metric_labels_and_rules(spark):
    samples = spark.createDataFrame([({"path": "/a", "code": "500"}, 1, 2.0), ({"path": "/b", "code": "200"}, 1, 3.0)], "labels map<string,string>, ts long, value double")
    count = lambda **t: metrics.where_labels(samples, **t).count()
    assert (count(path="/a"), count(path="!/a"), count(code="~5.."), count(code="!~5.."), count(none="")) == (1, 1, 1, 1, 2)
    left, right = samples.select(F.col("labels")["path"].alias("p"), "ts"), spark.createDataFrame([("/a", 1), ("/c", 1)], "p string, ts long")
    assert {r["p"] for r in metrics.series_and(left, right, ["p", "ts"]).collect()} == {"/a"}
    assert sorted(r["p"] for r in metrics.series_or(left, right, ["p", "ts"]).collect()) == ["/a", "/b", "/c"]
    checked = spark.createDataFrame([("a", ">"), ("b", "~"), ("", ">"), ("c", "<"), ("c", "<")], "name string, comparison string")
    assert [r["problem"] for r in metrics.checked_rules(checked).orderBy("name", "comparison").collect()] == ["empty name", None, "Invalid comparison operator", "duplicate name", "duplicate name"]


def test_a_daily_wave_is_found(spark):
    rows = [(i, i * 3_600_000, "k", 10.0 if 8 <= i % 24 < 18 else 2.0) for i in range(24 * 14)]
    events = spark.createDataFrame(rows, "line_no long, ts_ms long, key string, value double")
    at = spark.createDataFrame([("k", 14 * 86_400_000 + h * 3_600_000) for h in (3, 12)], "key string, at_ms long")
    night, noon = seasonal.at_times(events, at, "key", 100).orderBy("at_ms").collect()
    assert night["factor"] < 0.8 < 1.2 < noon["factor"] and noon["seasonal"] and noon["confidence"] > 0.7
    low, high = (r["expected"] for r in seasonal.expected(events, at, "key", 100).orderBy("at_ms").collect())
    assert low < 0.7 and high > 1.3
    exact = state.approximate_distinct(registry.log(spark, DATA), "ip").join(registry.log(spark, DATA).groupBy("ip").agg(F.countDistinct("path").alias("p")), "ip").collect()
    assert all(abs(r["paths"] - r["p"]) <= 1 for r in exact)


LOG_ROWS = "line_no long, ts_ms long, ip string, path string, method string, status int, request_time_s double, bytes_sent long, user_agent string"


def _log(n=260):
    rng = random.Random(21)
    paths, agents = ["/", "/a.html", "/static/x.js", "/login", "/../etc/passwd", "/admin"], ["a", "b", "sqlmap/1", "-", "Mozilla/5.0 (Windows) Chrome/80.0"]
    return [(i, 1_000_000 + i * 700 // 1000 * 1000 + 60_000 * (i // 100), f"10.0.0.{rng.choice([1, 1, 2])}", rng.choice(paths), rng.choice(["GET", "POST"]), rng.choice([200, 200, 401, 500]), rng.choice([0.125, 0.25, 9.0 if i % 17 == 0 else 0.5]), rng.randrange(1000), rng.choice(agents)) for i in range(n)]


def _live(spark, folder, cfg, delay="1 hour"):
    stream = spark.readStream.schema(LOG_ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")
    return detect.live_alerts(stream.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay), cfg)


CFG = Config(window_ms=5000, max_requests=4, max_failed_logins=2, max_agents=2, session_gap_s=20, session_requests=2, session_failed_logins=1, least_html=1, min_samples=10, z_threshold=2.0)


def _alert_keys(rows):
    return sorted((r["line_no"], r["rule"], round(r["score"], 6), r["reason"]) for r in rows)


def _table_alerts(spark, rows):
    enriched = sessions.running_sessions(E.enrich(spark.createDataFrame(rows, LOG_ROWS), CFG), CFG)
    found = enriched.select("line_no", F.explode(rules.candidates(CFG, sessions=True)).alias("a")).select("line_no", "a.*")
    return _alert_keys(found.collect())


def test_live_alerts_of_shuffled_batches_and_a_restart_equal_the_table(rocks, tmp_path):
    rows = _log()
    late = rows[:]
    random.Random(1).shuffle(late)
    after = [(10_000 + i, 10**9 + i * 10**8, "10.9.9.9", "/", "GET", 200, 0.1, 1, "z") for i in range(2)]
    parts = [late[:90], late[90:180], late[180:], after[:1], after[1:]]
    for n, part in enumerate(parts[:2]):
        rocks.createDataFrame(part, LOG_ROWS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    finish(_live(rocks, tmp_path / "in", CFG), tmp_path)
    for n, part in enumerate(parts[2:], 2):  # the query is started again from its checkpoint
        rocks.createDataFrame(part, LOG_ROWS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    got = [r for r in finish(_live(rocks, tmp_path / "in", CFG), tmp_path).collect() if r["line_no"] < 10_000]
    want = _table_alerts(rocks, rows)
    assert len({r["rule"] for r in got}) >= 10 and {"session_requests", "session_failed_logins", "ua_cycling"} <= {r["rule"] for r in got}
    assert _alert_keys(got) == want


def test_rows_behind_the_watermark_are_counted_and_state_is_forgotten(rocks, tmp_path):
    row = lambda i, ts, ip: (i, ts, ip, "/login", "GET", 401, 0.1, 1, "a")
    parts = [[row(1, 1000, "x"), row(2, 2000, "x")], [row(3, 500_000, "y")], [row(5, 600_000, "y")], [row(4, 3000, "x"), row(6, 900_000, "x")], [row(7, 2_000_000, "y")]]
    for n, part in enumerate(parts):
        rocks.createDataFrame(part, LOG_ROWS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    stream = rocks.readStream.schema(LOG_ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part*").withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", "10 seconds")
    live_rows = detect.live_enrich(stream, CFG, ttl_ms=100_000).select("line_no", "is_first", "session_no", "ip_time_n")
    query = live_rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["line_no"]: (r["is_first"], r["session_no"], r["ip_time_n"]) for r in rocks.read.schema(live_rows.schema).parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (True, 1, 1), 2: (False, 1, 2), 3: (True, 1, 1), 5: (False, 2, 2), 6: (True, 1, 1)}
    assert detect.dropped_rows(query) == 1
