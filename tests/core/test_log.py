import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logsentinel.config import Config
from logsentinel.functions import scalars as S
from logsentinel.operators import alerting as T
from logsentinel.operators import enrich as E
from logsentinel.operators import lookups as J
from logsentinel.operators import reports as P
from logsentinel.operators import rules as R
from logsentinel.operators import sessions as N
from logsentinel.operators.blocks import address_features
from logsentinel.sources import logs

GOOD = "192.168.0.1|-|01/Jan/2023:12:00:01 +0000|0.120|0.100|GET /index.html HTTP/1.1|200|1024|https://example.com|Mozilla/5.0 (X11; Linux x86_64)|example.com|US|127.0.0.1:80|abc123|0.020"


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_parse(spark):
    lines = [GOOD, "1.2.3.4|this is a malformed log line", GOOD.replace("01/Jan/2023:12:00:01 +0000", "INVALID_TIMESTAMP"), GOOD.replace("|200|", "|x|"), "|".join(["null"] * 15), GOOD.replace("/index.html", "/some%2Fpath%20with%2Bspaces")]
    good, bad = logs.parse_access_log(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))
    rows = {r["line_no"]: r for r in good.collect()}
    assert set(rows) == {0, 5}
    assert (rows[0]["ts_ms"], rows[0]["method"], rows[0]["path"], rows[0]["protocol"], rows[0]["status"], rows[0]["bytes_sent"], rows[0]["request_time_s"]) == (1672574401000, "GET", "/index.html", "HTTP/1.1", 200, 1024, 0.12)
    assert rows[5]["path"] == "/some/path with+spaces"
    assert {r["line_no"]: r["reason"] for r in bad.collect()} == {1: "field count", 2: "timestamp", 3: "status", 4: "timestamp"}


def test_scalars(spark):
    assert one(spark, S.ip_number, "192.168.1.1", "0.0.0.0", "255.255.255.255", "127.0.0.1", "not.an.ip", "192.168.1", "192.168.1.256", "") == [3232235777, 0, 4294967295, 2130706433, 0, 0, 0, 0]
    assert one(spark, lambda x: S.cidr(x)[0], "192.168.1.100/24", "8.8.8.8", "1.2.3.4/33", "1.2.3.4/foo", "not.an.ip/24") == [3232235776, 134744072, None, None, None]
    assert one(spark, S.log_time_ms, "23/May/2025:08:30:00 -0500", "not a time", "", "-") == [1748007000000, None, None, None]
    assert one(spark, S.url_decode, "hello+world", "foo%20bar", "%2Fetc%2Fpasswd", "invalid%2g", "") == ["hello world", "foo bar", "/etc/passwd", "invalid%2g", ""]
    assert one(spark, lambda x: S.request_type(x, Config()), "/", "/static/a.html", "/a.html?x=1", "/b.js#t", "/c") == ["HTML", "ASSET", "HTML", "ASSET", "OTHER"]
    assert one(spark, lambda x: S.number(x, "int"), "", "-", "12", "x") == [0, 0, 12, None]


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "line_no long, ts_ms long, ip string, path string, method string, status int, request_time_s double, bytes_sent long, user_agent string")


def test_windows_with_ties_equal_a_simulated_deque(spark):
    rows, state, want = [], {}, {}
    for i in range(200):
        ip, ts, status = f"10.0.0.{i % 3}", (i // 7) * 400, 401 if i % 5 == 0 else 200
        rows.append((i, ts, ip, "/a.html", "GET", status, 0.1, 10, "x"))
    for line, ts, ip, _, _, status, *_ in rows:
        s = state.setdefault(ip, {"all": [], "bad": [], "held": 0})
        s["all"] = [t for t in s["all"] if t >= ts - 1000] + [ts]
        if status == 401:
            s["bad"] = [t for t in s["bad"] if t >= ts - 1000] + [ts]
            s["held"] = len(s["bad"])
        want[line] = (len(s["all"]), s["held"])
    got = E.ip_windows(log_rows(spark, rows), Config(window_ms=1000)).select("line_no", "ip_req_window", "ip_failed_window").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want


def test_path_cap(spark):
    rows = [(i, i * 1000, "10.0.0.1", f"/p{i % 10}", "GET", 200, 0.1, 1, "x") for i in range(20)]
    got = E.seen(log_rows(spark, rows), Config(max_paths=5)).orderBy("line_no").collect()
    assert [r["is_path_new"] for r in got] == [True] * 10 + [False] * 5 + [True] * 5


def test_cidr_join_has_no_nested_loop(spark, capsys):
    df = spark.createDataFrame([(i, f"10.20.{i // 256}.{i % 256}") for i in range(1000)], "line_no long, ip string")
    out = J.cidr_semi(df, logs.cidr_table(spark.createDataFrame([("10.20.1.0/24",), ("bad",), ("# x",)], "value string")))
    assert sorted(r["line_no"] for r in out.collect()) == list(range(256, 512))
    out.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_throttle_equals_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(t, i, f"10.0.0.{rng.randrange(3)}", f"r{rng.randrange(4)}") for i, t in enumerate(sorted(rng.randrange(4_000_000) // 1000 * 1000 for _ in range(600)))]
    alerts = spark.createDataFrame([(*r, r[3], "tier1", 1.0) for r in rows], "ts_ms long, line_no long, ip string, reason string, rule string, tier string, score double")
    for most in (0, 1, 3):
        want, last, recorded = [], {}, Counter()
        for t, i, ip, reason in rows:
            seen = last.get((ip, reason))
            if seen is None or t >= seen[0] + 300_000 or (most and recorded[ip] - seen[1] >= most):
                recorded[ip] += 1
                last[ip, reason] = (t, recorded[ip])
                want.append(i)
        assert sorted(r["line_no"] for r in R.throttle(alerts, 300, most).collect()) == want


def test_two_phase_statistics_equal_one_phase(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(50) * 1000, "10.0.0.1", f"/p{i % 2}", "GET", rng.choice([200, 404]), rng.random() if i % 9 else None, i, "x") for i in range(300)]
    one, two = (E.running_stats(log_rows(spark, rows), "path", E.stats_columns("path"), b).orderBy("line_no").toPandas() for b in (10**12, 7000))
    for c in one.columns[9:]:
        assert ((one[c] - two[c]).abs() < 1e-9).all() or (one[c].isna() == two[c].isna()).all() and (one[c] - two[c]).abs().max() < 1e-9, c


def test_scores(spark):
    df = spark.createDataFrame([(50.0,), (100.0,), (550.0,), (2000.0,)], "v double")
    assert [r[0] for r in df.select(F.expr(S.score_threshold("v", 100, 1000, 60.0))).collect()] == [0.0, 0.0, 79.0, 98.0]


def test_agents_come_back_after_the_window(spark):
    cfg = Config(window_ms=1000, max_agents=1)
    seen = [(0, "a"), (500, "a"), (900, "b"), (1000, "a"), (1001, "a"), (1950, "-"), (1950, None), (2900, "c"), (2900, "a"), (2900, "c")]
    rows = spark.createDataFrame([(i, t, "10.0.0.1", u) for i, (t, u) in enumerate(seen)] + [(10, 2900, "10.0.0.2", "z")], "line_no long, ts_ms long, ip string, user_agent string")
    got = {r.line_no: (r.agents_window, r.ua_cycling) for r in E.ua_cycling(rows, cfg).collect()}
    stored, want = [], []
    for t, u in seen:
        stored = [(s, v) for s, v in stored if t - s <= cfg.window_ms]
        if u not in (None, "-") and all(v != u for _, v in stored):
            stored.append((t, u))
        want.append((len(stored), u not in (None, "-") and len(stored) > 1))
    assert [got[i] for i in range(10)] == want and got[10] == (1, False)


def test_session_events_leave_out_what_has_not_happened(spark):
    running = spark.createDataFrame([(1, 5, "h", 2, 1, 1, 0, 0), (2, 6, "h", 4, 2, 1, 1, 3)], "line_no long, ts_ms long, ip string, session_requests long, session_paths long, session_4xx long, session_5xx long, session_failed long")
    got = {(r.line_no, r.entity_type): r.value for r in N.session_events(running).collect()}
    assert len(got) == 9 and got[1, "session_error_rate"] == got[2, "session_error_rate"] == 0.5
    assert (1, "session_failed_logins") not in got and got[2, "session_failed_logins"] == 3.0


def test_later_tiers_count_only_below_the_stop(spark):
    rows = spark.createDataFrame([(1, "a", 200), (2, "b", 401), (3, "c", None)], "line_no long, ip string, status int")
    tiers = [[("any", "status > 0", 60.0), ("denied", "status = 401", 40.0)], [], [("late", "true", 45.0)]]
    got = {r.line_no: (r.total, r.rules) for r in P.weigh_tiers(rows, tiers, 40.0).collect()}
    assert got == {1: (105.0, "any,late"), 2: (100.0, "any,denied"), 3: (45.0, "late")}


def test_numbers_are_printed_like_printf(spark):
    values = [2.025, 0.125, 1.005, 0.375, -0.125, 0.0, 1e-9, 123456.789, 2.5, 3.5, 1e15, 99.995, -7.0]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for digits in (1, 2, 6):
        assert [r[0] for r in df.select(F.expr(S.fixed("v", digits))).collect()] == [f"{v:.{digits}f}" for v in values] + [None]
    assert df.select(F.expr(S.figure("2.0000005D"))).first()[0] == f"{2.0000005:.6f}"


def test_agents_of_two_platforms(spark):
    agents = ["Mozilla/5.0 (Linux; Android 14) Chrome/120", "Mozilla/5.0 (X11; Ubuntu) Mobile", "Mozilla/5.0 (Macintosh) iPhone", "Windows Chrome/120 Firefox/70", "-", None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(agents)], "line_no long, user_agent string")
    got = E.ua_flags(rows).orderBy("line_no").collect()
    assert [r["ua_inconsistent"] for r in got] == [True, False, True, False, False, False]
    assert (got[3]["ua_outdated"], got[3]["browser"]) == (True, "Firefox/70") and [r["ua_missing"] for r in got[4:]] == [True, True]


def plain_features(rows, cfg):
    """The state of each address, row by row. rows: (line, ts, ip, path, status, agent, seconds)."""
    out, state = {}, {}
    for line, ts, ip, path, status, agent, seconds in sorted(rows, key=lambda r: (r[1], r[0])):
        s = state.setdefault(ip, {"req": [], "failed": [], "html": [], "asset": [], "held": {}, "paths": set(), "agent": None, "stored": [], "times": []})
        kind = "html" if path == "/" or path.endswith(".html") else "asset" if path.startswith("/static/") else None
        for name, flag in (("req", True), ("failed", status in (401, 403)), ("html", kind == "html"), ("asset", kind == "asset")):
            if flag:
                s[name] = [t for t in s[name] if t >= ts - cfg.window_ms] + [ts]
                s["held"][name] = len(s[name])
        first, new = not s["times"], path not in s["paths"]
        if len(s["paths"]) < cfg.max_paths:
            s["paths"].add(path)
        there = agent not in (None, "", "-")
        changed = there and s["agent"] is not None and s["agent"] != agent
        s["stored"] = [(t, a) for t, a in s["stored"] if t >= ts - cfg.window_ms]
        if there:
            s["agent"] = agent
            if all(a != agent for _, a in s["stored"]):
                s["stored"].append((ts, agent))
        s["times"].append(seconds)
        mean = sum(s["times"]) / len(s["times"])
        sd = (sum((x - mean) ** 2 for x in s["times"]) / (len(s["times"]) - 1)) ** 0.5 if len(s["times"]) > 1 else 0.0
        h = s["held"]
        out[line] = [h["req"], h.get("failed", 0), h.get("html", 0), h.get("asset", 0), first, new, changed, len(s["stored"]), there and len(s["stored"]) > cfg.max_agents, round(mean, 9), round(sd, 9)]
    return out


FEATURES = ["ip_req_window", "ip_failed_window", "html_window", "asset_window", "is_first", "is_path_new", "ua_changed", "agents_window", "ua_cycling", "ip_time_mean", "ip_time_sd"]


@pytest.mark.parametrize("length", [1000, 4000, 10**9])
def test_features_in_blocks_equal_a_plain_loop(spark, length):
    rng = random.Random(11)
    paths = ["/", "/a.html", "/b.html", "/static/x.js", "/login", "/c"]
    rows = [(i, rng.randrange(60) * 250 + 8000 * (i % 7 == 0), f"10.0.0.{rng.choice([1, 1, 1, 2, 3])}", rng.choice(paths), rng.choice([200, 401, 403, 500]), rng.choice(["a", "b", "c", "-", None]), rng.randrange(100) / 8) for i in range(400)]
    cfg = Config(window_ms=1000, max_paths=4, max_agents=1)
    table = spark.createDataFrame([(*r, "x") for r in rows], "line_no long, ts_ms long, ip string, path string, status int, user_agent string, request_time_s double, method string").withColumn("bytes_sent", F.lit(1))
    got = {r["line_no"]: [round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in FEATURES)] for r in address_features(table, cfg, E.stats_columns("ip"), length=length).collect()}
    assert got == plain_features(rows, cfg)


def test_a_hot_address_is_spread_over_tasks(spark):
    rows = spark.range(0, 20000, 1, 4).selectExpr("id AS line_no", "id * 10 AS ts_ms", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('ip', id % 977) END AS ip", "concat('/p', id % 5) AS path", "200 AS status", "concat('u', id % 3) AS user_agent", "0.5D AS request_time_s", "1L AS bytes_sent")
    dealt = address_features(rows, Config(window_ms=250), E.stats_columns("ip"), length=1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 20000 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tiers_can_be_left_out_and_every_session_rule_fires(spark):
    rows = [(i, i * 1000, "10.0.0.1", "/../etc/passwd", "GET", 401, 0.5, 10, f"a{i % 4}") for i in range(40)]
    cfg = Config(session_requests=5, session_failed_logins=5, min_samples=5)
    enriched = N.running_sessions(E.enrich(log_rows(spark, rows), cfg), cfg, ("ip",))
    none = logs.cidr_table(spark.createDataFrame([("192.0.2.1",)], "value string"))
    rules = lambda tiers: {(r["rule"], r["tier"]) for r in T.alert_table(enriched, cfg, none, none, tiers=tiers).collect()}
    both = rules((1, 2))
    assert {"session_failed_logins", "session_requests", "session_agents", "suspicious_path", "ua_cycling"} <= {r for r, _ in both}
    assert rules((1,)) == {r for r in both if r[1] == "tier1"} and rules((2,)) == {r for r in both if r[1] == "tier2"} and rules(()) == set()
    agents = T.alert_table(enriched, cfg, none, none).where("rule = 'session_agents'").first()
    assert agents["reason"] == "User-Agent changed 3 times within a single session." and agents["score"] == 90.0
