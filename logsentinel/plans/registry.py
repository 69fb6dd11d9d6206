"""Registered queries over the access-log view of the events table, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsentinel.config import SPARSE
from logsentinel.functions import scalars as S
from logsentinel.operators import aggregates as A
from logsentinel.operators import enrich as E
from logsentinel.operators import learning as L
from logsentinel.operators import lookups as J
from logsentinel.operators import metrics as M
from logsentinel.operators import rules as R
from logsentinel.operators import seasonal
from logsentinel.sources import logs

C = SPARSE
DAY = 86_400_000

#: The access-log view in DuckDB.
LOG = """al AS (
  SELECT event_id AS line_no, (epoch_us(ts) // 1000) AS ts_ms,
    concat('10.20.', CAST(CAST(floor(user_id/256) AS BIGINT) AS VARCHAR), '.', CAST(user_id%256 AS VARCHAR)) AS ip,
    CASE event_type WHEN 'click' THEN concat('/static/app', CAST(k%7 AS VARCHAR), '.js') WHEN 'view' THEN concat('/page', CAST(k%10 AS VARCHAR), '.html')
      WHEN 'purchase' THEN '/api/data' WHEN 'signup' THEN '/login' ELSE CASE WHEN k%5=0 THEN '/../etc/passwd' ELSE '/admin/config' END END AS path,
    CASE WHEN event_type IN ('signup','purchase') THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN event_type='error' THEN CASE k%4 WHEN 0 THEN 500 WHEN 1 THEN 404 WHEN 2 THEN 401 ELSE 403 END WHEN event_type='signup' AND k%3=0 THEN 401 ELSE 200 END AS status,
    value/100.0 AS request_time_s, CAST(floor(value*1000) AS BIGINT) AS bytes_sent,
    CASE k%10 WHEN 0 THEN '-' WHEN 1 THEN 'sqlmap/1.5' WHEN 2 THEN 'Mozilla/5.0 HeadlessChrome/99' WHEN 3 THEN 'Mozilla/5.0 (Windows) Chrome/80.0'
      WHEN 4 THEN 'Mozilla/5.0 (X11; Linux) Firefox/70.0' WHEN 5 THEN 'Mozilla/5.0 (Windows; Android) Chrome/120.0' ELSE 'Mozilla/5.0 (Macintosh) Chrome/120.0' END AS user_agent
  FROM (SELECT *, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM events) e)"""

SEQ = "ORDER BY ts_ms, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _count(key: str, flag: str = "1") -> str:
    return f"""(sum({flag}) OVER (PARTITION BY {key} ORDER BY ts_ms RANGE BETWEEN {C.window_ms} PRECEDING AND CURRENT ROW) - sum({flag}) OVER (PARTITION BY {key}, ts_ms)
      + sum({flag}) OVER (PARTITION BY {key}, ts_ms ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


FAILED = "CASE WHEN status IN (401,403) THEN 1 ELSE 0 END"
ERROR = "CASE WHEN status >= 400 AND status < 600 THEN 1.0 ELSE 0.0 END"
KIND = "CASE WHEN path = '/' THEN 'HTML' WHEN path LIKE '/static/%' OR path LIKE '/api/%' THEN 'ASSET' WHEN path LIKE '%.html' THEN 'HTML' WHEN path LIKE '%.js' THEN 'ASSET' ELSE 'OTHER' END"
WINDOWS = f"""w1 AS (SELECT *, {KIND} AS request_type, CAST({_count('ip')} AS BIGINT) AS ip_req_window, {_count('ip', FAILED)} AS f FROM al),
w2 AS (SELECT *, {_count('ip', "CASE WHEN request_type = 'HTML' THEN 1 ELSE 0 END")} AS h, {_count('ip', "CASE WHEN request_type = 'ASSET' THEN 1 ELSE 0 END")} AS a FROM w1),
win AS (SELECT * EXCLUDE (f, h, a),
  CAST(coalesce(last_value(CASE WHEN status IN (401,403) THEN f END IGNORE NULLS) OVER (PARTITION BY ip {SEQ}), 0) AS BIGINT) AS ip_failed_window,
  CAST(coalesce(last_value(CASE WHEN request_type = 'HTML' THEN h END IGNORE NULLS) OVER (PARTITION BY ip {SEQ}), 0) AS BIGINT) AS html_window,
  CAST(coalesce(last_value(CASE WHEN request_type = 'ASSET' THEN a END IGNORE NULLS) OVER (PARTITION BY ip {SEQ}), 0) AS BIGINT) AS asset_window FROM w2)"""


def _stats(key: str, source: str) -> str:
    cols = {"time": "request_time_s", "bytes": "CAST(bytes_sent AS DOUBLE)", "error": f"CAST({ERROR} AS DOUBLE)"} | ({"vol": "CAST(ip_req_window AS DOUBLE)"} if key == "ip" else {})
    now = cols | {"error": "CAST(CASE WHEN status >= 400 THEN 1 ELSE 0 END AS DOUBLE)"}
    over = f"OVER (PARTITION BY {key} {SEQ})"
    first = ", ".join(f"avg({c}) {over} AS {key}_{n}_mean, coalesce(stddev_samp({c}) {over}, 0.0) AS {key}_{n}_sd, count({c}) {over} AS {key}_{n}_n" for n, c in cols.items())
    z = ", ".join(f"CASE WHEN {key}_{n}_n >= {C.min_samples} AND {key}_{n}_sd > {E.FLOORS[n]} THEN ({c} - {key}_{n}_mean) / {key}_{n}_sd END AS {key}_{n}_z" for n, c in now.items())
    return f"s_{key} AS (SELECT *, {first} FROM {source}), z_{key} AS (SELECT *, {z} FROM s_{key})"


UA = """CASE WHEN user_agent IN ('', '-') THEN TRUE ELSE FALSE END AS ua_missing, user_agent LIKE '%HeadlessChrome%' OR user_agent LIKE '%Puppeteer%' AS ua_headless,
  user_agent LIKE '%sqlmap%' OR user_agent LIKE '%Nmap%' AS ua_bad,
  coalesce(TRY_CAST(regexp_extract(user_agent, 'Chrome/([0-9]+)', 1) AS INT) < 90, FALSE) OR coalesce(TRY_CAST(regexp_extract(user_agent, 'Firefox/([0-9]+)', 1) AS INT) < 85, FALSE) AS ua_outdated,
  (user_agent LIKE '%Windows%' OR user_agent LIKE '%Macintosh%' OR user_agent LIKE '%Linux%') AND (user_agent LIKE '%iPhone%' OR user_agent LIKE '%Android%') AS ua_inconsistent"""
CHANGED = "coalesce(user_agent NOT IN ('', '-') AND user_agent <> last_value(CASE WHEN user_agent NOT IN ('', '-') THEN user_agent END IGNORE NULLS) OVER (PARTITION BY ip ORDER BY ts_ms, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ua_changed"
SESSIONS = f"""g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY ip, user_agent ORDER BY ts_ms, line_no) <= {C.session_gap_s * 1000} THEN 0 ELSE 1 END AS fresh FROM al),
ses AS (SELECT * EXCLUDE fresh, CAST(sum(fresh) OVER (PARTITION BY ip, user_agent {SEQ}) AS BIGINT) AS session_no FROM g)"""
#: User agents that are stored at a row: the list fold of an agent's rows keeps one that comes after the kept one has left the window.
AGENTS = f"""fo AS (SELECT ip, user_agent, list_reduce(list({{'last': ts_ms, 'kept': [{{'l': line_no, 't': ts_ms}}]}} ORDER BY ts_ms, line_no),
    lambda a, x: CASE WHEN x.last <= a.last + {C.window_ms} THEN a ELSE {{'last': x.last, 'kept': list_concat(a.kept, x.kept)}} END) AS f FROM al WHERE user_agent NOT IN ('', '-') GROUP BY ip, user_agent),
  en AS (SELECT ip, k.l AS l, k.t AS t FROM (SELECT ip, unnest(f.kept) AS k FROM fo)),
  ag AS (SELECT a.line_no AS al_no, count(e.t) AS agents_window, a.user_agent NOT IN ('', '-') AND count(e.t) > {C.max_agents} AS ua_cycling
    FROM al a LEFT JOIN en e ON e.ip = a.ip AND e.t >= a.ts_ms - {C.window_ms} AND (e.t < a.ts_ms OR (e.t = a.ts_ms AND e.l <= a.line_no)) GROUP BY a.line_no, a.user_agent)"""
ENRICHED = f"""{LOG}, {WINDOWS}, {AGENTS},
fl AS (SELECT * EXCLUDE al_no, {UA}, {CHANGED}, row_number() OVER (PARTITION BY ip ORDER BY ts_ms, line_no) = 1 AS is_first, row_number() OVER (PARTITION BY ip, path ORDER BY ts_ms, line_no) = 1 AS is_path_new,
  CASE WHEN html_window > 0 THEN asset_window / html_window END AS asset_ratio FROM win JOIN ag ON al_no = line_no),
{_stats('ip', 'fl')}, {_stats('path', 'z_ip')}"""


def _thr(v: str, t: str, d: str, base: float, most: float = 98.0) -> str:
    return f"CASE WHEN {v} <= {t} THEN 0.0 WHEN {d} <= {t} THEN {base} WHEN {v} >= {d} THEN {most} ELSE {base} + ({v} - {t}) / ({d} - {t}) * ({most} - {base}) END"


def _zs(z: str, t: float, base: float = 65.0) -> str:
    return f"least(99.0, {base} + 5.0 * (abs({z}) - {t}))"


def _alerts_sql() -> str:
    r, f = C.max_requests, C.max_failed_logins
    rows = [
        ("requests_per_ip", 1, "RATE_LIMIT", f"ip_req_window > {r}", _thr("CAST(ip_req_window AS DOUBLE)", f"{r}.0", f"{10 * r}.0", 60.0)),
        ("failed_logins", 1, "BLOCK", f"ip_failed_window > {f}", _thr("CAST(ip_failed_window AS DOUBLE)", f"{f}.0", f"{5 * f}.0", 70.0, 99.0)),
        ("suspicious_path", 1, "BLOCK", "contains(path, '../') OR contains(path, '/etc/passwd') OR contains(path, 'sqlmap') OR contains(path, 'xss') OR contains(path, 'script')", "95.0"),
        ("suspicious_ua", 1, "BLOCK", "contains(user_agent, 'Nmap') OR contains(user_agent, 'sqlmap') OR contains(user_agent, 'nikto') OR contains(user_agent, 'curl/')", "75.0"),
        ("ua_missing", 1, "LOG", "ua_missing", "5.0"),
        ("ua_known_bad", 1, "BLOCK", "ua_bad", "75.0"),
        ("ua_headless", 1, "CHALLENGE", "ua_headless", "40.0"),
        ("ua_outdated", 1, "LOG", "ua_outdated", "10.0"),
        ("ua_cycling", 1, "BLOCK", "ua_cycling", "85.0"),
        ("asset_ratio", 1, "CHALLENGE", f"html_window >= {C.least_html} AND asset_ratio < {C.least_asset_ratio}", "CASE WHEN asset_ratio >= 0.1 THEN 50.0 ELSE 95.0 END"),
        ("sensitive_new_ip", 1, "BLOCK", "is_first AND (" + " OR ".join(f"contains(path, '{p}')" for p in C.sensitive) + ")", "80.0"),
        ("new_path_errors", 2, "CHALLENGE", "is_path_new AND ip_error_z > 2.5", _zs("ip_error_z", 2.5, 70.0)),
        *[(f"{k}_{s}_z", 2, "LOG", f"abs({k}_{s}_z) > {C.z_threshold}", _zs(f"{k}_{s}_z", C.z_threshold)) for k in ("ip", "path") for s in ("time", "bytes", "error", "vol") if (k, s) != ("path", "vol")],
        ("slowdown", 2, "LOG", "ip_time_n >= 30 AND ip_time_mean > 0 AND request_time_s > 3.0 * ip_time_mean", _thr("request_time_s", "3.0 * ip_time_mean", "15.0 * ip_time_mean", 50.0)),
    ]
    parts = [f"SELECT line_no, ts_ms, ip, '{n}' AS rule, 'tier{t}' AS tier, '{a}' AS action, CAST({s} AS DOUBLE) AS score FROM z_path WHERE {w}" for n, t, a, w, s in rows]
    return f"WITH {ENRICHED}, every AS ({' UNION ALL '.join(parts)}), alerts AS (SELECT * FROM every WHERE score > 0)"


ALERTS = _alerts_sql()


def log(spark: SparkSession, d: str) -> DataFrame:
    return logs.events_as_log(spark, d)


def alerts(spark: SparkSession, d: str) -> DataFrame:
    return R.evaluate_rules(E.enrich(log(spark, d), C), C)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _even_sql(*cols: str) -> str:
    """Rounded so that ties fall the same way in any engine."""
    return ", ".join(f"round({c} + 1e-9, 4) AS {c}" for c in cols)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def with_log(rest: str, ctes: str = "") -> str:
    return f"WITH {LOG}{', ' + ctes if ctes else ''} {rest}"


@query("access_log", with_log("SELECT line_no, ts_ms, ip, path, method, status, bytes_sent, user_agent FROM al"))
def _(spark, d):
    return log(spark, d).select("line_no", "ts_ms", "ip", "path", "method", "status", "bytes_sent", "user_agent")


@query("parse_good", with_log("SELECT line_no, (ts_ms // 1000) * 1000 AS ts_ms, ip, method, path, 'HTTP/1.1' AS protocol, status, bytes_sent, user_agent FROM al WHERE line_no % 50 <> 0"))
def _(spark, d):
    good, _bad = logs.parse_access_log(logs.log_lines(log(spark, d)))
    return good.select("line_no", "ts_ms", "ip", "method", "path", "protocol", "status", "bytes_sent", "user_agent")


@query("parse_reject_counts", with_log("SELECT 'field count' AS reason, count(*) AS n FROM al WHERE line_no % 50 = 0"))
def _(spark, d):
    _good, bad = logs.parse_access_log(logs.log_lines(log(spark, d)))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("request_type", with_log(f"SELECT line_no, {KIND} AS request_type FROM al"))
def _(spark, d):
    return log(spark, d).select("line_no", S.request_type(F.col("path"), C).alias("request_type"))


@query("ua_flags", with_log(f"SELECT line_no, {UA}, {CHANGED} FROM al"))
def _(spark, d):
    return E.ua_cycling(E.ua_flags(log(spark, d), C), C).select("line_no", "ua_missing", "ua_headless", "ua_bad", "ua_outdated", "ua_inconsistent", "ua_changed")


@query("suspicious_path", with_log("SELECT line_no, CASE WHEN contains(path, '../') THEN '../' WHEN contains(path, '/etc/passwd') THEN '/etc/passwd' WHEN contains(path, 'script') THEN 'script' END AS pattern FROM al"))
def _(spark, d):
    return log(spark, d).select("line_no", F.expr(S.first_match("path", C.bad_paths)).alias("pattern"))


WINDOW_COLUMNS = ["line_no", "ip_req_window", "ip_failed_window", "html_window", "asset_window"]


@query("ip_windows", with_log(f"SELECT {', '.join(WINDOW_COLUMNS)}, round(CASE WHEN html_window > 0 THEN asset_window / html_window END, 6) AS asset_ratio FROM win", WINDOWS))
def _(spark, d):
    return _rounded(E.ip_windows(log(spark, d), C).select(*WINDOW_COLUMNS, "asset_ratio"), "asset_ratio")


@query("first_seen", with_log("SELECT line_no, row_number() OVER (PARTITION BY ip ORDER BY ts_ms, line_no) = 1 AS is_first, row_number() OVER (PARTITION BY ip, path ORDER BY ts_ms, line_no) = 1 AS is_path_new FROM al"))
def _(spark, d):
    return E.seen(log(spark, d), C).select("line_no", "is_first", "is_path_new")


@query("ua_cycling", with_log("SELECT al_no AS line_no, agents_window, ua_cycling FROM ag", AGENTS))
def _(spark, d):
    return E.ua_cycling(log(spark, d), C).select("line_no", "agents_window", "ua_cycling")


@query("ua_cycling_exact", with_log("SELECT al_no AS line_no, agents_window, ua_cycling FROM ag", AGENTS))
def _(spark, d):
    return E.enrich(log(spark, d), C).select("line_no", "agents_window", "ua_cycling")


@query("sessionize", with_log("SELECT line_no, session_no FROM ses", SESSIONS))
def _(spark, d):
    return E.sessionize(log(spark, d), C).select("line_no", "session_no")


@query("session_summary", with_log("""SELECT ip, user_agent, session_no, count(*) AS requests, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(DISTINCT path) AS paths, count(*) FILTER (status BETWEEN 400 AND 499) AS errors_4xx,
  count(*) FILTER (status BETWEEN 500 AND 599) AS errors_5xx, count(*) FILTER (status IN (401, 403)) AS failed_logins, count(*) FILTER (method = 'POST') AS posts, count(*) FILTER (method = 'GET') AS gets,
  round(avg(request_time_s), 6) AS mean_time, round(avg(bytes_sent), 3) AS mean_bytes FROM ses GROUP BY ip, user_agent, session_no""", SESSIONS))  # fmt: skip
def _(spark, d):
    return E.session_summary(log(spark, d), C)


for _key in ("ip", "path"):
    _names = [f"{_key}_{s}" for s in ("time", "bytes", "error", "vol")[: 4 if _key == "ip" else 3]]
    _stat_cols = [f"{n}_{x}" for n in _names for x in ("mean", "sd")]
    _z_cols = [f"{n}_z" for n in _names]

    def _run(spark, d, key=_key, cols=_stat_cols, z=False):
        df = log(spark, d)
        df = E.address_features(df, C, E.stats_columns(key), ("windows", "stats")) if key == "ip" else E.running_stats(df, key, E.stats_columns(key))
        df = E.zscores(df, key, C) if z else df
        return df.select("line_no", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in cols])

    _ctes = f"{WINDOWS}, {_stats(_key, 'win' if _key == 'ip' else 'al')}"
    query(f"{_key}_running_stats", with_log(f"SELECT line_no, {_even_sql(*_stat_cols)} FROM s_{_key}", _ctes))(_run)
    query(f"{_key}_zscores", with_log(f"SELECT line_no, {_even_sql(*_z_cols)} FROM z_{_key}", _ctes))(lambda spark, d, f=_run, k=_key, c=_z_cols: f(spark, d, k, c, True))
    _other = "path" if _key == "ip" else "ip"
    query(
        f"{_key}_profile",
        with_log(f"""SELECT {_key}, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(DISTINCT {_other}) AS others, count(DISTINCT user_agent) AS agents, round(avg(request_time_s), 6) AS time_mean,
          round(coalesce(stddev_samp(request_time_s), 0.0), 6) AS time_sd, round(avg(bytes_sent), 3) AS bytes_mean, round(avg({ERROR}), 6) AS error_mean FROM al GROUP BY {_key}"""),
    )(lambda spark, d, k=_key: A.profile(log(spark, d), k))


@query("all_alerts", f"{ALERTS} SELECT line_no, ts_ms, ip, rule, tier, action, round(score, 6) AS score FROM alerts")
def _(spark, d):
    return _rounded(alerts(spark, d).select("line_no", "ts_ms", "ip", "rule", "tier", "action", "score"), "score")


@query("alert_counts", f"{ALERTS} SELECT rule, tier, action, count(*) AS n, round(sum(score), 3) AS total_score FROM alerts GROUP BY rule, tier, action")
def _(spark, d):
    return alerts(spark, d).groupBy("rule", "tier", "action").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total_score"))


@query("score_hist", f"{ALERTS} SELECT tier, " + ", ".join(f"count(*) FILTER (score <= {b}) AS le_{b}" for b in (10, 25, 50, 75, 90, 99)) + " FROM alerts GROUP BY tier")
def _(spark, d):
    return alerts(spark, d).groupBy("tier").agg(*[F.count_if(F.col("score") <= b).alias(f"le_{b}") for b in (10, 25, 50, 75, 90, 99)])


@query("recent_alerts", f"{ALERTS} SELECT line_no, ts_ms, ip, rule, tier FROM alerts ORDER BY ts_ms DESC, line_no DESC, rule LIMIT 50")
def _(spark, d):
    return alerts(spark, d).select("line_no", "ts_ms", "ip", "rule", "tier").orderBy(F.desc("ts_ms"), F.desc("line_no"), "rule").limit(50)


@query("top_ips", with_log("SELECT ip, count(*) AS n FROM al GROUP BY ip ORDER BY n DESC, ip LIMIT 10"))
def _(spark, d):
    return A.top(log(spark, d).groupBy("ip").agg(F.count("*").alias("n")), 10, "n", "ip")


@query("topk_sources", with_log("SELECT path, ip, n, CAST(rank AS INT) AS rank FROM (SELECT path, ip, count(*) AS n, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, ip) AS rank FROM al GROUP BY path, ip) WHERE rank <= 3"))
def _(spark, d):
    return A.top_per_group(log(spark, d).groupBy("path", "ip").agg(F.count("*").alias("n")), "path", "n", "ip", 3)


@query("threat_hits", with_log("SELECT line_no, ip FROM al WHERE ip IN (SELECT concat('10.20.', CAST(CAST(floor(user_id/256) AS BIGINT) AS VARCHAR), '.', CAST(user_id%256 AS VARCHAR)) FROM events WHERE user_id % 37 = 0)"))
def _(spark, d):
    u = spark.read.parquet(f"{d}/events.parquet").where("user_id % 37 = 0").select(F.concat(F.lit("10.20."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("ip"))
    return J.threat_join(log(spark, d), u).select("line_no", "ip")


IN_BLOCK = "(u < 16 OR (u >= 64 AND u < 128) OR u = 261)"
U = "CAST(split_part(ip, '.', 3) AS INT) * 256 + CAST(split_part(ip, '.', 4) AS INT)"


def _blocks(spark: SparkSession) -> DataFrame:
    return logs.cidr_table(spark.createDataFrame([("# office",), ("10.20.0.0/28",), ("10.20.0.64/26",), ("10.20.1.5",), ("not.an.ip/24",)], "value string"))


@query("allowlist_anti", with_log(f"SELECT line_no FROM (SELECT line_no, {U} AS u FROM al) WHERE NOT {IN_BLOCK}"))
def _(spark, d):
    return J.cidr_anti(log(spark, d), _blocks(spark)).select("line_no")


@query("cidr_semi", with_log(f"SELECT line_no FROM (SELECT line_no, {U} AS u FROM al) WHERE {IN_BLOCK}"))
def _(spark, d):
    return J.cidr_semi(log(spark, d), _blocks(spark)).select("line_no")


@query("threat_domains", "SELECT page_id FROM (SELECT page_id, '.' || lower(split_part(substr(url, instr(url, '://') + 3), '/', 1)) AS h FROM pages WHERE url LIKE '%://%') WHERE h LIKE '%.example.net' OR h LIKE '%.spam-farm.example.org'")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").where("url LIKE '%://%'").select("page_id", F.lower(F.substring_index(F.expr("substr(url, instr(url, '://') + 3)"), "/", 1)).alias("host"))
    return J.domain_suffix_join(pages, spark.createDataFrame([("example.net",), ("spam-farm.example.org",)], "domain string")).select("page_id")


@query("geo_enrich", with_log("SELECT line_no, n_name AS country FROM al LEFT JOIN nation ON (CAST(split_part(ip, '.', 3) AS INT) * 256 + CAST(split_part(ip, '.', 4) AS INT)) % 25 = n_nationkey"))
def _(spark, d):
    geo = log(spark, d).select("ip").distinct().withColumn("n", (F.split("ip", r"\.")[2].cast("int") * 256 + F.split("ip", r"\.")[3].cast("int")) % 25)
    nation = spark.read.parquet(f"{d}/nation.parquet")
    return J.geo_enrich(log(spark, d), geo.join(nation, F.col("n") == F.col("n_nationkey")).select("ip", F.col("n_name").alias("country"))).select("line_no", "country")


NEWEST = "r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts_ms DESC, line_no DESC) AS r FROM al)"


@query("baseline_p95", with_log("SELECT path, count(*) AS n, round(quantile_cont(request_time_s, 0.5), 6) AS p50, round(quantile_cont(request_time_s, 0.95), 6) AS p95, round(quantile_cont(request_time_s, 0.99), 6) AS p99 FROM r WHERE r <= 1000 GROUP BY path", NEWEST))
def _(spark, d):
    return A.recent_percentile(log(spark, d), "path", "request_time_s")


@query("latency_percentiles", with_log("SELECT path, " + ", ".join(f"list_sort(list(request_time_s))[count(*) * {p} // 100 + 1] AS p{p}" for p in (50, 90, 95, 99)) + " FROM al GROUP BY path"))
def _(spark, d):
    return A.nearest_rank(log(spark, d), "path", "request_time_s")


@query("path_recent", with_log(f"SELECT path, string_agg(CASE WHEN r <= 16 THEN CAST(status AS VARCHAR) END, ',' ORDER BY ts_ms, line_no) AS recent, count(*) AS n, CAST(sum({ERROR}) AS BIGINT) AS errors FROM r GROUP BY path", NEWEST))
def _(spark, d):
    return A.path_recent(log(spark, d))


@query("welford_merge", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity) * count(*), 2) AS m2 FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    parts = A.moments(items, ["l_returnflag", "l_linenumber"], "l_quantity")
    return A.merge_moments(parts, ["l_returnflag"]).select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("m2", 2).alias("m2"))


@query("ip_rates", with_log(f"SELECT ip, round(count(*) / {DAY / 1000}, 9) AS request_rate, round(count(*) FILTER (status IN (401, 403)) / {DAY / 1000}, 9) AS failed_rate, round(avg({ERROR}) * 100, 6) AS error_percent FROM al WHERE ts_ms >= (SELECT max(ts_ms) FROM al) - {DAY} GROUP BY ip"))
def _(spark, d):
    return A.window_rates(log(spark, d), DAY)


@query("window_counts", with_log(f"SELECT count(*) FILTER (ts_ms > m - 3600000) AS hour, count(*) FILTER (ts_ms > m - {DAY}) AS day, count(*) FILTER (ts_ms > m - {7 * DAY}) AS week, count(*) AS total FROM al, (SELECT max(ts_ms) AS m FROM al)"))
def _(spark, d):
    return A.window_counts(log(spark, d), {"hour": 3_600_000, "day": DAY, "week": 7 * DAY})


@query("activity_bitmap", with_log("SELECT ip, CAST(bit_or(CAST(1 AS INT) << CAST((ts_ms // 3600000) % 24 AS INT)) AS INT) AS hours FROM al GROUP BY ip"))
def _(spark, d):
    return A.activity_bitmap(log(spark, d))


@query("prune_state", with_log(f"SELECT ip, max(ts_ms) AS last_ms FROM al GROUP BY ip HAVING 1706659200000 - max(ts_ms) <= {DAY}"))
def _(spark, d):
    return A.prune(A.profile(log(spark, d), "ip"), 1_706_659_200_000, DAY).select("ip", "last_ms")


COUNTER = "per AS (SELECT path, ts_ms // 3600000 AS bucket, count(*) AS n FROM al GROUP BY ALL), cnt AS (SELECT path, bucket, n, sum(n) OVER (PARTITION BY path ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM per)"


@query("metric_counter", with_log("SELECT path, bucket, CAST(value AS BIGINT) AS value FROM cnt", COUNTER))
def _(spark, d):
    return M.hourly_counter(log(spark, d), "path")


@query("metric_rate", with_log("SELECT path, bucket, CAST(sum(step) OVER (PARTITION BY path ORDER BY bucket RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS increase FROM (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY path ORDER BY bucket), 0) AS step FROM cnt)", COUNTER))
def _(spark, d):
    return M.increase(M.hourly_counter(log(spark, d), "path"), "path", 24)


BOUNDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]


@query("metric_histogram", with_log(" UNION ALL ".join(f"SELECT path, CAST({i} AS INT) AS pos, '{b:g}' AS le, count(*) FILTER (request_time_s <= {b}) AS n FROM al GROUP BY path" for i, b in enumerate(BOUNDS)) + f" UNION ALL SELECT path, CAST({len(BOUNDS)} AS INT), '+Inf', count(*) FROM al GROUP BY path"))
def _(spark, d):
    return M.histogram(log(spark, d), "path", "request_time_s", BOUNDS)


@query("histogram_quantile")
def _(spark, d):
    return M.histogram_quantile(M.histogram(log(spark, d), "path", "request_time_s", BOUNDS), "path", 0.95)


@query("metric_offset", with_log("SELECT a.path, a.bucket, a.n, b.n AS before, round(a.n / b.n, 6) AS ratio FROM per a JOIN per b ON a.path = b.path AND a.bucket = b.bucket + 24", COUNTER))
def _(spark, d):
    per = log(spark, d).groupBy("path", F.floor(F.col("ts_ms") / M.HOUR).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return M.with_offset(per, "path", 24)


@query("metric_trend", with_log("SELECT path, round(regr_slope(n, h), 6) AS slope, round(regr_intercept(n, h), 4) AS intercept, round(regr_r2(n, h), 6) AS r2, round(greatest(0.0, regr_intercept(n, h) + regr_slope(n, h) * (max(h) + 24)), 4) AS predicted FROM (SELECT path, n, CAST(bucket - 473352 AS DOUBLE) AS h FROM per) GROUP BY path", COUNTER))
def _(spark, d):
    per = log(spark, d).groupBy("path", F.floor(F.col("ts_ms") / M.HOUR).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return M.trend(per, "path", "n", (F.col("bucket") - 473352).cast("double"), 24.0)


@query("metric_changes", with_log("SELECT ip, count(*) FILTER (m) AS changes FROM (SELECT ip, coalesce(status <> lag(status) OVER (PARTITION BY ip ORDER BY ts_ms, line_no), FALSE) AS m FROM al) GROUP BY ip"))
def _(spark, d):
    return M.changes(log(spark, d), "ip", "status")


@query("metric_alerts", with_log("SELECT path, min(bucket) AS since, max(bucket) AS until, count(*) AS length FROM (SELECT path, bucket, bucket - row_number() OVER (PARTITION BY path ORDER BY bucket) AS run FROM per WHERE n >= 2) GROUP BY path, run HAVING count(*) >= 3", COUNTER))
def _(spark, d):
    per = log(spark, d).groupBy("path", F.floor(F.col("ts_ms") / M.HOUR).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return M.firing(per, "path", F.col("n") >= 2, 3)


@query("rule_metric", with_log("""SELECT name, r.label, CASE WHEN op NOT IN ('>', '<', '!=') THEN 'Invalid comparison operator' WHEN v IS NULL THEN 'No data' ELSE 'OK' END AS status,
  coalesce(op IN ('>', '<', '!=') AND CASE op WHEN '>' THEN v > t WHEN '<' THEN v < t WHEN '!=' THEN v <> t END, FALSE) AS triggered,
  CASE WHEN CASE op WHEN '>' THEN v > t WHEN '<' THEN v < t WHEN '!=' THEN v <> t END THEN round(abs(v - t), 6) END AS score
  FROM (VALUES ('many logins', '/login', 100.0, '>'), ('few pages', '/page1.html', 10.0, '<'), ('odd', '/api/data', 5.0, '~'), ('none', '/nowhere', 1.0, '!=')) r(name, label, t, op)
  LEFT JOIN (SELECT path AS label, CAST(count(*) AS DOUBLE) AS v FROM al GROUP BY path) x ON x.label = r.label"""))  # fmt: skip
def _(spark, d):
    rules = spark.createDataFrame([("many logins", "/login", 100.0, ">"), ("few pages", "/page1.html", 10.0, "<"), ("odd", "/api/data", 5.0, "~"), ("none", "/nowhere", 1.0, "!=")], "name string, label string, threshold double, comparison string")
    return M.evaluate_metric_rules(log(spark, d).groupBy(F.col("path").alias("label")).agg(F.count("*").cast("double").alias("value")), rules)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return L.baseline_events(E.ip_windows(log(spark, d), C))


BASE = f"""{WINDOWS}, ev AS ({' UNION ALL '.join(f"SELECT '{n}' AS entity_type, {k} AS entity_id, ts_ms, line_no, CAST({v} AS DOUBLE) AS value FROM win" for n, k, v in (
    ('ip_request_time', 'ip', 'request_time_s'), ('ip_bytes', 'ip', 'bytes_sent'), ('ip_error_rate', 'ip', ERROR), ('ip_request_volume', 'ip', 'ip_req_window'), ('ip_request_count', 'ip', 'ip_req_window'), ('ip_failed_logins', 'ip', 'ip_failed_window'),
    ('path_request_time', 'path', 'request_time_s'), ('path_bytes', 'path', 'bytes_sent'), ('path_error_rate', 'path', ERROR)))})"""  # fmt: skip


@query("baseline_events", with_log("SELECT entity_type, entity_id, line_no, round(value, 6) AS value FROM ev", BASE))
def _(spark, d):
    return _rounded(_events(spark, d).select("entity_type", "entity_id", "line_no", "value"), "value")


@query("baseline_established", with_log("SELECT entity_type, entity_id, count(*) AS n, count(*) >= 30 AS established, max(CASE WHEN r = 30 THEN ts_ms END) AS established_ms FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY ts_ms, line_no) AS r FROM ev) GROUP BY entity_type, entity_id", BASE))
def _(spark, d):
    return L.established(_events(spark, d), ["entity_type", "entity_id"])


@query("ewma_baseline")
def _(spark, d):
    return L.ewma(_events(spark, d), ["entity_type", "entity_id"]).withColumn("ewma_var", F.round(F.col("ewma_var") + 1e-9, 2))


@query("baseline_anomalies")
def _(spark, d):
    e = _events(spark, d)
    return L.anomalies(e, L.ewma(e, ["entity_type", "entity_id"]))


def _season(spark: SparkSession, d: str, dim: str) -> DataFrame:
    return L.seasonal_pattern(log(spark, d).withColumn("value", F.col("request_time_s")), "path", dim)


for _dim, _bucket in (("hour", "CAST((ts_ms // 3600000) % 24 AS INT)"), ("day", "CAST((ts_ms // 86400000 + 4) % 7 AS INT)")):
    _n = L.BUCKETS[_dim]
    query(
        f"seasonal_{_dim}",
        with_log(
            f"""SELECT w.path, CAST(b AS INT) AS bucket, round(coalesce(mean / all_mean, 1.0), 6) AS pattern,
              round(coalesce(least(1.0, n / ({100 / _n})) * CASE WHEN n > 1 AND sd > 0 THEN exp(-sd / greatest(0.1, abs(mean))) ELSE 1.0 END, 0.0), 6) AS confidence, coalesce(n, 0) AS n
              FROM (SELECT path, avg(request_time_s) AS all_mean FROM q GROUP BY path HAVING count(*) >= 100) w CROSS JOIN (SELECT unnest(range({_n})) AS b) g
              LEFT JOIN (SELECT path, bucket, avg(request_time_s) AS mean, stddev_pop(request_time_s) AS sd, count(*) AS n FROM q GROUP BY path, bucket) o ON o.path = w.path AND o.bucket = g.b""",
            f"{NEWEST}, q AS (SELECT *, {_bucket} AS bucket FROM r WHERE r <= 200)",
        ),
    )(lambda spark, d, dim=_dim: _season(spark, d, dim))


def spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the transform of the hourly pattern, which isn't rounded before."""
    s = seasonal.spectrum(L.seasonal_pattern(log(spark, d).withColumn("value", F.col("request_time_s")), "path", "hour", digits=None), "path", 24)
    even = lambda c, size: F.round(c * size + 1e-9, 5)
    return s.select("path", "k", even(F.col("re"), 24).alias("re"), even(F.col("im"), 24).alias("im"), even(F.col("magnitude"), 1).alias("magnitude"))


@query("seasonal_dft")
def _(spark, d):
    return spectrum(spark, d)


from logsentinel.plans import learned, more, ops, series  # noqa: E402, F401  register the rest


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
