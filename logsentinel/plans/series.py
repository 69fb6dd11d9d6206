"""Registered queries: rates at any time, rule tables, every move of a threshold, sketches, mappings of any life, forests, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsentinel.operators import adaptive as D
from logsentinel.operators import forest as I
from logsentinel.operators import lookups as J
from logsentinel.operators import ranges as R
from logsentinel.operators import state as S
from logsentinel.plans import more
from logsentinel.plans import registry as Q
from logsentinel.plans.registry import ALERTS, DAY, query, with_log
from logsentinel.sources.kept import stored

MINUTE, HOUR = 60_000, 3_600_000

#: A counter of each path that begins anew every day, sampled whenever a request comes.
SAMPLES = f"sm AS (SELECT path, ts_ms, line_no, row_number() OVER (PARTITION BY path, ts_ms // {DAY} ORDER BY ts_ms, line_no) AS value FROM al)"


def _samples(spark, d):
    day = F.floor(F.col("ts_ms") / DAY)
    return Q.log(spark, d).select("path", "ts_ms", "line_no", F.row_number().over(W.partitionBy("path", day).orderBy("ts_ms", "line_no")).alias("value"))


@query("metric_increase", with_log(f"""SELECT path, t AS at_ms, CASE WHEN count(*) > 1 THEN sum(CASE WHEN f THEN 0 ELSE step END) END::DOUBLE AS increase, CASE WHEN count(*) > 1 THEN sum(CASE WHEN f THEN 0 ELSE step END) / 3600.0 END AS rate, count(*) AS samples
  FROM (SELECT path, t, ts_ms, coalesce(CASE WHEN value < b THEN value ELSE value - b END, 0) AS step, row_number() OVER (PARTITION BY path, t ORDER BY ts_ms, line_no) = 1 AS f
    FROM (SELECT *, lag(value) OVER (PARTITION BY path ORDER BY ts_ms, line_no) AS b, unnest(list_filter(list_transform(range(0, 14), lambda i: (ts_ms // 300000 + i) * 300000), lambda x: x >= ts_ms AND x - {HOUR} < ts_ms)) AS t FROM sm)) GROUP BY path, t""", SAMPLES))  # fmt: skip
def _(spark, d):
    return R.increases(_samples(spark, d), ["path"], 5 * MINUTE, HOUR)


# fixed values: names, holds and severities of the sample alert rules; thresholds and ranges for sparse traffic
RULES = [
    {"name": "HighCriticalAlertRate", "expression": ("rate", "critical_alerts", 6 * HOUR), "comparison": ">", "threshold": 0.0005, "hold_ms": HOUR, "severity": "critical", "summary": "High rate of critical alerts detected: {{value}}"},
    {"name": "ProcessingLatencyHigh", "expression": ("quantile", 0.95, "seconds_bucket", 6 * HOUR), "comparison": ">", "threshold": 1.5, "hold_ms": 2 * HOUR, "severity": "critical", "summary": "95 of 100 requests take up to {{value}} s"},
    {"name": "ProcessingThroughputLow", "expression": ("rate", "requests", 6 * HOUR), "comparison": "<", "threshold": 0.0005, "hold_ms": HOUR, "severity": "warning", "summary": "Log processing throughput is low"},
    {"name": "ErrorRateHigh", "expression": ("*", ("/", ("rate", "errors", 6 * HOUR), ("rate", "requests", 6 * HOUR)), 100), "comparison": ">", "threshold": 25, "hold_ms": 2 * HOUR, "severity": "warning", "summary": "Error rate is {{value}} percent"},
    {"name": "DynamicLearningStagnant", "expression": ("rate", "requests", 24 * HOUR), "comparison": "<", "threshold": 0.003, "hold_ms": 3 * HOUR, "severity": "warning", "summary": "Dynamic learning engine appears stagnant"},
    {"name": "HighVolumeAttackSource", "expression": ("sources", "alerts", 24 * HOUR, 0.00002), "comparison": ">", "threshold": 10, "hold_ms": HOUR, "severity": "info", "summary": "{{value}} sources attack"},
]
LES = (0.1, 0.25, 0.5, 1.0, 2.5)


def _increments(spark, d):
    log, found = Q.log(spark, d), Q.alerts(spark, d)
    one = F.lit(1.0).alias("value")
    of = lambda name, rows, label: rows.select(F.lit(name).alias("metric"), F.col(label).alias("label"), "ts_ms", one)
    les = F.array(*[F.when(F.col("request_time_s") <= b, f"{b:g}") for b in LES], F.lit("+Inf"))
    buckets = log.select("ts_ms", F.explode(F.array_compact(les)).alias("le"))
    alerts = found.select("ts_ms", "ip", F.explode(F.array_compact(F.array(F.lit("alerts"), F.when(F.col("action") == "BLOCK", "critical_alerts")))).alias("metric")).select("metric", F.col("ip").alias("label"), "ts_ms", one)
    parts = [of("requests", log, "path"), of("errors", log.where("status >= 400"), "path"), of("seconds_bucket", buckets, "le"), alerts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _runs(name: str, severity: str, hold: int, value: str, test: str, text: str) -> str:
    """A rule from values at each time (rv: at_ms and one column for each figure)."""
    summary = "concat('" + text.replace("{{value}}", "', printf('%.2f', round(arg_max(v, at_ms), 9)), '") + "')" if "{{value}}" in text else f"'{text}'"
    return f"""SELECT '{name}' AS name, '{severity}' AS severity, min(at_ms) AS since_ms, max(at_ms) AS until_ms, round(arg_max(v, at_ms) + 1e-9, 6) AS value, {summary} AS summary
      FROM (SELECT at_ms, v, at_ms - {HOUR} * row_number() OVER (ORDER BY at_ms) AS run FROM (SELECT at_ms, {value} AS v FROM rv) WHERE v {test}) GROUP BY run HAVING max(at_ms) - min(at_ms) >= {hold}"""


_IN = "SELECT at_ms, {} FROM gr LEFT JOIN {} x ON x.ts_ms <= at_ms AND x.ts_ms > at_ms - {} GROUP BY at_ms"
_CUMULATIVE = ", ".join(f"count(*) FILTER (request_time_s <= {b}) AS b{i}" for i, b in enumerate(LES))
_BANDS = " ".join(f"WHEN b{i} >= 0.95 * n6 AND b{i} > 0 THEN {LES[i - 1] if i else 0.0} + ({b} - {LES[i - 1] if i else 0.0}) * (0.95 * n6 - {f'b{i - 1}' if i else 0}) / (b{i} - {f'b{i - 1}' if i else 0})" for i, b in enumerate(LES))
RULE_VALUES = f"""gr AS (SELECT unnest(range(CAST(ceil((SELECT min(ts_ms) FROM al) / {HOUR}) * {HOUR} AS BIGINT), CAST(ceil((SELECT max(ts_ms) FROM al) / {HOUR}) * {HOUR} AS BIGINT) + 1, {HOUR})) AS at_ms),
  v6 AS ({_IN.format("count(x.ts_ms) AS n6, count(*) FILTER (x.status >= 400) AS e6, " + _CUMULATIVE, 'al', 6 * HOUR)}),
  v24 AS ({_IN.format('count(x.ts_ms) AS n24', 'al', 24 * HOUR)}),
  c6 AS ({_IN.format('count(x.ts_ms) AS c6', "(SELECT * FROM alerts WHERE action = 'BLOCK')", 6 * HOUR)}),
  s24 AS (SELECT at_ms, count(*) FILTER (k / 86400.0 > 0.00002) AS s24 FROM (SELECT at_ms, ip, count(x.ts_ms) AS k FROM gr LEFT JOIN alerts x ON x.ts_ms <= at_ms AND x.ts_ms > at_ms - {24 * HOUR} GROUP BY at_ms, ip) GROUP BY at_ms),
  rv AS (SELECT * FROM v6 JOIN v24 USING (at_ms) JOIN c6 USING (at_ms) JOIN s24 USING (at_ms))"""
_RULE_SQL = [
    _runs("HighCriticalAlertRate", "critical", HOUR, "c6 / 21600.0", "> 0.0005", "High rate of critical alerts detected: {{value}}"),
    _runs("ProcessingLatencyHigh", "critical", 2 * HOUR, f"CASE WHEN n6 = 0 THEN NULL {_BANDS} ELSE {LES[-1]} END", "> 1.5", "95 of 100 requests take up to {{value}} s"),
    _runs("ProcessingThroughputLow", "warning", HOUR, "n6 / 21600.0", "< 0.0005", "Log processing throughput is low"),
    _runs("ErrorRateHigh", "warning", 2 * HOUR, "CASE WHEN n6 > 0 THEN e6 / n6 * 100 END", "> 25", "Error rate is {{value}} percent"),
    _runs("DynamicLearningStagnant", "warning", 3 * HOUR, "n24 / 86400.0", "< 0.003", "Dynamic learning engine appears stagnant"),
    _runs("HighVolumeAttackSource", "info", HOUR, "CAST(s24 AS DOUBLE)", "> 10", "{{value}} sources attack"),
]


@query("rule_table", f"{ALERTS}, {RULE_VALUES} " + " UNION ALL ".join(_RULE_SQL))
def _(spark, d):
    # the rules read them several times, and alerts cost most
    return R.rule_alerts(stored(_increments(spark, d)), RULES, HOUR).withColumn("value", F.round(F.col("value") + 1e-9, 6))


_MOVES = """mv AS (SELECT path, line_no, ts_ms, r, lag(p) OVER (PARTITION BY path ORDER BY ts_ms, line_no) AS old_threshold, p AS new_threshold
  FROM (SELECT path, line_no, ts_ms, row_number() OVER (PARTITION BY path ORDER BY ts_ms, line_no) AS r, quantile_cont(request_time_s, 0.95) OVER (PARTITION BY path ORDER BY ts_ms, line_no ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS p FROM al))"""


@query("threshold_moves", with_log("""SELECT path, line_no, round(old_threshold + 1e-9, 6) AS old_threshold, round(new_threshold + 1e-9, 6) AS new_threshold, CASE WHEN old_threshold = 0 THEN TRUE ELSE abs(new_threshold - old_threshold) / abs(old_threshold) * 100 <= 50.0 END AS accepted
  FROM mv WHERE r >= 30 AND abs(new_threshold - old_threshold) > 0.01 * greatest(abs(old_threshold), 1.0)""", _MOVES))  # fmt: skip
def _(spark, d):
    moves = D.sample_audit(Q.log(spark, d).withColumn("value", F.col("request_time_s")), "path")
    return moves.select("path", "line_no", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("old_threshold", "new_threshold")], "accepted")


@query("sketch_errors", with_log("SELECT ip AS id, count(*) AS n, TRUE AS paths_ok, TRUE AS agents_ok, TRUE AS p95_ok FROM al GROUP BY ip"))
def _(spark, d):
    """Sketches of thirds of the log, merged, against exact figures: counts within 5 % or 1, the rank of p95 within 2 %."""
    log = Q.log(spark, d)
    merged = S.sketched(S.merge_sketches(*[S.sketches(log.where(f"line_no % 3 = {i}"), "ip", "ip") for i in range(3)]))
    exact = log.groupBy("ip").agg(F.countDistinct("path").alias("p"), F.countDistinct("user_agent").alias("a"))
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= F.greatest(F.lit(1.0), 0.05 * F.col(y))
    both = log.select("ip", "request_time_s").join(merged.withColumnRenamed("id", "ip"), "ip").groupBy("ip", "n", "paths", "agents").agg(F.avg((F.col("request_time_s") <= F.col("p95")).cast("double")).alias("upto"), F.avg((F.col("request_time_s") < F.col("p95")).cast("double")).alias("below"))
    return both.join(exact, "ip").select(F.col("ip").alias("id"), "n", near("paths", "p").alias("paths_ok"), near("agents", "a").alias("agents_ok"), ((F.col("upto") >= 0.93) & (F.col("below") <= 0.97)).alias("p95_ok"))


#: Every request that was not answered well names its address, for a minute, an hour, a day or ten days.
NAMED = "mp AS (SELECT ip, concat('host', line_no % 100) AS name, ts_ms AS cached_ms, ts_ms + CASE line_no % 4 WHEN 0 THEN 60000 WHEN 1 THEN 3600000 WHEN 2 THEN 86400000 ELSE 864000000 END AS expires_ms FROM al WHERE status <> 200)"


@query("dns_interval", with_log("SELECT line_no, name FROM (SELECT a.line_no, m.name, row_number() OVER (PARTITION BY a.line_no ORDER BY m.cached_ms DESC NULLS LAST, m.name DESC) AS r FROM al a LEFT JOIN mp m ON m.ip = a.ip AND m.cached_ms <= a.ts_ms AND a.ts_ms <= m.expires_ms) WHERE r = 1", NAMED))
def _(spark, d):
    rows, c = Q.log(spark, d), F.col("line_no")
    life = F.when(c % 4 == 0, 60_000).when(c % 4 == 1, 3_600_000).when(c % 4 == 2, 86_400_000).otherwise(864_000_000)
    names = rows.where("status <> 200").select("ip", F.concat(F.lit("host"), (c % 100).cast("string")).alias("name"), F.col("ts_ms").alias("cached_ms"), (F.col("ts_ms") + life).alias("expires_ms"))
    return J.valid_interval(rows, names).select("line_no", "name")


def _slow_tree(rows):
    slow = F.col("ip_time_z") >= 0.9
    return rows.select("line_no", F.when(slow, 0.9).otherwise(0.1).alias("score"), F.when(slow, "slow answers").alias("factors"))


@query("forest_score", f"WITH {more.VECTORS} SELECT line_no, round((CASE WHEN ua_bad >= 0.5 THEN 1.0 WHEN ip_bytes_z >= 0.9 THEN 0.9 ELSE 0.1 END + CASE WHEN ip_time_z >= 0.9 THEN 0.9 ELSE 0.1 END) / 2, 6)::DOUBLE AS score, nullif(concat_ws(', ', CASE WHEN ua_bad >= 0.5 THEN 'known bad user agent' WHEN ip_bytes_z >= 0.9 THEN 'large answers' END, CASE WHEN ip_time_z >= 0.9 THEN 'slow answers' END), '') AS factors FROM fv")
def _(spark, d):
    return I.forest_score(more._features(spark, d), [I.tree_score, _slow_tree]).withColumn("score", F.round("score", 6))
